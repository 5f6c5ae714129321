"""Planners, tables, parsing and streams."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.functions import dates
from kinweave.functions.dates import DateOptions, extract_dates
from kinweave.operators import extract, graph, resolve
from kinweave.schemas import EDGE, FACT
from kinweave.sources.tables import GraphTables
from kinweave.streaming.ingest import apply_facts_stream, latest_state

DAY = dt.datetime(2025, 1, 1)


def edge(id_, target, valid=None, invalid=None, expired=None, support=("m1",)):
    return (id_, "s", target, "lives", valid, invalid, DAY, expired, list(support))


@pytest.mark.parametrize(
    ("edges", "target", "valid", "action", "closed"),
    [
        ([edge("a", "x", DAY)], "x", DAY, "refresh", []),
        ([edge("a", "x", DAY)], "y", DAY, "insert", ["a"]),
        ([edge("a", "x", DAY)], "y", DAY - dt.timedelta(1), "insert", []),
        ([edge("a", "x", None)], "y", DAY - dt.timedelta(9), "insert", ["a"]),
        ([edge("a", "x", DAY, invalid=DAY)], "x", DAY, "insert", []),
        ([edge("a", "x", DAY, expired=DAY)], "x", DAY, "insert", []),
        ([edge("a", "x", DAY + dt.timedelta(900))], "y", None, "insert", []),
    ],
)
def test_upsert_plan(spark, edges, target, valid, action, closed):
    facts = spark.createDataFrame([("s", target, "lives", valid, ["m"], 1)], FACT)
    policies = spark.createDataFrame([("lives", "exclusive_per_source")], "predicate string, cardinality string")
    got = graph.plan_edge_upserts(facts, policies, spark.createDataFrame(edges, EDGE), F.lit(dt.datetime(2026, 1, 1))).first()
    assert got["action"] == action and [i["edge_id"] for i in got["invalidations"]] == closed


def test_support_removal_keeps_order_and_repeats(spark):
    edges = spark.createDataFrame([edge("a", "x", support=["m3", "m1", "m3", "m2"]), edge("b", "x", support=["m1"]), edge("c", "x", support=["m9"]), edge("d", "x", expired=DAY)], EDGE)
    removed = spark.createDataFrame([("m1",)], "mention_id string")
    got = {r["edge_id"]: (r["remaining_support"], r["orphaned"]) for r in graph.plan_support_removal(edges, removed).collect()}
    assert got == {"a": (["m3", "m3", "m2"], False), "b": ([], True)}


def test_tables(spark, tmp_path):
    store = GraphTables(spark, str(tmp_path))
    store.migrate()
    made = store.create_entities(spark.createDataFrame([("person", "Ann", ["A"])], "kind string, label string, aliases array<string>"))
    id_ = made.first()["id"]
    for _ in range(2):
        store.add_aliases(spark.createDataFrame([(id_, "Annie")], "id string, alias string"))
    assert store.get("entities", id_).first()["aliases"] == ["A", "Annie"]
    store.append("mentions", spark.createDataFrame([("m", "d", "person", "Ann", 0, 3, "Ann", id_, "pending", 0.9, DAY)], "id string, source_id string, kind string, surface_form string, span_start int, span_end int, candidate_label string, entity_id string, status string, confidence double, created_at timestamp"))
    store.set_mention_status(spark.createDataFrame([("m", "confirmed")], "id string, status string"))
    assert store.list("mentions", status="confirmed").first()["entity_id"] == id_
    store.set_mention_status(spark.createDataFrame([("m", "rejected", None)], "id string, status string, entity_id string"))
    assert store.get("mentions", "m").first()["entity_id"] is None
    with pytest.raises(KeyError):
        store.invalidate_edges(spark.createDataFrame([("none", DAY)], "id string, invalid_at timestamp"))
    store.append("edges", spark.createDataFrame([edge("e", "x")], EDGE))
    store.invalidate_edges(spark.createDataFrame([("e", DAY)], "id string, invalid_at timestamp"))
    assert store.current_edges(predicate="lives").count() == 1
    store.set_edge_support(spark.createDataFrame([("e", [])], "id string, support array<string>"))
    assert store.get("edges", "e").first()["support"] == []
    store.expire_edges(spark.createDataFrame([("e", DAY)], "id string, expired_at timestamp"))
    assert store.current_edges().count() == 0


def reply(**kinds):
    return json.dumps({"extraction": kinds})


@pytest.mark.parametrize(
    ("text", "body", "expected"),
    [
        ("Ann met Ann", reply(people=[{"surface_form": "Ann", "span_start": 1, "span_end": 4}] * 3), [("Ann", 0, 3, 0.7), ("Ann", 8, 11, 0.7)]),
        ("🎉 Ann", "```json\n" + reply(people=[{"surface_form": "Ann", "span_start": 3, "span_end": 6.0, "confidence": 2}]) + "\n```", [("Ann", 3, 6, 1.0)]),
        ("aa tea", reply(concepts=[{"surface_form": "tea", "confidence": 0.1}, {"surface_form": "tea", "confidence": 0.9}]), []),
        ("Ann", reply(people=[{"surface_form": "Bob"}, 5, None, {"surface_form": ""}]), []),
        ("Ann", reply(people=[{"surface_form": "Ann", "confidence": "0.95", "span_start": True, "span_end": 3}]), [("Ann", 0, 3, 0.7)]),
        ("x" * 201, reply(people=[{"surface_form": "x" * 201}, {"surface_form": "x" * 200}]), [("x" * 200, 0, 200, 0.7)]),
        ("Ann", '{"extraction": {"people": [{"surface_form": "Ann", "confidence": NaN}]}}', []),
        ("Ann", "no json", []),
        (None, None, []),
    ],
)
def test_parse_reply(text, body, expected):
    assert [(m[1], m[2], m[3], m[6]) for m in extract.parse_reply(body, text, 0.6)] == expected


def test_call_model_survives_failures(spark):
    docs = spark.createDataFrame([("1", "Ann"), ("2", "boom")], "source_id string, text string")
    people = spark.createDataFrame([("p", "Ann", [], 1)], "id string, display_name string, aliases array<string>, ordinal int")
    context = extract.trusted_context("en", known_people=people)
    assert json.loads(context.first()["context"]) == {"content_language": "en", "known_people": [{"id": "p", "display_name": "Ann"}]}

    def model(prompt, context, text):
        if text == "boom":
            raise RuntimeError
        return json.dumps({"extraction": {"people": [{"surface_form": text}]}})

    assert [r["source_id"] for r in extract.mentions(extract.call_model(docs, model, context)).collect()] == ["1"]


DATED = {
    DateOptions(): {
        "due 2026-05-21 ok": [("2026-05-21", "day", 4)], "2024-02-30": [], "the day after tomorrow": [("2026-05-22", "day", 0)], "🎉 ۲۹ خرداد ۱۴۰۵": [("2026-06-19", "day", 3)],
        "last wed, wed": [("2026-05-13", "day", 0), ("2026-05-20", "day", 10)], "۳۰ اسفند ۱۴۰۴": [("2026-02-20", "month", 3)], "2026/3/29": [("2026-03-29", "day", 5)], "": [],
    },
    DateOptions(languages=("fa",), require_weekday_qualifier=True): {"2026-05-21": [], "فردا": [("2026-05-21", "day", 0)], "جمعه": [], "جمعه بعد": [("2026-05-22", "day", 0)]},
}


@pytest.mark.parametrize("options", list(DATED))
def test_dates(spark, options):
    rows = spark.createDataFrame([(x,) for x in DATED[options]], "t string").coalesce(1)
    for r in rows.select("t", extract_dates(F.col("t"), F.lit("2026-05-20").cast("date"), options).alias("m")).collect():
        assert [(str(m["date"]), m["grain"], m["span_start"]) for m in r["m"] or []] == DATED[options][r["t"]]


def test_facts_stream_agrees_with_batch(spark, tmp_path):
    rows = [("s1", t, "lives", DAY + dt.timedelta(k), [f"m{k}"], k) for k, t in enumerate("xyxzx")]
    facts = spark.createDataFrame(rows, FACT)
    policies = spark.createDataFrame([("lives", "exclusive_per_source")], "predicate string, cardinality string")
    facts.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(facts.schema).parquet(str(tmp_path / "in"))
    q = apply_facts_stream(stream, policies).writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    one = {(r["id"], r["invalid_at"], tuple(r["support"])) for r in spark.table("folded").collect()}
    assert one == {(r["id"], r["invalid_at"], tuple(r["support"])) for r in graph.apply_facts(facts, policies).collect()}


def test_latest_state_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, DAY, "view"), (1, DAY + dt.timedelta(1), "buy"), (2, DAY, "view")], "user_id int, ts timestamp, event_type string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = latest_state(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("newest").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {(r["user_id"], r["event_type"]) for r in spark.table("newest").collect()} == {(1, "buy"), (2, "view")}


def test_homonyms_stay_apart(spark, tmp_path):
    store = GraphTables(spark, str(tmp_path))
    store.migrate()
    rows = [("person", "Ann", ["A"]), ("person", "Ann", ["B"]), ("person", "Ann", ["B"])]
    made = store.create_entities(spark.createDataFrame(rows, "kind string, label string, aliases array<string>"))
    got = store.list("entities", label="Ann").collect()
    assert sorted(r["aliases"] for r in got) == [["A"], ["B"], ["B"]] and {r["id"] for r in got} == {r["id"] for r in made.collect()}
    one = store.create_mentions(spark.createDataFrame([("doc", "person", "Ann")], "source_id string, kind string, surface_form string")).first()
    assert (one["status"], one["confidence"], one["entity_id"]) == ("pending", 1.0, None) and one["created_at"] is not None


def test_deleted_documents_lose_their_support(spark, tmp_path):
    store = GraphTables(spark, str(tmp_path))
    store.migrate()
    mentions = [("m1", "d1"), ("m2", "d1"), ("m3", "d2")]
    store.create_mentions(spark.createDataFrame(mentions, "id string, source_id string"))
    store.create_edges(spark.createDataFrame([("e1", ["m1", "m3", "m2"]), ("e2", ["m2"]), ("e3", ["m3"])], "id string, support array<string>"))
    reviews = store.delete_documents(spark.createDataFrame([("d1",)], "source_id string"))
    assert {r["edge_id"]: (r["remaining_support"], r["orphaned"]) for r in reviews.collect()} == {"e1": (["m3"], False), "e2": ([], True)}
    assert {r["id"]: r["support"] for r in store.read("edges").collect()} == {"e1": ["m3"], "e2": [], "e3": ["m3"]}


def test_facts_of_unknown_time_count_from_now(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [("s", "a", "lives", day(1), ["x"], 1), ("s", "b", "lives", None, ["y"], 2), ("s", "b", "lives", day(3), ["y", "z"], 3), ("s", "c", "lives", day(2), None, 4), ("s", "a", "knows", None, ["k"], 5), ("s", "a", "knows", day(2), ["j", "k"], 6)]
    facts = spark.createDataFrame(rows, "source_entity_id string, target_entity_id string, predicate string, valid_at timestamp, support array<string>, ordinal long")
    policies = spark.createDataFrame([("lives", "exclusive_per_source")], "predicate string, cardinality string")
    got = {(r["target_entity_id"], r["predicate"]): (r["valid_at"], r["invalid_at"], r["support"], r["ordinal"]) for r in graph.apply_facts(facts, policies, now=F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got == {
        ("a", "lives"): (day(1), dt.datetime(2024, 2, 1), ["x"], 1), ("b", "lives"): (None, day(2), ["y", "z"], 2), ("c", "lives"): (day(2), None, [], 4), ("a", "knows"): (None, None, ["k", "j"], 5),
    }
    there = graph.apply_facts(facts.where("ordinal < 3"), policies, now=F.lit("2024-02-01").cast("timestamp"))
    more = graph.apply_facts(facts.where("ordinal >= 3"), policies, edges=there).collect()
    assert {(r["target_entity_id"], r["predicate"]): (r["valid_at"], r["invalid_at"], r["support"]) for r in more if r["predicate"] == "lives"} == {k: v[:3] for k, v in got.items() if k[1] == "lives"}


def test_repeated_facts_close_once(spark):
    edges = spark.createDataFrame([("a", "s", "x", "p", None, None, dt.datetime(2024, 1, 1), None, [])], schemas.EDGE)
    fact = ("s", "y", "p", None, ["m"], 1)
    facts = spark.createDataFrame([fact, fact], schemas.FACT)
    plans = graph.plan_edge_upserts(facts, spark.createDataFrame([("p", "exclusive_per_source")], schemas.POLICY), edges, F.lit("2024-02-01").cast("timestamp")).collect()
    assert len(plans) == 2 and all([i["edge_id"] for i in p["invalidations"]] == ["a"] for p in plans)


def test_nearest_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(60)] + [(60, [0.0] * 8), (61, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows[:61]])
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = {}
    for k in range(0, 61, 7):
        order = sorted((j for j in range(61) if j != k), key=lambda j: (-round(float(x[k] @ x[j]), 9), j))
        want[k] = order[:3]
    for rows_a_block in (7, 1024):
        got = {}
        for r in sorted(resolve.nearest(vectors.where("vec_id % 7 = 0"), vectors, 3, rows_a_block).collect(), key=lambda r: (r["vec_id"], -round(r["score"], 9), r["near"])):
            got.setdefault(r["vec_id"], []).append(r["near"])
        assert got == want


def test_a_period_behind_a_month_ends_the_date(spark):
    text = lambda x: spark.range(1).select(dates.extract_dates(F.lit(x), F.lit("2026-05-20").cast("date")).alias("d")).first()["d"]
    for x, surface in (("met on 5 May. Then", "5 May"), ("on 5 May", "5 May"), ("on 5 Dec. 2021 there", "5 Dec. 2021"), ("5 May 2020.", "5 May 2020")):
        found = text(x)
        assert [r["surface_form"] for r in found] == [surface] and found[0]["span_start"] == x.index("5"), x


def test_creates_keep_order_and_repeats(spark, tmp_path):
    store = GraphTables(spark, str(tmp_path))
    store.migrate()
    store.create_edges(spark.createDataFrame([("e", ["b", "a", "b"]), ("f", None)], "id string, support array<string>"))
    store.create_entities(spark.createDataFrame([("n", "person", "Q", ["q", "p", "q"])], "id string, kind string, label string, aliases array<string>"))
    made = store.create_episodes(spark.createDataFrame([("d", ["m1", "m1"])], "source_id string, mention_ids array<string>"))
    assert made.first()["mention_ids"] == ["m1", "m1"] and made.first()["id"] == store.read("episodes").first()["id"]
    assert {r["id"]: r["support"] for r in store.read("edges").collect()} == {"e": ["b", "a", "b"], "f": []}
    store.add_aliases(spark.createDataFrame([("n", "q"), ("n", "r")], "id string, alias string"))
    assert store.read("entities").first()["aliases"] == ["q", "p", "q", "r"]
    store.create_mentions(spark.createDataFrame([("b", "d")], "id string, source_id string"))
    reviews = store.delete_documents(spark.createDataFrame([("d",)], "source_id string")).collect()
    assert [(r["edge_id"], r["remaining_support"], r["orphaned"]) for r in reviews] == [("e", ["a"], False)]


def test_reads_by_id_prune_and_compaction_goes_on(spark, tmp_path):
    store = GraphTables(spark, str(tmp_path / "a"))
    store.migrate()
    store.create_edges(spark.createDataFrame([(f"e{k}", [f"m{k}"]) for k in range(40)], "id string, support array<string>"))
    store.set_edge_support(spark.createDataFrame([("e7", ["x", "x"]), ("e8", [])], "id string, support array<string>"))
    plan = store.get("edges", "e7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "(id,e7)" in plan
    assert store.get("edges", "e7").first()["support"] == ["x", "x"] and store.get("edges", "none").first() is None
    assert {r["id"]: r["support"] for r in store.read_some("edges", spark.createDataFrame([("e8",), ("e9",), ("no",)], "id string")).collect()} == {"e8": [], "e9": ["m9"]}
    assert store.log("edges").count() == 42
    new = GraphTables(spark, str(tmp_path / "b"))
    new.migrate()
    store.compact("edges", str(tmp_path / "b"))
    assert new.log("edges").count() == 40 and sorted(new.read("edges").collect()) == sorted(store.read("edges").collect())
    new.invalidate_edges(spark.createDataFrame([("e7", DAY)], "id string, invalid_at timestamp"))
    edge = new.get("edges", "e7").first()
    assert edge["invalid_at"] == DAY and edge["support"] == ["x", "x"]
    assert [r["id"] for r in new.list("edges").collect()] == sorted((f"e{k}" for k in range(40)))
    assert [r["id"] for r in new.current_edges(id="e7").collect()] == ["e7"]


def test_lists_filter_in_the_scan_and_are_ordered(spark, tmp_path):
    store = GraphTables(spark, str(tmp_path))
    store.migrate()
    day = lambda k: dt.datetime(2026, 1, k)
    rows = [("m3", "d", "person", None, day(1)), ("m1", "d", "place", "e", day(2)), ("m2", "d", "person", "e", day(2)), ("m4", "c", "person", "e", day(1)), ("m5", None, "person", "e", day(1))]
    store.create_mentions(spark.createDataFrame(rows, "id string, source_id string, kind string, entity_id string, created_at timestamp"))
    store.set_mention_status(spark.createDataFrame([("m1", "confirmed"), ("m4", "confirmed")], "id string, status string"))
    ids = lambda **where: [r["id"] for r in store.list("mentions", **where).collect()]
    assert ids() == ["m3", "m4", "m5", "m1", "m2"] and ids(source_id="d") == ["m3", "m1", "m2"]
    assert ids(source_id="d", status="pending") == ["m3", "m2"] and ids(source_id="d", entity_id="e", status="confirmed") == ["m1"]
    assert ids(kind="place") == ["m1"] and ids(source_id="none") == [] and ids(status="none") == []
    plan = store.list("mentions", source_id="d", status="pending")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source_id,d)" in plan and "EqualTo(status" not in plan  # a newer version may have another status
    store.create_episodes(spark.createDataFrame([("p2", "d", day(2), ["m1", "m1"]), ("p1", "d", day(1), None), ("p3", "c", day(1), [])], "id string, source_id string, ingested_at timestamp, mention_ids array<string>"))
    assert [(r["id"], r["mention_ids"]) for r in store.list("episodes", source_id="d").collect()] == [("p1", []), ("p2", ["m1", "m1"])]
    store.create_entities(spark.createDataFrame([("e", "person", "Ann", day(2)), ("f", "place", "Ur", day(1)), ("g", "person", "Bo", day(1))], "id string, kind string, label string, created_at timestamp"))
    assert [r["id"] for r in store.list("entities", kind="person").collect()] == ["g", "e"]
    with pytest.raises(ValueError, match="fixed"):
        store.change_sink("mentions", "s", ["source_id"])
    store.views("kept_")
    joined = spark.sql("SELECT m.id FROM kept_mentions m JOIN kept_entities e ON m.entity_id = e.id WHERE m.source_id = 'd' AND e.kind = 'person' ORDER BY m.id")
    assert [r["id"] for r in joined.collect()] == ["m1", "m2"]
    assert "EqualTo(kind,person)" in joined._jdf.queryExecution().executedPlan().toString()


def test_deletion_compares_no_versions_of_mentions(spark, tmp_path, monkeypatch):
    """Which source a mention has is the same in all its versions, and the edges that are reviewed are known to be there."""
    store = GraphTables(spark, str(tmp_path))
    store.migrate()
    store.create_mentions(spark.createDataFrame([("m1", "d1"), ("m2", "d2")], "id string, source_id string"))
    store.set_mention_status(spark.createDataFrame([("m1", "confirmed")], "id string, status string"))
    store.create_edges(spark.createDataFrame([("e1", ["m1", "m2", "m1"])], "id string, support array<string>"))
    read = []
    monkeypatch.setattr(GraphTables, "read", lambda self, name, f=GraphTables.read: read.append(name) or f(self, name))
    store.delete_documents(spark.createDataFrame([("d1",)], "source_id string"))
    assert read == ["edges"] and [r["support"] for r in store.read("edges").collect()] == [["m2"]]
