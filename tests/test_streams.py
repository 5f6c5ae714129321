"""Streams into the store, and sessions with late events."""

import datetime as dt
import random

from kinweave import schemas
from kinweave.sources.tables import GraphTables
from kinweave.operators import graph
from kinweave.streaming.ingest import apply_facts_by_edge, apply_facts_stream, late_rows, sessions

DAY = dt.datetime(2024, 1, 1)


def run(stream, sink, checkpoint):
    q = stream.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination()


def seen(store, name):
    return sorted(repr(r) for r in store.read(name).collect())


def test_batches_that_come_again_change_nothing(spark, tmp_path):
    store = GraphTables(spark, str(tmp_path / "store"))
    store.migrate()
    put = store.create_sink("mentions", "one")
    first = spark.createDataFrame([("d1", "Ann"), ("d1", "Ann"), ("d2", "Bob")], "source_id string, surface_form string")
    put(first, 0)
    before = seen(store, "mentions")
    assert len(before) == 3 and len({r["id"] for r in store.read("mentions").collect()}) == 3
    put(first, 0)
    assert seen(store, "mentions") == before
    import shutil

    shutil.rmtree(tmp_path / "store/_streams/one/mentions-0/done")  # as if the writer had died before it could say so
    put(first, 0)
    assert seen(store, "mentions") == before and store.log("mentions").count() == 6
    put(first, 1)
    assert len(seen(store, "mentions")) == 6

    change = store.change_sink("mentions", "two", ["status"])
    one = store.read("mentions").first()["id"]
    change(spark.createDataFrame([(one, "confirmed")], "id string, status string"), 0)
    store.set_mention_status(spark.createDataFrame([(one, "rejected")], "id string, status string"))
    shutil.rmtree(tmp_path / "store/_streams/two/mentions-0/done")
    change(spark.createDataFrame([(one, "confirmed")], "id string, status string"), 0)
    assert store.get("mentions", one).first()["status"] == "rejected"  # what came later stays


def test_folded_edges_go_into_the_store(spark, tmp_path):
    store = GraphTables(spark, str(tmp_path / "store"))
    store.migrate()
    policies = spark.createDataFrame([("lives", "exclusive_per_source")], schemas.POLICY)
    source = str(tmp_path / "in")
    for k, facts in enumerate(([("s", "x", "lives", DAY, ["m1"], 1)], [("s", "x", "lives", DAY, ["m2"], 2), ("s", "y", "lives", DAY + dt.timedelta(1), ["m3"], 3)])):
        spark.createDataFrame(facts, schemas.FACT).coalesce(1).write.mode("append").parquet(source)
        run(apply_facts_stream(spark.readStream.schema(schemas.FACT).parquet(source), policies), store.edge_sink("facts"), tmp_path / "c")
        if k == 0:
            recorded = store.read("edges").first()["recorded_at"]
    edges = {r["target_entity_id"]: r for r in store.read("edges").collect()}
    assert edges["x"]["invalid_at"] == DAY + dt.timedelta(1) and edges["x"]["support"] == ["m1", "m2"] and edges["x"]["recorded_at"] == recorded
    assert edges["y"]["invalid_at"] is None and len(edges) == 2


def test_sessions_on_a_stream_count_what_is_late(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "user_id int, ts timestamp"
    at = lambda user, minutes: (user, DAY + dt.timedelta(minutes=minutes))
    parts = [[at(1, 0), at(1, 20), at(2, 5), (3, None)], [at(1, 45), at(9, 600)], [at(1, 10), at(2, 30), at(9, 605)], [at(9, 1200)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = sessions(spark.readStream.schema(schema).parquet(source), "30 minutes", "60 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        late = late_rows(q)
        if rows is parts[2]:
            assert late == 2  # users 1 and 2 after the watermark of 540 minutes
    got = {(r["user_id"], r["starts"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, DAY, 3), (2, DAY + dt.timedelta(minutes=5), 1), (9, DAY + dt.timedelta(minutes=600), 2)}
    every = spark.createDataFrame([r for p in parts for r in p], schema)
    assert {(r["user_id"], r["starts"], r["n"]) for r in sessions(every).collect()} == {(1, DAY, 4), (2, DAY + dt.timedelta(minutes=5), 2), (9, DAY + dt.timedelta(minutes=600), 2), (9, DAY + dt.timedelta(minutes=1200), 1)}


def test_state_by_edge_agrees_with_the_batch_fold(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(f"s{rnd.randrange(3)}", rnd.choice(["x", "y", "z", None]), rnd.choice(["lives", "knows"]), DAY + dt.timedelta(rnd.randrange(12)), [f"m{rnd.randrange(9)}"], k) for k in range(90)]
    policies = spark.createDataFrame([("lives", "exclusive_per_source")], schemas.POLICY)
    source, name = str(tmp_path / "in"), "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        newest: dict = {}
        for k in range(3):
            spark.createDataFrame(rows[30 * k : 30 * k + 30], schemas.FACT).coalesce(1).write.mode("append").parquet(source)
            stream = apply_facts_by_edge(spark.readStream.schema(schemas.FACT).parquet(source), policies)
            run(stream, lambda batch, _: newest.update({r["id"]: r for r in batch.collect()}), tmp_path / "c")
        state = spark.read.format("statestore").option("stateVarName", "live").load(str(tmp_path / "c"))
        live = state.count()
    finally:
        spark.conf.unset(name)
    shape = lambda r: (r["id"], r["source_entity_id"], r["target_entity_id"], r["predicate"], r["valid_at"], r["invalid_at"], tuple(r["support"]))
    want = set(map(shape, graph.apply_facts(spark.createDataFrame(rows, schemas.FACT), policies).collect()))
    assert set(map(shape, newest.values())) == want
    assert live == sum(r[5] is None for r in want)  # nothing is kept of closed edges
