"""Facts folded piece by piece against a plain loop over all edges."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import fold, graph
from kinweave.schemas import FACT, POLICY

NOW = dt.datetime(2024, 6, 1)


def plain_fold(facts, there=()):
    """Edges by source as sets of (target, valid_at, invalid_at, support, ordinal); each fact looks at every edge before."""
    edges = [dict(zip(("source", "target", "valid", "invalid", "support", "ordinal"), e, strict=True)) for e in there]
    for source, target, valid, support, ordinal in sorted(facts, key=lambda f: f[4]):
        live = [e for e in edges if e["source"] == source and e["invalid"] is None]
        same = next((e for e in live if e["target"] == target), None)
        if same:
            same["support"] = list(dict.fromkeys([*same["support"], *support]))
            continue
        begins = valid or NOW
        for e in live:
            if e["valid"] is None or e["valid"] <= begins:
                e["invalid"] = begins
        edges.append({"source": source, "target": target, "valid": valid, "invalid": None, "support": list(dict.fromkeys(support)), "ordinal": ordinal})
    return collections.Counter((e["source"], e["target"], e["valid"], e["invalid"], tuple(e["support"]), e["ordinal"]) for e in edges)


def random_facts(seed, n, targets, days, ordered):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        source = rnd.choice(["hot", None, "s1", "s2", "s3", "s4"]) if k % 3 else "hot"
        day = k * days // n + rnd.randrange(3) if ordered else rnd.randrange(days)
        valid = None if rnd.random() < 0.1 else dt.datetime(2024, 1, 1) + dt.timedelta(day)
        out.append((source, rnd.choice(targets), valid, [f"m{rnd.randrange(40)}" for _ in range(rnd.randrange(3))], k))
    return out


def folded(spark, facts, edges=None, piece=fold.PIECE):
    rows = spark.createDataFrame([(s, t, "lives", v, m, k) for s, t, v, m, k in facts], FACT).repartition(3)
    out = graph.apply_facts(rows, spark.createDataFrame([("lives", "exclusive_per_source")], POLICY), now=F.lit(NOW), edges=edges, piece=piece)
    return out


def counted(out):
    return collections.Counter((r["source_entity_id"], r["target_entity_id"], r["valid_at"], r["invalid_at"], tuple(r["support"]), r["ordinal"]) for r in out.collect())


@pytest.mark.parametrize(
    ("n", "targets", "days", "ordered"),
    [(400, ["a", "b", "c", None], 30, False), (400, ["a", "b"], 60, True), (300, ["a"], 20, False), (300, [f"t{k}" for k in range(200)], 400, False)],
)
def test_pieces_agree_with_a_plain_loop(spark, n, targets, days, ordered):
    facts = random_facts(n + days, n, targets, days, ordered)
    assert counted(folded(spark, facts, piece=25)) == plain_fold(facts)


def test_pieces_go_on_from_edges_that_are_there(spark):
    facts = random_facts(1, 240, ["a", "b", "c"], 40, False)
    whole = folded(spark, facts[:120])
    there = [(r["source_entity_id"], r["target_entity_id"], r["valid_at"], r["invalid_at"], r["support"], r["ordinal"]) for r in whole.collect()]
    assert counted(folded(spark, facts[120:], edges=whole, piece=20)) == plain_fold(facts[120:], there)


def test_a_source_that_never_changes_needs_few_rounds(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(fold, "cut", lambda df, cut=fold.cut: calls.append(1) or cut(df))
    facts = [("hot", "home", dt.datetime(2024, 1, 1) + dt.timedelta(k % 7), [f"m{k}"], k) for k in range(600)]
    assert counted(folded(spark, facts, piece=20)) == plain_fold(facts)
    assert len(calls) < 10


def test_small_pieces_make_no_more_tasks(spark, monkeypatch):
    """Pieces bound what is folded at once, not how many tasks read the rows."""
    tasks = []
    monkeypatch.setattr(fold, "cut", lambda df, cut=fold.cut: [out := cut(df), tasks.append(out.rdd.getNumPartitions())][0])
    facts = random_facts(3, 400, ["a", "b", "c"], 60, True)
    assert counted(folded(spark, facts, piece=5)) == plain_fold(facts)
    assert max(tasks) < 30
