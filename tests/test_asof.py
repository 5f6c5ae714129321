"""Interval joins against a loop over all pairs."""

import datetime as dt
import random

import pytest

from kinweave.operators import asof
from kinweave.operators.asof import as_of_join

START = dt.datetime(2024, 1, 1)


def moment(rnd, empty=0.2):
    return None if rnd.random() < empty else START + dt.timedelta(minutes=rnd.randrange(3000))


@pytest.mark.parametrize(("seed", "levels"), [(1, 12), (2, 1), (3, 5)])
def test_as_of_join(spark, seed, levels):
    rnd = random.Random(seed)
    asked = [(k, rnd.choice(["hot", "a", None]), moment(rnd, 0.05), START + dt.timedelta(minutes=rnd.randrange(3000))) for k in range(80)]
    rows = [(k, rnd.choice(["hot", "a", "b", None]), moment(rnd), moment(rnd, 0.4), START + dt.timedelta(minutes=rnd.randrange(3000)), moment(rnd, 0.5)) for k in range(120)]
    rows += [(200, "a", None, START, START, None), (201, "a", START + dt.timedelta(9), None, START, None), (202, "hot", START, START, START, None)]
    left = spark.createDataFrame(asked, "q long, who string, at timestamp, known timestamp")
    right = spark.createDataFrame(rows, "e long, s string, valid_at timestamp, invalid_at timestamp, recorded_at timestamp, expired_at timestamp")
    true = lambda a, b, t: (a is None or a <= t) and (b is None or b > t)
    met = [(q, e, rec, exp, known) for q, who, at, known in asked for e, s, a, b, rec, exp in rows if who is not None and who == s and at is not None and true(a, b, at)]
    got = as_of_join(left, right, [("who", "s")], "at", known_at="known", levels=levels).select("q", "e").collect()
    assert sorted(map(tuple, got)) == sorted((q, e) for q, e, rec, exp, known in met if rec <= known and (exp is None or exp > known))
    got = as_of_join(left, right, [("who", "s")], "at", levels=levels).select("q", "e").collect()
    assert sorted(map(tuple, got)) == sorted((q, e) for q, e, rec, exp, known in met if exp is None)
    assert as_of_join(left.limit(0), right, [("who", "s")], "at").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        as_of_join(left.withColumnRenamed("who", "S"), right, [("S", "s")], "at")


@pytest.mark.parametrize("broadcast", [0, 50_000])
@pytest.mark.parametrize("few", [0, 20, 1000])
def test_large_and_small_keys(spark, monkeypatch, few, broadcast):
    """Keys by the tree, and keys whose rows are few; only the instants of the former are multiplied."""
    monkeypatch.setattr(asof, "BROADCAST_KEYS", broadcast, raising=False)
    monkeypatch.setattr(asof, "BROADCAST_ROWS", broadcast, raising=False)
    rnd = random.Random(9)
    asked = [(k, rnd.choice(["hot", "a", "b", "c", None]), moment(rnd, 0.05)) for k in range(120)]
    rows = [(k, rnd.choice(["hot", "hot", "hot", "a", "b", "d", None]), moment(rnd), moment(rnd, 0.4)) for k in range(150)]
    left, right = spark.createDataFrame(asked, "q long, who string, at timestamp"), spark.createDataFrame(rows, "e long, s string, valid_at timestamp, invalid_at timestamp")
    want = sorted((q, e) for q, who, at in asked for e, s, a, b in rows if who is not None and who == s and at is not None and (a is None or a <= at) and (b is None or b > at))
    out = as_of_join(left, right, [("who", "s")], "at", few=few)
    assert sorted(map(tuple, out.select("q", "e").collect())) == want
    assert ("Generate explode" in out._jdf.queryExecution().executedPlan().toString()) == (few < 1000)
