"""Running sums within keys against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators.scan import running


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_running(spark, hot):
    rnd = random.Random(4)
    rows = [(7 if rnd.random() < hot else rnd.randrange(20), k, rnd.randrange(-9, 9), rnd.getrandbits(62) * rnd.choice([1, -1])) for k in range(3000)]
    rnd.shuffle(rows)
    got = {r["k"]: (r["run_v"], r["run_x"]) for r in running(spark.createDataFrame(rows, "g long, k long, v long, x long").repartition(5), ["g"], [F.col("k").desc()], adds=["v"], xors=["x"]).collect()}
    state, want = {}, {}
    for g, k, v, x in sorted(rows, key=lambda r: -r[1]):
        a, b = state.get(g, (0, 0))
        state[g] = want[k] = (a + v, b ^ x)
    assert got == want


def test_running_over_two_keys_wraps_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, 1, 0, 2**63 - 1), (1, 1, 1, 5), (1, 2, 0, 3)], "a int, b long, o int, v long")
    assert sorted(r["run_v"] for r in running(df, ["a", "b"], ["o"], adds=["v"], keep=["a", "b", "v"]).collect()) == [-(2**63) + 4, 3, 2**63 - 1]
    assert running(df.where("a = 9"), ["a"], ["o"], adds=["v"]).count() == 0
