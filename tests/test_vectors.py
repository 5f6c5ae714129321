"""The inverted file against comparing everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import resolve, vectors

KIND = "id long, kind string, vec array<double>"


def rows(n, seed=0, width=12, centres=20):
    """Clustered vectors, a third of them equal; awkward ones at the end."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    out = [(k, "ab"[k % 2], (middle[k % centres] + 0.4 * rng.normal(size=width)).tolist()) for k in range(n)]
    out += [(n + k, "a", out[0][2]) for k in range(n // 2)]
    return out + [(9000, "a", None), (9001, "a", [0.0] * width), (9002, None, out[1][2]), (9003, "b", [1.0]), (9004, "b", [None] * width), (9005, "b", [float("nan")] * width)]


def brute(asked, table, most, threshold):
    width = len(table[0][2])
    fine = lambda r: r[1] is not None and r[2] is not None and len(r[2]) == width and not any(x is None or x != x for x in r[2])
    out = set()
    for i, kind, v, banned in asked:
        if fine((i, kind, v)):
            near = [(-round(float(vectors.units([v])[0] @ vectors.units([w])[0]), 9), j) for j, other, w in filter(fine, table) if other == kind and j not in (banned or [])]
            out |= {(i, j, -s) for s, j in sorted(x for x in near if -x[0] >= threshold)[:most]}
    return out


@pytest.mark.parametrize(("most", "threshold"), [(1, 0.85), (1, -1.0), (4, 0.6)])
def test_probing_all_that_may_hold_a_hit_loses_nothing(spark, most, threshold, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    table = rows(240)
    asked = [(k, kind, v, [k] if k % 3 else None) for k, kind, v in table if k % 5 == 0 or k > 8000]
    index = vectors.VectorIndex(spark.createDataFrame(table, KIND).repartition(4), cells=9)
    got = index.nearest(spark.createDataFrame(asked, f"{KIND}, banned array<long>").repartition(3), most, threshold).collect()
    assert {(r["id"], r["near"], round(r["score"], 9)) for r in got} == brute(asked, table, most, threshold)


def test_few_probes_find_most(spark):
    table = rows(900, seed=3, centres=30)
    df = spark.createDataFrame(table, KIND)
    index = vectors.VectorIndex(df)
    asked = df.where("id % 20 = 0").withColumn("banned", F.array("id"))
    found, exact = index.nearest(asked, 3, probes=6), index.nearest(asked, 3)
    assert len(index.centres) > 20 and vectors.recall(found, exact).first()["recall"] >= 0.9


def test_empty_sides(spark):
    none = spark.createDataFrame([], KIND)
    some = spark.createDataFrame(rows(10), KIND)
    assert vectors.VectorIndex(none).nearest(some).count() == 0 and vectors.VectorIndex(some).nearest(none).count() == 0
    assert tuple(vectors.recall(*[none.select("id", F.col("id").alias("near"))] * 2).first()) == (0, 0.0)


def test_probes_grow_until_nine_in_ten_are_found(spark):
    """Vectors without clusters lie in ever more cells; a fixed number of probes finds few of them."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, "a", rng.normal(size=24).tolist()) for k in range(3000)], KIND)
    index = vectors.VectorIndex(df)
    asked = df.where("id % 20 = 0").withColumn("banned", F.array("id"))
    exact = index.nearest(asked, 3)
    assert vectors.recall(index.nearest(asked, 3, probes=12), exact).first()["recall"] < 0.9
    assert vectors.recall(index.nearest(asked, 3, probes=index.probes(3, 0.95)), exact).first()["recall"] >= 0.9
    assert vectors.VectorIndex(df.limit(0)).probes(3, 0.95) == 1


def test_equal_vectors_tie_by_id_in_every_product(spark):
    """Copies in different blocks and places: the comparison with all rows and the index name the same ones."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 64))
    df = spark.createDataFrame([(k, base[k % 40].tolist()) for k in range(1200)], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["near"]) for r in resolve.nearest(df.where("vec_id % 20 = 0"), df, 3, rows=37).collect()}
    assert got == {(q, n) for q in range(0, 1200, 20) for n in [k for k in range(q % 40, 1200, 40) if k != q][:3]}
