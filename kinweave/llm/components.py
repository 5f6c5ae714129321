"""Connected components of an edge table, by contraction in parts and spreading of smallest labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.storage import cut
from kinweave.llm.words import lean

#: Edges that a task contracts at once.
AT_ONCE = 200_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of some edges, and the smallest vertex that each is linked with by them."""
    v, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    p = np.arange(len(v))
    while True:
        px, py = p[x], p[y]
        if (px == py).all():
            return v, v[p]
        np.minimum.at(p, np.maximum(px, py), np.minimum(px, py))
        while (p != p[p]).any():
            p = p[p]


def _contract(batches):
    parts, n = [], 0

    def emit():
        v, root = roots(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(root)], names=["v", "root"])

    for batch in batches:
        parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= AT_ONCE:
            yield emit()
            parts, n = [], 0
    if n:
        yield emit()


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) for every vertex of ``edges`` (a, b): ``comp`` is the smallest vertex that it is linked with.

    Every task first contracts its share of the edges, by their smaller end; vertices with several roots then
    link those, and these few links are spread until nothing changes.
    """
    dealt = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).repartition("a")
    found = dealt.mapInArrow(lean(_contract), "v long, root long").groupBy("v").agg(F.collect_set("root").alias("roots"))  # a root for each task at most
    found = cut(found.select("v", F.array_min("roots").alias("comp"), F.when(F.size("roots") > 1, F.col("roots")).alias("roots")))
    between = found.where("roots is not null").select("comp", F.explode("roots").alias("root")).where("comp != root").select(F.col("comp").alias("a"), F.col("root").alias("b")).distinct()
    between = cut(between)
    if between.isEmpty():
        return found.select("v", "comp")
    return _renamed(found.select("v", "comp"), _spread(between))


def _renamed(comps: DataFrame, found: DataFrame) -> DataFrame:
    new = found.select(F.col("v").alias("comp"), F.col("comp").alias("new"))
    return cut(comps.join(new, "comp", "left").select("v", F.coalesce("new", "comp").alias("comp")))


def _spread(edges: DataFrame) -> DataFrame:
    """Every round takes the smallest label among neighbours and then the label of that label, so long chains
    close in few rounds. Labels stay distributed; the driver sees how many changed.
    """
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = cut(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("comp").alias("near"))
        spread = labels.join(near, "v").select("v", F.least("comp", "near").alias("low"), F.col("comp").alias("old"))
        jump = labels.select(F.col("v").alias("low"), F.col("comp").alias("far"))
        new = cut(spread.join(jump, "low", "left").select("v", F.least("low", F.coalesce("far", "low")).alias("comp"), "old"))
        done = new.where("comp != old").isEmpty()
        labels = new.drop("old")
        if done:
            return labels


def merged(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """``comps`` after further ``edges``; only the components that these join are worked on."""
    of = lambda side: comps.select(F.col("v").alias(side), F.col("comp").alias(f"c{side}"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    found = components(between.where("a != b").distinct())
    more = found.select("v", F.col("v").alias("comp")).join(comps.select("v"), "v", "left_anti")
    return _renamed(comps.select("v", "comp").unionByName(more), found)
