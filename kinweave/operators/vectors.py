"""An inverted file over vectors: coarse cells, probed cell by cell, with exact cosines for what lies in them.

Cells are fitted on a bounded sample of the vectors (``FIT_ROWS``, by hash of their ids); every vector is then assigned to
the nearest cell and dealt into blocks of about ``BLOCK`` rows by (kind, cell), so a cell with any share of the rows is many
blocks. Queries go to the cells that they probe and are dealt into blocks likewise; blocks of one cell meet in a
matrix product, of which only the best rows go on.

A cell whose nearest possible member is too far from a query (angle to its centre less the cell's radius) is never probed.
With ``probes=None`` all others are, which loses nothing; else the ``probes`` nearest of them, which may miss some:
``recall`` tells how many. The more cells there are and the less the vectors cluster, the more have to be probed;
``VectorIndex.probes`` finds how many on a bounded sample of the rows (``TRIED``), compared with all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.sources.shared import cut

FIT_ROWS = 20_000
MOST_CELLS = 1024
BLOCK = 1024
#: Rows that the number of probes is tried on.
TRIED = 512
#: Decimals of a cosine that count, so that equal vectors tie wherever they stand in a product.
DECIMALS = 12


def units(vectors) -> np.ndarray:
    """Rows of length 1; those without a length stay 0, so that their cosine with anything is 0."""
    v = np.array([np.asarray(x, dtype=np.float64) for x in vectors])
    return v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1)


def _fit(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres by k-means on the sphere, from rows of the sample that are spread over it."""
    if not len(sample):
        return sample
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1, 1))


def _packed(rows: DataFrame, value: list[str], name: str) -> DataFrame:
    """(kind, cell, name): rows of a cell in blocks of about ``BLOCK``."""
    sizes = rows.groupBy("kind", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = rows.join(sizes, ["kind", "cell"]).withColumn("block", F.pmod(F.xxhash64(value[0]), F.col("blocks")))
    return dealt.groupBy("kind", "cell", "block").agg(F.collect_list(F.struct(*value)).alias(name)).drop("block")  # a block is bounded


class VectorIndex:
    """Over ``vectors`` (id, kind, vec); rows without a kind, or whose vector is null, holds nulls or is of another length than most, are left out."""

    def __init__(self, vectors: DataFrame, cells: int | None = None, fit_rows: int = FIT_ROWS):
        fine = F.col("vec").isNotNull() & F.col("kind").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))
        rows = vectors.select("id", "kind", F.col("vec").cast("array<double>").alias("vec")).where(fine)
        n = rows.count()
        sample = [r["vec"] for r in rows.select("vec", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(fit_rows).collect()]
        self.width = int(pd.Series([len(v) for v in sample]).mode()[0]) if sample else 0
        sample = units([v for v in sample if len(v) == self.width]) if sample else np.zeros((0, 0))
        centres = self.centres = _fit(sample, cells or min(MOST_CELLS, max(1, math.isqrt(n))))
        self.id_type = dict(rows.dtypes)["id"]
        if not len(centres):
            self.radii, self.blocks = np.zeros(0), None
            return

        def assign(batches):
            for pdf in filter(len, batches):
                x = units(pdf["vec"])
                angle = _angles(x, centres)
                cell = angle.argmin(axis=1)
                far = np.where(np.abs(x).sum(axis=1) > 0, angle[np.arange(len(x)), cell], np.pi)  # no length: near to nothing, never excluded
                yield pdf.assign(cell=cell, angle=far)

        members = cut(rows.where(F.size("vec") == self.width).mapInPandas(assign, f"id {self.id_type}, kind string, vec array<double>, cell int, angle double"))
        radii = {r["cell"]: r["radius"] for r in members.groupBy("cell").agg(F.max("angle").alias("radius")).collect()}  # a row for each cell
        self.radii = np.array([radii.get(k, -np.inf) for k in range(len(centres))])
        self.blocks, self.cells = cut(_packed(members, ["id", "vec"], "y")), members.select("id", "cell")
        self.tried = members.select("id", "kind", "vec", F.array("id").alias("banned")).orderBy(F.xxhash64("id", F.lit("tried")), "id").limit(TRIED)

    def probes(self, most: int, share: float) -> int:
        """How many cells to probe for ``share`` of the ``most`` nearest rows to be found, by a sample of the rows, each of which is left out of its own hits."""
        if self.blocks is None:
            return 1
        asked = cut(self.tried)
        hits = self.nearest(asked, most).select(F.col("id").alias("q"), F.col("near").alias("id")).join(self.cells, "id").select("q", "cell").toPandas()  # ``most`` a row tried
        vecs = {r["id"]: r["vec"] for r in asked.select("id", "vec").collect()}
        if not len(hits):
            return len(self.centres)
        order = np.argsort(_angles(units([vecs[q] for q in hits["q"]]), self.centres), axis=1, kind="stable")
        rank = np.sort((order == hits["cell"].to_numpy()[:, None]).argmax(axis=1))
        return int(rank[min(len(rank), math.ceil(share * len(rank))) - 1]) + 1

    def nearest(self, asked: DataFrame, most: int = 1, threshold: float = -1.0, probes: int | None = None) -> DataFrame:
        """(id, near, score): of each of ``asked`` (id, kind, vec and, if some are to be passed over, banned: array of ids) the ``most``
        rows of its kind with the largest cosines of at least ``threshold``, ties by id."""
        spark = asked.sparkSession
        kind = f"id {dict(asked.dtypes)['id']}, near {self.id_type}, score double"
        if self.blocks is None:
            return spark.createDataFrame([], kind)
        banned = F.col("banned") if "banned" in asked.columns else F.array()
        fine = F.col("vec").isNotNull() & F.col("kind").isNotNull() & (F.size("vec") == self.width) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))
        use = asked.where(fine).select("id", "kind", F.col("vec").cast("array<double>").alias("vec"), F.coalesce(banned, F.array()).cast(f"array<{self.id_type}>").alias("banned"))
        centres, radii, reach = self.centres, self.radii, math.acos(max(-1.0, min(1.0, threshold))) + 1e-9

        def probe(batches):
            for pdf in filter(len, batches):
                x = units(pdf["vec"])
                angle = np.where(np.abs(x).sum(axis=1, keepdims=True) > 0, _angles(x, centres), 0)
                may = angle - radii[None, :] <= reach
                if probes is not None and probes < len(centres):
                    order = np.argsort(np.where(may, angle, np.inf), axis=1, kind="stable")[:, probes:]
                    np.put_along_axis(may, order, False, axis=1)
                q, cell = np.nonzero(may)
                if len(q):
                    yield pd.DataFrame({c: pdf[c].to_numpy(dtype=object)[q] for c in pdf.columns}).assign(cell=cell)

        def product(batches):
            for pdf in batches:
                for left, right in zip(pdf["x"], pdf["y"], strict=True):
                    right = sorted(right, key=lambda r: r["id"])
                    ids, near = [r["id"] for r in left], [r["id"] for r in right]
                    score = np.round(units([r["vec"] for r in left]) @ units([r["vec"] for r in right]).T, DECIMALS)
                    score[score < threshold] = -np.inf
                    at = {i: k for k, i in enumerate(near)}
                    for k, r in enumerate(left):
                        score[k, [at[b] for b in r["banned"] if b in at]] = -np.inf
                    top = np.argsort(-score, axis=1, kind="stable")[:, :most]  # ids ascend, so ties are in order
                    best = np.take_along_axis(score, top, 1)
                    q, j = np.nonzero(np.isfinite(best))
                    if not len(q):
                        continue
                    yield pd.DataFrame({"id": [ids[k] for k in q], "near": [near[k] for k in top[q, j]], "score": best[q, j]})

        probed = cut(use.mapInPandas(probe, f"id {dict(asked.dtypes)['id']}, kind string, vec array<double>, banned array<{self.id_type}>, cell int"))
        pairs = _packed(probed, ["id", "vec", "banned"], "x").join(self.blocks, ["kind", "cell"]).select("x", "y")
        found = pairs.mapInPandas(product, kind)
        if most == 1:
            best = found.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("less"), "near")).alias("b"))
            return best.select("id", F.col("b.near").alias("near"), (-F.col("b.less")).alias("score"))
        ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "near")))  # ``most`` rows a block
        return ranked.where(F.col("k") <= most).drop("k")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the pairs (id, near) of ``exact``, and the share of them in ``found``."""
    hits = exact.select("id", "near").join(found.select("id", "near").withColumn("hit", F.lit(1)), ["id", "near"], "left")
    return hits.agg(F.count("*").alias("pairs"), (F.count("hit") / F.greatest(F.lit(1), F.count("*"))).alias("recall"))
