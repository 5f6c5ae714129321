"""Vector code compression: product codes whose codebooks are refined by Lloyd rounds with the filtering method.

Vectors become integers floor(scale * x) and are cut into equal consecutive parts; every part position has a codebook
of its own. Every Spark partition deals its vectors into blocks and builds, once, a kd-tree over each block's parts at
every position, with the bounding box, the count and the sums of every node. A round walks down these trees with the
codebook: at a node, entries that are farther than the entry next to the box's middle from every point of the box are
eliminated; where one entry is left, the whole subtree goes to it by its cached count and sums; what remains at the
leaves is compared point by point. Only counts and sums by (position, entry) leave the tasks.

All arithmetic is in 64-bit integers and exact: distances are squared Euclidean, ties go to the lower index (an entry
that is eliminated is farther everywhere, or as far at best and of a higher index), means are floor(sum / count), and
entries without points stay. Components must be below 2^19 in magnitude for that; others raise an error.

Vectors that are null or hold null or non-finite components are dropped, and so are those whose length isn't that of
the kept vector with the smallest id (the first one whose length is a positive multiple of the parts). Ids may repeat:
every row has its code; null ids come last. With fewer vectors than entries the codebook is as short. An empty table
gives an empty table. Other columns stay away; ``label`` may be of any type, null labels count as one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.storage import arrow_rows, cut
from kinweave.llm.words import lean

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors in a block, and points in a leaf at most.
BLOCK, LEAF = 4096, 16
#: Labels whose sums are broadcast; more are joined by shuffling.
BROADCAST_LABELS = 100_000
_LIMIT = 1 << 19


def _spans(n: int) -> list[np.ndarray]:
    """Bounds of the nodes of a tree over ``n`` points, level by level: every node is halved until leaves are small."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max() > LEAF:
        b = levels[-1]
        levels.append(np.sort(np.concatenate([b, (b[:-1] + b[1:]) // 2])))
    return levels


class Tree:
    """A kd-tree over integer points (n, d): ``order`` puts them into leaves, each level has boxes and sums of its nodes."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.levels = _spans(n)
        order = np.arange(n)
        for bounds in self.levels[:-1]:  # halve every node across its widest side
            own = points[order]
            low, high = np.minimum.reduceat(own, bounds[:-1]), np.maximum.reduceat(own, bounds[:-1])
            node = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            side = np.argmax(high - low, axis=1)[node]
            order = order[np.lexsort((own[np.arange(n), side], node))]
        self.order, self.points = order, points[order]
        self.low = [np.minimum.reduceat(self.points, b[:-1]) for b in self.levels]
        self.high = [np.maximum.reduceat(self.points, b[:-1]) for b in self.levels]
        self.sums = [np.add.reduceat(self.points, b[:-1]) for b in self.levels]

    def pack(self) -> bytes:
        narrow = np.int16 if len(self.points) == 0 or np.abs(self.points).max() < 1 << 15 else np.int32
        head = np.array([*self.points.shape, np.dtype(narrow).itemsize], dtype="<i8")
        boxes = [x.astype(narrow) for pair in zip(self.low, self.high, strict=True) for x in pair]
        return b"".join(x.tobytes() for x in (head, *self.sums, self.order.astype(np.uint16), self.points.astype(narrow), *boxes))

    @classmethod
    def unpack(cls, raw: bytes) -> Tree:
        tree, at = cls.__new__(cls), 24
        n, d, width = np.frombuffer(raw, "<i8", 3).tolist()
        narrow = np.int16 if width == 2 else np.int32

        def take(kind, *shape):
            nonlocal at
            out = np.frombuffer(raw, kind, int(np.prod(shape)), at).reshape(shape)
            at += out.nbytes
            return out

        tree.levels = _spans(n)
        tree.sums = [take(np.int64, len(b) - 1, d) for b in tree.levels]
        tree.order = take(np.uint16, n).astype(np.int64)
        tree.points = take(narrow, n, d).astype(np.int64)
        tree.low, tree.high = [], []
        for b in tree.levels:
            tree.low.append(take(narrow, len(b) - 1, d).astype(np.int64))
            tree.high.append(take(narrow, len(b) - 1, d).astype(np.int64))
        return tree

    def filtered(self, book: np.ndarray) -> tuple[list[tuple[int, int, int, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
        """What the codebook gets: (level, node indices, entries) of whole subtrees, and (point indices, entries) of single points."""
        whole, single = [], []
        norms = (book * book).sum(axis=1)
        index = np.arange(len(book))
        nodes, left = np.zeros(1, dtype=np.int64), np.ones((1, len(book)), dtype=bool)
        for level, bounds in enumerate(self.levels):
            low, high = self.low[level][nodes], self.high[level][nodes]
            middle = low + high  # twice the middle; distances from it are doubled alike
            near = np.where(left, 2 * norms - 2 * (middle @ book.T), np.iinfo(np.int64).max).argmin(axis=1)
            ahead = book[None, :, :] - book[near][:, None, :]
            corner = np.where(ahead > 0, high[:, None, :], low[:, None, :])  # of the box, the farthest towards each entry
            farther = norms[None, :] - norms[near][:, None] - 2 * (corner * ahead).sum(axis=2)
            left = left & ((farther < 0) | ((farther == 0) & (index[None, :] < near[:, None])) | (index[None, :] == near[:, None]))
            sure = left.sum(axis=1) == 1
            if sure.any():
                whole.append((level, nodes[sure], near[sure]))
            nodes, left = nodes[~sure], left[~sure]
            if not len(nodes):
                break
            if level + 1 < len(self.levels):
                nodes, left = (2 * nodes[:, None] + np.arange(2)).reshape(-1), np.repeat(left, 2, axis=0)
            else:
                sizes = bounds[nodes + 1] - bounds[nodes]
                at = np.repeat(bounds[nodes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                far = norms[None, :] - 2 * (self.points[at] @ book.T)
                single.append((at, np.where(np.repeat(left, sizes, axis=0), far, np.iinfo(np.int64).max).argmin(axis=1)))
        return whole, single

    def sums_by_entry(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums of the points of each entry."""
        counts, sums = np.zeros(len(book), dtype=np.int64), np.zeros(book.shape, dtype=np.int64)
        whole, single = self.filtered(book)
        for level, nodes, entries in whole:
            np.add.at(counts, entries, np.diff(self.levels[level])[nodes])
            np.add.at(sums, entries, self.sums[level][nodes])
        for at, entries in single:
            np.add.at(counts, entries, 1)
            np.add.at(sums, entries, self.points[at])
        return counts, sums

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every point, in the order in which the points were given."""
        own = np.zeros(len(self.points), dtype=np.int64)
        whole, single = self.filtered(book)
        for level, nodes, entries in whole:
            bounds = self.levels[level]
            sizes = bounds[nodes + 1] - bounds[nodes]
            own[np.repeat(bounds[nodes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())] = np.repeat(entries, sizes)
        for at, entries in single:
            own[at] = entries
        gap = self.points - book[own]
        code, error = np.empty_like(own), np.empty_like(own)
        code[self.order], error[self.order] = own, (gap * gap).sum(axis=1)
        return code, error


def kept(rows: DataFrame, id_col: str, vector_col: str, label_col: str | None, parts: int, scale: int) -> DataFrame:
    """(vec_id, label, ints) of the vectors that count."""
    v = F.col("v")
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    label = rows[label_col] if label_col else F.lit(None).cast("string")
    named = rows.select(rows[id_col].alias("vec_id"), label.alias("label"), rows[vector_col].cast("array<double>").alias("v")).where(whole)
    first = named.where((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    fits = named.where(F.size("v") == (first["n"] if first else -1))
    small = F.transform(v, lambda x: F.when(F.abs(x) < _LIMIT, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact codes"))).cast("long"))
    return fits.select("vec_id", "label", small.alias("ints"))


def _deal(parts: int):
    """Blocks of a partition's vectors: their rows as Arrow data, and a packed tree for each position."""

    def run(batches):
        def emit(rows: pa.Table):
            flat = rows.column("ints").combine_chunks()
            points = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), parts, -1)
            trees = [Tree(np.ascontiguousarray(points[:, j])).pack() for j in range(parts)]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema.remove(2)) as out:
                out.write_table(rows.drop_columns(["ints"]))
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary()))], names=["rows", "trees"])

        waiting, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                waiting.append(batch.slice(lo, BLOCK))
                n += waiting[-1].num_rows
                if n >= BLOCK:
                    every = pa.Table.from_batches(waiting)
                    yield emit(every.slice(0, BLOCK).combine_chunks())
                    waiting, n = every.slice(BLOCK).to_batches(), n - BLOCK
        if n:
            yield emit(pa.Table.from_batches(waiting).combine_chunks())

    return run


def _round(books: np.ndarray):
    """(position, entry, count, sums) of every block's trees, summed up over a partition."""

    def run(batches):
        counts, sums = np.zeros(books.shape[:2], dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for batch in batches:
            for trees in batch.column(0):
                for j, tree in enumerate(trees):
                    c, s = Tree.unpack(tree.as_py()).sums_by_entry(books[j])
                    counts[j] += c
                    sums[j] += s
        j, i = np.nonzero(counts)
        if len(j):
            yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(counts[j, i]), pa.array(list(sums[j, i]), pa.list_(pa.int64()))], names=["j", "i", "n", "s"])

    return run


def _assign(books: np.ndarray, names: list[str]):
    def run(batches):
        for batch in batches:
            for rows, trees in zip(batch.column(0), batch.column(1), strict=True):
                own = pa.ipc.open_stream(rows.as_py()).read_all()
                found = [Tree.unpack(t.as_py()).codes(books[j]) for j, t in enumerate(trees)]
                codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                errors = np.sum([e for _, e in found], axis=0)
                text = pa.array([c.tobytes().hex() for c in codes], pa.string())
                for one in pa.table([*own.columns, text, pa.array(errors, pa.int64())], names=names).to_batches():
                    yield one

    return run


class Codes:
    """Codebooks of shape (parts, entries, width), and the coded ``rows``: vec_id, label, code, error."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
        if not 1 <= entries <= 256:
            raise ValueError("a code has two hex digits")
        spark = vectors.sparkSession
        use = kept(vectors, id_col, vector_col, label_col, parts, scale)
        first = use.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()  # the codebooks' size
        self.books = np.array([r["ints"] for r in first], dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy() if first else np.zeros((parts, 0, 0), dtype=np.int64)
        schema = T.StructType([*use.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        if not first:
            self.rows = spark.createDataFrame([], schema)
            return
        with arrow_rows(spark, BLOCK):
            blocks = cut(use.mapInArrow(lean(_deal(parts)), "rows binary, trees array<binary>"))
        with arrow_rows(spark, 4):  # rows of some MB
            for _ in range(rounds):
                got = blocks.select("trees").mapInArrow(lean(_round(self.books)), "j int, i int, n long, s array<long>")
                width = self.books.shape[2]
                summed = got.groupBy("j", "i").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(width)))
                for r in summed.collect():  # a row for each entry
                    self.books[r["j"], r["i"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
            self.rows = cut(blocks.mapInArrow(lean(_assign(self.books, schema.names)), schema))

    def digest(self) -> str:
        """Of all entries' components in decimal, by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()

    def with_label_errors(self) -> DataFrame:
        """Adds label_error, the error summed over the rows of the same label."""
        marks = [F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("named")]
        sums = cut(self.rows.groupBy(*marks).agg(F.sum("error").alias("label_error")))
        side = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
        return self.rows.select("*", *marks).join(side, ["none", "named"]).drop("none", "named")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every vector's 16 codes, with the errors that they leave."""
    made = Codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return made.with_label_errors().select("vec_id", "code", "error", "label_error", F.lit(made.digest()).alias("codebooks_sha256"))


QUERIES = {"op12_vector_codes": query}


def _rounds_sql() -> str:
    out = []
    for k in range(ROUNDS):
        out.append(f"""a{k} AS (SELECT j, v, {_nearest(f"c{k}")}),
s{k} AS (SELECT j, i, count(*)::BIGINT AS n, sum(v[1])::BIGINT AS s1, sum(v[2])::BIGINT AS s2, sum(v[3])::BIGINT AS s3, sum(v[4])::BIGINT AS s4 FROM a{k} GROUP BY j, i),
c{k + 1} AS (SELECT c.j, c.i, CASE WHEN n IS NULL THEN c.v ELSE list_transform([s1, s2, s3, s4], lambda s: (s - ((s % n) + n) % n) // n) END AS v FROM c{k} c LEFT JOIN s{k} s ON c.j = s.j AND c.i = s.i)""")
    return ",\n".join(out)


def _nearest(book: str) -> str:
    gap = " + ".join(f"(p.v[{k}] - c.v[{k}]) * (p.v[{k}] - c.v[{k}])" for k in range(1, 5))
    return f"i, d FROM (SELECT p.vec_id, p.label, p.j, p.v, c.i, {gap} AS d, row_number() OVER (PARTITION BY p.row, p.j ORDER BY {gap}, c.i) AS k FROM p JOIN {book} c ON p.j = c.j) WHERE k = 1"


ORACLE_SQL = {
    "op12_vector_codes": f"""
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) = 64),
r AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS row FROM e),
p AS (SELECT vec_id, label, row, j::INT AS j, e[4 * j + 1 : 4 * j + 4] AS v FROM r, range({PARTS}) t(j)),
c0 AS (SELECT j, (row - 1)::INT AS i, v FROM p WHERE row <= {ENTRIES}),
{_rounds_sql()},
f AS (SELECT vec_id, label, row, j, {_nearest(f"c{ROUNDS}").replace("p.vec_id, p.label, ", "p.vec_id, p.label, p.row, ")}),
g AS (SELECT row, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(printf('%02x', i), '' ORDER BY j) AS code, sum(d)::BIGINT AS error FROM f GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY j, i)) AS s FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h.s AS codebooks_sha256 FROM g, h
"""
}
