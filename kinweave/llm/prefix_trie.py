"""The trie of conversations' prefixes, its subtree sums by heavy-path decomposition.

A node is a distinct sequence of first turns. Turns are hashed with their place, and a prefix is the exclusive or of its
turns' hashes (2 x 64 bits) with its length: prefixes come from a running scan in which one conversation may run over
many tasks. A node is named by its smallest conversation and its depth.

Subtree sums: each node's child with the most conversations (then the smallest id) continues its path, so that any way
up leaves at most log2(conversations) paths. The top of each node's path is found by doubling; paths are then attached
to their parents' paths, those without open paths below first, in logarithmically many rounds on sums by path alone; a
last running scan along the paths from below gives every node's sums.

Turns come in order of turn (null first), role and text; null roles and texts are empty. Turns without a conversation id
belong to none and are left out. Repeated rows are turns of their own. Empty tables give empty tables. A long text is one
row, of which only the hashes and the length go on. Other columns stay away.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.storage import cut
from kinweave.llm.words import lean
from kinweave.operators.scan import running

#: Conversation ids hashed together, before the parts of a node meet.
AT_ONCE = 8192
SHARED, GROUP = 6, 100


def ordered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, rank from 1, size in code points, x, y: hashes of role and text) of every turn."""
    role, text = (F.coalesce(turns[c], F.lit("")) for c in (role_col, text_col))
    rows = turns.where(turns[conv_col].isNotNull()).select(turns[conv_col].cast("long").alias("c"), turns[turn_col].alias("turn"), role.alias("role"), text.alias("text"))
    marked = rows.select("*", F.lit(1).cast("long").alias("rank"), F.length("text").cast("long").alias("size"), F.xxhash64(F.lit(1), "role", "text").alias("x"), F.xxhash64(F.lit(2), "role", "text").alias("y"))
    ranked = running(marked, ["c"], [F.col("turn").asc_nulls_first(), "role", "text"], adds=["rank"], keep=["c", "rank", "size", "x", "y"])
    return ranked.select("c", F.col("run_rank").alias("rank"), "size", "x", "y")


def _shared(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % SHARED


def rebuilt(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, p from 1, size, x, y) and conversations (c) after each has taken its first turns from the first of its hundred."""
    c = F.col("c")
    convs = cut(ranked.groupBy("c").agg(F.max("rank").alias("n")))
    heads = ranked.where((F.col("rank") < SHARED) & (c % GROUP == 0)).withColumnRenamed("c", "b")
    copied = convs.select("c", (c - c % GROUP).alias("b")).join(heads, "b").where(F.col("rank") <= _shared(c)).select("c", F.col("rank").alias("p"), "size", "x", "y")
    there = convs.where(c % GROUP == 0).select(c.alias("b"), "n")
    taken = F.least(_shared(c), F.coalesce("n", F.lit(0)))
    own = ranked.where(F.col("rank") > _shared(c)).withColumn("b", c - c % GROUP).join(there, "b", "left")
    return copied.unionByName(own.select("c", (F.col("rank") - _shared(c) + taken).alias("p"), "size", "x", "y")), convs.select("c")


def digests(ends: DataFrame) -> DataFrame:
    """(d, a, b, sha) of ``ends`` (d, a, b, c): of the ids in ascending order, joined by commas.

    Runs of ids are joined where they lie, in ranges that split large groups; a group's runs are then hashed one after the other.
    """

    def joined(batches):
        key, ids = None, []

        def emit():
            d, a, b = key
            return pa.RecordBatch.from_pydict({"d": [d], "a": [a], "b": [b], "c": [ids[0]], "run": [",".join(map(str, ids))]})

        for batch in batches:
            out = []
            for d, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if key != (d, a, b) or len(ids) == AT_ONCE:
                    if key is not None:
                        out.append(emit())
                    key, ids = (d, a, b), []
                ids.append(c)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if key is not None:
            yield emit()

    def hashed(batches):
        key, state = None, None
        emit = lambda found: pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in found], pa.int64()) for i in range(3)), pa.array([s for _, s in found], pa.string())], names=["d", "a", "b", "sha"])
        for batch in batches:
            found = []
            for d, a, b, run in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if key == (d, a, b):
                    state.update(b",")
                else:
                    if key is not None:
                        found.append((key, state.hexdigest()))
                    key, state = (d, a, b), hashlib.sha256()
                state.update(run.encode())
            if found:
                yield emit(found)
        if key is not None:
            yield emit([(key, state.hexdigest())])

    by = ("d", "a", "b", "c")
    runs = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(lean(joined), "d long, a long, b long, c long, run string")
    return runs.repartition("d", "a", "b").sortWithinPartitions(*by).mapInArrow(lean(hashed), "d long, a long, b long, sha string")


def _tops(nodes: DataFrame) -> DataFrame:
    """(c, d, tc, td): the top of every node's path; each round doubles how far a node sees."""
    up = F.coalesce("heavy", F.lit(False))
    links = nodes.select("c", "d", F.when(up, F.col("pc")).otherwise(F.col("c")).alias("tc"), F.when(up, F.col("d") - 1).otherwise(F.col("d")).alias("td"), up.alias("open"))
    while True:
        links = cut(links)
        if links.where("open").isEmpty():
            return links.drop("open")
        ahead = links.select(F.col("c").alias("tc"), F.col("d").alias("td"), F.col("tc").alias("uc"), F.col("td").alias("ud"), F.col("open").alias("more"))
        further = links.where("open").join(ahead, ["tc", "td"]).select("c", "d", F.col("uc").alias("tc"), F.col("ud").alias("td"), F.col("more").alias("open"))
        links = links.where("not open").unionByName(further)


def _attached(paths: DataFrame) -> DataFrame:
    """Paths (tc, td; qc, qd: its parent's; pc; leaves, saved) with the sums of all that hangs on them."""
    done = None
    while True:
        used = paths.where("qc is not null").select(F.col("qc").alias("tc"), F.col("qd").alias("td")).distinct().withColumn("waits", F.lit(True))
        marked = cut(paths.join(used, ["tc", "td"], "left"))
        ready = marked.where("waits is null").drop("waits")
        done = ready if done is None else done.unionByName(ready)
        rest = marked.where("waits").drop("waits")
        if rest.isEmpty():
            return done
        sums = ready.groupBy(F.col("qc").alias("tc"), F.col("qd").alias("td")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        more = lambda own, other: (F.col(own) + F.coalesce(other, F.lit(0))).alias(own)
        paths = rest.join(sums, ["tc", "td"], "left").select("tc", "td", "pc", "qc", "qd", more("leaves", "l"), more("saved", "s"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``turns`` (c, p, size, x, y) and of the conversations ``convs`` (c), some of them perhaps without turns."""
    hashed = turns.select("c", "p", "size", F.xxhash64("p", "x", "y").alias("a"), F.xxhash64(F.lit(3), "p", "x", "y").alias("b"))
    paths = running(hashed, ["c"], ["p"], xors=["a", "b"]).select(F.col("c"), F.col("p").alias("d"), "size", F.col("run_a").alias("a"), F.col("run_b").alias("b"), F.col("run_a").bitwiseXOR(F.col("a")).alias("pa"), F.col("run_b").bitwiseXOR(F.col("b")).alias("pb"))
    found = cut(paths.groupBy("d", "a", "b").agg(F.count("*").alias("n_convs"), F.min("c").alias("c"), F.min("size").alias("size"), F.min("pa").alias("pa"), F.min("pb").alias("pb")))
    saved = ((F.col("n_convs") - 1) * F.col("size")).alias("saved")
    top = F.lit(0).cast("long")
    every = convs.agg(F.count("*").alias("n"), F.min("c").alias("c")).first()
    root = convs.sparkSession.range(1 if every["n"] else 0).select(top.alias("d"), top.alias("a"), top.alias("b"), F.lit(every["c"]).cast("long").alias("c"), F.lit(None).cast("long").alias("pc"), F.lit(every["n"]).cast("long").alias("n_convs"), top.alias("saved"))
    first = found.where("d = 1").withColumn("pc", F.lit(every["c"]).cast("long"))
    above = found.select((F.col("d") + 1).alias("d"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("c").alias("pc"))
    below = found.where("d > 1").join(above, ["d", "pa", "pb"])
    nodes = cut(root.unionByName(first.select("d", "a", "b", "c", "pc", "n_convs", saved)).unionByName(below.select("d", "a", "b", "c", "pc", "n_convs", saved)))

    kids = cut(nodes.where("pc is not null").groupBy(F.col("pc").alias("c"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"), F.max_by("c", F.struct("n_convs", -F.col("c"))).alias("next")))
    marked = nodes.join(kids.drop("next"), ["c", "d"], "left").join(kids.select(F.col("next").alias("c"), (F.col("d") + 1).alias("d"), F.lit(True).alias("heavy")), ["c", "d"], "left")
    leaf = F.col("n_children").isNull().cast("long")
    marked = cut(marked.withColumn("leaves", leaf))
    placed = cut(marked.join(_tops(marked), ["c", "d"]))
    own = placed.groupBy("tc", "td").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    parents = placed.select(F.col("c").alias("pc"), (F.col("d") + 1).alias("td"), F.col("tc").alias("qc"), F.col("td").alias("qd"))
    tops = placed.where("c = tc and d = td").select("tc", "td", "pc").join(parents, ["pc", "td"], "left")
    light = _attached(tops.join(own, ["tc", "td"]).select("tc", "td", "pc", "qc", "qd", "leaves", "saved"))
    hung = light.where("pc is not null").groupBy(F.col("pc").alias("c"), (F.col("td") - 1).alias("d")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    full = placed.join(hung, ["c", "d"], "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))})
    summed = running(full, ["tc", "td"], [F.col("d").desc()], adds=["leaves", "saved"], keep=["c", "d", "a", "b", "pc", "n_convs", "n_children", "tc", "td", "leaves", "saved"])

    last = paths.groupBy("c").agg(F.max(F.struct("d", "a", "b")).alias("e")).select("c", "e.*")
    bare = convs.join(last.select("c"), "c", "left_anti").select("c", top.alias("d"), top.alias("a"), top.alias("b"))
    shas = digests(cut(last.unionByName(bare)))
    out = summed.join(shas, ["d", "a", "b"], "left")
    return out.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("pc").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.col("run_leaves").alias("n_leaves"),
        F.col("run_saved").alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the trie of all conversations, rebuilt with shared first turns."""
    return trie(*rebuilt(ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


QUERIES = {"op13_prefix_trie": query}

ORACLE_SQL = {
    "op13_prefix_trie": """
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT c, c - c % 100 AS b, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
         lambda h, y: list_reduce(list_prepend(xor(h, y), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % 6 AS crc
  FROM (SELECT DISTINCT c FROM o)),
t AS (
  SELECT k.c, o.r AS p, role, text FROM k JOIN o ON o.c = k.b AND o.r <= k.crc
  UNION ALL
  SELECT k.c, o.r - k.crc + least(k.crc, (SELECT count(*) FROM o x WHERE x.c = k.b)) AS p, role, text FROM k JOIN o ON o.c = k.c AND o.r > k.crc),
s AS (SELECT c, p AS d, length(text) AS size, md5(string_agg(md5(role) || md5(text), '' ORDER BY p) OVER (PARTITION BY c ORDER BY p)) AS h FROM t),
e AS (SELECT c, max(d) AS d FROM s GROUP BY c),
m AS (SELECT c, d, size, h FROM s UNION ALL SELECT c, 0, 0, '' FROM k),
n AS (SELECT d, h, min(c) AS conv_id, count(*) AS n_convs, min(size) AS size FROM m GROUP BY d, h),
w AS (SELECT n.*, q.conv_id AS parent FROM n LEFT JOIN m ON m.c = n.conv_id AND m.d = n.d - 1 LEFT JOIN n q ON q.d = m.d AND q.h = m.h),
x AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM w WHERE d > 0 GROUP BY ALL),
y AS (SELECT w.*, coalesce(x.n_children, 0) AS n_children FROM w LEFT JOIN x ON x.parent = w.conv_id AND x.d = w.d),
z AS (
  SELECT m.d, m.h, count(*) FILTER (y.n_children = 0) AS n_leaves, sum((y.n_convs - 1) * y.size)::BIGINT AS saved_tokens
  FROM y JOIN m ON m.c = y.conv_id AND m.d <= y.d GROUP BY m.d, m.h),
g AS (SELECT m.d, m.h, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) AS sha FROM m LEFT JOIN e ON e.c = m.c WHERE m.d = coalesce(e.d, 0) GROUP BY m.d, m.h)
SELECT y.conv_id, y.d::BIGINT AS depth, y.parent AS parent_conv_id, y.n_convs, y.n_children, z.n_leaves, z.saved_tokens, coalesce(g.sha, sha256('')) AS ends_sha256
FROM y JOIN z ON z.d = y.d AND z.h = y.h LEFT JOIN g ON g.d = y.d AND g.h = y.h
"""
}
