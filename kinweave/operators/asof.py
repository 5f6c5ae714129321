"""Interval joins in time: for every instant asked, the rows whose interval holds it.

The time that the instants span is cut into 2^levels buckets, and the buckets into a binary tree. An interval is the few
nodes (two a level at most) that cover its buckets, an instant the path from its bucket to the root; they meet in
exactly one node or in none. So an interval without an end costs no more than a short one, and a key that holds any
share of the rows is spread over the nodes.

Only keys with more than ``FEW`` rows are spread so. The instants of others meet their key's rows at once and aren't multiplied. Where
few keys are asked for, rows of others are dropped first, and what is left is broadcast if it is counted to be small: then
what is asked isn't shuffled at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.sources.shared import cut

#: 64 buckets: an instant is 7 rows, an interval 12 at most. More spread a key farther, and cost more rows.
LEVELS = 6
#: Rows of a key that each of its instants is compared with; the tree is for keys with more.
FEW = 1024
#: Most keys, and most rows (in nodes: some times as many), that are broadcast; both are counted.
BROADCAST_KEYS, BROADCAST_ROWS = 50_000, 50_000


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _cover(low: Column, high: Column, levels: int) -> Column:
    """ARRAY<STRUCT<level, node>>: the largest nodes within the buckets low..high."""
    first = lambda k: F.shiftright(low + (1 << k) - 1, k)
    last = lambda k: F.shiftright(high + 1, k) - 1
    out = []
    for level in range(levels + 1):
        a, b, up_a, up_b = first(level), last(level), first(level + 1), last(level + 1)
        outer = lambda n: (F.shiftright(n, 1) < up_a) | (F.shiftright(n, 1) > up_b)  # noqa: B023, E731
        node = lambda n: F.struct(F.lit(level).alias("level"), n.alias("node"))  # noqa: B023, E731
        out += [F.when((a <= b) & outer(a), node(a)), F.when((a < b) & outer(b), node(b))]
    return F.filter(F.array(*out), lambda n: n.isNotNull())


def as_of_join(
    asked: DataFrame, rows: DataFrame, on: Sequence[tuple[str, str]], at: str, begins: str = "valid_at", ends: str = "invalid_at",
    known_at: str | None = None, recorded: str = "recorded_at", expired: str = "expired_at", levels: int = LEVELS, few: int = FEW,
) -> DataFrame:
    """Every row of ``asked`` with every row of ``rows`` that agrees in ``on`` (left column, right column) and whose [begins, ends)
    holds ``at``; unknown begins and ends are open. With ``known_at``, only rows that the system recorded at that instant; else only
    rows that aren't expired, where there is such a column.

    Columns are those of both sides. Instants and keys that are null meet nothing.
    """
    left, right = asked.columns, rows.columns
    both = {c.lower() for c in left} & {c.lower() for c in right}
    if both:
        raise ValueError(f"columns of both sides: {', '.join(sorted(both))}")
    mine_on, rows_on = [f"__on{k}" for k in range(len(on))], [f"__r{k}" for k in range(len(on))]
    keyed = asked.where(F.col(at).isNotNull()).select(*left, *(F.col(a).alias(n) for n, (a, _) in zip(mine_on, on, strict=True)))
    use = rows
    if known_at is None and expired in right:
        use = use.where(F.col(expired).isNull())
    use = use.select(*right, *(F.col(b).alias(n) for n, (_, b) in zip(rows_on, on, strict=True)))
    span = keyed.agg(F.min(_micros(F.col(at))).alias("a"), F.max(_micros(F.col(at))).alias("b"), F.approx_count_distinct(F.struct(*mine_on)).alias("keys")).first()
    start, stop = span["a"] or 0, span["b"] or 0
    width, top = max(1, -(-(stop - start + 1) >> levels)), (1 << levels) - 1
    bucket = lambda t: F.floor((t - start) / F.lit(width)).cast("long")
    low = F.greatest(F.lit(0), F.coalesce(bucket(_micros(F.col(begins))), F.lit(0)))
    high = F.least(F.lit(top), F.coalesce(bucket(_micros(F.col(ends)) - 1), F.lit(top)))
    use = use.withColumns({"__low": low.cast("long"), "__high": high.cast("long")}).where("__low <= __high")
    agree = lambda mine, theirs: reduce(lambda x, y: x & y, (F.col(m) == F.col(t) for m, t in zip(mine, theirs, strict=True)), F.lit(True))
    placed = lambda small, df: F.broadcast(df) if small else df.hint("merge")
    if on and span["keys"] <= BROADCAST_KEYS:
        wanted = keyed.select(*mine_on).distinct()
        use = use.join(F.broadcast(wanted), agree(mine_on, rows_on), "left_semi")
    small = use.count() <= BROADCAST_ROWS
    large = cut(use.groupBy(*rows_on).agg(F.count("*").alias("__size")).where(F.col("__size") > few).select(*(F.col(n).alias(f"__l{k}") for k, n in enumerate(rows_on)), F.lit(True).alias("__large")))
    many = large.count()
    same = agree(mine_on, rows_on)
    if many:  # their instants and intervals in nodes, those of others all in the root
        root, marks = F.array(F.struct(F.lit(levels).alias("level"), F.lit(0).cast("long").alias("node"))), [f"__l{k}" for k in range(len(on))]
        path = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(bucket(_micros(F.col(at))), k).alias("node")) for k in range(levels + 1)))
        large = placed(many <= BROADCAST_KEYS, large)
        keyed = keyed.join(large, agree(mine_on, marks), "left").withColumn("__n", F.explode(F.when(F.col("__large"), path).otherwise(root))).drop(*marks, "__large")
        use = use.join(large, agree(rows_on, marks), "left").withColumn("__m", F.explode(F.when(F.col("__large"), _cover(F.col("__low"), F.col("__high"), levels)).otherwise(root))).drop(*marks, "__large")
        same &= (F.col("__n.level") == F.col("__m.level")) & (F.col("__n.node") == F.col("__m.node"))
    holds = lambda t, a, b: (F.col(a).isNull() | (F.col(a) <= F.col(t))) & (F.col(b).isNull() | (F.col(b) > F.col(t)))
    met = keyed.join(placed(small, use), same).where(holds(at, begins, ends))
    return (met if known_at is None else met.where((F.col(recorded) <= F.col(known_at)) & (F.col(expired).isNull() | (F.col(expired) > F.col(known_at))))).select(*left, *right)
