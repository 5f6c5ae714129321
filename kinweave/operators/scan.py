"""Running sums within keys, in order, where one key may hold any share of the rows.

Rows are dealt into ranges of (key, order), so a large key runs over many tasks. Every task adds up within its range;
from each only its first key, its last key and that one's sums come to the driver, where a pass over these few
rows tells what each range's first key has to start from.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.sources.shared import cut


def _local(columns: list[str], keys: list[str], adds: Sequence[str], xors: Sequence[str]):
    sums = [(c, np.add, np.subtract) for c in adds] + [(c, np.bitwise_xor, np.bitwise_xor) for c in xors]

    def run(batches):
        part, first, last, carried, seq = TaskContext.get().partitionId(), None, None, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = np.stack([batch.column(columns.index(k)).to_numpy().astype(np.int64) for k in keys])
            starts = np.concatenate([[0], np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1])
            lengths = np.diff(np.append(starts, n))
            first = own[:, 0].copy() if first is None else first
            out = []
            for k, (c, put, take) in enumerate(sums):
                v = batch.column(columns.index(c)).to_numpy().astype(np.int64)
                whole = put.accumulate(v)
                run_ = take(whole, np.repeat(take(whole[starts], v[starts]), lengths))
                if last is not None and (own[:, 0] == last).all():
                    run_[: lengths[0]] = put(run_[: lengths[0]], carried[k])
                out.append(run_)
            last, carried = own[:, -1].copy(), [r[-1] for r in out]
            marks = [pa.array(np.full(n, part, dtype=np.int32)), pa.array((own == first[:, None]).all(axis=0)), pa.array(np.arange(seq, seq + n))]
            seq += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out), *marks], names=[*columns, *(f"run_{c}" for c, _, _ in sums), "__part", "__head", "__seq"])

    return run


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], adds: Sequence[str] = (), xors: Sequence[str] = (), keep: Sequence[str] | None = None) -> DataFrame:
    """Adds ``run_x`` for every column x of ``adds`` and ``xors``: the sum, or the exclusive or, of x over the rows of the same key
    up to this one in ``order``.

    Keys and summed columns are integers without nulls; ``order`` settles all ties that matter. Of the columns those in
    ``keep`` stay (all by default), the others only serve for the order.
    """
    by = [*(F.col(k) for k in keys), *(F.col(o) if isinstance(o, str) else o for o in order)]
    columns = list(keep or rows.columns)
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*columns)
    names = [f"run_{c}" for c in (*adds, *xors)]
    marks = [T.StructField("__part", T.IntegerType()), T.StructField("__head", T.BooleanType()), T.StructField("__seq", T.LongType())]
    schema = T.StructType([*dealt.schema.fields, *(T.StructField(c, T.LongType()) for c in names), *marks])
    local = cut(dealt.mapInArrow(_local(columns, list(keys), adds, xors), schema))
    ends = local.groupBy("__part").agg(F.min(F.struct(*keys)).alias("first"), F.max_by(F.struct(*keys, *names), "__seq").alias("last"))
    carry, key, state = [], None, None
    for r in ends.orderBy("__part").collect():  # a row for each range
        first, last = (tuple(r[side][k] for k in keys) for side in ("first", "last"))
        sums = [r["last"][c] for c in names]
        if first == key:
            carry.append((r["__part"], *state))
        if first == key == last:
            state = [_wrapped(a + b) if k < len(adds) else a ^ b for k, (a, b) in enumerate(zip(state, sums, strict=True))]
        else:
            key, state = last, sums
    if not carry:
        return local.drop("__part", "__head", "__seq")
    side = F.broadcast(local.sparkSession.createDataFrame(carry, T.StructType([marks[0], *(T.StructField(f"__{c}", T.LongType()) for c in names)])))
    add = lambda k, c: F.when(F.col("__head") & F.col(f"__{c}").isNotNull(), F.col(c) + F.col(f"__{c}") if k < len(adds) else F.col(c).bitwiseXOR(F.col(f"__{c}"))).otherwise(F.col(c))
    return local.join(side, "__part", "left").select(*columns, *(add(k, c).alias(c) for k, c in enumerate(names)))


def _wrapped(n: int) -> int:
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)
