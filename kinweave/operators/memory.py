"""Decision memory: an append-only log of confirmed and rejected resolutions, and its latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame) -> DataFrame:
    """The last decision of every cell (surface, kind, entity_id, context), by seq."""
    return log.groupBy("surface", "kind", "entity_id", "context").agg(F.max_by("decision", "seq").alias("decision"), F.max("seq").alias("seq"))


def confirmed(log: DataFrame) -> DataFrame:
    """(surface, kind, context, entity_id): what each surface was last confirmed to be, a row for each context."""
    cells = latest(log).where("decision = 'confirmed'")
    return cells.groupBy("surface", "kind", "context").agg(F.max_by("entity_id", "seq").alias("entity_id"))


def rejected(log: DataFrame) -> DataFrame:
    return latest(log).where("decision = 'rejected'").select("surface", "kind", "entity_id", "context")


def lookup(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Adds confirmed and rejected (sorted array) to requests (surface, kind, context).

    Decisions without a context hold everywhere, others in theirs alone; of two confirmations the one with a
    context counts.
    """
    keyed = requests.withColumn("__id", F.xxhash64(*(F.coalesce(F.col(c), F.lit("\0")) for c in ("surface", "kind", "context"))))
    asked = keyed.select("__id", "surface", "kind", "context").distinct()

    def of(cells: DataFrame) -> DataFrame:
        c = cells.withColumnsRenamed({"surface": "s", "kind": "k", "context": "x"})
        return asked.join(c, (F.col("surface") == F.col("s")) & (F.col("kind") == F.col("k")) & (F.col("x").isNull() | F.col("x").eqNullSafe(F.col("context"))))

    yes = of(confirmed(log)).groupBy("__id").agg(F.max_by("entity_id", F.col("x").isNotNull()).alias("confirmed"))
    no = of(rejected(log)).groupBy("__id").agg(F.array_sort(F.collect_set("entity_id")).alias("rejected"))
    out = keyed.join(yes, "__id", "left").join(no, "__id", "left").drop("__id")
    return out.withColumn("rejected", F.coalesce("rejected", F.array().cast("array<string>")))
