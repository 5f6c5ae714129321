"""Graph maintenance: edge upsert plans, support removal, bi-temporal reads, and the fold that applies facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.fold import NAMES, PIECE, fold_facts


def current(edges: DataFrame) -> DataFrame:
    """Rows that the system still records; an invalidated edge that isn't expired is one."""
    return edges.where(F.col("expired_at").isNull())


def as_of_valid(edges: DataFrame, at: Column) -> DataFrame:
    """Recorded edges that were true at a time: unknown starts count, ends are exclusive."""
    return current(edges).where((F.col("valid_at").isNull() | (F.col("valid_at") <= at)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at)))


def as_of_system(edges: DataFrame, at: Column) -> DataFrame:
    """Edges as the system recorded them at a time."""
    return edges.where((F.col("recorded_at") <= at) & (F.col("expired_at").isNull() | (F.col("expired_at") > at)))


def plan_edge_upserts(facts: DataFrame, policies: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """Every fact of ``facts`` planned against the same edges: adds action, existing_edge_id and invalidations.

    A live edge (neither expired nor invalidated) with the fact's source, predicate and target makes it a
    ``refresh``; else it is an ``insert``, which, where the predicate is exclusive per source, proposes to close
    the live edges that don't begin after it. Predicates without a policy are additive. Repeated facts get a plan
    each, with the same closings.
    """
    live = current(edges).where(F.col("invalid_at").isNull()).select("id", F.col("source_entity_id").alias("s"), F.col("predicate").alias("p"), F.col("target_entity_id").alias("t"), F.col("valid_at").alias("since"), "recorded_at")
    keyed = facts.join(policies, "predicate", "left")
    key = ("source_entity_id", "target_entity_id", "predicate", "valid_at", "cardinality")
    begins = F.coalesce("valid_at", now)
    met = keyed.select(*key).distinct().join(live, (F.col("source_entity_id") == F.col("s")) & (F.col("predicate") == F.col("p")), "left")
    same = F.col("t") == F.col("target_entity_id")
    closes = (F.col("cardinality") == "exclusive_per_source") & F.col("id").isNotNull() & (F.col("since").isNull() | (begins >= F.col("since")))
    plans = met.groupBy(*key).agg(
        F.min_by("id", F.when(same, F.struct("recorded_at", "id"))).alias("existing_edge_id"),
        F.array_sort(F.collect_list(F.when(closes, F.struct(F.col("id").alias("edge_id"), begins.alias("invalid_at"))))).alias("closing"),
    )
    plans = plans.withColumnsRenamed({k: f"__{k}" for k in key})
    out = keyed.join(plans, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key))).drop(*(f"__{k}" for k in key))
    refresh = F.col("existing_edge_id").isNotNull()
    empty = F.filter("closing", lambda c: F.lit(False))
    return out.withColumn("action", F.when(refresh, "refresh").otherwise("insert")).withColumn("invalidations", F.when(refresh, empty).otherwise(F.col("closing"))).drop("closing")


def plan_support_removal(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """(edge_id, remaining_support, orphaned) of recorded edges that lose support; order and repeats stay.

    ``removed`` has a column mention_id. Support is exploded and joined, so neither side needs to be small.
    """
    each = current(edges).select("id", F.posexplode("support").alias("pos", "mention_id"))
    marked = each.join(removed.select("mention_id").distinct().withColumn("gone", F.lit(True)), "mention_id", "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("gone").isNull(), F.struct("pos", "mention_id"))))
    reviews = marked.groupBy(F.col("id").alias("edge_id")).agg(F.count_if("gone").alias("lost"), F.transform(kept, lambda k: k["mention_id"]).alias("remaining_support")).where("lost > 0")
    return reviews.select("edge_id", "remaining_support", (F.size("remaining_support") == 0).alias("orphaned"))


def plan_document_deletion(edges: DataFrame, mentions: DataFrame, sources: DataFrame) -> DataFrame:
    """(edge_id, remaining_support, orphaned) of the edges that the mentions of the deleted ``sources`` (source_id) support."""
    gone = mentions.join(sources.select("source_id").distinct(), "source_id", "left_semi").select(F.col("id").alias("mention_id"))
    return plan_support_removal(edges, gone)


def ready(facts: DataFrame, policies: DataFrame, now: Column | None) -> DataFrame:
    """Facts with their cardinality, their edge's id and the time that counts where theirs is unknown."""
    parts = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in ("source_entity_id", "predicate", "target_entity_id", "ordinal"))
    ident = F.sha2(F.concat_ws("\1", *parts), 256)
    return facts.join(policies, "predicate", "left").withColumns({"id": ident, "now": F.current_timestamp() if now is None else now, "support": F.coalesce("support", F.array().cast("array<string>"))})


def apply_facts(facts: DataFrame, policies: DataFrame, now: Column | None = None, edges: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """Edges after the facts, in the order of ``ordinal``: those that the facts make, and ``edges`` (as ``FOLDED``) that were there.

    Where a predicate is exclusive per source, facts of one source depend on each other and are folded in order, large sources
    piece by piece. Else only facts of one (source, predicate, target) do, and these are summed up without gathering them:
    the first one makes the edge, unless one is live, and all lend their support.
    """
    keyed = ready(facts, policies, now)
    exclusive = F.coalesce(F.col("cardinality") == "exclusive_per_source", F.lit(False))
    names = NAMES
    there = None if edges is None else edges.select(*names).join(policies, "predicate", "left")

    columns = [*names, "cardinality", "now", "old"]
    new = keyed.withColumns({"invalid_at": F.lit(None).cast("timestamp"), "old": F.lit(False)}).select(*columns)
    every = new if there is None else new.unionByName(there.withColumns({"now": F.lit(None).cast("timestamp"), "old": F.lit(True)}).select(*columns))
    folded = fold_facts(every.where(exclusive), piece)
    rest = every.where(~exclusive)
    closed = rest.where(F.col("old") & F.col("invalid_at").isNotNull()).select(*names)
    one = ("source_entity_id", "predicate", "target_entity_id")
    first = F.min_by(F.struct("id", "valid_at", "ordinal"), F.struct(~F.col("old"), "ordinal", "id"))
    seen = rest.where(F.col("invalid_at").isNull())
    base = seen.groupBy(*one).agg(first.alias("first"))
    # support in order of first appearance, as far as (edge there, ordinal, place) tells it
    each = seen.select(*one, "old", "ordinal", F.posexplode("support").alias("pos", "mention")).groupBy(*one, "mention").agg(F.min(F.struct(~F.col("old"), "ordinal", "pos")).alias("at"))
    support = each.groupBy(*one).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "mention"))), lambda x: x["mention"]).alias("support"))
    named = support.withColumnsRenamed({c: f"__{c}" for c in one})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in one))  # facts without a target are facts too
    summed = base.join(named, same, "left").select("first.id", *one, "first.valid_at", F.lit(None).cast("timestamp").alias("invalid_at"), F.coalesce("support", F.array().cast("array<string>")).alias("support"), "first.ordinal")
    return folded.select(*names).unionByName(summed.select(*names)).unionByName(closed)
