"""Scoring of proposals against what candidates should resolve to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.text import normalize_name, shannon_entropy
from kinweave.operators.resolve import Options, resolve_candidates
from kinweave.sources.shared import cut


def confusion(proposals: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of tp, fp, fn, tn; a merge with the wrong entity counts as false positive and false negative."""
    rows = expected.select("ref", "target").join(proposals.select("ref", F.col("entity_id").alias("got")), "ref", "left")
    target, got = F.col("target"), F.col("got")
    wrong = target.isNotNull() & got.isNotNull() & (target != got)
    return rows.agg(
        F.count_if(target.isNotNull() & got.isNotNull() & (target == got)).alias("tp"), F.count_if((target.isNull() & got.isNotNull()) | wrong).alias("fp"),
        F.count_if((target.isNotNull() & got.isNull()) | wrong).alias("fn"), F.count_if(target.isNull() & got.isNull()).alias("tn"),
    )


def precision_recall(outcome: DataFrame) -> DataFrame:
    """Adds precision and recall (1 where there is nothing to count) and f1 (0 where both are 0)."""
    ratio = lambda n, d: F.when(d == 0, F.lit(1.0)).otherwise(n / d)
    out = outcome.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / both))


def curve(scored: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn at every threshold: over all rows, by each column of ``by`` and by all of them together, from one pass.

    ``scored``: ref, target, entity_id, score (the best nominee of each ref; null for none) and ``by``. Rows are counted
    once by the highest threshold that they reach; a running sum from above then gives each threshold what it accepts.
    Groups that don't hold a column of ``by`` have null there, and ``level`` says which they hold.
    """
    points = sorted(set(thresholds))
    reached = sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in points), F.lit(0))
    taken = F.col("entity_id").isNotNull() & F.col("score").isNotNull()
    right = F.coalesce(F.col("target") == F.col("entity_id"), F.lit(False))
    rows = scored.select(*by, F.when(taken, reached).otherwise(0).alias("reached"), (taken & right).alias("right"), F.col("target").isNull().alias("new"))
    counts = [F.count_if("right").alias("right"), F.count_if(~F.col("right")).alias("wrong"), F.count_if("new").alias("new"), F.count("*").alias("n")]
    sets = [[], *([c] for c in by), *([list(by)] if len(by) > 1 else [])]
    level = F.grouping_id().alias("level") if by else F.lit(0).alias("level")
    grouped = rows.groupingSets([[F.col(c) for c in (*own, "reached")] for own in sets], *by, "reached").agg(level, *counts) if by else rows.groupBy("reached").agg(level, *counts)
    steps = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("k"), F.lit(t).alias("threshold")) for k, t in enumerate(points))))
    own = Window.partitionBy("level", *by)
    groups = grouped.withColumns({"all_new": F.sum("new").over(own), "all": F.sum("n").over(own)})
    # at each threshold a group's rows count that have reached it: a row for each (group, threshold), then a sum from above
    grid = groups.select("level", *by, "all_new", "all").distinct().select("*", steps.alias("s")).select("level", *by, "all_new", "all", "s.k", "s.threshold")
    same = F.col("k") == F.col("reached")
    for c in ("level", *by):
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    placed = grid.join(groups.select(F.col("level").alias("__level"), *(F.col(c).alias(f"__{c}") for c in by), "reached", "right", "wrong", "new"), same, "left")
    above = Window.partitionBy("level", *by).orderBy(F.col("k").desc())
    run = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    out = placed.select("level", *by, "threshold", "all", "all_new", run("right").alias("tp"), run("wrong").alias("fp"), run("new").alias("new_taken"))
    return out.select("level", *by, "threshold", "tp", "fp", (F.col("all") - F.col("all_new") - F.col("tp")).alias("fn"), (F.col("all_new") - F.col("new_taken")).alias("tn"))


def sweep(candidates: DataFrame, catalog: DataFrame, expected: DataFrame, settings: Sequence[Options]) -> DataFrame:
    """tp, fp, fn, tn and auto (merges without review) for each of ``settings`` (by its place), which differ in phonetic stage, fuzzy
    threshold and entropy gate.

    The stages are run once, at the lowest threshold and without a gate; each setting then only picks from what they found.
    """
    lowest = min(s.fuzzy_threshold for s in settings)
    schemes = next((s.phonetic_schemes for s in settings if s.phonetic_schemes is None or s.phonetic_schemes), [])
    sound = resolve_candidates(candidates, catalog, Options(phonetic_schemes=schemes, fuzzy_threshold=1.01)).select("ref", F.col("entity_id").alias("early"), F.col("basis").alias("stage"), ~F.col("requires_review") & F.col("entity_id").isNotNull())
    sound = sound.toDF("ref", "early", "stage", "auto")
    close = resolve_candidates(candidates, catalog, Options(phonetic_schemes=[], fuzzy_threshold=lowest, entropy_threshold=0.0)).where("basis = 'fuzzy'").select("ref", F.col("entity_id").alias("late"), "score")
    bits = candidates.select("ref", shannon_entropy(normalize_name(F.col("label"))).alias("bits"))
    found = cut(expected.select("ref", "target").join(bits, "ref").join(sound, "ref").join(close, "ref", "left"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("setting"), F.lit(s.phonetic_schemes is None or bool(s.phonetic_schemes)).alias("sounds"), F.lit(s.fuzzy_threshold).alias("least"), F.lit(s.entropy_threshold).alias("gate")) for k, s in enumerate(settings))))
    rows = found.select("*", each.alias("s")).select("*", "s.*")
    early = (F.col("stage") == "exact") | ((F.col("stage") == "phonetic") & F.col("sounds"))
    late = (F.col("score") >= F.col("least")) & (F.col("bits") >= F.col("gate"))
    rows = rows.withColumn("got", F.when(early, F.col("early")).when(late, F.col("late")))
    target, got = F.col("target"), F.col("got")
    right, wrong = F.coalesce(target == got, F.lit(False)), target.isNotNull() & got.isNotNull() & (target != got)
    return rows.groupBy("setting").agg(
        F.count_if(right).alias("tp"), F.count_if((target.isNull() & got.isNotNull()) | wrong).alias("fp"), F.count_if((target.isNotNull() & got.isNull()) | wrong).alias("fn"),
        F.count_if(target.isNull() & got.isNull()).alias("tn"), F.count_if(early & F.col("auto")).alias("auto"),
    )
