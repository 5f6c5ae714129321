"""The resolution cascade: candidates against a catalog, cheapest stage first.

remembered -> exact -> phonetic -> fuzzy -> embedding, with a judge on unambiguous fuzzy or embedding nominees.
Each stage is a join whose hits leave the survivors by an anti-join. Only remembered and unambiguous exact
hits need no review.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.phonetic import Scheme, default_schemes, phonetic_keys
from kinweave.functions.text import jaccard, lsh_band_keys, minhash_signature, normalize_name, passes_entropy_gate, shingles
from kinweave.operators import memory as decisions
from kinweave.operators.vectors import DECIMALS, VectorIndex
from kinweave.sources.shared import cut

#: Below this threshold banding would lose many pairs (at it, 1 - (1 - 0.65^4)^16 = 0.96 are found); sets are then joined on
#: their prefixes whatever is asked for.
LSH_LEAST = 0.65
#: Most names and aliases of a catalog that is broadcast. Nothing else is: see ``_spread``.
BROADCAST_FORMS = 2000


@dataclass(frozen=True)
class Options:
    fuzzy_threshold: float = 0.82
    entropy_threshold: float = 2.0
    embedding_threshold: float = 0.85
    #: Cells of the vector index that a label probes; None: all that may hold a hit, which loses none.
    embedding_probes: int | None = 32
    #: None: the default ones; an empty list turns the stage off.
    phonetic_schemes: Sequence[Scheme] | None = None
    phonetic_score: float = 0.9
    #: Catalog rows above which bands propose the fuzzy pairs, which may miss some; None: an exact join at every size.
    lsh_cutover: int | None = None
    ambiguity_margin: float = 0.02
    judge_budget: int = 20
    #: labels -> vectors, and (left labels, right labels) -> (same, confidence) pairs; a failure counts as no answer.
    embedder: Callable[[list[str]], list[list[float]]] | None = None
    judge: Callable[[list[str], list[str]], list[tuple[bool, float]]] | None = None
    #: Input known to be in NFKC needs no Python for its match keys.
    compose: bool = True


def _spread(df: DataFrame) -> DataFrame:
    """For a join by shuffling. Left to itself the planner goes by the bytes of the files, and few of them may hold millions of names,
    which the driver would have to gather for a broadcast."""
    return df.hint("merge")


def _forms(df: DataFrame, key: str, options: Options) -> DataFrame:
    """(key, kind, raw, form) of labels and aliases."""
    raws = F.array_distinct(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))))
    each = df.select(key, "kind", F.explode(raws).alias("raw"))
    return each.withColumn("form", normalize_name(F.col("raw"), options.compose)).where("form != ''")


def _best(hits: DataFrame, basis: str, review: Column) -> DataFrame:
    """A hit a group: the best score, then the smallest id."""
    best = hits.groupBy("gid").agg(F.min(F.struct((-F.col("score")).alias("less"), "entity_id")).alias("b"), F.count_distinct("entity_id").alias("entities"))
    return best.select("gid", F.col("b.entity_id").alias("entity_id"), F.lit(basis).alias("basis"), (-F.col("b.less")).alias("score"), review.alias("requires_review"), "entities")


def _prefix(shingle_set: Column, threshold: float) -> Column:
    """The elements, smallest hashes first, of which sets that reach the threshold share at least one: all but
    ceil(threshold * size) - 1."""
    by_hash = F.transform(F.array_sort(F.transform(shingle_set, lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("s")))), lambda x: x["s"])
    most = F.size(shingle_set) - F.ceil(F.size(shingle_set) * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    return F.slice(by_hash, F.lit(1), F.greatest(F.lit(0), F.least(F.size(shingle_set), most)))


def fuzzy_pairs(left: DataFrame, right: DataFrame, threshold: float, use_lsh: bool = False, lsh_least: float = LSH_LEAST) -> DataFrame:
    """Adds score to pairs of (id, kind, form) and (rid, rkind, rform) whose shingle sets reach the threshold.

    Pairs meet on an element of both prefixes, which loses none; with ``use_lsh`` on a band of their MinHash
    signatures, which finds 1 - (1 - s^4)^16 of those of similarity s, unless the threshold is below ``lsh_least``.
    """
    a = left.withColumn("sh", shingles(F.col("form")))
    b = right.withColumn("rsh", shingles(F.col("rform")))
    if use_lsh and threshold >= lsh_least:
        a = a.withColumn("key", F.explode(lsh_band_keys(minhash_signature(F.col("sh")))))
        b = b.withColumn("key", F.explode(lsh_band_keys(minhash_signature(F.col("rsh")))))
    else:
        a, b = a.withColumn("key", F.explode(_prefix(F.col("sh"), threshold))), b.withColumn("key", F.explode(_prefix(F.col("rsh"), threshold)))
    alike = F.least(F.size("sh"), F.size("rsh")) >= F.greatest(F.size("sh"), F.size("rsh")) * F.lit(threshold) - F.lit(1e-9)
    pairs = a.join(b, (F.col("kind") == F.col("rkind")) & (a["key"] == b["key"]) & alike).drop("key").dropDuplicates(["id", "form", "rid", "rform"])
    return pairs.withColumn("score", jaccard(F.col("sh"), F.col("rsh"))).where(F.col("score") >= F.lit(threshold)).drop("sh", "rsh")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def _embedded(labels: DataFrame, embedder) -> DataFrame:
    """(label, vec) of distinct labels, a batch at a time; what the embedder fails on has no vector."""

    def run(batches):
        for pdf in batches:
            try:
                vecs = [list(map(float, v)) for v in embedder(pdf["label"].tolist())]
            except Exception:
                vecs = [None] * len(pdf)
            yield pd.DataFrame({"label": pdf["label"], "vec": vecs})

    return labels.select("label").distinct().mapInPandas(run, "label string, vec array<double>").where("vec is not null")


def judged(nominees: DataFrame, options: Options) -> DataFrame:
    """(gid, same, confidence) of the first nominees by ordinal, as many as the budget allows; no answer where the judge fails."""

    def run(batches):
        for pdf in batches:
            try:
                answers = [(bool(s), float(c)) for s, c in options.judge(pdf["label"].tolist(), pdf["entity_label"].tolist())]
                if len(answers) != len(pdf):
                    raise ValueError("an answer for each pair")
            except Exception:
                answers = [(None, None)] * len(pdf)
            yield pd.DataFrame({"gid": pdf["gid"], "same": [a[0] for a in answers], "confidence": [a[1] for a in answers]}).astype({"same": "object"})

    asked = nominees.orderBy("ordinal", "gid").limit(options.judge_budget).select("gid", "label", "entity_label")
    return asked.mapInPandas(run, "gid long, same boolean, confidence double")


def phonetic_index(catalog_keys: DataFrame) -> DataFrame:
    """(kind, key, lo, hi, entities) of (entity_id, kind, key): a row for each key, however many entities share it."""
    return catalog_keys.groupBy("kind", "key").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"), F.count_distinct("entity_id").alias("entities"))


def phonetic_hits(asked: DataFrame, catalog_keys: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """(gid, entity_id): what (gid, kind, key) points to where that is one entity.

    Keys meet the index, one row each, so a key that many share fans out into nothing. Only where some entities are
    rejected for a group (gid, entity_id) are a key's entities listed, and only if they are few enough for one to be left.
    """
    index = phonetic_index(catalog_keys)
    met = asked.join(_spread(index), ["kind", "key"])
    if rejected is not None:
        met = met.join(_spread(rejected.groupBy("gid").agg(F.count("*").alias("less"))), "gid", "left")
        listed = met.where(F.col("entities") <= F.col("less") + 1).select("gid", "kind", "key").join(_spread(catalog_keys.distinct()), ["kind", "key"])
        listed = listed.join(_spread(rejected), ["gid", "entity_id"], "left_anti").select("gid", F.col("entity_id").alias("lo"), F.col("entity_id").alias("hi"))
        met = met.where(F.col("less").isNull() | (F.col("entities") > F.col("less") + 1)).select("gid", "lo", "hi").unionByName(listed)
    return met.groupBy("gid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo = hi").select("gid", F.col("lo").alias("entity_id"))


def nearest(asked: DataFrame, vectors: DataFrame, most: int, rows: int = 1024) -> DataFrame:
    """(vec_id, near, score): the ``most`` vectors of ``vectors`` nearest to each of ``asked`` by cosine, ties by id, itself left out.

    Both sides (vec_id, embedding) are dealt into blocks of about ``rows``; every two blocks meet in one matrix
    product, and only its best rows go on. Vectors without a length have a cosine of 0.
    """

    def dealt(side: DataFrame) -> DataFrame:
        blocks = max(1, -(-side.count() // rows))
        own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
        packed = side.where("embedding is not null").select("vec_id", "embedding", own.alias("block"))
        return packed.groupBy("block").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("v"))  # a block is bounded

    def product(batches):
        for pdf in batches:
            for left, right in zip(pdf["x"], pdf["y"], strict=True):
                ids, near = (np.array([r["vec_id"] for r in side]) for side in (left, right))
                x, y = (np.array([r["embedding"] for r in side], dtype=np.float64) for side in (left, right))
                x, y = (v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1) for v in (x, y))
                score = np.round(x @ y.T, DECIMALS)
                score[ids[:, None] == near[None, :]] = -np.inf
                top = np.lexsort((np.broadcast_to(near, score.shape), -score), axis=1)[:, :most]
                out = pd.DataFrame({"vec_id": np.repeat(ids, top.shape[1]), "near": near[top].reshape(-1), "score": np.take_along_axis(score, top, 1).reshape(-1)})
                yield out[np.isfinite(out["score"])]

    pairs = dealt(asked).select(F.col("v").alias("x")).crossJoin(dealt(vectors).select(F.col("v").alias("y")))  # blocks of a stated query set against all
    best = pairs.repartition(F.spark_partition_id()).mapInPandas(product, "vec_id long, near long, score double")
    ranked = best.withColumn("k", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.col("score").desc(), "near")))
    return ranked.where(F.col("k") <= most).drop("k")


def resolve_candidates(candidates: DataFrame, catalog: DataFrame, options: Options = Options(), log: DataFrame | None = None) -> DataFrame:
    """(ref, entity_id, basis, score, requires_review) for every candidate.

    ``candidates``: ref, kind, label and, where known, aliases, context, ordinal. ``catalog``: id, kind, label,
    aliases. Candidates of equal kind, match keys and context are resolved once.
    """
    for name, kind in (("aliases", "array<string>"), ("context", "string"), ("ordinal", "long")):
        if name not in candidates.columns:
            candidates = candidates.withColumn(name, F.lit(None).cast(kind))
    keyed = candidates.withColumn("norm", normalize_name(F.col("label"), options.compose))
    alias_key = F.array_join(F.array_sort(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: normalize_name(a, compose=False))), "\1")
    keyed = keyed.withColumn("gid", F.xxhash64("kind", "norm", alias_key, F.coalesce("context", F.lit("\0"))))
    first = F.struct(F.coalesce("ordinal", F.lit(0)).alias("o"), "label", "aliases")
    groups = keyed.groupBy("gid", "kind", "norm", "context").agg(F.min_by(F.struct("label", "aliases"), first).alias("f"), F.min(F.coalesce("ordinal", F.lit(0))).alias("ordinal"))
    groups = cut(groups.select("gid", "kind", "norm", "context", "f.label", "f.aliases", "ordinal"))

    known = catalog.select(F.col("id").alias("entity_id"), "kind", "label", "aliases")
    cat_forms = cut(_forms(known, "entity_id", options).select("entity_id", F.col("kind").alias("rkind"), F.col("raw").alias("rraw"), F.col("form").alias("rform")))
    forms = cut(_forms(groups, "gid", options))
    none = None
    if log is not None:
        said = decisions.lookup(groups.select("gid", F.col("norm").alias("surface"), "kind", "context"), log)
        said = cut(said)
        none = said.select("gid", F.explode("rejected").alias("entity_id"))
        told = said.where("confirmed is not null").select("gid", F.col("confirmed").alias("entity_id")).join(_spread(known.select("entity_id")), "entity_id", "left_semi")
        resolved = cut(told.select("gid", "entity_id", F.lit("remembered").alias("basis"), F.lit(1.0).alias("score"), F.lit(False).alias("requires_review")))
    else:
        resolved = groups.where(F.lit(False)).select("gid", F.lit("").alias("entity_id"), F.lit("").alias("basis"), F.lit(0.0).alias("score"), F.lit(False).alias("requires_review"))

    allowed = lambda hits: hits if none is None else hits.join(_spread(none), ["gid", "entity_id"], "left_anti")
    left = lambda df: df.join(_spread(resolved), "gid", "left_anti")
    few = cat_forms.count() <= BROADCAST_FORMS
    catalogued = lambda df: F.broadcast(df) if few else _spread(df)

    exact = left(forms).join(catalogued(cat_forms), (F.col("kind") == F.col("rkind")) & (F.col("form") == F.col("rform"))).select("gid", "entity_id", F.lit(1.0).alias("score"))
    resolved = resolved.unionByName(cut(_best(allowed(exact), "exact", F.col("entities") > 1).drop("entities")))  # a stage's hits are written once

    schemes = default_schemes() if options.phonetic_schemes is None else options.phonetic_schemes
    if schemes:
        keys = lambda raw: F.explode(phonetic_keys(raw, schemes, options.compose))
        a = left(forms).select("gid", "kind", keys(F.col("raw")).alias("key"))
        b = cat_forms.select("entity_id", F.col("rkind").alias("kind"), keys(F.col("rraw")).alias("key"))
        sound = phonetic_hits(a.distinct(), b.distinct(), none)
        resolved = resolved.unionByName(cut(sound.select("gid", "entity_id", F.lit("phonetic").alias("basis"), F.lit(options.phonetic_score).alias("score"), F.lit(True).alias("requires_review"))))

    big = options.lsh_cutover is not None and catalog.count() > options.lsh_cutover
    gated = left(groups).where(passes_entropy_gate(F.col("norm"), options.entropy_threshold)).select("gid")
    sides = forms.join(_spread(gated), "gid", "left_semi").select(F.col("gid").alias("id"), "kind", "form"), cat_forms.select(F.col("entity_id").alias("rid"), "rkind", "rform")
    close = fuzzy_pairs(sides[0], catalogued(sides[1]), options.fuzzy_threshold, big).groupBy(F.col("id").alias("gid"), F.col("rid").alias("entity_id")).agg(F.max("score").alias("score"))
    close = cut(allowed(close))
    top = close.groupBy("gid").agg(F.max("score").alias("top"))
    near = close.join(_spread(top), "gid").groupBy("gid").agg(F.count_if(F.col("score") >= F.col("top") - options.ambiguity_margin).alias("rivals"))
    fuzzy = _best(close, "fuzzy", F.lit(True)).drop("entities").join(_spread(near), "gid")
    nominees = fuzzy
    resolved_fuzzy = resolved.unionByName(fuzzy.drop("rivals"))

    if options.embedder is not None:
        waiting = cut(groups.join(_spread(resolved_fuzzy), "gid", "left_anti").select("gid", "kind", "label"))
        vec = cut(_embedded(waiting.select("label").union(known.select("label")), options.embedder))  # each label is embedded once
        index = VectorIndex(known.select(F.col("entity_id").alias("id"), "kind", "label").join(_spread(vec), "label"))
        asked = waiting.join(_spread(vec), "label").select(F.col("gid").alias("id"), "kind", "vec")
        if none is not None:
            asked = asked.join(_spread(none.groupBy(F.col("gid").alias("id")).agg(F.collect_set("entity_id").alias("banned"))), "id", "left")
        like = index.nearest(asked, 1, options.embedding_threshold, options.embedding_probes)
        found = cut(like.select(F.col("id").alias("gid"), F.col("near").alias("entity_id"), F.lit("embedding").alias("basis"), "score", F.lit(True).alias("requires_review")))
        nominees = nominees.unionByName(found.withColumn("rivals", F.lit(1).cast("long")))

    if options.judge is not None:
        sure = nominees.where("rivals = 1").join(_spread(groups.select("gid", "label", "ordinal")), "gid").join(_spread(known.select("entity_id", F.col("label").alias("entity_label"))), "entity_id")
        said = cut(judged(sure, options))
        nominees = nominees.join(said, "gid", "left").select(
            "gid", F.when(F.col("same").isNull() | F.col("same"), F.col("entity_id")).alias("entity_id"), F.when(F.col("same").isNull(), F.col("basis")).when(F.col("same"), "judge").otherwise("none").alias("basis"),
            F.when(F.coalesce("same", F.lit(False)), F.col("confidence")).otherwise(F.col("score")).alias("score"), F.lit(True).alias("requires_review"), "rivals",
        )

    resolved = resolved.unionByName(nominees.drop("rivals"))
    out = keyed.select("ref", "gid").join(_spread(resolved), "gid", "left")
    return out.select("ref", "entity_id", F.coalesce("basis", F.lit("none")).alias("basis"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("requires_review", F.lit(True)).alias("requires_review"))
