"""Mixing sources to target weights by capped water-filling.

Every source gets words in proportion to its weight; one that would exceed its largest number of epochs is
clamped there and its excess is shared by weight among the rest, until none is above. A source then takes
whole repetitions of all its documents and, in a seeded order, a last fractional repetition: documents up to
the words that are missing, the document at the border in part.

Each document's share is a function of (source, seeded hash, size), found by refining hash buckets, so no
source is ever gathered in one task; rows that agree in all three share what falls to them. Null texts have
size 0 and take nothing, null sources form one source (ordered last), null ids hash like an empty id, and an
empty table gives an empty table. Columns whose names clash with the added ones are replaced by
``mix`` and kept by ``repeated``; others are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.names import Veil
from kinweave.llm.storage import cut

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
#: Up to this many sources, their table is broadcast; beyond it, it is joined by shuffling.
BROADCAST_SOURCES = 100_000
_BITS = 12
_ADDED = ("size", "source_size", "target", "taken", "copies")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _hash(doc_id: Column, seed: str) -> Column:
    """40 seeded bits."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 10), 16, 10).cast("long")


def _ranked(sources: DataFrame, parts: int = 8) -> tuple[DataFrame, int]:
    """Adds ``__rank`` from 0 by code point, null last, without gathering the table; and the number of rows."""
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = cut(sources.repartitionByRange(parts, F.col("__source").asc_nulls_last()).sortWithinPartitions(F.col("__source").asc_nulls_last()).select("*", F.spark_partition_id().alias("__part"), own.alias("__own")))
    counts = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}  # a row for each partition
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    start = F.element_at(F.array(*map(F.lit, starts or [0])), F.col("__part") + 1)
    return dealt.withColumn("__rank", F.col("__own") + start), total


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> tuple[DataFrame, int]:
    """(__key, source size, target words, whole repetitions, words of the fractional one) by source; their number.

    ``sizes`` has __source, __key and __size.
    """
    sums = sizes.groupBy("__source", "__key").agg(F.sum("__size").alias("__total"))
    ranked, n = _ranked(sums)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int")).cast("long")
    table = cut(ranked.select("__key", "__total", weight.alias("__weight")))
    cap = F.col("__total") * epochs
    all_words = table.agg(F.sum("__total")).first()[0] or 0
    above, clamped, share = F.lit(False), -1, F.lit(0.0)
    while True:  # a pass over the sources for each round of clamping; only sums reach the driver
        r = table.agg(F.sum(F.when(above, cap)).alias("c"), F.sum(F.when(~above, F.col("__weight"))).alias("w"), F.count(F.when(above, 1)).alias("n")).first()
        if r["n"] == clamped:
            break
        clamped = r["n"]
        share = F.lit(float(all_words - (r["c"] or 0))) * F.col("__weight") / F.lit(float(r["w"] or 1))
        above = share > cap
    target = F.when(above, cap.cast("double")).otherwise(share)
    whole = F.when(F.col("__total") > 0, F.floor(target / F.col("__total"))).otherwise(0).cast("long")
    out = table.select("__key", "__total", target.alias("__target"), whole.alias("__whole"))
    extra = F.round(F.col("__target") - F.col("__whole") * F.col("__total")).cast("long")
    return cut(out.withColumn("__extra", extra)), n


def _border(rows: DataFrame, quota: DataFrame, keys: list[str], bucket: str, many: bool) -> DataFrame:
    """The bucket in which the running size of each key reaches its quota, and what the quota has left there."""
    side = quota if many else F.broadcast(quota)
    inside = rows.join(side, keys).groupBy(*keys, bucket).agg(F.sum("__size").alias("__sum"), F.first("__left").alias("__left"))
    before = F.sum("__sum").over(Window.partitionBy(*keys).orderBy(bucket)) - F.col("__sum")
    return inside.withColumn("__before", before).where((F.col("__before") < F.col("__left")) & (F.col("__before") + F.col("__sum") >= F.col("__left"))).select(*keys, bucket, (F.col("__left") - F.col("__before")).alias("__left"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Adds size, source_size, target, taken (words, repeats counted) and copies (whole rows, the last rounded)."""
    veil = Veil(docs)
    return veil.lift(_mixed(veil.docs, weights, epochs, seed, veil.name(id_col), veil.name(text_col), veil.name(source_col)))


def _mixed(docs: DataFrame, weights: tuple[int, ...], epochs: int, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text, source, ident = docs[text_col], docs[source_col], docs[id_col]
    high, low = F.shiftright("__hash", 40 - _BITS), F.shiftright("__hash", 40 - 2 * _BITS)
    marks = [source.cast("string").alias("__source"), _key(source).alias("__key"), word_count(text).alias("__size"), _hash(ident, seed).alias("__hash")]
    sizes = cut(docs.select(*marks))
    plan, n = targets(sizes, weights, epochs)
    many = n > BROADCAST_SOURCES
    rows = sizes.where("__size > 0").select("__key", "__size", "__hash", high.alias("__high"), low.alias("__low"))
    first = cut(_border(rows, plan.where("__extra > 0").select("__key", F.col("__extra").alias("__left")), ["__key"], "__high", many))
    second = cut(_border(rows, first, ["__key", "__high"], "__low", many))
    side = second if many else F.broadcast(second)
    last = rows.join(side, ["__key", "__high", "__low"]).groupBy("__key", "__hash", "__size").agg(F.count("*").alias("__n"), F.first("__left").alias("__left"))
    before = F.sum(F.col("__n") * F.col("__size")).over(Window.partitionBy("__key").orderBy("__hash", "__size")) - F.col("__n") * F.col("__size")
    part = F.least(F.col("__size"), F.floor(F.greatest(F.lit(0), F.col("__left") - F.col("__before")) / F.col("__n"))).cast("long")
    last = cut(last.withColumn("__before", before).select("__key", "__hash", "__size", part.alias("__part")))
    borders = plan.join(second.select("__key", F.col("__low").alias("__edge")), "__key", "left")
    kept = [c for c in docs.columns if c.lower() not in _ADDED]
    marked = docs.select(*(docs[c] for c in kept), *marks[1:])
    wide = marked.join(borders if many else F.broadcast(borders), "__key").join(last if many else F.broadcast(last), ["__key", "__hash", "__size"], "left")
    extra = F.coalesce(F.col("__part"), F.when(low < F.col("__edge"), F.col("__size")), F.lit(0))
    taken = (F.col("__whole") * F.col("__size") + extra).cast("long")
    copies = F.col("__whole") + F.when((F.col("__size") > 0) & (2 * extra >= F.col("__size")), 1).otherwise(0)
    return wide.select(*kept, F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"), taken.alias("taken"), copies.cast("int").alias("copies"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its copies say, with the same columns."""
    veil = Veil(docs, _ADDED)
    mixed = mix(veil.docs, **{k: veil.name(v) if k.endswith("_col") else v for k, v in options.items()})
    out = mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return veil.lift(out.select(*veil.docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents, weights 5, 2, 1, at most 3 epochs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op9_water_filling": query}

ORACLE_SQL = {
    "op9_water_filling": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 10))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER e, 0) AS r, sum(w) OVER () - coalesce(sum(w) OVER e, 0) AS sw,
         row_number() OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST) AS i
  FROM s WINDOW e AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT i, r, sw FROM o WHERE r::DOUBLE * w / sw::DOUBLE <= cap ORDER BY i LIMIT 1),
t AS (
  SELECT o.source, source_size, CASE WHEN o.i < f.i THEN cap::DOUBLE ELSE f.r::DOUBLE * w / f.sw::DOUBLE END AS target FROM o, f),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
p AS (
  SELECT *, round(target - whole * source_size)::BIGINT AS extra FROM q),
x AS (
  SELECT doc_id, size, source_size, target, whole,
         greatest(0, least(size, extra - (sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size)))::BIGINT AS part
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + part)::BIGINT AS taken,
       (whole + CASE WHEN size > 0 AND 2 * part >= size THEN 1 ELSE 0 END)::INT AS copies
FROM x
"""
}
