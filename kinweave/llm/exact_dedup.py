"""Exact deduplication by a stateful stream over content digests.

The keyed state lives in RocksDB on disk and never expires; for every digest of a normalised text it retains
the row that stays (its length, stable identifier and content locator), the locator of the row that came first,
and the number of rows. A second stream over the same rows checks each hit of a batch byte by byte against the
text that came first, which it finds through the locator; rows that arrive later are checked when they do. Should
a digest ever stand for several texts, its rows are grouped anew by their whole texts.

Normalised: without ``[\\x20\\x09-\\x0D]``; null counts as empty. Of equal texts the row with the most code
points stays, then the smallest id (null last), then one of the repeated rows. Empty texts are equal to each
other. A table without rows gives a table without rows. ``kept()`` has the columns of the documents, whatever
their names. What was staged is deleted once the decisions are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.names import Veil
from kinweave.llm.storage import cut, drop_path, fresh_path

#: Rows of a lookup that is broadcast (some 100 bytes each); a larger one is joined by shuffling.
BROADCAST_ROWS = 100_000
# Many small stores share a disk: they don't reserve space ahead (4 MB each otherwise).
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(rows: DataFrame) -> DataFrame:
    """Staged rows with their content locator: the file and the place in it where the text is stored."""
    at = F.concat(F.col("_metadata.file_path"), F.lit("#"), F.col("_metadata.row_index"))
    rows = rows if "locator" in rows.columns else rows.withColumn("locator", at)
    return rows if "epoch" in rows.columns else rows.withColumn("epoch", F.lit(0).cast("long"))


def keyed(rows: DataFrame) -> DataFrame:
    """The stateful step, for a stream or a table of (digest, chars, ident, row, locator, epoch)."""
    best = F.struct((-F.col("chars")).alias("less"), F.col("ident").isNull().alias("none"), "ident", "row", "locator")
    return rows.groupBy("digest").agg(F.min(best).alias("best"), F.count("*").alias("rows"), F.max(F.struct((-F.col("epoch")).alias("less"), (-F.col("row")).alias("row"), "locator")).alias("anchor"))


def stage(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, epoch: int = 0) -> None:
    """Append ``docs`` to the rows below ``path``; each later addition has a larger ``epoch``."""
    text = normalised(docs[text_col])
    marks = docs.select(digest(text).alias("digest"), F.coalesce(F.length(docs[text_col]), F.lit(0)).alias("chars"), docs[id_col].alias("ident"), F.lit(epoch).cast("long").alias("epoch"), text.alias("norm"))
    marks.withColumn("row", F.monotonically_increasing_id()).write.mode("append").option("compression", "zstd").parquet(path)


def run_stream(spark: SparkSession, staged: str, schema, checkpoint: str, files_per_batch: int | None = None) -> None:
    """Feed what is new below ``staged`` into the state; call it again as rows arrive."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        sink = keyed(located(_reader(spark, schema, files_per_batch).parquet(staged))).writeStream.format("noop").outputMode("update")
        sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _reader(spark: SparkSession, schema, files_per_batch: int | None):
    reader = spark.readStream.schema(schema)
    return reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader


def check_stream(spark: SparkSession, staged: str, schema, checkpoint: str, files_per_batch: int | None = None) -> None:
    """Compare the bytes of what is new below ``staged``, and a hit in the state, with the text that its digest came
    with first, found through the state's locator. Runs after each ``run_stream``; a batch that comes again changes nothing."""

    def check(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        here.conf.set("spark.sql.adaptive.enabled", "true")  # streams switch it off; hot digests need split joins
        groups = here.read.parquet(f"{checkpoint}-groups")
        side = _bounded(groups, groups.count())
        first = located(here.read.schema(schema).parquet(staged).select("digest", "norm", "epoch", "_metadata"))
        first = first.join(side.withColumnRenamed("anchor", "locator"), ["digest", "locator"]).select("digest", F.col("norm").alias("first"))
        hits = located(batch).join(side, "digest").where("locator != anchor").select("digest", "norm")
        odd = hits.join(first, "digest").where("norm != first").select("digest").distinct()
        odd.write.mode("overwrite").parquet(f"{checkpoint}-odd/batch={number}")

    read_state(spark, checkpoint).where("group_size > 1").select("digest", "anchor").write.mode("overwrite").parquet(f"{checkpoint}-groups")
    rows = _reader(spark, schema, files_per_batch).parquet(staged).select("digest", "norm", "epoch", "_metadata")
    rows.writeStream.foreachBatch(check).option("checkpointLocation", f"{checkpoint}-bytes").trigger(availableNow=True).start().awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, keep_chars, keep_id, keep_row, locator, group_size, anchor) as the state holds them."""
    state = spark.read.format("statestore").load(checkpoint)
    best, rows, anchor = (f"value.{f.name}" for f in state.schema["value"].dataType.fields)
    return state.select(
        F.col("key.digest").alias("digest"), (-F.col(f"{best}.less")).alias("keep_chars"), F.col(f"{best}.ident").alias("keep_id"), F.col(f"{best}.row").alias("keep_row"),
        F.col(f"{best}.locator").alias("locator"), F.col(rows).alias("group_size"), F.col(f"{anchor}.locator").alias("anchor"),
    )


def odd_digests(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The digests that stand for several texts, as all checks so far found them."""
    return spark.read.schema("digest binary, batch int").parquet(f"{checkpoint}-odd").select("digest").distinct()


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class ExactDedup:
    """Decisions on ``docs``: ``rows`` has one row for each document, ``kept()`` the documents that stay."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None):
        spark = docs.sparkSession
        self._veil = Veil(docs)
        docs, id_col, text_col = self._veil.docs, self._veil.name(id_col), self._veil.name(text_col)
        self.docs, self.ident, self.text, self.digest = docs, docs[id_col], normalised(docs[text_col]), digest
        self.chars = F.coalesce(F.length(docs[text_col]), F.lit(0))
        path, checkpoint = fresh_path(spark, "dedup-rows"), fresh_path(spark, "dedup-state")
        stage(docs, path, id_col, text_col, digest)
        staged = spark.read.parquet(path)
        self.split = None
        if staged.isEmpty():
            decided = staged.select(F.col("ident").alias("doc_id"), F.col("ident").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", "chars")
        else:
            run_stream(spark, path, staged.schema, checkpoint, files_per_batch)
            check_stream(spark, path, staged.schema, checkpoint, files_per_batch)
            rows = staged.select("digest", "chars", "ident", "row").join(read_state(spark, checkpoint).drop("locator", "anchor"), "digest")
            decided = rows.select(F.col("ident").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest", "chars")
            odd = cut(odd_digests(spark, checkpoint))
            if not odd.isEmpty():
                self.split = odd
                decided = decided.join(odd, "digest", "left_anti").unionByName(self._regrouped())
        self.rows = cut(decided)
        for gone in (path, checkpoint, *(f"{checkpoint}-{x}" for x in ("bytes", "groups", "odd"))):
            drop_path(spark, gone)

    def _regrouped(self) -> DataFrame:
        """Rows of the digests in ``split``, decided by whole texts."""
        texts = self.docs.select(self.digest(self.text).alias("digest"), self.chars.alias("chars"), self.ident.alias("ident"), self.text.alias("norm"))
        odd = cut(texts.join(self.split, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()).withColumn("locator", F.lit("")))
        best = F.struct((-F.col("chars")).alias("less"), F.col("ident").isNull().alias("none"), "ident", "row")
        groups = odd.groupBy("norm").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
        return odd.join(groups, "norm").select(F.col("ident").alias("doc_id"), F.col("best.ident").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest", "chars")

    def kept(self) -> DataFrame:
        """The documents that stay, with their columns."""
        losers = cut(self.rows.where("not kept").groupBy("digest", "chars", "doc_id").count())
        lost = _bounded(losers, losers.count())
        marked = self.docs.withColumns({"__digest": self.digest(self.text), "__chars": self.chars})
        same = (F.col("__digest") == lost["digest"]) & (F.col("__chars") == lost["chars"]) & self.ident.eqNullSafe(lost["doc_id"])
        out = marked.join(lost, same, "left_anti")
        if self.split is None:
            # repeated rows agree with the one that stays in id, text and length: of those, one comes back
            twins = losers.join(self.rows.where("kept").select("digest", "chars", "doc_id").withColumnRenamed("doc_id", "__id"), ["digest", "chars"]).where(F.col("doc_id").eqNullSafe(F.col("__id"))).select("digest", "chars", "doc_id")
            twins = cut(twins)
            if twins.isEmpty():
                return self._veil.lift(out.drop("__digest", "__chars"))
            again = (F.col("__digest") == twins["digest"]) & (F.col("__chars") == twins["chars"]) & self.ident.eqNullSafe(twins["doc_id"])
            back = marked.join(_bounded(twins, twins.count()), again, "left_semi").dropDuplicates(["__digest"])
            return self._veil.lift(out.unionByName(back).drop("__digest", "__chars"))
        stay = self.docs.withColumns({"__digest": self.digest(self.text), "__chars": self.chars, "__norm": self.text, "__none": self.ident.isNull()})
        order = Window.partitionBy("__norm").orderBy(F.col("__chars").desc(), self.ident.asc_nulls_last())
        odd = stay.join(self.split.withColumnRenamed("digest", "__digest"), "__digest", "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1")
        even = out.join(self.split.withColumnRenamed("digest", "__digest"), "__digest", "left_anti")
        return self._veil.lift(even.select(*self.docs.columns).unionByName(odd.select(*self.docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document with the row that stays in its stead."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ExactDedup(docs).rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op10_exact_dedup": query}

ORACLE_SQL = {
    "op10_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
r AS (
  SELECT *, row_number() OVER w AS n, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size
  FROM d WINDOW w AS (PARTITION BY h ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, n = 1 AS kept, h AS text_sha256 FROM r
"""
}
