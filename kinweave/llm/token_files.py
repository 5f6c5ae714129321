"""Token ids as Parquet list columns, in files that give up single documents, ranges and metadata without the rest.

Documents are put in order of their id once, as texts, and encoded behind that sort, so that every file is a run
of the order and holds for each document its id, its tokens, their number and the number of tokens before it in the
file. A manifest has a row for each file: where it begins in the whole stream. A position in the stream is thus
(start of the file) + (tokens before), known without reading a token.

Token ids are dictionary encoded (packed to the bits that the vocabulary needs) or delta encoded, the other integers
always delta encoded. Row groups and pages are of a stated size, and pages have their index, so that a reader skips the
files, row groups and pages outside of what it asks for: ids ascend in every file.

Null texts count as empty and hold the end id alone. Null ids come first. Rows with the same id are ordered by a
hash of their text; such rows may lie in several files, so a hot id is no hot file. A long text is one row. Empty
tables make one file without rows. Other columns are left out, or kept as they are in the struct ``meta``, where
their names clash with nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.bpe import Codec, default_tokenizer
from kinweave.llm.storage import arrow_rows, fresh_path
from kinweave.llm.words import lean

END = 2
#: Bytes of text that a file is made from.
FILE_BYTES = 256 << 20
#: Files are made smaller than that, down to these bytes of text, while there are fewer of them than tasks that can run.
LEAST_BYTES = 8 << 20
#: Bytes of a row group and of a page, before compression.
ROW_GROUP, PAGE = 16 << 20, 256 << 10
#: Texts encoded at once.
_ROWS = 500


def _encode(path: str, end: int, kept: int):
    """(doc_id, meta.., part, before, n_tokens, tokens) of (doc_id, meta.., text), a running number of tokens in ``before``."""

    def run(batches):
        codec, before, part = Codec.load(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                own = batch.slice(lo, _ROWS)
                found = codec.encode(own.column(kept).cast(pa.binary()).to_pylist())
                ids = np.concatenate([x for i in found for x in (i, np.array([end], np.uint32))]).astype(np.int32)
                sizes = np.array([len(i) + 1 for i in found], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                marks = [pa.array(np.full(len(sizes), part, dtype=np.int32)), pa.array(before + offsets[:-1]), pa.array(sizes), lists]
                yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(kept)), *marks], names=[*own.schema.names[:kept], "part", "before", "n_tokens", "tokens"])
                before += int(offsets[-1])

    return run


def _layout(encoding: str, row_group: int, page: int) -> dict[str, str]:
    """Options of the Parquet writer."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding: {encoding}")
    return {
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": str(row_group), "parquet.page.size": str(page), "parquet.page.write-checksum.enabled": "true",
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": str(encoding == "dictionary").lower(), "parquet.dictionary.page.size": str(4 << 20),
    }


def write(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END, meta: Sequence[str] = (),
    encoding: str = "dictionary", row_group: int = ROW_GROUP, page: int = PAGE, file_bytes: int = FILE_BYTES,
) -> TokenFiles:
    """Encode ``docs`` in order of their id into new files below ``path``; ``end`` closes every document."""
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    files = max(1, -(-size // file_bytes), min(2 * spark.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)))
    kept = [docs[id_col].alias("doc_id"), *([F.struct(*(docs[c] for c in meta)).alias("meta")] if meta else [])]
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    rows = docs.select(*kept, text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("tie", "row")
    added = [T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*dealt.schema.fields[: len(kept)], *added])
    with arrow_rows(spark, 2 * _ROWS):
        dealt.mapInArrow(lean(_encode(tokenizer or default_tokenizer(), end, len(kept))), schema).write.options(**_layout(encoding, row_group, page)).parquet(f"{path}/tokens")
    counts = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).orderBy("part").collect()  # a row for each file
    manifest, base = [], 0
    for r in counts:
        manifest.append((r["part"], base, r["n"], r["docs"]))
        base += r["n"]
    spark.createDataFrame(manifest, "part int, base long, file_tokens long, file_docs long").coalesce(1).write.parquet(f"{path}/manifest")
    return TokenFiles(spark, path)


class TokenFiles:
    """What ``write`` has left below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def manifest(self) -> DataFrame:
        """(part, base, file_tokens, file_docs), a row for each file."""
        return self.spark.read.parquet(f"{self.path}/manifest")

    def _placed(self, rows: DataFrame) -> DataFrame:
        base = F.broadcast(self.manifest().select("part", "base"))  # 12 bytes for each file of some 256 MB of text
        return rows.join(base, "part").withColumn("start", F.col("base") + F.col("before")).drop("part", "base", "before")

    def documents(self) -> DataFrame:
        """(doc_id, meta, n_tokens, start) of every document; the tokens aren't read."""
        return self._placed(self.spark.read.parquet(f"{self.path}/tokens").drop("tokens"))

    def read(self, low=None, high=None) -> DataFrame:
        """Documents with their tokens: all, or those with ids from ``low`` to ``high``, of which only the pages are read that may hold them."""
        rows = self.spark.read.parquet(f"{self.path}/tokens")
        if low is not None:
            rows = rows.where(F.col("doc_id") >= low)
        if high is not None:
            rows = rows.where(F.col("doc_id") <= high)
        return self._placed(rows)

    def span(self, first: int, last: int) -> DataFrame:
        """(doc_id, start, tokens): the stream from position ``first`` to before ``last``, in documents or parts of them."""
        within = self.manifest().where((F.col("base") < last) & (F.col("base") + F.col("file_tokens") > first)).agg(F.min("part").alias("a"), F.max("part").alias("b"), F.min("base").alias("base")).first()
        rows = self.spark.read.parquet(f"{self.path}/tokens")
        rows = rows.where(F.lit(False)) if within["a"] is None else rows.where(F.col("part").between(within["a"], within["b"]) & (F.col("before") < last - within["base"]))
        rows = self._placed(rows).where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
        skip = F.greatest(F.lit(0), F.lit(first) - F.col("start"))
        length = F.least(F.col("n_tokens"), F.lit(last) - F.col("start")) - skip
        return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("tokens", (skip + 1).cast("int"), length.cast("int")).alias("tokens"))


def checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents as ``read`` gives them, from their tokens as unsigned 32-bit little-endian integers."""

    def run(batches):
        for batch in batches:
            tokens = batch.column(2)
            values = np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8)
            at = tokens.offsets.to_numpy().astype(np.int64)
            crcs = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    asked = rows.select("doc_id", "start", "tokens")
    schema = T.StructType([asked.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return asked.mapInArrow(lean(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every document written as a list of token ids in order of doc_id, and what the files then hold of it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return checksums(write(docs, fresh_path(spark, "token-files")).read())


QUERIES = {"op11_token_files": query}

ORACLE_SQL: dict[str, str] = {}
