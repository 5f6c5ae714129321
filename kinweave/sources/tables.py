"""The graph's relations as append-only change logs in Parquet, and the operations of a store on them.

A row is a version of a record; the latest by (version) counts. Writes append, so a write that is repeated
after a failure changes nothing that is read. Created records get an id of their own, written once: records that
agree in all fields are still different ones. Logs lie in folders by a hash of the id, so that what is asked by id is read
from its folder alone. Versions come from the writer's clock and a random part, so that
writers needn't agree on a number; ``compact`` leaves the latest versions alone. All versions of a record agree in the ``FIXED`` columns,
so filters on those reach the scan.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.operators.graph import plan_document_deletion

#: What a create fills in where it isn't given.
_DEFAULTS = {
    "entities": {"created_at": "current_timestamp()"}, "mentions": {"created_at": "current_timestamp()", "status": "'pending'", "confidence": "1.0D"},
    "edges": {"recorded_at": "current_timestamp()"}, "episodes": {"ingested_at": "current_timestamp()"},
}
RELATIONS = {"entities": schemas.ENTITY, "mentions": schemas.MENTION, "edges": schemas.EDGE, "episodes": schemas.EPISODE}
_NEWEST = {"entities": "created_at", "edges": "recorded_at", "episodes": "ingested_at", "mentions": "created_at"}

#: What no version of a record changes.
FIXED = {
    "entities": ("kind",), "mentions": ("source_id", "kind"),
    "edges": ("source_entity_id", "target_entity_id", "predicate"), "episodes": ("source_id",),
}

#: Folders that the ids of a log are dealt into.
BUCKETS = 16


def _bucket(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(BUCKETS)).cast("int")


def _fields(name: str) -> list[str]:
    return [c.split()[0] for c in RELATIONS[name].split(", ")]


def latest(log: DataFrame, fixed: Sequence[str] = ()) -> DataFrame:
    """The newest version of every id. ``fixed`` columns are grouped by as well, so that the optimizer moves filters on them below the aggregate."""
    keys = ("id", *fixed)
    columns = [c for c in log.columns if c not in ("version", "bucket")]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in columns if c not in keys)), "version").alias("r"))
    return newest.select(*(c if c in keys else f"r.{c}" for c in columns))


class GraphTables:
    """Relations below ``path``; ``migrate`` makes the empty ones."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._last = spark, path.rstrip("/"), 0

    def migrate(self) -> None:
        for name, schema in RELATIONS.items():
            self._write(self.spark.createDataFrame([], f"{schema}, version long"), f"{self.path}/{name}")

    def log(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{RELATIONS[name]}, version long, bucket int").parquet(f"{self.path}/{name}")

    def _write(self, rows: DataFrame, path: str, dealt: bool = False) -> None:
        """Rows with their version, into the folders of their ids: from every task a file for each folder, or, with ``dealt``, a file for
        each folder at the price of a shuffle. Batches of streams are dealt, as they are many and small."""
        placed = rows.withColumn("bucket", _bucket(F.col("id")))
        (placed.repartition(BUCKETS, "bucket") if dealt else placed).write.mode("append").partitionBy("bucket").parquet(path)

    def read(self, name: str) -> DataFrame:
        """The relation as it is; arrays that are missing are empty."""
        return self._whole(latest(self.log(name), FIXED[name]))

    def views(self, prefix: str = "") -> None:
        """Temporary views of the relations, for SQL: ``<prefix>entities`` and so on, as they are when queried."""
        for name in RELATIONS:
            self.read(name).createOrReplaceTempView(f"{prefix}{name}")

    def _whole(self, out: DataFrame) -> DataFrame:
        arrays = [c for c, t in out.dtypes if t.startswith("array")]
        return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in arrays})

    def read_some(self, name: str, ids: DataFrame) -> DataFrame:
        """The records of ``ids`` (id): their folders are read, and only their versions are compared."""
        wanted = ids.select("id").distinct()
        buckets = [r["b"] for r in wanted.select(_bucket(F.col("id")).alias("b")).distinct().collect()]  # as many as folders
        return self._whole(latest(self.log(name).where(F.col("bucket").isin(buckets)).join(wanted, "id", "left_semi")))

    def _version(self) -> int:
        """Above those there are: microseconds, then 10 random bits."""
        self._last = max(time.time_ns() // 1000, self._last + 1)
        return self._last << 10 | random.getrandbits(10)

    def append(self, name: str, rows: DataFrame, version: int | None = None) -> None:
        """Add records, or new versions of records, which keep their ``FIXED`` columns."""
        marked = rows.select(*_fields(name), F.lit(self._version() if version is None else version).cast("long").alias("version"))
        self._write(marked, f"{self.path}/{name}")

    def compact(self, name: str, path: str) -> None:
        """The latest versions of a relation as the log of a store at ``path``, which goes on from it."""
        log = self.log(name).drop("bucket")
        top = log.groupBy("id").agg(F.max_by(F.struct(*log.columns), "version").alias("r")).select("r.*")
        self._write(top, f"{path}/{name}", dealt=True)

    def _filled(self, name: str, rows: DataFrame) -> DataFrame:
        """Whole records: ids and what else isn't given are made here, arrays keep order and repeats."""
        have = set(rows.columns)
        given = {}
        for field in RELATIONS[name].split(", "):
            column, kind = field.split()
            default = F.expr("uuid()") if column == "id" else F.expr(_DEFAULTS[name].get(column, "null")).cast(kind)
            value = F.coalesce(F.col(column).cast(kind), default) if column in have else default
            given[column] = F.coalesce(value, F.array().cast(kind)) if kind.startswith("array") else value
        return rows.select(*(v.alias(k) for k, v in given.items()))

    def create(self, name: str, rows: DataFrame) -> DataFrame:
        """Add a record for each row, as it was written."""
        version = self._version()
        self.append(name, self._filled(name, rows), version)
        return self.log(name).where(F.col("version") == version).drop("version", "bucket")  # as written, as ids are random

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _put_once(self, name: str, stream: str, batch_id: int, rows: DataFrame) -> None:
        """Add what a batch of a stream holds, however often it comes.

        Its records are first written under the batch's number, with their ids and their version; a batch that comes again finds
        them there and adds those, or nothing if it was done. Rows that are added twice are equal, and so change nothing.
        """
        staged = f"{self.path}/_streams/{stream}/{name}-{batch_id}"
        if self._exists(f"{staged}/done"):
            return
        if not self._exists(f"{staged}/rows/_SUCCESS"):
            rows.select(*_fields(name), F.lit(self._version()).alias("version")).write.mode("overwrite").parquet(f"{staged}/rows")
        self._write(self.spark.read.schema(f"{RELATIONS[name]}, version long").parquet(f"{staged}/rows"), f"{self.path}/{name}", dealt=True)
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{staged}/done")

    def create_sink(self, name: str, stream: str) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: a record for each row; ``stream`` names the query, as its checkpoint does."""
        return lambda batch, batch_id: self._put_once(name, stream, batch_id, self._filled(name, batch))

    def change_sink(self, name: str, stream: str, columns: Sequence[str]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: rows of (id, ``columns``) replace these columns of their records. Of several rows of an id in a batch the
        greatest counts. ``FIXED`` columns can't be among them."""
        if set(columns) & set(FIXED[name]):
            raise ValueError(f"fixed columns of {name}: {', '.join(FIXED[name])}")

        def put(batch: DataFrame, batch_id: int) -> None:
            one = batch.groupBy("id").agg(F.max(F.struct(*columns)).alias("c")).select("id", *(F.col(f"c.{c}").alias(c) for c in columns))
            self._put_once(name, stream, batch_id, self._changed(name, one, {c: F.col(f"__{c}") for c in columns}))

        return put

    def edge_sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch`` on what ``apply_facts_stream`` emits: new edges are added, known ones get a version with their new end and
        support; when they were recorded, and whether they are expired, stays. Of several rows of an edge in a batch the last to close it counts."""

        def put(batch: DataFrame, batch_id: int) -> None:
            fields = [c for c in _fields("edges") if c in batch.columns and c != "id"]
            newest = F.max_by(F.struct(*fields), F.struct(F.col("invalid_at").isNotNull(), F.size("support")))
            one = batch.groupBy("id").agg(newest.alias("r")).select("id", "r.*")
            there = self.read_some("edges", one).select("id", F.col("recorded_at").alias("recorded"), F.col("expired_at").alias("expired"))
            self._put_once("edges", stream, batch_id, self._filled("edges", one.join(there, "id", "left").withColumnsRenamed({"recorded": "recorded_at", "expired": "expired_at"})))

        return put

    def create_entities(self, rows: DataFrame) -> DataFrame:
        return self.create("entities", rows)

    def create_mentions(self, rows: DataFrame) -> DataFrame:
        return self.create("mentions", rows)

    def create_edges(self, rows: DataFrame) -> DataFrame:
        return self.create("edges", rows)

    def create_episodes(self, rows: DataFrame) -> DataFrame:
        return self.create("episodes", rows)

    def delete_documents(self, sources: DataFrame) -> DataFrame:
        """Take the support of the mentions of ``sources`` (source_id) from the edges; returns the reviews of those that lost some."""
        path = f"{self.path}/_reviews/{uuid.uuid4().hex}"
        mentions = self.log("mentions").select("id", "source_id")  # no version changes these, so any will do
        plan_document_deletion(self.read("edges"), mentions, sources).write.parquet(path)  # before the edges change
        reviews = self.spark.read.parquet(path)
        changes = reviews.select(F.col("edge_id").alias("id"), F.col("remaining_support").alias("support"))
        self.append("edges", self._changed("edges", changes, {"support": F.col("__support")}, there=True))  # ids that were read from the edges
        return reviews

    def get(self, name: str, id_: str) -> DataFrame:
        one = self.log(name).where((F.col("bucket") == _bucket(F.lit(id_))) & (F.col("id") == id_))
        return self._whole(latest(one))

    def list(self, name: str, **where) -> DataFrame:
        """Records that agree with all given columns, oldest first. Fixed columns are compared in the scan, others in the newest versions."""
        out = self.read(name)
        for column, value in where.items():
            out = out.where(F.col(column) == value)
        return out.orderBy(_NEWEST[name], "id")

    def current_edges(self, **where) -> DataFrame:
        return self.list("edges", **where).where("expired_at is null")

    def _changed(self, name: str, changes: DataFrame, columns: dict[str, Column], there: bool = False) -> DataFrame:
        """The records that ``changes`` names by id, changed; ids that aren't there are an error, unless they are known to be ``there``."""
        found = self.read_some(name, changes)
        if not there:
            missing = changes.select("id").join(found, "id", "left_anti").limit(5).collect()
            if missing:
                raise KeyError(f"{name} not found: {', '.join(r['id'] for r in missing)}")
        return found.join(changes.withColumnsRenamed({c: f"__{c}" for c in changes.columns if c != "id"}), "id").withColumns(columns)

    def _change(self, name: str, changes: DataFrame, columns: dict[str, Column]) -> None:
        self.append(name, self._changed(name, changes, columns))

    def add_aliases(self, changes: DataFrame) -> None:
        """(id, alias): appended where it isn't there yet."""
        one = changes.groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("add"))
        self._change("entities", one, {"aliases": F.concat("aliases", F.array_except("__add", "aliases"))})

    def set_mention_status(self, changes: DataFrame) -> None:
        """(id, status[, entity_id]): without the column the link stays, a null clears it."""
        columns = {"status": F.col("__status")}
        if "entity_id" in changes.columns:
            columns["entity_id"] = F.col("__entity_id")
        self._change("mentions", changes, columns)

    def invalidate_edges(self, changes: DataFrame) -> None:
        """(id, invalid_at)."""
        self._change("edges", changes, {"invalid_at": F.col("__invalid_at")})

    def expire_edges(self, changes: DataFrame) -> None:
        """(id, expired_at)."""
        self._change("edges", changes, {"expired_at": F.col("__expired_at")})

    def set_edge_support(self, changes: DataFrame) -> None:
        """(id, support): replaced, an empty array clears it."""
        self._change("edges", changes, {"support": F.col("__support")})
