"""Not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

``resolve`` takes capture records: record_id, url, ts (seconds), kind (``response`` or ``revisit``), etag,
last_modified, headers (map, names in lower case). Every revisit gets the latest response of its canonical URL
with an earlier time; of responses at one time, the one with the largest record_id. Validators are checked: entity
tags, weakly compared, if both sides have one, else the modification times. Status is ``resolved``, ``unvalidated``
if neither can be compared, ``mismatch``, or ``orphan`` without an earlier response; the first two get merged headers:
the response's, overridden by those that a 304 may update.

The join goes through (URL, day): within a day by a running value, across days by the day's last response, of
which a URL has one row a day. A URL with very many records is so spread over its days, never gathered.

Records with a null url, ts or kind take no part; null headers count as none. Repeated records give a row each.
Extra columns are not returned; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds of a time bucket.
SPAN = 86_400
# Fields that describe the stored body or the connection, which a 304 doesn't update (RFC 9110, 9111).
KEPT = ("content-encoding", "content-length", "content-range", "content-type", "connection", "keep-alive", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")


def canonical(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a last slash, parameters sorted without trackers."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#[\s\S]*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?([\s\S]*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|fbclid|gclid|ref)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, canonical, ts, status, response_id, response_ts, headers) of every revisit."""
    rows = records.where(F.col("url").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isNotNull()).select(
        "record_id", canonical(F.col("url")).alias("canonical"), F.col("ts").cast("long").alias("ts"), "kind", "etag", "last_modified", "headers"
    )
    rows = rows.withColumn("__day", F.floor(F.col("ts") / SPAN)).withColumn("__full", F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "headers")))
    key = F.struct("ts", "record_id")
    # a revisit comes before responses of its own second, which aren't earlier
    within = Window.partitionBy("canonical", "__day").orderBy("ts", F.col("__full").isNotNull(), "record_id").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("__near", F.last("__full", ignorenulls=True).over(within)).where(F.col("kind") == "revisit").drop("__full")
    days = rows.groupBy("canonical", "__day").agg(F.max_by("__full", F.when(F.col("__full").isNotNull(), key)).alias("__full"))
    before = Window.partitionBy("canonical").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("canonical", "__day", F.last("__full", ignorenulls=True).over(before).alias("__far"))
    found = near.join(carried, ["canonical", "__day"], "left").withColumn("r", F.coalesce("__near", "__far"))
    tags = F.when(F.col("etag").isNotNull() & F.col("r.etag").isNotNull(), _opaque(F.col("etag")) == _opaque(F.col("r.etag")))
    times = F.when(F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull(), F.col("last_modified") == F.col("r.last_modified"))
    valid = F.coalesce(tags, times)
    status = F.when(F.col("r").isNull(), "orphan").when(valid.isNull(), "unvalidated").when(valid, "resolved").otherwise("mismatch")
    none = F.from_json(F.lit("{}"), "map<string,string>")
    own = F.map_filter(F.coalesce("headers", none), lambda k, v: ~k.isin(*KEPT) & v.isNotNull())
    merged = F.map_zip_with(F.coalesce("r.headers", none), own, lambda k, a, b: F.coalesce(b, a))
    return found.select(
        "record_id", "canonical", "ts", status.alias("status"), F.col("r.record_id").alias("response_id"), F.col("r.ts").alias("response_ts"),
        F.when(status.isin("resolved", "unvalidated"), merged).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A crawl of ``pages``: a response each, and by page_id revisits that agree, that don't, and that come too early."""
    page = F.col("page_id")
    tag, seen = F.md5(F.coalesce("html", F.lit(""))), F.lit(1_700_000_000) + page * 60
    length = F.coalesce(F.length("html"), F.lit(0)).cast("string")
    response = F.struct((page * 4).alias("record_id"), seen.alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), F.create_map(F.lit("content-length"), length, F.lit("date"), seen.cast("string"), F.lit("etag"), tag, F.lit("server"), F.lit("s1")).alias("headers"))

    def revisit(number: int, ts: Column, etag: Column) -> Column:
        headers = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), ts.cast("string"), F.lit("etag"), etag, F.lit("cache-control"), F.concat(F.lit("max-age="), (page % 1000).cast("string")))
        return F.struct((page * 4 + number).alias("record_id"), ts.alias("ts"), F.lit("revisit").alias("kind"), etag.alias("etag"), headers.alias("headers"))

    weak = F.concat(F.lit("W/"), tag)
    all_ = F.array(
        response, F.when(page % 2 == 0, revisit(1, seen + 86_430, weak)), F.when(page % 5 == 0, revisit(2, seen + 172_800, F.md5(F.coalesce("url", F.lit(""))))), F.when(page % 7 == 0, revisit(3, seen - 45, tag)),
    )
    return pages.select("url", F.explode(F.filter(all_, lambda r: r.isNotNull())).alias("r")).select("r.record_id", "url", "r.ts", "r.kind", "r.etag", F.lit(None).cast("string").alias("last_modified"), "r.headers")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: revisits in a crawl of all pages."""
    found = resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.select("record_id", "canonical", "ts", "status", "response_id", "response_ts", lines.alias("headers"))


QUERIES = {"op4_warc_revisits": query}

ORACLE_SQL = {
    "op4_warc_revisits": r"""
WITH a AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS tag, coalesce(length(html), 0) AS n, 1700000000 + page_id * 60 AS seen,
         regexp_replace(regexp_replace(url, '#(.|\n)*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages WHERE url IS NOT NULL AND page_id IS NOT NULL),
b AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(CASE WHEN contains(rest, '?') THEN substr(rest, strpos(rest, '?') + 1) ELSE '' END, '&'),
                   lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|fbclid|gclid|ref)(=|$)'))) AS q
  FROM a),
c AS (SELECT *, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM b),
p AS (SELECT page_id * 4 AS response_id, canonical, seen AS response_ts, tag AS response_tag, n FROM c),
v AS (
  SELECT page_id, page_id * 4 + 1 AS record_id, canonical, seen + 86430 AS ts, 'W/' || tag AS etag FROM c WHERE page_id % 2 = 0
  UNION ALL SELECT page_id, page_id * 4 + 2, canonical, seen + 172800, md5(url) FROM c WHERE page_id % 5 = 0
  UNION ALL SELECT page_id, page_id * 4 + 3, canonical, seen - 45, tag FROM c WHERE page_id % 7 = 0),
j AS (
  SELECT v.*, response_id, response_ts, response_tag, n, row_number() OVER (PARTITION BY record_id ORDER BY response_ts DESC NULLS LAST, response_id DESC) AS k
  FROM v LEFT JOIN p ON v.canonical = p.canonical AND response_ts < ts),
s AS (SELECT *, CASE WHEN response_id IS NULL THEN 'orphan' WHEN regexp_replace(etag, '^W/', '') = response_tag THEN 'resolved' ELSE 'mismatch' END AS status FROM j WHERE k = 1)
SELECT record_id, canonical, ts, status, response_id, response_ts,
       CASE WHEN status = 'resolved' THEN 'cache-control: max-age=' || (page_id % 1000) || chr(10) || 'content-length: ' || n || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || etag || chr(10) || 'server: s1' END AS headers
FROM s
"""
}
