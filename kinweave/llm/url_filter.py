"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path
follows up to ``?``, ``#`` or the end. A rule fits its host and all subdomains where the path starts with its
path. The longest fitting rule wins; of equally long ones the longer host, then block.

Null URLs and those without ``://`` have empty host and path and get the default verdict, as do all URLs if
there are no rules. Repeated rows get a row each. Columns whose names clash with the added ones are
replaced, others are kept whatever their names.
Expressions are made once for each distinct (host, path), so a URL that fills the table costs no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.names import Veil

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest that expressions and rules are joined on: 32 bits.
SHORT = 8
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _parts(url):
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    return F.coalesce(rest, F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (null where none fits) and verdict. ``rules`` has verdict, host and path."""
    veil = Veil(pages, ("best",))
    return veil.lift(_judged(veil.docs, rules, veil.name(url_col), default))


def _judged(pages: DataFrame, rules: DataFrame, url_col: str, default: str) -> DataFrame:
    added = ["host", "path", "rule", "verdict"]
    kept = [c for c in pages.columns if c.lower() not in added]
    split = pages.select(*(pages[c] for c in kept), pages[url_col].alias("__url")).withColumn("__rest", _parts(F.col("__url")))
    split = split.withColumn("__host", F.regexp_extract("__rest", r"^[^/?#]*", 0))
    split = split.withColumn("__path", F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), r"^[^?#]*", 0))
    split = split.withColumn("__host", F.translate("__host", UPPER, LOWER)).drop("__rest", "__url")

    clean = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path")).where("r_host is not null and verdict is not null").distinct()
    clean = clean.withColumn("rule", F.concat("r_host", "r_path")).withColumn("digest", F.sha2("rule", 256))
    found = F.struct(F.length("rule").alias("long"), F.length("r_host").alias("host_long"), "verdict", "rule", "digest")
    buckets = clean.groupBy(F.substring("digest", 1, SHORT).alias("short")).agg(F.collect_list(found).alias("found"))
    # the shapes of expressions that rules can have: numbers of labels and lengths of paths
    shapes = [(r[0], r[1]) for r in clean.select(F.size(F.split("r_host", r"\.")), F.length("r_path")).distinct().collect()]
    urls = split.select("__host", "__path").distinct()
    if not shapes:
        return split.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    shape = F.array(*(F.struct(F.lit(n).alias("labels"), F.lit(c).alias("chars")) for n, c in sorted(shapes)))
    wide = urls.withColumn("__labels", F.split("__host", r"\.")).select("*", F.explode(F.filter(shape, lambda s: (s.labels <= F.size("__labels")) & (s.chars <= F.length("__path")))).alias("s"))
    expression = F.concat(F.array_join(F.expr("slice(__labels, -s.labels, s.labels)"), "."), F.expr("substring(__path, 1, s.chars)"))
    wide = wide.select("__host", "__path", F.sha2(expression, 256).alias("full"))
    hits = wide.withColumn("short", F.substring("full", 1, SHORT)).join(buckets, "short")
    hits = hits.select("__host", "__path", F.explode(F.filter("found", lambda r: r.digest == F.col("full"))).alias("hit"))
    best = hits.groupBy("__host", "__path").agg(F.max(F.struct("hit.long", "hit.host_long", "hit.verdict", "hit.rule")).alias("best"))
    out = split.join(best, ["__host", "__path"], "left")
    return out.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every page's URL against the five rules."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op1_url_filter": query}

ORACLE_SQL = {
    "op1_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT p.*, r.verdict, rh || rp AS rule,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC, verdict DESC) AS n
      FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
}
