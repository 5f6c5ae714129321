"""Operators keep columns named like their helpers, with dots, or twice; exact deduplication checks bytes as rows arrive."""

import pytest
from pyspark.sql import functions as F

from kinweave.llm import bpe, exact_dedup, language_id, lm_scoring, mixing, ngram_join, pii, url_filter
from kinweave.llm.names import Veil

HELPERS = "__url __rest __host __path __key __new __text __held __block __levels __row __shared __packed __size __hash __part __copy __m1 __m2 __ident __digest __chars __norm best digest ident".split()
LONG = "Mrs Ann Lee wrote to ann@lee.org. " + "long words follow each other " * 40_000


def model(spark):
    return spark.createDataFrame([(k, f"{'the cat sat here' if k % 2 else 'le chat noir dort'} {k}", "en" if k % 2 else "fr") for k in range(40)], "doc_id long, text string, lang string")


OPERATORS = {
    "op1": lambda spark, d: url_filter.judge(d.withColumn("url", F.concat(F.lit("http://a.org/"), "doc_id")), url_filter.rule_table(spark, url_filter.RULES)),
    "op2": lambda spark, d: pii.replace(d),
    "op5": lambda spark, d: ngram_join.ShingleJoin(d).kept(),
    "op6": lambda spark, d: language_id.LanguageId(model(spark)).predict(d),
    "op7": lambda spark, d: lm_scoring.LanguageModel(model(spark)).score(d, F.col("doc_id") == 1),
    "op7 routed": lambda spark, d: lm_scoring.LanguageModel(model(spark), broadcast_bytes=0).score(d, F.col("doc_id") == 1),
    "op8": lambda spark, d: bpe.encode(d),
    "op9": lambda spark, d: mixing.mix(d),
    "op9 repeated": lambda spark, d: mixing.repeated(d),
    "op10": lambda spark, d: exact_dedup.ExactDedup(d).kept(),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, name):
    rows = [(1, "Mrs Ann Lee sat", "s"), (2, "a cat sat", "s"), (2, "a cat sat", "s"), (3, "", "s"), (4, None, None), (None, "le chat dort", "t"), (5, LONG, "t")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    values = [F.concat(F.lit(f"{h}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(h) for h in HELPERS]
    twice = [F.lit("x").alias("a.b"), F.lit("y").alias("Twin"), F.lit("z").alias("twin")]
    wide = plain.select("*", *values, *twice)
    for docs in (plain, plain.limit(0)):
        want = OPERATORS[name](spark, docs)
        got = OPERATORS[name](spark, wide if docs is plain else wide.limit(0))
        assert [c for c in got.columns if c in want.columns] == want.columns
        assert [c for c in got.columns if c in HELPERS or c in ("a.b", "Twin", "twin")] == [*HELPERS, "a.b", "Twin", "twin"]
        out = got.toDF(*(f"c{k}" for k in range(len(got.columns)))).collect()
        at = [got.columns.index(c) for c in want.columns]
        assert sorted(repr([r[k] for k in at]) for r in out) == sorted(repr(list(r)) for r in want.collect())
        ident = got.columns.index("doc_id")
        for h in HELPERS:
            assert all(r[got.columns.index(h)] == f"{h}-{'-' if r[ident] is None else r[ident]}" for r in out)
        assert {r[-1] for r in got.select(F.lit(0)).collect()} <= {0}


def test_veil_leaves_plain_tables(spark):
    plain = spark.createDataFrame([(1, 2)], "doc_id long, _x long")
    assert Veil(plain).docs is plain and Veil(plain, ("_x",)).docs.columns == ["doc_id", "column 1"]
    assert Veil(plain.toDF("a", "A")).docs.columns == ["column 0", "column 1"]


@pytest.mark.parametrize("files", [None, 1])
def test_bytes_are_checked_as_rows_arrive(spark, tmp_path, files):
    """Digests of two characters; what collides comes with the second addition, and a better row of an old text too."""
    path, checkpoint = str(tmp_path / "rows"), str(tmp_path / "state")
    digest = lambda text: F.encode(F.substring(text, 1, 2), "utf-8")
    seen = []
    additions = ([(1, "ab one"), (2, "cd two"), (3, "cd two")], [(4, "ab  one"), (5, "cd other"), (6, "ef six")], [(7, "ef seven"), (8, "ab one")])
    for epoch, rows in enumerate(additions):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        exact_dedup.stage(docs, path, digest=digest, epoch=epoch)
        schema = spark.read.parquet(path).schema
        for _ in range(2):  # a second call without new rows changes nothing
            exact_dedup.run_stream(spark, path, schema, checkpoint, files)
            exact_dedup.check_stream(spark, path, schema, checkpoint, files)
        seen.append(sorted(bytes(r["digest"]) for r in exact_dedup.odd_digests(spark, checkpoint).collect()))
    assert seen == [[], [b"cd"], [b"cd", b"ef"]]
    kept = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.read_state(spark, checkpoint).collect()}
    assert kept == {b"ab": (4, 3), b"cd": (5, 3), b"ef": (7, 2)}
