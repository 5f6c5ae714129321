"""Surrogates over a whole table, against a plain scan for entities: the rest stays, the map of entities is one to one."""

import os
import re

import pytest
import regex
from pyspark.sql import functions as F

from kinweave.llm import pii

SF = "/root/testdata/sf0.001/documents.parquet"


def out(spark, texts, **options):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r for r in pii.replace(d, **options).orderBy("doc_id").collect()]


def test_lone_names_are_what_they_are_elsewhere(spark):
    got = [r["text"] for r in out(spark, ["Frau Anna rief an.", "Frau Anna Schmidt rief an.", "Frau Schmidt kam.", "Herr Weber kam.", "Dr Anna ging.", "FRAU ANNA lief."])]
    given, family = got[1].split()[1:3]
    assert got[0] == f"Frau {given} rief an." and got[2] == f"Frau {family} kam." and given.endswith("a") and "Weber" not in got[3]
    assert got[4] == f"Dr {given} ging." and got[5] == f"FRAU {given.upper()} lief." and {given, family}.isdisjoint({"Anna", "Schmidt"})


def test_digit_runs_need_a_check_digit(spark):
    texts = ["order 1234567890123456 here", "card 4111111111111111 here", "card 1234 5678 9012 3456 here", "1234567890123456 and ann@lee.org"]
    got = out(spark, texts)
    assert [r["kinds"] for r in got] == [None, ["card"], ["card"], ["email"]] and [r["n_entities"] for r in got] == [0, 1, 1, 1]
    assert got[0]["text"] == texts[0] and "4111111111111111" not in got[1]["text"] and got[3]["text"].startswith("1234567890123456 and ")


def test_surrogates_depend_on_the_key(spark):
    texts = ["Mrs Ann Lee, ann@lee.org, 4111111111111111, +49 30 1234567"]
    a, b, c = (out(spark, texts, **o)[0]["text"] for o in ({}, {"key": "another"}, {"key": "another"}))
    assert a != b == c and len({x for t in (a, b, texts[0]) for x in t.split(", ")}) == 12


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else 2 * int(d) - 9 * (int(d) > 4) for k, d in enumerate(reversed(digits))) % 10 == 0


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_whole_table_against_a_scan(spark):
    pattern = regex.compile(pii.PATTERN.replace("(?iu:", "(?i:"))
    kinds = {k: regex.compile(v.replace("(?iu:", "(?i:")) for k, v in pii.KINDS.items() if k != "secret"}
    rows = pii.replace(spark.read.parquet(SF).select("doc_id", F.col("text"), F.col("text").alias("old"))).collect()
    assert rows
    became = {}
    for r in rows:
        old, new = r["old"], r["text"]
        if old is None:
            assert new is None and r["n_entities"] == 0
            continue
        at, seen, between, last = 0, [], [], 0
        for m in pattern.finditer(old):
            kind = next((k for k, p in kinds.items() if p.fullmatch(m[0])), "secret")
            if re.fullmatch(r"\d{13,19}", m[0]) and kind == "card" and not luhn(m[0]):
                continue
            seen.append((kind, m[0]))
            between.append(old[last : m.start()])
            last = m.end()
        assert (r["kinds"] or []) == [k for k, _ in seen] and r["n_entities"] == len(seen)
        for k, (kind, value) in enumerate(seen):
            assert new.startswith(between[k], at)
            at += len(between[k])
            follows = between[k + 1] if k + 1 < len(seen) else old[last:]
            same = kind in ("card", "phone", "ssn", "iban")  # as long as what they stand for
            end = at + len(value) if same else new.index(follows, at + 1) if follows else len(new)
            norm = re.sub(r"\D", "", value) if kind in ("phone", "card", "ssn") else value.lower() if kind == "email" else value.replace(" ", "") if kind == "iban" else value
            sur = new[at:end]
            plain = re.sub(r"\D", "", sur) if kind in ("phone", "card", "ssn") else sur.lower() if kind == "email" else sur.replace(" ", "") if kind == "iban" else sur
            if kind != "person":
                assert became.setdefault((kind, norm), plain) == plain and plain != norm
            if kind == "card":
                assert luhn(plain) == luhn(norm)
            at = end
        assert new[at:] == old[last:]
    assert len({(k, v) for (k, _), v in became.items()}) == len(became) and not {(k, v) for (k, _), v in became.items()} & set(became)
