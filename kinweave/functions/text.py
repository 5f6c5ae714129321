"""Match keys and lexical similarity as Column expressions.

Lengths and positions count code points; for texts within the basic plane they equal UTF-16 units.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Perso-Arabic letters that are folded, and marks that are dropped (diacritics by range, the rest by letter).
FOLD_FROM, FOLD_TO = "يكآأإة", "یکاااه"
DIACRITICS = "[ً-ٰٟۖ-ۭ]"
DROPPED = "ـ‌‍"
#: White space as the match key sees it, beyond what Java's ``\s`` holds.
SPACE = r"[\s   -     　﻿]"
HASHES, BANDS, ROWS = 64, 16, 4
MASK = 0xFFFFFFFF


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """Compatibility composition; texts of ASCII alone are left to the JVM."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_nfkc(text))


def normalize_name(text: Column, compose: bool = True) -> Column:
    """The key that names are compared by; ``compose=False`` for input known to be in NFKC."""
    s = nfkc(text) if compose else text
    s = F.translate(s, FOLD_FROM, FOLD_TO)
    s = F.translate(F.regexp_replace(s, DIACRITICS, ""), DROPPED, "")
    s = F.regexp_replace(F.lower(s), SPACE + "+", " ")
    edge = r"[\p{P}\p{S} ]+"
    return F.regexp_replace(s, f"^{edge}|{edge}$", "")


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def shannon_entropy(text: Column) -> Column:
    """Bits a character, over the distribution of characters; 0 for the empty text."""

    def total(cs):
        def bits(c):
            return let(F.size(F.filter(cs, lambda x: x == c)) / F.size(cs), lambda p: -p * F.log2(p))

        return F.aggregate(F.transform(F.array_sort(F.array_distinct(cs)), bits), F.lit(0.0), lambda a, b: a + b)

    return let(chars(text), total)


def passes_entropy_gate(normalized: Column, threshold: float = 2.0) -> Column:
    return shannon_entropy(normalized) >= F.lit(threshold)


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct runs of ``size`` characters; a shorter text is its own, the empty text has none."""

    def of(t):
        n = F.length(t)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1)), lambda i: F.substring(t, i, F.lit(size)))
        return F.when(n == 0, F.array().cast("array<string>")).when(n <= size, F.array(t)).otherwise(F.array_distinct(runs))

    return let(text, of)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def fnv1a(text: Column, seed: Column | int = 0) -> Column:
    """Salted 32-bit FNV-1a over code units, as a long."""
    start = F.lit(0x811C9DC5).cast("long").bitwiseXOR(F.lit(seed).cast("long") if isinstance(seed, int) else seed)
    codes = F.transform(chars(text), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, start, lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193)).bitwiseAND(F.lit(MASK)))


def minhash_signature(shingle_set: Column) -> Column:
    """The least hash of the set for each of 64 seeds; all ones for the empty set."""

    def least(i):
        seed = (i.cast("long") * F.lit(0x9E3779B9)).bitwiseAND(F.lit(MASK))
        return F.coalesce(F.array_min(F.transform(shingle_set, lambda s: fnv1a(s, seed))), F.lit(MASK).cast("long"))

    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), least)


def estimate_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(HASHES))


def lsh_band_keys(signature: Column) -> Column:
    """``band:v,v,v,v`` for each of the 16 bands of 4 values."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.concat(b.cast("string"), F.lit(":"), F.array_join(F.transform(F.slice(signature, b * ROWS + 1, F.lit(ROWS)), lambda v: v.cast("string")), ",")))


def utf16_offset(text: Column, code_points: Column) -> Column:
    """The offset in UTF-16 units of an offset in code points."""
    wide = F.regexp_replace(F.substring(text, F.lit(1), code_points), r"[^\x{10000}-\x{10FFFF}]", "")
    return (code_points + F.length(wide)).cast("int")
