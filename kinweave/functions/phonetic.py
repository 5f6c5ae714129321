"""Consonant-skeleton keys that meet across scripts, as Column expressions.

A scheme claims words and gives each a bounded list of keys; a host may pass its own list of schemes. Where a
letter is ambiguous the keys fork, in a fixed order, with at most ``PER_WORD`` keys a word and four times that a
name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions.text import chars, let, nfkc

PER_WORD = 8

# What each letter sounds as; two sounds where it is ambiguous, none where it is silent.
PERSIAN = {
    "ب": "b", "پ": "p", "ت": "t", "ط": "t", "ث": "s", "س": "s", "ص": "s", "ج": "j", "چ": "c", "ح": "h", "ه": "h", "ة": "h", "خ": "x", "د": "d", "ذ": "z", "ز": "z",
    "ض": "z", "ظ": "z", "ر": "r", "ژ": "j", "ش": "c", "ف": "f", "ک": "k", "ك": "k", "گ": "g", "ل": "l", "م": "m", "ن": "n", "ق": "q", "غ": "q",
    "ع": "", "ء": "", "ئ": "", "أ": "", "إ": "", "ؤ": "", "ا": "", "آ": "", "و": ("v", ""), "ی": ("y", ""), "ي": ("y", ""),
}
CYRILLIC = {
    "б": "b", "в": "v", "г": "g", "д": "d", "ж": "j", "з": "z", "к": "k", "л": "l", "м": "m", "н": "n", "п": "p", "р": "r", "с": "s", "т": "t", "ф": "f", "х": "x",
    "ц": "ts", "ч": "c", "ш": "c", "щ": "c", "й": ("y", ""), "а": "", "о": "", "у": "", "ы": "", "э": "", "и": "", "е": "", "ё": "", "я": "", "ю": "", "і": "", "ї": "", "є": "", "ь": "", "ъ": "",
}
LATIN_PAIRS = (("kh", "X"), ("gh", "Q"), ("sh", "C"), ("ch", "C"), ("zh", "J"), ("ph", "F"))


@dataclass(frozen=True)
class Scheme:
    """Which words it claims, and the keys of a word it has claimed (an array of strings)."""

    name: str
    claims: Callable[[Column], Column]
    keys: Callable[[Column], Column]


def collapse_repeats(text: Column) -> Column:
    return F.regexp_replace(text, r"(.)\1+", "$1")


def dedupe_cap(keys: Column, cap: int = PER_WORD) -> Column:
    return F.slice(F.array_distinct(keys), 1, cap)


def _none() -> Column:
    return F.array().cast("array<string>")


def expand(classes: Column) -> Column:
    """Keys of a sequence of alternatives: every choice, in order, capped after each letter."""
    grow = lambda keys, alts: dedupe_cap(F.flatten(F.transform(keys, lambda k: F.transform(alts, lambda a: F.concat(k, a)))))
    grown = F.aggregate(classes, F.array(F.lit("")), grow)
    return F.filter(dedupe_cap(F.transform(grown, collapse_repeats)), lambda k: k != "")


def _sounds(*alternatives: str) -> Column:
    return F.array(*map(F.lit, alternatives))


def _table(letters: dict[str, str | tuple[str, str]], special: Callable[[Column, Column, Column], Column]) -> Callable[[Column], Column]:
    """Keys by a table of letters; ``special(letter, place, last place)`` overrides it where it isn't null."""

    def of(cs: Column) -> Column:
        table = F.create_map(*(x for letter, sounds in letters.items() for x in (F.lit(letter), _sounds(*([sounds] if isinstance(sounds, str) else sounds)))))
        last = F.size(cs) - 1
        sounds = F.transform(cs, lambda c, i: F.coalesce(special(c, i, last), F.try_element_at(table, c)))
        return expand(F.filter(sounds, lambda s: s.isNotNull()))

    def keys(word: Column) -> Column:
        return let(chars(word), of)

    return keys


def _latin_keys(word: Column) -> Column:
    def of(s: Column) -> Column:
        first = F.substring(s, 1, 1)
        head = F.when(first == "y", "y").when(first == "w", "v").otherwise(F.translate(first, "aeiou", ""))
        body = F.concat(head, F.translate(F.substring(s, F.lit(2), F.length(s)), "aeiouyw", ""))
        key = collapse_repeats(F.lower(F.translate(F.regexp_replace(body, "[^A-Za-z]", ""), "c", "k")))
        silent = F.regexp_replace(s, "[A-Z]", "").rlike("[aeiou]h$")
        both = lambda k: F.when(silent & k.endswith("h"), dedupe_cap(F.array(k, F.substring(k, F.lit(1), F.length(k) - 1)))).otherwise(F.array(k))
        return F.filter(let(key, both), lambda k: k != "")

    return let(reduce(lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), LATIN_PAIRS, F.translate(word, "'", "")), of)


def _persian_special(c: Column, i: Column, last: Column) -> Column:
    initial = F.when(c == "و", _sounds("v")).when(c.isin("ی", "ي"), _sounds("y"))
    final = F.when((i == last) & c.isin("ه", "ة"), _sounds("h", ""))
    return F.when(i == 0, F.coalesce(initial, final)).otherwise(final)


def _cyrillic_special(c: Column, i: Column, last: Column) -> Column:
    return F.when((i == 0) & c.isin("я", "ю", "ё", "е", "є", "ї"), _sounds("y", "")).when((i == 0) & (c == "й"), _sounds("y"))


def persian() -> Scheme:
    return Scheme("fa", lambda w: w.rlike("[؀-ۿ]"), _table(PERSIAN, _persian_special))


def cyrillic() -> Scheme:
    return Scheme("cyrl", lambda w: w.rlike("[Ѐ-ӿ]"), _table(CYRILLIC, _cyrillic_special))


def latin() -> Scheme:
    return Scheme("latn", lambda w: w.rlike("[a-z]"), _latin_keys)


def default_schemes() -> list[Scheme]:
    return [persian(), cyrillic(), latin()]


def phonetic_keys(name: Column, schemes: Sequence[Scheme] | None = None, compose: bool = True) -> Column:
    """Distinct keys of a name, word by word; words without a key drop out, and other scripts have none."""
    use = default_schemes() if schemes is None else list(schemes)
    if not use:
        return F.when(name.isNotNull(), _none())
    words = F.filter(F.split(F.lower(nfkc(name) if compose else name), r"[^\p{L}\p{M}']+"), lambda w: w != "")

    def of_word(w: Column) -> Column:
        found = reduce(lambda out, s: out.when(s.claims(w), s.keys(w)), use[1:], F.when(use[0].claims(w), use[0].keys(w)))
        return found.otherwise(_none())

    grow = lambda keys, ks: F.slice(F.flatten(F.transform(keys, lambda p: F.transform(ks, lambda k: F.when(p == "", k).otherwise(F.concat(p, F.lit(" "), k))))), 1, PER_WORD * 4)
    whole = lambda keyed: F.when(F.size(keyed) == 0, _none()).otherwise(F.array_distinct(F.aggregate(keyed, F.array(F.lit("")), grow)))
    return let(F.filter(F.transform(words, of_word), lambda ks: F.size(ks) > 0), whole)


def phonetic_match(a: Column, b: Column, schemes: Sequence[Scheme] | None = None) -> Column:
    return F.arrays_overlap(phonetic_keys(a, schemes), phonetic_keys(b, schemes))
