"""Columns that an operator only carries, under names that clash with none of its own."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


class Veil:
    """``docs`` as an operator may work on them, and the way back.

    Columns named like helpers (with two underscores first, or one of ``helpers``), those whose names aren't plain
    words, and those whose names repeat are renamed; the others, and a table without such columns, stay as they are.
    """

    def __init__(self, docs: DataFrame, helpers: tuple[str, ...] = ()):
        lower = [c.lower() for c in docs.columns]
        plain = [bool(re.fullmatch(r"[a-z]\w*|_[a-z0-9]\w*", c, re.ASCII)) and c not in helpers and lower.count(c) == 1 for c in lower]
        inside = [c if good else f"column {k}" for k, (c, good) in enumerate(zip(docs.columns, plain, strict=True))]
        self._outer = {a: b for a, b in zip(inside, docs.columns, strict=True) if a != b}
        self._inner = {b: a for a, b in self._outer.items()}
        self.docs = docs.toDF(*inside) if self._outer else docs

    def name(self, column: str) -> str:
        """What ``column`` is called in ``self.docs``."""
        return self._inner.get(column, column)

    def lift(self, out: DataFrame) -> DataFrame:
        """``out`` with the names that the caller's columns had."""
        return out.toDF(*(self._outer.get(c, c) for c in out.columns)) if self._outer else out
