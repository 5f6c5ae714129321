"""The Solar Hijri (Jalali) calendar in integer Column arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions.text import let

# Years at which the pattern of leap years shifts; the first and last bound what the calendar covers.
BREAKS = (-61, 9, 38, 199, 426, 686, 756, 818, 1111, 1181, 1210, 1635, 2060, 2097, 2192, 2262, 2326, 2394, 2456, 3178)


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def _spans() -> list[tuple[int, int, int, int]]:
    """(first year, last year, length, leap days before) of each stretch between breaks."""
    out, leaps = [], -14
    for a, b in zip(BREAKS, BREAKS[1:], strict=False):
        out.append((a, b - 1, b - a, leaps))
        leaps += (b - a) // 33 * 8 + (b - a) % 33 // 4
    return out


def _year(jy: Column) -> Column:
    """STRUCT<leap, march>: years since the last leap year, 0 in one, and the day of March on which the year begins;
    null outside the calendar."""
    rows = [(jy.between(first, last), F.struct(F.lit(first).alias("start"), F.lit(length).alias("length"), F.lit(leaps).alias("leaps"))) for first, last, length, leaps in _spans()]
    stretch = reduce(lambda out, r: out.when(*r), rows[1:], F.when(*rows[0]))

    def of(s: Column) -> Column:
        n, gy = jy - s["start"], jy + 621
        leaps = s["leaps"] + _div(n, 33) * 8 + _div(F.pmod(n, F.lit(33)) + 3, 4)
        leaps = leaps + F.when((F.pmod(s["length"], F.lit(33)) == 4) & (s["length"] - n == 4), 1).otherwise(0)
        gregorian = _div(gy, 4) - _div((_div(gy, 100) + 1) * 3, 4) - 150
        late = F.when(s["length"] - n < 6, n - s["length"] + _div(s["length"] + 4, 33) * 33).otherwise(n)
        return F.struct(F.pmod(F.pmod(late + 1, F.lit(33)) - 1, F.lit(4)).alias("leap"), (20 + leaps - gregorian).cast("int").alias("march"))

    return let(stretch, of)


def is_leap(jy: Column) -> Column:
    return let(jy, lambda y: _year(y)["leap"] == 0)


def month_length(jy: Column, jm: Column) -> Column:
    """31 days to the sixth month, 30 to the eleventh, 29 or 30 in the twelfth."""
    return F.when(jm <= 6, 31).when(jm <= 11, 30).when(is_leap(jy), 30).otherwise(29)


def to_gregorian(jy: Column, jm: Column, jd: Column) -> Column:
    """The DATE of a Jalali day; null for days that aren't, and outside the calendar."""

    def of(d: Column) -> Column:
        y, m, day = d["y"], d["m"], d["d"]
        first = F.make_date(y + 621, F.lit(3), F.lit(1))
        length = F.when(m <= 6, 31).when(m <= 11, 30).when(d["year"]["leap"] == 0, 30).otherwise(29)
        whole = F.date_add(first, (d["year"]["march"] - 1 + (m - 1) * 31 - F.when(m > 7, m - 7).otherwise(0) + day - 1).cast("int"))
        return F.when(y.between(BREAKS[0], BREAKS[-1] - 1) & m.between(1, 12) & (day >= 1) & (day <= length), whole)

    parts = F.struct(jy.cast("int").alias("y"), jm.cast("int").alias("m"), jd.cast("int").alias("d"))
    with_year = lambda p: F.struct(p["y"].alias("y"), p["m"].alias("m"), p["d"].alias("d"), _year(p["y"]).alias("year"))
    return let(let(parts, with_year), of)


def from_gregorian(day: Column) -> Column:
    """STRUCT<jy, jm, jd> of a DATE."""

    def of(d: Column) -> Column:
        k = F.datediff(d["day"], F.date_add(F.make_date(F.year(d["day"]), F.lit(3), F.lit(1)), d["year"]["march"] - 1))
        early = k < 0
        late = F.when(early, k + 179 + F.when(d["year"]["leap"] == 1, 1).otherwise(0)).otherwise(k - 186)
        half = ~early & (k <= 185)
        jy = F.year(d["day"]) - 621 - F.when(early, 1).otherwise(0)
        jm = F.when(half, 1 + _div(k, 31)).otherwise(7 + _div(late, 30))
        jd = F.when(half, F.pmod(k, F.lit(31)) + 1).otherwise(F.pmod(late, F.lit(30)) + 1)
        return F.struct(jy.cast("int").alias("jy"), jm.cast("int").alias("jm"), jd.cast("int").alias("jd"))

    return let(let(day, lambda d: F.struct(d.alias("day"), _year(F.year(d) - 621).alias("year"))), of)
