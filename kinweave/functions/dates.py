"""Dates named in texts, as Column expressions: English and Persian, absolute and relative, with spans.

A rule is a pattern and how a match is read: as a day of either calendar, a number of days from the reference, or a weekday.
All rules of a language are tried in one pass over the text, wherever something stands that one could begin with, and leave
marks there; what a rule has marked is read by that rule alone, and all readings are resolved by the same few expressions.
A rule's matches don't overlap, as if it were scanned for alone; of all rules' matches that are dates the longest are kept
first, then the earliest, then by order of rules. Offsets count UTF-16 units.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.calendar import from_gregorian, to_gregorian
from kinweave.functions.text import let, utf16_offset

# Names of weekdays (Sunday 0) and months, and the digits that fold to ASCII.
WEEKDAYS = {
    "sunday": 0, "sun": 0, "monday": 1, "mon": 1, "tuesday": 2, "tue": 2, "tues": 2, "wednesday": 3, "wed": 3, "thursday": 4, "thu": 4, "thur": 4, "thurs": 4,
    "friday": 5, "fri": 5, "saturday": 6, "sat": 6,
}
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8,
    "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
FA_WEEKDAYS = {"پنج‌شنبه": 4, "پنجشنبه": 4, "سه‌شنبه": 2, "سه شنبه": 2, "یکشنبه": 0, "دوشنبه": 1, "چهارشنبه": 3, "جمعه": 5, "شنبه": 6}
FA_MONTHS = {"فروردین": 1, "اردیبهشت": 2, "خرداد": 3, "تیر": 4, "امرداد": 5, "مرداد": 5, "شهریور": 6, "مهر": 7, "آبان": 8, "آذر": 9, "دی": 10, "بهمن": 11, "اسفند": 12}
DIGITS_FROM, DIGITS_TO = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789"

SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_GAP = r"[\x{200C}\s\x{A0}\x{FEFF}]+"
_ANY_DIGIT = "[0-9۰-۹٠-٩]"
_START, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


@dataclass(frozen=True)
class DateOptions:
    languages: tuple[str, ...] | None = None
    require_weekday_qualifier: bool = False
    numeric_date_order: str = "MDY"


#: How a match is read.
DAY, SHIFT, WEEKDAY, JALALI = range(4)
LAST, NEXT, UPCOMING = range(3)
# private characters that mark places; a text's own are taken out first
_MARK, _NEXT = "\ue000", "\ue001"


@dataclass(frozen=True)
class Rule:
    """``read(match)`` gives what ``reading`` makes, or null for what is no date."""

    language: str
    pattern: str
    grain: str
    read: Callable[[Column], Column]
    bare_weekday: bool = False


def reading(kind: int, confidence: Column | float, y: Column | None = None, m: Column | int | None = None, d: Column | int | None = None) -> Column:
    """DAY, JALALI: year (null: the reference's), month, day. SHIFT: days in ``d``. WEEKDAY: direction in ``m``, day in ``d``."""
    plain = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("int")
    sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(F.lit(kind).alias("kind"), plain(y).alias("y"), plain(m).alias("m"), plain(d).alias("d"), sure.cast("double").alias("confidence"))


def fold_digits(text: Column) -> Column:
    return F.translate(text, DIGITS_FROM, DIGITS_TO)


def gregorian_day(year: Column, month: Column, day: Column) -> Column:
    """The DATE, or null if the month has no such day; years below 100 aren't taken."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(year >= 100, text.try_cast("date"))


def resolve_weekday(ref: Column, dow: Column, direction: str) -> Column:
    """The day ``dow`` (Sunday 0) before, after, or from ``ref`` on."""
    cur = F.dayofweek(ref) - 1
    if direction == "last":
        back = F.pmod(cur - dow, F.lit(7))
        return F.date_sub(ref, F.when(back == 0, 7).otherwise(back))
    ahead = F.pmod(dow - cur, F.lit(7))
    return F.date_add(ref, F.when(ahead == 0, 7).otherwise(ahead) if direction == "next" else ahead)


def _number(text: Column) -> Column:
    return F.when(text != "", fold_digits(text)).try_cast("int")


def _table(table: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def _alternatives(words) -> str:
    return "|".join(words)


def rules(options: DateOptions = DateOptions()) -> list[Rule]:
    out: list[Rule] = []
    month_of, weekday_of, fa_month_of, fa_weekday_of = map(_table, (MONTHS, WEEKDAYS, FA_MONTHS, FA_WEEKDAYS))
    look = F.try_element_at
    part = F.regexp_extract

    def add(language, pattern, read, grain="day", bare=False):
        out.append(Rule(language, pattern, grain, read, bare))

    def shift(days: int, confidence: float):
        return lambda m: reading(SHIFT, confidence, d=days)

    iso = r"(\d{4})-(\d{2})-(\d{2})"
    add("en", f"{_START}{iso}{_END}", lambda m: reading(DAY, 0.95, *(_number(part(m, iso, k)) for k in (1, 2, 3))))

    months = _alternatives(MONTHS)
    named = rf"({months})\.?{SPACE}+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?{SPACE}+(\d{{4}}))?"
    turned = rf"(\d{{1,2}})(?:st|nd|rd|th)?{SPACE}+({months})\.?(?:{SPACE}+(\d{{4}}))?"
    # a period belongs to the month only where a year follows it or a word goes on
    ended = rf"(\d{{1,2}})(?:st|nd|rd|th)?{SPACE}+({months})(?:\.?{SPACE}+(\d{{4}}){_END}|\.(?=[A-Za-z0-9_])|{_END})"

    def by_name(pattern: str, month: int, day: int):
        def read(m):
            year = part(m, f"(?i)^{pattern}$", 3)
            return reading(DAY, F.when(year != "", 0.95).otherwise(0.85), _number(year), look(month_of, F.lower(part(m, f"(?i)^{pattern}$", month))), _number(part(m, f"(?i)^{pattern}$", day)))

        return read

    add("en", f"(?i){_START}{named}{_END}", by_name(named, 1, 2))
    add("en", f"(?i){_START}{ended}", by_name(turned, 2, 1))

    slashed = r"(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?"

    def numeric(m):
        a, b, y = (part(m, f"^{slashed}$", k) for k in (1, 2, 3))
        month, day = (a, b) if options.numeric_date_order == "MDY" else (b, a)
        n = _number(y)
        year = F.when(F.length(y) == 2, n + F.when(n < 50, 2000).otherwise(1900)).otherwise(n)
        return reading(DAY, F.when(y != "", 0.85).otherwise(0.7), year, _number(month), _number(day))

    add("en", f"{_START}{slashed}{_END}", numeric)
    word = lambda w: f"(?i){_START}{w}{_END}"
    add("en", word("(?:today|tonight)"), shift(0, 0.95))
    add("en", word("the day after tomorrow"), shift(2, 0.9))
    add("en", word("the day before yesterday"), shift(-2, 0.9))
    add("en", word("tomorrow"), shift(1, 0.95))
    add("en", word("yesterday"), shift(-1, 0.95))
    ahead = lambda days: lambda m: reading(SHIFT, 0.9, d=_number(part(m, r"(\d{1,3})", 1)) * days)
    add("en", word(rf"in{SPACE}+\d{{1,3}}{SPACE}+days?"), ahead(1))
    add("en", word(rf"in{SPACE}+\d{{1,3}}{SPACE}+weeks?"), ahead(7), "week")
    add("en", word(f"next{SPACE}+week"), shift(7, 0.85), "week")
    add("en", word(f"last{SPACE}+week"), shift(-7, 0.85), "week")

    days = _alternatives(WEEKDAYS)
    way = lambda m, last, following: F.when(m.rlike(last), LAST).when(m.rlike(following), NEXT).otherwise(UPCOMING)
    add("en", word(f"(?:next|last|this|on){SPACE}+(?:{days})"), lambda m: reading(WEEKDAY, 0.8, m=way(m, "(?i)^last", "(?i)^next"), d=look(weekday_of, F.lower(part(m, rf"(?i){SPACE}({days})$", 1)))))
    add("en", word(f"(?:{days})"), lambda m: reading(WEEKDAY, 0.6, m=UPCOMING, d=look(weekday_of, F.lower(m))), bare=True)

    add("fa", "امروز", shift(0, 0.95))
    add("fa", "پس‌?فردا", shift(2, 0.9))
    add("fa", "پریروز", shift(-2, 0.9))
    add("fa", "فردا", shift(1, 0.95))
    add("fa", "دیروز", shift(-1, 0.95))
    week = r"هفته[\x{200C}\s]?(?:ی[\x{200C}\s]?)?"
    add("fa", f"{week}(?:بعد|آینده)", shift(7, 0.85), "week")
    add("fa", f"{week}(?:پیش|گذشته|قبل)", shift(-7, 0.85), "week")
    fa_days = _alternatives(FA_WEEKDAYS)
    tail = r"(?:[\x{200C}\s]?(?:بعد|آینده|پیش|گذشته))"

    def fa_weekday(m):
        qualified = m.rlike("(?:بعد|آینده|پیش|گذشته)$")
        found = reading(WEEKDAY, F.when(qualified, 0.8).otherwise(0.6), m=way(m, "(?:پیش|گذشته)$", "(?:بعد|آینده)$"), d=look(fa_weekday_of, part(m, f"^({fa_days})", 1)))
        return F.when(qualified, found) if options.require_weekday_qualifier else found

    add("fa", f"(?:{fa_days}){tail}?", fa_weekday)

    fa_months = _alternatives(FA_MONTHS)
    full = f"({_ANY_DIGIT}{{1,2}}){_GAP}({fa_months})(?:{_GAP}({_ANY_DIGIT}{{3,4}})(?!{_ANY_DIGIT}))?"

    def jalali(m):
        day, month, year = (part(m, f"^{full}$", k) for k in (1, 2, 3))
        return reading(JALALI, F.when(year != "", 0.95).otherwise(0.85), _number(year), look(fa_month_of, month), _number(day))

    add("fa", f"(?<!{_ANY_DIGIT}){full}", jalali)
    monthly = f"({fa_months}){_GAP}({_ANY_DIGIT}{{4}})"
    add("fa", f"{monthly}(?!{_ANY_DIGIT})", lambda m: reading(JALALI, 0.9, _number(part(m, monthly, 2)), look(fa_month_of, part(m, monthly, 1)), 1), "month")
    ymd = f"({_ANY_DIGIT}{{4}})/({_ANY_DIGIT}{{1,2}})/({_ANY_DIGIT}{{1,2}})"

    def year_first(m):
        y, mo, d = (_number(part(m, ymd, k)) for k in (1, 2, 3))
        return F.when(y.between(1000, 1700), reading(JALALI, 0.9, y, mo, d))

    add("fa", f"(?<!{_ANY_DIGIT}){ymd}(?!{_ANY_DIGIT})", year_first)
    return [r for r in out if (options.languages is None or r.language in options.languages) and not (r.bare_weekday and options.require_weekday_qualifier)]


# Where a rule can match at all: what a text must hold, and what stands where a match begins.
_HOLDS = {"en": r"(?i)[0-9]|today|tonight|tomorrow|yesterday|week|sun|mon|tue|wed|thu|fri|sat", "fa": r"[\x{600}-\x{6FF}]|[0-9]/"}
_BEGINS = {
    "en": rf"(?i){_START}(?=[0-9]|today|tonight|tomorrow|yesterday|the day|in{SPACE}|next|last|this|on{SPACE}|{'|'.join(sorted({w[:3] for w in (*MONTHS, *WEEKDAYS)}))})",
    "fa": r"(?=[\x{600}-\x{6FF}0-9])",
}


def _marked(text: Column, language: str, use: list[tuple[int, Rule]]) -> Column:
    """ARRAY<STRUCT<rule, start, stop, surface>> of all places where rules of a language match, by one pass over the text."""
    pattern = f"(?:{_BEGINS[language]})" + "".join(f"(?=(?<r{k}>{r.pattern})|)" for k, r in use)
    marks = _MARK + _NEXT.join(f"${{r{k}}}" for k, _ in use) + _NEXT
    pieces = F.split(F.regexp_replace(F.translate(text, _MARK + _NEXT, "\ufffd\ufffd"), pattern, marks), _MARK, -1)
    numbers = F.array(*(F.lit(k) for k, _ in use))
    none = F.array().cast("array<struct<rule:int,start:int,stop:int,surface:string>>")

    def of(ps: Column) -> Column:
        # a piece holds what each rule has marked at its start, and then the text up to the next mark
        lengths = F.transform(ps, lambda p: F.length(F.substring_index(p, _NEXT, -1)))
        hits = F.filter(F.transform(ps, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: (x["i"] > 0) & ~x["p"].startswith(_NEXT * len(use)))

        def found(x: Column) -> Column:
            begins = F.aggregate(F.slice(lengths, F.lit(1), x["i"]), F.lit(0), lambda n, k: n + k)
            place = lambda start: lambda k, m: F.struct(k.alias("rule"), start.alias("start"), (start + F.length(m)).alias("stop"), m.alias("surface"))
            every = lambda start: F.zip_with(numbers, F.slice(F.split(x["p"], _NEXT, -1), 1, len(use)), place(start))
            return F.filter(let(begins, every), lambda y: y["surface"] != "")

        return F.flatten(F.transform(hits, found))

    return F.when(text.rlike(_HOLDS[language]), let(pieces, lambda ps: F.when(F.size(ps) > 1, of(ps)).otherwise(none))).otherwise(none)


def _apart(places: Column) -> Column:
    """Each rule's matches from the left, without those that begin within the one before."""
    first = F.struct(F.lit(-1).alias("rule"), F.lit(0).alias("stop"), F.array().cast("array<struct<rule:int,start:int,stop:int,surface:string>>").alias("kept"))
    add = lambda acc, x: F.when((acc["rule"] == x["rule"]) & (x["start"] < acc["stop"]), acc).otherwise(F.struct(x["rule"].alias("rule"), x["stop"].alias("stop"), F.concat(acc["kept"], F.array(x)).alias("kept")))
    return F.aggregate(F.array_sort(places), first, add, lambda acc: acc["kept"])


def _resolved(r: Column, reference: Column) -> Column:
    """The DATE of a reading."""
    way = F.when(r["m"] == LAST, resolve_weekday(reference, r["d"], "last")).when(r["m"] == NEXT, resolve_weekday(reference, r["d"], "next")).otherwise(resolve_weekday(reference, r["d"], "upcoming"))
    day = gregorian_day(F.coalesce(r["y"], F.year(reference)), r["m"], r["d"])
    solar = to_gregorian(F.coalesce(r["y"], from_gregorian(reference)["jy"]), r["m"], r["d"])
    return F.when(r["kind"] == DAY, day).when(r["kind"] == SHIFT, F.date_add(reference, r["d"])).when(r["kind"] == WEEKDAY, way).when(r["kind"] == JALALI, solar)


def extract_dates(text: Column, reference: Column, options: DateOptions = DateOptions()) -> Column:
    """ARRAY<STRUCT<surface_form, span_start, span_end, date, grain, confidence>> in order of place; null where nothing matches."""
    use = list(enumerate(rules(options)))
    by_language = [(language, [x for x in use if x[1].language == language]) for language in ("en", "fa")]
    places = [_marked(text, language, own) for language, own in by_language if own]
    grains = F.array(*(F.lit(r.grain) for _, r in use))

    def read(x: Column) -> Column:
        own = reduce(lambda out, k: out.when(x["rule"] == k[0], k[1].read(x["surface"])), use[1:], F.when(x["rule"] == use[0][0], use[0][1].read(x["surface"])))
        dated = lambda r: F.struct((x["start"] - x["stop"]).alias("less"), x["start"].alias("start"), x["rule"].alias("rule"), x["stop"].alias("stop"), x["surface"].alias("surface"), _resolved(r, reference).alias("date"), r["confidence"].alias("confidence"))
        return let(own, dated)

    def pick(found: Column) -> Column:
        every = F.array_sort(F.filter(F.transform(_apart(found), read), lambda x: x["date"].isNotNull()))
        placed = lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x.alias("m"))
        none = F.filter(F.transform(every, placed), lambda x: F.lit(False))
        add = lambda kept, x: F.when(F.exists(kept, lambda k: (x["start"] < k["stop"]) & (x["stop"] > k["start"])), kept).otherwise(F.concat(kept, F.array(placed(x))))
        shape = lambda x: F.struct(
            x["m"]["surface"].alias("surface_form"), utf16_offset(text, x["start"]).alias("span_start"), utf16_offset(text, x["stop"]).alias("span_end"),
            x["m"]["date"].alias("date"), F.get(grains, x["m"]["rule"]).alias("grain"), x["m"]["confidence"].alias("confidence"),
        )
        return F.when(F.size(found) > 0, F.transform(F.array_sort(F.aggregate(every, none, add)), shape))

    return let(F.concat(*places), pick)


def find_dates(rows: DataFrame, text: Column, reference: Column, options: DateOptions = DateOptions()) -> DataFrame:
    """A row for each date in ``text``: the columns of ``rows``, and ``m`` as ``extract_dates`` has it.

    An outer explode, whose input isn't repeated in a filter below it, so that texts are read once.
    """
    return rows.select(*(f"`{c}`" for c in rows.columns), F.explode_outer(extract_dates(text, reference, options)).alias("m")).where("m is not null")
