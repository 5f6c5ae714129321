"""PII surrogates: detected entities get keyed replacements of their kind, gender, script and format.

Found are e-mail addresses, secrets behind names like ``token =``, IBANs, social security numbers, card numbers
(in groups, or in one run with a right check digit), IPv4 addresses, telephone numbers, and names behind a title.
The same entity has the same replacement everywhere: digits are compared without their separators, addresses and
names without case, and names word by word, so a name alone behind a title is replaced as the given or the family
name that it is elsewhere. Replacements keep separators, script, case, length of numbers, whether a card number's
check digit is right, that an IBAN's check digits are, and a given name's gender as its title tells it, or where
the title doesn't, as other mentions of the name do. Titles, names and what secrets stand behind may be in
capitals; up to three words in capitals behind a title count as its name. Addresses
lead to names and networks reserved for no one. They are keyed hashes, checked for collisions: no two entities of a
kind share one, and none is an entity itself; losers draw again from a larger space until all differ, so where
those of a length run out, replacements are longer.

Null and empty texts stay as they are, with no entities; empty tables give empty tables, repeated rows a row
each. Texts are joined by their digests, so ids may repeat or be null. Columns named like the added ones
are replaced, others are kept whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.names import Veil
from kinweave.llm.storage import cut

#: For tables whose surrogates needn't stay secret; callers give their own.
KEY = "surrogates-1"
#: Draws after which telephone and social security numbers may get longer, should those of their length run out.
SAME_LENGTH = 8
#: In any case, but for two that are other words in small letters.
FEMALE = r"(?:(?iu:Mrs|Frau|Sra|Señora|Srta|Señorita|Madame|Mme|Mlle|госпожа|г-жа)|Ms|MS|Miss|MISS)"
MALE = r"(?:(?iu:Mr|Herr|Señor|Monsieur|господин|г-н))"
NEUTRAL = r"(?:(?i:Dr|Prof))"
_NAME = r"\p{Lu}[\p{L}’'-]+"
#: In order: where several fit at one place, the first counts.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?<=\b(?i:token|secret|password|passwd|api_key|apikey|api-key)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9+/_-]{12,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,4})?)(?![\w-])",
    "ip": r"(?<![\w.-])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w-]|\.\d)",
    "phone": r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])",
    "person": rf"(?<![\p{{L}}-])(?:{FEMALE}|{MALE}|{NEUTRAL})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
PATTERN = "|".join(KINDS.values())
#: The kind of what a pattern finds and nothing is: digits in a run without a card's check digit.
PLAIN = "plain"

_ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
#: Consonants, vowels, and the endings of male and female given names, by script.
_SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou", "n", "a"), "cyrillic": ("бвгдзклмнпрст", "аеиоу", "н", "а"), "greek": ("βγδζκλμνπρστ", "αεηιο", "ς", "α")}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _mac(*parts: Column | str) -> Column:
    """64 hexadecimal digits that depend on the caller's key, a column, and all parts."""
    text = F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.sha2(F.concat(F.col("key"), F.sha2(F.concat(F.col("key"), text), 256)), 256)


def _draw(mac: Column, i: Column) -> Column:
    """The number from 0 to 65535 at place ``i`` of a keyed digest."""
    return F.conv(F.substring(F.concat(mac, mac), F.pmod(i * 3, F.lit(61)) + 1, F.lit(4)), 16, 10).cast("int")


def _pick(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(number, F.lit(len(alphabet))).cast("int") + 1, F.lit(1))


def _moved(value: Column, mac: Column, alphabets=_ALPHABETS) -> Column:
    """Every letter and digit moved within its alphabet; the rest stays."""

    def one(c, i):
        out = c
        for a in alphabets:
            place = F.call_function("instr", F.lit(a), c)
            out = F.when(place > 0, _pick(a, place - 1 + _draw(mac, i))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The sum that the check digit of a card number makes a multiple of 10."""
    n = F.length(digits)

    def one(c, i):
        d = c.try_cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda a, b: a + b)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of a number whose letters stand for 10 to 35."""

    def one(r, c):
        place = F.call_function("instr", F.lit(_ALPHABETS[2]), c)
        return F.pmod(F.when(place > 0, r * 100 + place + 9).otherwise(r * 10 + F.coalesce(c.try_cast("int"), F.lit(0))), F.lit(97))

    return F.aggregate(F.split(text, ""), F.lit(0), one)


def _name(script: Column, gender: Column | None, value: Column, mac: Column, attempt: int) -> Column:
    """A name of syllables in the script, about as long, with the gender's ending; a syllable more for each draw lost."""
    outs = []
    for s, (consonants, vowels, male, female) in _SYLLABLES.items():
        count = F.greatest(F.lit(2), (F.length(value) / 2).cast("int")) + attempt
        body = F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat(_pick(consonants, _draw(mac, i * 2)), _pick(vowels, _draw(mac, i * 2 + 1)))), "")  # noqa: B023
        end = F.lit(male) if gender is None else F.when(gender == "f", F.lit(female)).when(gender == "m", F.lit(male)).otherwise(_pick(male + female, _draw(mac, F.lit(40))))
        body = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), end) if gender is not None else F.concat(body, end)
        outs.append(F.when(script == s, F.initcap(body)))
    return F.coalesce(*outs)


def _more(mac: Column, count: int) -> Column:
    """``count`` digits that the draws of a long value don't use up."""
    return F.concat(*(_pick("0123456789", _draw(F.sha2(mac, 256), F.lit(i))) for i in range(count))) if count else F.lit("")


def _surrogate(attempt: int) -> Column:
    """The replacement of (kind, norm) at a number of draws, in normal form.

    The space of a draw grows with the draws lost, so that all find a place: names, local parts and secrets at
    once, numbers of a fixed length only after ``SAME_LENGTH`` draws.
    """
    kind, norm = F.col("kind"), F.col("norm")
    mac = _mac(kind, norm, str(attempt))
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    host = F.regexp_replace(domain, r"\.[^.]*$", "")
    more, digit = _more(mac, attempt), _more(mac, max(0, attempt - SAME_LENGTH + 1))
    email = F.concat(_moved(local, mac), more, F.lit("@"), _moved(host, _mac("domain", domain)), F.lit(".example"))
    card = _moved(norm, mac)
    body = F.substring(card, F.lit(1), F.length(card) - 1)
    need = F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10))
    wrong = F.pmod(need + 1 + _draw(mac, F.lit(50)) % 9, F.lit(10))
    last = F.when(_luhn(norm) % 10 == 0, need).otherwise(wrong)
    octet = lambda i: F.pmod(_draw(mac, F.lit(i)), F.lit(256)).cast("string")
    ip = F.concat_ws(".", (F.pmod(_draw(mac, F.lit(9)), F.lit(15)) + 240).cast("string"), octet(1), octet(2), octet(3))
    country = F.when(F.length(norm) > 9, 2).otherwise(0)
    phone = F.concat(F.substring(norm, F.lit(1), country), _moved(F.substring(norm, country + 1, F.length(norm)), mac), digit)
    land, moved = F.substring(norm, 1, 2), _moved(F.substring(norm, F.lit(3), F.length(norm)), mac)
    account = F.substring(moved, F.lit(3), F.length(moved))
    right = _mod97(F.concat(F.substring(norm, F.lit(5), F.length(norm)), F.substring(norm, 1, 4))) == 1
    iban = F.concat(land, F.when(right, F.lpad((98 - _mod97(F.concat(account, land, F.lit("00")))).cast("string"), 2, "0")).otherwise(F.substring(moved, 1, 2)), account)
    secret = F.when(norm.rlike("^[0-9a-f]+$"), _moved(norm, mac, ("0123456789abcdef",))).when(norm.rlike("^[0-9A-F]+$"), _moved(norm, mac, ("0123456789ABCDEF",))).otherwise(_moved(norm, mac))
    secret = F.concat(secret, more)
    return (
        F.when(kind == "email", email).when(kind == "card", F.concat(body, last.cast("string"))).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "secret", secret)
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(_moved(norm, mac), 2, 8), digit)).when(kind == "iban", iban)
        .otherwise(_name(F.element_at(F.split(kind, "_"), 3), F.when(kind.startswith("given"), F.element_at(F.split(kind, "_"), 2)), norm, mac, attempt))
    )


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, sur) of distinct (kind, norm) under a key: unequal for unequal norms of a kind, and none of them a norm."""
    pending, done, attempt = entities, None, 0
    while True:
        drawn = pending.withColumn("key", F.lit(key)).withColumn("sur", _surrogate(attempt))
        first = drawn.groupBy("kind", "sur").agg(F.min("norm").alias("norm"))
        first = first.join(entities.select("kind", F.col("norm").alias("sur")), ["kind", "sur"], "left_anti")
        first = first.join(entities.select("kind", F.initcap("norm").alias("sur")), ["kind", "sur"], "left_anti")
        if done is not None:
            first = first.join(done.select("kind", "sur"), ["kind", "sur"], "left_anti")
        won = cut(first.select("kind", "norm", "sur"))
        done = won if done is None else done.union(won)
        pending = cut(pending.join(won, ["kind", "norm"], "left_anti"))
        if pending.isEmpty():
            return done
        attempt += 1


def _kind(value: Column) -> Column:
    """The kind of a found value; a secret is told by what stood before it, so it is what no other pattern fits."""
    no_card = value.rlike(r"^\d{13,19}$") & (_luhn(value) % 10 != 0)
    return reduce(lambda out, k: out.when(value.rlike(f"^(?:{KINDS[k]})$"), k), [k for k in KINDS if k != "secret"], F.when(no_card, PLAIN)).otherwise("secret")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _norm(kind: Column, value: Column) -> Column:
    return F.when(kind.isin("phone", "card", "ssn"), _digits(value)).when(kind == "email", F.lower(value)).when(kind == "iban", F.regexp_replace(value, " ", "")).otherwise(value)


def _placed(parts: DataFrame) -> DataFrame:
    """``parts`` with names that stand alone behind a title as given or as family names: what mentions with several names
    have them for more often, and family names where these don't tell."""
    script = F.element_at(F.split("kind", "_"), 3).alias("script")
    alone = F.col("kind").startswith("lone_")
    whole = parts.where(F.col("kind").startswith("given_") | F.col("kind").startswith("family_")).groupBy(script, "norm")
    given = whole.agg((2 * F.count_if(F.col("kind").startswith("given_")) > F.count("*")).alias("is_given")).where("is_given")
    lone = parts.where(alone).select("*", script).join(given, ["script", "norm"], "left")
    kind = F.when(F.col("is_given"), F.regexp_replace("kind", "^lone_", "given_")).otherwise(F.regexp_replace("kind", "^lone_[fmx]_", "family_x_"))
    return parts.where(~alone).unionByName(lone.withColumn("kind", kind).select(*parts.columns))


def _settled(parts: DataFrame) -> DataFrame:
    """``parts`` with the gender of given names behind neutral titles, if any other mention tells it: the commoner one."""
    mentions = parts.where(F.col("kind").startswith("given_")).groupBy(F.concat(F.lit("given_x_"), F.element_at(F.split("kind", "_"), 3)).alias("kind"), "norm")
    told = mentions.agg(*(F.count_if(F.col("kind").startswith(f"given_{g}_")).alias(g) for g in "fm")).where("f + m > 0")
    told = told.select("kind", "norm", F.regexp_replace("kind", "_x_", F.when(F.col("f") >= F.col("m"), "_f_").otherwise("_m_")).alias("told"))
    return parts.join(told, ["kind", "norm"], "left").withColumn("kind", F.coalesce("told", "kind")).drop("told")


def _filled(value: Column, sur: Column, drop: str) -> Column:
    """``sur``'s characters in the places of those of ``value`` that aren't separators; what is left over follows."""
    rest = F.substring(sur, F.length(F.regexp_replace(value, drop, "")) + 1, F.length(sur))
    filled = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(drop), c).otherwise(F.substring(sur, F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), drop, "")), F.lit(1)))), "")
    return F.concat(filled, rest)


def replace(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with entities in ``text_col`` replaced; adds n_entities and kinds (in order of place).

    Surrogates depend on ``key``: who doesn't have it can't tell which entity one stands for by trying.
    """
    veil = Veil(docs)
    return veil.lift(_replaced(veil.docs, veil.name(text_col), key))


def _replaced(docs: DataFrame, text_col: str, key: str) -> DataFrame:
    kept = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    text = docs[text_col]
    found = docs.select(F.sha2(text, 256).alias("__key"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("all")).where(F.size("all") > 0)
    found = cut(found.dropDuplicates(["__key"]))
    each = found.select("__key", F.posexplode("all").alias("pos", "value"))
    each = each.withColumn("kind", _kind(F.col("value"))).withColumn("title", F.regexp_extract("value", r"^([^ .]+)\.? ", 1))
    names = F.split(F.regexp_replace("value", r"^[^ ]+ ", ""), " ")
    gender = F.when(F.col("title").rlike(f"^{FEMALE}$"), "f").when(F.col("title").rlike(f"^{MALE}$"), "m").otherwise("x")
    last = F.size(names) - 1
    parts = F.transform(names, lambda w, i: F.struct(i.alias("i"), F.when(last == 0, F.concat(F.lit("lone_"), gender, F.lit("_"), _script(w))).when(i == last, F.concat(F.lit("family_x_"), _script(w))).otherwise(F.concat(F.lit("given_"), gender, F.lit("_"), _script(w))).alias("kind"), F.initcap(F.lower(w)).alias("norm")))
    plain = F.array(F.struct(F.lit(0).alias("i"), F.col("kind").alias("kind"), _norm(F.col("kind"), F.col("value")).alias("norm")))
    parts = cut(each.select("__key", "pos", "value", F.col("kind").alias("what"), F.explode(F.when(F.col("kind") == "person", parts).otherwise(plain)).alias("p")).select("__key", "pos", "value", "what", "p.*"))
    parts = cut(_settled(_placed(parts)))
    table = surrogates(cut(parts.where(F.col("kind") != PLAIN).select("kind", "norm").distinct()), key)
    drawn = parts.join(table, ["kind", "norm"], "left").groupBy("__key", "pos", "value", "what").agg(F.array_sort(F.collect_list(F.struct("i", "sur"))).alias("surs"))
    sur = F.element_at("surs", 1)["sur"]
    value = F.col("value")
    cased = lambda s, w: F.when(w == F.upper(w), F.upper(s["sur"])).otherwise(s["sur"])
    new = (
        F.when(F.col("what") == PLAIN, value).when(F.col("what") == "person", F.concat_ws(" ", F.regexp_extract("value", r"^([^ ]+) ", 1), F.zip_with("surs", names, cased)))
        .when(F.col("what").isin("phone", "card", "ssn"), _filled(value, sur, r"\D")).when(F.col("what") == "iban", _filled(value, sur, " "))
        .when((F.col("what") == "email") & (value == F.upper(value)), F.upper(sur)).otherwise(sur)
    )
    by_text = drawn.select("__key", F.struct("pos", new.alias("new"), "what").alias("r")).groupBy("__key").agg(F.array_sort(F.collect_list("r")).alias("__new"))
    wide = docs.select(*(docs[c] for c in kept), F.sha2(text, 256).alias("__key")).join(by_text, "__key", "left")
    between = F.split(F.col(text_col), PATTERN, -1)
    whole = F.array_join(F.zip_with(between, F.col("__new"), lambda a, b: F.concat(a, F.coalesce(b["new"], F.lit("")))), "")
    out = {text_col: F.when(F.col("__new").isNull(), F.col(text_col)).otherwise(whole)}
    kinds = F.array_remove(F.transform("__new", lambda r: r["what"]), PLAIN)
    kinds = F.when(F.size(kinds) > 0, kinds)
    return wide.select(*(out.get(c, F.col(c)).alias(c) for c in kept), F.coalesce(F.size(kinds), F.lit(0)).cast("long").alias("n_entities"), kinds.alias("kinds"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document with its entities replaced."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace(docs).select("doc_id", "n_entities", "kinds", "text")


QUERIES = {"op2_pii_surrogates": query}

ORACLE_SQL: dict[str, str] = {}
