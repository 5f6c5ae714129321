"""Each corpus operator on a small table with nulls, empty and repeated rows, against brute force or a round trip."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import bpe, exact_dedup, language_id, lm_scoring, media, mixing, ngram_join, pii, url_filter, warc
from kinweave.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def corpus(n=60, seed=5):
    """Random texts, near copies of some, and the awkward rows."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        rows.append((k, " ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(rnd.choice([1, 3, 5, 8, 40, 90]))), "en", f"s{k % 3}", 0))
    for k in range(n):
        w = (rows[rnd.randrange(n)][1]).split()
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = f"edit{rnd.randrange(9999)}"
        rows.append((n + k, " ".join(w).upper() if k % 4 == 0 else "  ".join(w), "en", "s0", 0))
    rows += [(1000, None, None, None, None), (1001, "", "en", None, 0), (1002, " \t\n", "en", "s1", 0), (None, "null id here", "de", "s1", 0), rows[0], rows[0]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().translate(LOWER).split()


def test_url_filter(spark):
    urls = ["http://a.example.org/es/x?y#z", "https://EXAMPLE.org/en/12", "http://x.com/de/", "http://com/fr/", "http://org", "http://net/x", "no scheme", "", None, "http://evil.com:80/de/", "http://a.b/?http://x.com/de/"] * 2
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)], "page_id int, url string, verdict int")
    got = sorted(url_filter.judge(pages, url_filter.rule_table(spark, url_filter.RULES)).select("page_id", "host", "path", "rule", "verdict").collect())
    for r, u in zip(got, urls, strict=True):
        rest = (u or "").split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *want)
    assert url_filter.judge(pages, url_filter.rule_table(spark, [])).where("verdict != 'allow'").isEmpty()
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark, url_filter.RULES)).isEmpty()


def test_pii_keeps_kinds_distinct_and_coreferent(spark):
    texts = ["Mail Ann.Lee@corp.example.com or ANN.LEE@CORP.EXAMPLE.COM", "call +49 30 1234567 or +49-30-1234567", "card 4111 1111 1111 1111 ip 10.1.2.3", "Mrs Anna Smith and Mr Smith; г-жа Анна Иванова", 'token = "24be64439e3e49cf46b2d7c90f"', None, "", "plain text 12", "ip 10.1.2.3"]
    d = spark.createDataFrame([(k, x, 1) for k, x in enumerate(texts)], "doc_id int, text string, kinds int")
    got = {r["doc_id"]: r for r in pii.replace(d).collect()}
    mail = got[0]["text"].split()
    assert mail[1].upper() == mail[3] and mail[1].endswith(".example") and "lee" not in mail[1]
    phone = got[1]["text"]
    assert phone.startswith("call +49 ") and phone[5:19].translate(str.maketrans(" ", "-")) == phone[23:] and "1234567" not in phone
    card = got[2]["text"].split()
    digits = [int(c) for c in "".join(card[1:5])]
    assert sum(x if k % 2 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(digits)) % 10 == 0
    assert got[8]["text"] == f"ip {card[6]}" and card[6] != "10.1.2.3"
    names = got[3]["text"].replace(";", "").split()
    assert names[2] == names[5] and names[1].endswith("a") and names[7].endswith("а") and names[0] == "Mrs"
    assert "24be" not in got[4]["text"] and got[4]["kinds"] == ["secret"]
    assert got[5]["text"] is None and got[6]["text"] == "" and got[7]["text"] == "plain text 12" and got[7]["n_entities"] == 0
    many = spark.range(3000).select(F.lit("ssn").alias("kind"), F.lpad(F.col("id").cast("string"), 9, "0").alias("norm"))
    table = pii.surrogates(many)
    assert table.count() == 3000 == table.select("sur").distinct().count()
    assert pii.replace(empty(spark)).isEmpty()


def test_pii_finds_places_where_short_entities_outnumber_them(spark, monkeypatch):
    letters = "bcdfghjklmnpqrstvwxyz"
    names = ["".join(x).title() for x in itertools.product(letters, "aeiou", letters)]
    entities = [("given_f_latin", x) for x in names] + [("family_x_latin", x) for x in names] + [("given_f_cyrillic", f"А{a}{b}") for a in "бвгдежзиклмнопр" for b in "абвгдежзийклмнопрстуфхцчшщэюя"]
    entities += [("email", f"{x}@{h}") for x in letters for h in ("x.com", "x.org", "y.com", "z.net")] + [("secret", "_" * 12), ("secret", "-" * 11 + "1")]
    entities += [("phone", f"{k:04d}") for k in range(10000)]
    monkeypatch.setattr(pii, "SAME_LENGTH", 2)
    drawn, loops = pii._surrogate, []

    def bounded(attempt):
        loops.append(attempt)
        assert attempt < 12, "draws don't end"
        return drawn(attempt)

    monkeypatch.setattr(pii, "_surrogate", bounded)
    got = pii.surrogates(spark.createDataFrame(entities, "kind string, norm string")).collect()
    assert len(got) == len(entities) == len({(r["kind"], r["sur"]) for r in got}) and not {(r["kind"], r["sur"]) for r in got} & set(entities)
    value = F.lit("+12 34")
    assert spark.range(1).select(pii._filled(value, F.lit("567890"), r"\D")).first()[0] == "+56 7890"


def test_pii_in_capitals_and_behind_neutral_titles(spark):
    secret = "9233A8EC41D07B5F6A2C9233A8EC41D07B5F6A2C"
    texts = [f'TOKEN = "{secret}"', f"Password: {secret.lower()}", "Dr Anna Smith", "Mrs Anna Smith", "DR. ANNA SMITH", "MR SMITH", "prof Iwan Smith", "Mr Iwan Smith", "I miss London", "Господин Иванов"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in pii.replace(d).collect()}
    assert [got[k]["kinds"] for k in (0, 1)] == [["secret"]] * 2 and secret not in got[0]["text"] and secret.lower() not in got[1]["text"]
    assert set(got[0]["text"][9:-1]) <= set("0123456789ABCDEF") and len(got[0]["text"]) == len(texts[0])
    name = [got[k]["text"].split(" ", 1)[1] for k in range(2, 8)]
    given, family = name[0].split()
    assert given.endswith("a") and "Anna" != given and "Smith" != family and name[1] == name[0]
    assert got[4]["text"] == f"DR. {name[0].upper()}" and got[5]["text"] == f"MR {family.upper()}"
    assert name[4] == name[5] and name[4].split()[0].endswith("n") and name[4].split()[1] == family
    assert got[8]["text"] == texts[8] and got[9]["text"].startswith("Господин ") and "Иванов" not in got[9]["text"]


def test_pii_keeps_whether_an_iban_is_right(spark):
    texts = ["Pay to DE89 3704 0044 0532 0130 00 now", "Pay to DE12 3704 0044 0532 0130 00 now", "or to GB29NWBK60161331926819."]
    out = [r["text"] for r in pii.replace(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()]

    def right(text):
        found = re.search(r"[A-Z]{2}\d\d[A-Z0-9 ]{11,}[A-Z0-9]", text)[0].replace(" ", "")
        return int("".join(str(int(c, 36)) for c in found[4:] + found[:4])) % 97 == 1

    assert [right(t) for t in texts] == [True, False, True] and [right(t) for t in (out[0], out[2])] == [True, True]
    assert all(a != b and len(a) == len(b) for a, b in zip(texts, out, strict=True))


def test_mpeg_round_trip(spark, docs, rows):
    stored = media.store_payload(docs.withColumn("frames", F.lit(1)))
    got = media.parse_audio(stored).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (r["text"] or "").encode()
        assert r["payload"] == raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert r["bad_checksums"] == r["skipped_bytes"] == 0 and r["vbr_frames"] == r["frames"] and r["tags"]["text_bytes"] == str(len(raw))
        assert r["duration_s"] == r["frames"] * 1152 / 32000
    assert media.parse_audio(media.store_payload(empty(spark))).isEmpty()


def test_mpeg_resynchronises():
    good = media.encode_stream(bytes(range(256)) * 30, 7680)
    whole = media.parse_stream(good)
    cut = whole["offsets"][2]
    noisy = good[:cut] + b"\xff\xfbnoise\xff\xe0" + good[cut:] + b"TAG" + bytes(125)
    p = media.parse_stream(noisy)
    assert len(p["offsets"]) == len(whole["offsets"]) and p["skipped"] == 9
    assert media.read_payload(noisy, p) == bytes(range(256)) * 30
    broken = bytearray(good)
    broken[whole["offsets"][1] + 5] ^= 1
    assert media.parse_stream(bytes(broken))["bad"] == 1
    assert media.parse_stream(b"")["offsets"] == [] and media.parse_stream(b"\xff" * 50)["offsets"] == []
    assert media.header(bytes((0xFF, 0xFB, 0x90, 0x00)))[2:5] == (417, 1152, 44100)


def test_warc(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    recs = [
        (1, "http://www.a.com/x/?b=2&a=1#f", 100, "response", "t1", None, h(content_length="5", date="1")), (2, "https://a.com/x?a=1&b=2&utm_x=3", 200, "revisit", "W/t1", None, h(content_length="0", date="2")),
        (3, "http://a.com/x?a=1&b=2", 90_000_000, "revisit", "t9", None, None), (4, "http://a.com/x?a=1&b=2", 100, "revisit", "t1", None, h(date="0")), (5, "http://b.com", 50, "revisit", None, None, None),
        (6, "http://c.com", 10, "response", None, "m1", h(server="s")), (7, "http://c.com/", 10, "response", None, "m2", h(server="t")), (8, "http://c.com", 20, "revisit", None, "m2", h(vary="x")),
        (9, "http://c.com", 30, "revisit", "e", None, None), (10, None, 30, "revisit", "e", None, None), (11, "http://c.com", None, "response", None, None, None),
    ]
    df = spark.createDataFrame(recs, "record_id int, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>")
    got = {r["record_id"]: (r["status"], r["response_id"], r["headers"]) for r in warc.resolve(df).collect()}
    assert got == {
        2: ("resolved", 1, {"content-length": "5", "date": "2"}), 3: ("mismatch", 1, None), 4: ("orphan", None, None), 5: ("orphan", None, None),
        8: ("resolved", 7, {"server": "t", "vary": "x"}), 9: ("unvalidated", 7, {"server": "t"}),
    }
    assert warc.resolve(df.limit(0)).isEmpty()


def shingle_set(text):
    w = words(text)
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def linked_components(rows):
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k, r in enumerate(rows):
        groups[find(k)].append(r[0])
    return sets, [min((i for i in groups[find(k)] if i is not None), default=None) if sets[k] else r[0] for k, r in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"group_limit": 8, "pairs_up_to": 2}])
def test_ngram_join(docs, rows, options):
    sets, comps = linked_components(rows)
    got = ngram_join.ShingleJoin(docs, **options).rows.collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r[0], len(s), c)) for r, s, c in zip(rows, sets, comps, strict=True))


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ShingleJoin(empty(spark)).rows.isEmpty()
    one = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert ngram_join.ShingleJoin(one).kept().count() == 2
    assert sorted(map(tuple, ngram_join.ShingleJoin(one).rows.collect())) == [(1, 0, 1), (2, 0, 2)]


def test_ngram_join_keeps_other_texts_with_the_same_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (None, c + " end"), (None, " ".join("xyz")), (None, " ".join("uvw")), (7, None), (7, None)]
    d = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, __c int").repartition(3)
    got = sorted((repr(r["doc_id"]), r["text"] or "") for r in ngram_join.ShingleJoin(d).kept().collect())
    assert got == sorted((repr(i), t or "") for i, t in [(1, a), (2, b), (3, c), (None, "x y z"), (None, "u v w"), (7, None), (7, None)])


def test_partenum_signatures_meet():
    rnd = np.random.default_rng(3)
    for size in (4, 7, 20, 75, 100, 400):
        x = rnd.integers(0, 1 << 63, size, dtype=np.uint64)
        for _ in range(20):
            keep = rnd.permutation(size)[: max(1, -(-6 * size // 7))]  # 6/7 shared and as much new: about 0.75
            y = np.concatenate([x[keep], rnd.integers(0, 1 << 63, size - len(keep), dtype=np.uint64)])
            inter = len(np.intersect1d(x, y))
            if 4 * inter >= 3 * (2 * size - inter):
                a, b = (ngram_join._all_signatures(np.unique(v), 0) for v in (x, y))
                (a, i), (b, j) = a, b
                assert set(a[:i]) & set(b) or set(a) & set(b[:j])


@pytest.mark.parametrize("family", [0, 1])
def test_partenum_signatures_meet_at_the_edge_of_a_link(family):
    rnd = np.random.default_rng(11)
    for size in (3, 8, 21, 28, 60, 90, 120, 150, 333, 500):
        x = rnd.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
        for low, high in ((size // 4, size), (0, 4 * size // 3), (size // 7, size + size // 7)):  # a subset, a superset, some exchanged
            (a, i), (b, j) = (ngram_join._all_signatures(np.unique(v), family) for v in (x[:size], x[low:high]))
            assert set(a[:i]) & set(b) or set(a) & set(b[:j])


def test_coarse_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 700):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 1 << 63, n // 2 + 1, dtype=np.uint64)]))
        many = len(np.setxor1d(x, y))
        fine = [ngram_join._sketch(v) for v in (x, y)]
        coarse = [ngram_join._coarse(s) for s in fine]
        low, high = (int(ngram_join._differ(*ngram_join._folded(s))) for s in (coarse, fine))
        assert low <= high <= many and 4 * len(coarse[0]) == len(fine[0])


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (100, 102)] + [(200, k) for k in range(201, 230)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[k] == 0 for k in range(41)) and {got[k] for k in (100, 101, 102)} == {100} and all(got[k] == 200 for k in range(200, 230))


def test_chain_is_forward_backward():
    rng = np.random.default_rng(1)
    e, off, moves = rng.normal(size=(9, 3)), np.array([0, 5, 5, 6, 9]), rng.normal(size=(3, 3))
    want = np.zeros((9, 3))
    for a, b in itertools.pairwise(off):
        total = 0
        for labels in itertools.product(range(3), repeat=b - a):
            p = math.exp(sum(e[a + k, x] for k, x in enumerate(labels)) + sum(moves[x, y] for x, y in itertools.pairwise(labels)))
            total += p
            for k, x in enumerate(labels):
                want[a + k, x] += p
        want[a:b] /= total
    for segment in (1, 2, 32):
        assert np.allclose(language_id.chain(e, off, moves, segment), want)


def test_language_id(spark):
    rnd = random.Random(2)
    pools = {"en": ["the", "and", "thing", "with", "ship"], "de": ["der", "und", "schön", "nicht", "über"], "ru": ["это", "как", "что", "дом", "ещё"]}
    rows = [(k, " ".join(rnd.choice(pools[x]) + rnd.choice(["", ",", "."]) for _ in range(rnd.randrange(4, 60))), x) for k, x in enumerate(list(pools) * 60)]
    rows += [(900, None, "en"), (901, "12 34 !!", "de"), (902, "", None), (None, "the thing and the ship with", None), (903, "the and with der und schön", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.LanguageId(d, train=~language_id.held_out(F.col("doc_id"))).predict(d.withColumn("score", F.lit(1))).collect()
    assert len(got) == len(rows)
    assert all(r["lang_pred"] == r["lang"] for r in got if r["lang"] and r["text"] and r["doc_id"] < 900)
    by = {r["doc_id"]: r for r in got}
    assert [by[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and by[None]["lang_pred"] == "en" and by[903]["switches"] >= 1
    assert all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_id.LanguageId(none).predict(none).first()["lang_pred"] == "und"


def test_language_id_learns_from_few_words(spark):
    table = spark.createDataFrame([(k, t, lang) for k in range(30) for t, lang in (("the house and the garden", "en"), ("das Haus und der Garten", "de"))], "doc_id long, text string, lang string")
    got = language_id.LanguageId(table).predict(spark.createDataFrame([("the garden",), ("das Haus",)], "text string")).collect()  # copies count once: ten words
    assert [r["lang_pred"] for r in got] == ["en", "de"]


def test_language_id_words_are_letters_of_any_script():
    text = "été, мир—नमस्ते 1𠀁"
    data = np.frombuffer((text + "ab").encode(), dtype=np.uint8)
    points, starts, ends, bounds = language_id._letters(data, np.array([0, len(text.encode()), len(data)]))
    assert ["".join(map(chr, points[a:b])) for a, b in zip(starts, ends, strict=True)] == ["été", "мир", "नमस्ते", "𠀁", "ab"]
    assert bounds.tolist() == [0, len(text), len(text) + 2]


def test_language_id_takes_capitals_of_any_script_for_the_same_words(spark):
    pools = {"ru": ["дом", "сад", "мир"], "el": ["και", "γη", "νερό"]}
    rnd = random.Random(5)
    rows = [(" ".join(rnd.choice(pools[x]) for _ in range(12)), x) for x in [*pools] * 20]
    model = language_id.LanguageId(spark.createDataFrame(rows, "text string, lang string"))
    plain = model.predict(spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(rows)], "k int, text string, lang string")).collect()
    loud = model.predict(spark.createDataFrame([(k, t.upper()) for k, (t, _) in enumerate(rows)], "k int, text string")).collect()
    assert all(r["lang_pred"] == r["lang"] for r in plain)
    assert sorted((r["k"], r["lang_pred"], r["score"]) for r in plain) == sorted((r["k"], r["lang_pred"], r["score"]) for r in loud)


def test_lexicons_take_words_that_occur_mostly_with_one_label():
    words = np.array([3, 5, 9], dtype=np.uint64)
    kind, text_of = np.array([0, 0, 0, 1, 1, 1, 1, 2]), np.array([0, 1, 2, 0, 1, 2, 3, 3])
    found = language_id.Lexicons.learned(words, kind, text_of, np.array([0, 0, 0, 1]), 2)
    assert found.words.tolist() == [3] and found.labels.tolist() == [0]  # 5 occurs with both alike, 9 in one text
    assert [x.tolist() for x in found.find(np.array([9, 3], dtype=np.uint64))] == [[1], [0]]


def test_language_model(docs, rows, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FREQUENT", 20)
    held = lm_scoring.held_out(F.col("doc_id"))
    model = lm_scoring.LanguageModel(docs, train=~held)
    got = model.score(docs.select("doc_id", "text"), held).collect()
    routed = lm_scoring.LanguageModel(docs, train=~held, broadcast_bytes=0)
    assert routed.mu == model.mu
    key = lambda r: (repr(r["doc_id"]), r["text"] or "")
    other = sorted(routed.score(docs.select("doc_id", "text"), held).collect(), key=key)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = collections.Counter(w for r in rows if not out(r[0]) for w in [*words(r[1]), None])
    n, z = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    for r, o, want in zip(sorted(got, key=key), other, sorted(rows, key=lambda r: (repr(r[0]), r[1] or "")), strict=True):
        tok = [*words(want[1]), None]
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["train_tokens"]) == (want[0], out(want[0]), len(tok), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in tok) and math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.1) / z) for w in tok), abs_tol=1e-6)
        assert math.isclose(r["score"], o["score"], abs_tol=1e-9) and math.isclose(r["base_score"], o["base_score"], abs_tol=1e-6)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_language_model_score_is_near_that_of_exact_counts(spark):
    """Levels are within a quarter of an octave of counts, and some 2 % of the n-grams that aren't there seem to be."""
    rnd = random.Random(8)
    texts = [(k, " ".join(rnd.choice(WORDS) + str(int(rnd.paretovariate(0.7)) % 50) for _ in range(rnd.choice([0, 1, 30, 300])))) for k in range(300)]
    texts += [(900, None), (901, "Never seen BEFORE"), (902, "alpha1 " * 20000), texts[5], texts[5]]
    d = spark.createDataFrame([(*t, 1.5, "x") for t in texts], "doc_id long, text string, score double, __rare string")
    held = lm_scoring.held_out(F.col("doc_id"))
    model = lm_scoring.LanguageModel(d, train=~held)
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    uni, big, many = collections.Counter(), collections.Counter(), 0
    for i, t in texts:
        if not out(i):
            tok = [*words(t), None]
            uni.update(tok)
            big.update(zip(["start", *tok], tok, strict=False))
            many += 1
    n, v = sum(uni.values()), len(uni)
    error, tokens = 0.0, 0
    got = model.score(d, held, keep=["doc_id", "score"]).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in texts) and len(got[0]) == 7
    of = dict(texts)
    for r in got:
        tok = [*words(of[r["doc_id"]]), None]
        want = 0.0
        for h, w in zip(["start", *tok], tok, strict=False):
            base, c = (uni[w] + 0.1) / (n + 0.1 * (v + 1)), many if h == "start" else uni[h]
            want += math.log10((big[h, w] + model.mu * base) / (max(c, big[h, w]) + model.mu))
        assert abs(r["score"] - want) <= 0.35 * len(tok)
        error, tokens = error + abs(r["score"] - want), tokens + len(tok)
    assert error <= 0.08 * tokens


def test_language_model_fits_mu_whatever_the_filter_size(spark, docs):
    few = spark.createDataFrame([(k, f"alpha beta gamma w{k} x{k % 7}") for k in range(200)], "doc_id long, text string")
    fitted = set()
    for d in (docs, few):
        model, routed = (lm_scoring.LanguageModel(d, broadcast_bytes=b) for b in (None, 0))
        assert routed.filter is None and routed.mu == model.mu
        fitted.add(model.mu)
    assert fitted != {64.0}


def test_language_model_asks_once_for_each_ngram_of_a_block(spark, docs, monkeypatch):
    texts = [(k, "the " * 2000 + f"w{k % 9}") for k in range(40)]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string")).coalesce(2)
    model, routed = (lm_scoring.LanguageModel(d, broadcast_bytes=b) for b in (None, 0))
    score = lambda m: sorted((repr(r["doc_id"]), r["text"] or "", r["n_tokens"], round(r["score"], 6)) for r in m.score(d, F.lit(False)).collect())
    want = score(model)
    assert score(routed) == want
    _, asked = routed._asked(spark.createDataFrame(texts, "id long, __text string").coalesce(1))
    assert asked.agg(F.sum(F.length("uni") + F.length("big"))).first()[0] == 8 * (11 + 20)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lm_scoring, "ASKED_BYTES", 20000)
    assert score(routed) == want


AWKWARD = [None, "", "a" * 3000, "<|endoftext|>" * 300, "привет мир " * 300, "日本語テキスト" * 400, " " * 3000, "x  \n\n y\t's're" * 400, "é" * 5001, "  a　b" * 500, "don't 'll" + "<|endoftext|>" * 90 + " end"]


def test_bpe(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    texts = [r[1] for r in rows] + AWKWARD + [(x or "")[7:] + "zz" for x in AWKWARD] + AWKWARD[:4]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    long = " ".join(f"{w}{k}" for k in range(400) for w in WORDS[:3])
    d = d.unionByName(spark.createDataFrame([(5000, long), (5001, "x " + long), (5002, long + " y")], "doc_id int, text string"))
    encoded = bpe.encode(d)
    back = {r["doc_id"]: r for r in bpe.decode(encoded).collect()}
    digests = {r["doc_id"]: r for r in bpe.encode(d, digest_only=True).collect()}
    for r in d.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        got = back[r["doc_id"]]
        assert bytes(got["ids"]) == raw and got["n_tokens"] == len(ids) and got["decoded"] == t.decode(ids, skip_special_tokens=False)
        assert digests[r["doc_id"]]["ids_sha256"] == hashlib.sha256(raw).hexdigest() and digests[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(got["decoded"].encode()).hexdigest()
    assert bpe.encode(empty(spark)).isEmpty()


def test_bpe_repair_from_any_cut():
    codec = bpe.Codec.load(bpe.default_tokenizer())
    rnd = random.Random(4)
    for text in ["".join(rnd.choice(["a", "bc", " ", "  ", "\n", "é", "'s", "9", "<|endoftext|>", "!", "　"]) for _ in range(60)) for _ in range(60)]:
        raw = text.encode()
        places = sorted({p for p in (rnd.randrange(len(raw)) for _ in range(5)) if p and raw[p] & 0xC0 != 0x80})
        ends = [*places, len(raw)]
        parts = [(a, b, codec.encode([raw[a:b]])[0]) for a, b in zip([0, *ends], ends, strict=False)]
        assert bpe.repair(codec, raw, parts).tolist() == codec._slowly([raw])[0].tolist()


def test_mixing(spark, docs, rows):
    got = mixing.mix(docs.withColumn("size", F.lit(1))).collect()
    assert len(got) == len(rows)
    sources = collections.Counter()
    for r in rows:
        sources[r[3]] += len(words(r[1]))
    order = sorted((s for s in sources if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sources.values()), set()
    while True:
        level = (total - sum(3 * sources[s] for s in capped)) / max(1, sum(weight[s] for s in sources if s not in capped))
        more = {s for s in sources if s not in capped and level * weight[s] > 3 * sources[s]}
        if not more:
            break
        capped |= more
    taken = collections.Counter()
    for r in got:
        s = r["source"]
        assert math.isclose(r["target"], 3 * sources[s] if s in capped else level * weight[s]) and r["source_size"] == sources[s] and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sources:
        target = 3 * sources[s] if s in capped else level * weight[s]
        assert abs(taken[s] - target) <= 3  # repeated rows share what falls to them, rounded down
    again = mixing.mix(docs.withColumn("size", F.lit(1))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.repeated(docs).columns == docs.columns and mixing.repeated(docs).count() == sum(r["copies"] for r in got)
    assert mixing.mix(empty(spark)).isEmpty() and mixing.repeated(empty(spark)).isEmpty()


@pytest.mark.parametrize("bits", [None, 1])
def test_exact_dedup(spark, docs, rows, bits):
    """With a digest of one hexadecimal digit nearly every hit is a collision that the byte check must find."""
    digest = exact_dedup.sha256 if bits is None else (lambda text: F.encode(F.substring(F.sha2(text, 256), 1, bits), "utf-8"))
    found = exact_dedup.ExactDedup(docs, digest=digest)
    norm = lambda x: bytes(b for b in (x or "").encode() if b not in b"\x20\t\n\x0b\x0c\r")
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] if r[0] is not None else 0))
    want, stay = [], collections.Counter()
    for g in groups.values():
        best = min(g)
        ident = None if best[1] else best[2]
        for k, m in enumerate(sorted(g)):
            want.append((None if m[1] else m[2], ident, len(g), k == 0))
        stay[ident] += 1
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.rows.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    kept = found.kept()
    assert kept.columns == docs.columns and collections.Counter(r["doc_id"] for r in kept.collect()) == stay
    assert exact_dedup.ExactDedup(empty(spark)).rows.isEmpty()


def test_dedup_state_goes_on_with_new_rows(spark, tmp_path):
    schema = "digest binary, chars int, ident long, locator string, row long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(b"a", 3, 7, "f1", 0), (b"b", 1, 8, "f1", 1)])
    staged = spark.read.parquet(str(tmp_path / "in"))
    for more in ([], [(b"a", 5, 9, "f2", 2), (b"c", 1, 1, "f2", 3)]):
        if more:
            put(more)
        exact_dedup.run_stream(spark, str(tmp_path / "in"), staged.schema, str(tmp_path / "c"))
    got = {bytes(r["digest"]): (r["keep_id"], r["keep_chars"], r["locator"], r["group_size"]) for r in exact_dedup.read_state(spark, str(tmp_path / "c")).collect()}
    assert got == {b"a": (9, 5, "f2", 2), b"b": (8, 1, "f1", 1), b"c": (1, 1, "f2", 1)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(1)
    base = [(k, " ".join(rnd.choice(WORDS) + chr(97 + rnd.randrange(26)) for _ in range(40)), "en", f"s{k % 2}", 0) for k in range(30)]
    near = [(100 + k, r[1] + " more", "en", "s0", 0) for k, r in enumerate(base[:5])]
    more = [(200, base[9][1].replace(" ", "  "), "en", "s1", 0), (201, "123 456", "en", "s1", 0), (202, None, "en", "s1", 0)]
    spark.createDataFrame(base + near + more, DOCS).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = sorted(r["doc_id"] for r in docs.collect())
    assert seen["language_id"] == sorted([r[0] for r in base + near] + [200])
    assert seen["exact_dedup"] == sorted([r[0] for r in base + near if r[0] != 9] + [200])
    assert seen["ngram_jaccard_join"] == sorted([r[0] for r in base if r[0] != 9] + [200])
    assert set(seen["source_mixing"]) <= set(seen["ngram_jaccard_join"]) and seen["bpe_encoding"] == seen["source_mixing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["bpe_encoding"])


def test_pipeline_stages_keep_columns_rows_and_empty_tables(spark):
    import corpus_pipeline

    rnd = random.Random(3)
    text = lambda: " ".join(rnd.choice(WORDS) + chr(97 + rnd.randrange(26)) for _ in range(60))
    base = [(k, text(), "en", None if k % 5 == 0 else f"s{k % 3}", k / 2, -1, "z", b"k", f"c{k}") for k in range(40)]
    rows = [*base, base[3], base[3], (None, text(), None, None, 9.5, -1, None, None, None), (4, text(), "en", "s1", 9.5, None, "q", None, "other"), (50, base[7][1] + " end", "en", "s1", 0.0, 0, "near", None, None)]
    schema = "doc_id long, text string, lang string, source string, score double, size int, lang_pred string, __key binary, `column 2` string"
    docs = spark.createDataFrame(rows, schema).repartition(2)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").isEmpty(), name
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        got = collections.Counter(map(repr, map(tuple, out.collect())))
        want = collections.Counter(repr((*r[:7], r[7], r[8])) for r in rows)
        assert set(got) <= set(want), name
        if name == "language_id":
            assert got == want
        elif name == "exact_dedup":
            assert got == collections.Counter(set(want))
        elif name == "ngram_jaccard_join":
            assert got == collections.Counter(k for k in want if "'near'" not in k)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(rows) and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").isEmpty()




def test_language_model_fits_mu_on_every_training_text(spark, monkeypatch):
    """The tallies hold every training token, and mu is the likeliest by a plain sum over the tokens of all texts."""
    rnd = random.Random(4)
    d = spark.createDataFrame([(k, " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(9) * rnd.randrange(9)) for _ in range(rnd.randrange(12)))) for k in range(2500)], "doc_id long, text string").repartition(3)
    held = lm_scoring.held_out(F.col("doc_id"))
    seen = []
    fitted = lm_scoring.LanguageModel._fitted
    monkeypatch.setattr(lm_scoring.LanguageModel, "_fitted", lambda self, t: seen.append(t.agg(F.sum("n")).first()[0]) or fitted(self, t))
    model, passing, routed = (lm_scoring.LanguageModel(d, train=~held, broadcast_bytes=b) for b in (None, None, 0))
    scores = [sorted(map(tuple, m.score(d, held, keep=["doc_id"], own=own).select("doc_id", "score").collect())) for m, own in ((model, False), (passing, True), (routed, True))]
    assert scores[0] == scores[1] == scores[2] and seen == [model.total] * 3 and model.mu == passing.mu == routed.mu
    sums = np.zeros(len(lm_scoring.MUS))
    for r in d.where(~held).collect():
        hashed = next(iter(lm_scoring.word_hashes(lm_scoring.pa.array([r["text"]]))))
        tok, before, starts = lm_scoring._tokens(hashed[2], hashed[3])
        f = model.filter.value
        uni, big = lm_scoring.STANDS[f.levels(tok, 0)], lm_scoring.STANDS[f.levels(lm_scoring._bigrams(before, tok), 1)]
        less = [np.maximum(x - 1, 0) for x in (uni, lm_scoring._context(uni, starts, model.texts), big)]
        sums += [np.log10(lm_scoring._probabilities(*less, mu, model.total, model.types)).sum() for mu in lm_scoring.MUS]
    assert model.mu == lm_scoring.MUS[int(np.argmax(sums))]
