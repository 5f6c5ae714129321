"""Token files, vector codes and the prefix trie on small tables with nulls, ties and repeats, against brute force."""

import collections
import glob
import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinweave.llm import prefix_trie, token_files, vector_codes
from kinweave.llm.bpe import default_tokenizer

# --- token files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


def texts(n=300):
    rnd = random.Random(3)
    rows = [(k, " ".join(rnd.choice(["alpha", "Übung", "naïve", "42", "<|endoftext|>", "\n\n", "日本"]) for _ in range(rnd.randrange(60))), f"s{k % 3}") for k in rnd.sample(range(10 * n), n)]
    return rows + [(5000, None, None), (5001, "", ""), (None, "no id", "s0"), (5002, "long " * 200_000, "s1"), (5003, "same", "a"), (5003, "same", "b"), (5003, "other", "c")]


def put(spark, rows, path, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string").withColumnsRenamed({"part": "tokens"}).repartition(3)
    return token_files.write(docs, path, meta=["tokens"], **options)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, tokenizer, tmp_path, encoding):
    rows = texts()
    files = put(spark, rows, str(tmp_path / "f"), encoding=encoding, file_bytes=200_000, page=4096, row_group=1 << 20)
    ids = {(i, t or "", m): tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t, m in rows}
    got = sorted(files.read().collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["tokens"])
        assert any(k[0] == r["doc_id"] and k[2] == r["meta"]["tokens"] and v == r["tokens"] for k, v in ids.items())
        at += r["n_tokens"]
    stream = [t for r in got for t in r["tokens"]]
    sums = {r["start"]: r for r in token_files.checksums(files.read()).collect()}
    for r in got:
        assert sums[r["start"]]["ids_crc32"] == zlib.crc32(np.array(r["tokens"], dtype="<u4").tobytes()) and sums[r["start"]]["n_tokens"] == r["n_tokens"]
    for a, b in ((0, 5), (at - 3, at), (1000, 9000), (at, at + 9)):
        found = sorted(files.span(a, b).collect(), key=lambda r: r["start"])
        assert [t for r in found for t in r["tokens"]] == stream[a:b] and all(r["start"] >= a for r in found)
    written = glob.glob(f"{tmp_path}/f/tokens/*.parquet")
    assert len(written) > 3
    for f in written:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for k in range(meta.num_columns):
                c = meta.row_group(g).column(k)
                assert c.has_offset_index and (c.has_column_index or "tokens" in c.path_in_schema)
                if c.path_in_schema in ("doc_id", "before", "n_tokens"):
                    assert "DELTA_BINARY_PACKED" in c.encodings
    one = max((pq.ParquetFile(f).metadata.row_group(0) for f in written), key=lambda g: g.num_rows)
    tokens = next(one.column(k) for k in range(one.num_columns) if one.column(k).path_in_schema == "tokens.list.element")
    assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in tokens.encodings


def test_token_files_read_in_part(spark, tmp_path):
    files = put(spark, texts(), str(tmp_path / "f"), file_bytes=100_000)
    plan = files.documents()._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[1].split("\n")[0]
    few = files.read(low=100, high=200)
    assert "GreaterThanOrEqual(doc_id,100)" in few._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in few.collect()) == sorted(r[0] for r in texts() if r[0] is not None and 100 <= r[0] <= 200)


def test_token_files_empty(spark, tmp_path):
    files = put(spark, [], str(tmp_path / "f"))
    assert files.read().count() == 0 and token_files.checksums(files.read()).count() == 0 and files.span(0, 10).count() == 0
    with pytest.raises(ValueError):
        put(spark, [], str(tmp_path / "g"), encoding="none")


# --- vector codes


def brute_codes(rows, parts, entries, rounds, scale):
    def fine(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    good = [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in rows if fine(v)]
    size = next((len(v) for _, v, _ in sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1])) if v and len(v) % parts == 0), None)
    good = sorted((r for r in good if len(r[1]) == size), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = (size or 0) // parts
    cutup = lambda v: [v[k * w : (k + 1) * w] for k in range(parts)]
    books = [[cutup(v)[j] for _, v, _ in good[:entries]] for j in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, book: min(range(len(book)), key=lambda i: (dist(p, book[i]), i))
    for _ in range(rounds):
        for j in range(parts):
            own = collections.defaultdict(list)
            for _, v, _ in good:
                own[near(cutup(v)[j], books[j])].append(cutup(v)[j])
            books[j] = [[sum(c) // len(own[i]) for c in zip(*own[i], strict=True)] if i in own else e for i, e in enumerate(books[j])]
    out = []
    for i, v, label in good:
        code = [near(p, books[j]) for j, p in enumerate(cutup(v))]
        out.append((i, bytes(code).hex(), sum(dist(p, books[j][c]) for j, (p, c) in enumerate(zip(cutup(v), code, strict=True))), label))
    by_label = collections.Counter()
    for _, _, e, label in out:
        by_label[label] += e
    return collections.Counter((i, c, e, by_label[label]) for i, c, e, label in out)


def vectors(n, width, seed=1, coarse=False):
    rnd = random.Random(seed)
    draw = (lambda: float(rnd.randrange(-2, 3))) if coarse else (lambda: rnd.gauss(0, 1))
    rows = [(k, [draw() for _ in range(width)], rnd.choice(["a", "b", None])) for k in range(n)]
    rows += [(n + k, rows[0][1], "hot") for k in range(n // 2)]
    return rows + [(None, rows[1][1], None), (n * 2, None, "a"), (n * 2 + 1, [None] * width, "a"), (n * 2 + 2, [float("nan")] * width, "a"), (-1, [float("inf")] * width, "a"), (n * 2 + 3, [1.0], "a"), (-2, [], "a"), rows[3], rows[3]]


@pytest.mark.parametrize(("n", "width", "entries", "coarse"), [(300, 16, 12, False), (400, 8, 20, True), (9, 8, 64, False)])
def test_vector_codes(spark, n, width, entries, coarse):
    rows = vectors(n, width, coarse=coarse)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("code", F.lit("x")).repartition(3)
    made = vector_codes.Codes(df, parts=4, entries=entries, rounds=2)
    got = collections.Counter(tuple(r) for r in made.with_label_errors().select("vec_id", "code", "error", "label_error").collect())
    assert got == brute_codes(rows, 4, entries, 2, 256)


def test_filtering_assigns_as_comparing_all(spark):
    rnd = np.random.default_rng(2)
    for n, spread in ((5000, 3), (700, 1000), (1, 5), (50, 1)):
        points, book = rnd.integers(-spread, spread + 1, (n, 4)), rnd.integers(-spread, spread + 1, (40, 4))
        tree = vector_codes.Tree.unpack(vector_codes.Tree(points).pack())
        far = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
        code, error = tree.codes(book)
        assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
        counts, sums = tree.sums_by_entry(book)
        assert (counts == np.bincount(code, minlength=40)).all() and all((sums[i] == points[code == i].sum(axis=0)).all() for i in range(40))
    whole, single = vector_codes.Tree(rnd.normal(0, 300, (4096, 4)).astype(np.int64)).filtered(rnd.normal(0, 300, (8, 4)).astype(np.int64))
    assert sum(len(at) for at, _ in single) < 4096 and whole  # some subtrees are settled as a whole


def test_vector_codes_edges(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.Codes(spark.createDataFrame([], kind)).with_label_errors().count() == 0
    with pytest.raises(Exception, match="too large"):
        vector_codes.Codes(spark.createDataFrame([(1, [1e9] * 16, 1)], kind))


# --- prefix trie


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    members = collections.defaultdict(list)
    for c, s in sorted(seqs.items()):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out = set()
    for node, cs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        leaves = sum(not any(len(k) == len(m) + 1 and k[: len(m)] == m for k in members) for m in below)
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        ends = ",".join(str(c) for c in cs if len(seqs[c]) == len(node))
        children = sum(len(k) == len(node) + 1 and k[: len(node)] == node for k in members)
        out.add((cs[0], len(node), members[node[:-1]][0] if node else None, len(cs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def turns(seed, convs=150, most=9):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(400), convs):
        rows += [(c, t, rnd.choice(["user", "system", None]), rnd.choice(["hi", "yes", "", None, "日本語"])) for t in range(rnd.randrange(1, most))]
    rows += [(500 + k, t, "user", "same") for k in range(40) for t in range(7)]
    rows += [(700, t // 2 or None, "user", f"t{t % 5}") for t in range(300)] + [(None, 1, "user", "lost"), (100, None, None, None)]
    return rows + rows[:3]


def nodes(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"c": F.lit("x"), "d": F.lit("y")}).repartition(4)
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.ordered(df)))


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_trie(spark, seed):
    rows = turns(seed)
    got = [tuple(r) for r in nodes(spark, rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(rows)


def test_prefix_trie_edges(spark, monkeypatch):
    assert nodes(spark, []).count() == 0
    assert {tuple(r) for r in nodes(spark, [(3, 0, "user", "x")]).collect()} == brute_trie([(3, 0, "user", "x")])  # its only turn falls away
    monkeypatch.setattr(prefix_trie, "AT_ONCE", 7)  # a group's ids meet from several runs
    many = [(c, 0, "user", "x" if c % 3 else "y") for c in range(200)]
    assert {tuple(r) for r in nodes(spark, many).collect()} == brute_trie(many)
