"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters and their marks, of any script, in lower case; every word has affix, n-gram and lexicon features, hashed into one
table of weights, and labels follow each other by learned transitions. A label's lexicon holds the words of the sample that occur mostly in its texts. Weights and transitions are fitted by
maximum likelihood on sequences put together from pieces of labelled texts, so that languages switch within
them. Forward-backward then gives each word its label probabilities; a text's prediction is the label with the
largest mean, and its score that mean. Sequences are taken in segments whose transfer matrices are chained, which is
exact, so that long texts cost what short ones do.

The classifier is fitted on a bounded sample: at most about ``FIT_TEXTS`` labelled texts (evenly by label, by
a hash of the text) and ``FIT_WORDS`` words of them (distinct texts, ``FIT_CHARS`` characters of each). The ``FIT_LABELS`` commonest labels
are learned; with many, the table of weights gets fewer bits, so that all of them stay below 64 MB. Null texts and texts without a letter are ``und`` with score
0, as is everything if no labelled text is there to learn from. Rows whose label is null aren't learned from.
Repeated rows get a row each; an empty table gives an empty table; columns named like
the added ones are replaced, others are kept whatever their names.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.names import Veil
from kinweave.llm.storage import small_batches
from kinweave.llm.words import U64, _power, buffers, lean, mix, runs

FIT_TEXTS = 2400
FIT_WORDS = 400_000
#: Characters of a text that may go into the sample (80 MB of text at most altogether).
FIT_CHARS = 32_768
FIT_LABELS = 512
#: Bits of the table of weights, and of all labels' tables together.
BITS, ALL_BITS = 17, 24
#: A lexicon takes words of at least so many texts, and this share of a word's texts must be of its label (labels weighed alike).
LEXICON_TEXTS, LEXICON_SHARE = 3, 0.6
LENGTH, BATCH, EPOCHS, RATE = 64, 64, 3, 0.3
SEGMENT = 32
SEED = 7

#: Code points from here on, up to 0x40000, are ideographs.
PLANES = 0x20000


@cache
def _letter_table() -> np.ndarray:
    """Whether a code point is a letter or a mark; one entry for all from ``PLANES`` on."""
    table = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(PLANES + 1)])
    table[PLANES] = True
    return table


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _plain(text: Column) -> Column:
    """Lower-cased text, null where there is no letter."""
    return F.when(text.rlike(r"\p{L}"), F.lower(F.make_valid_utf8(text)))


def _letters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts with offsets ``bounds``, starts and ends of their letter runs, and the texts' offsets in code points."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    if len(points) != len(data):
        bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    word = _letter_table()[np.minimum(points, PLANES)]
    before, after = np.ones(len(points), dtype=bool), np.ones(len(points), dtype=bool)
    before[1:], after[:-1] = ~word[:-1], ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(points))]
    before[inner] = True
    after[inner - 1] = True
    return points, np.flatnonzero(word & before), np.flatnonzero(word & after) + 1, bounds


class Spans:
    """Hashes of ranges of code points of one buffer."""

    def __init__(self, points: np.ndarray):
        up, self.down = _power(len(points) + 1)
        self.sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum((mix((points + U64(1)) * U64(0x9E3779B97F4A7C15)) | U64(1)) * up[: len(points)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


class Lexicons:
    """Words (sorted hashes) and the label that each belongs to."""

    def __init__(self, words: np.ndarray, labels: np.ndarray):
        self.words, self.labels = words, labels

    @classmethod
    def learned(cls, words: np.ndarray, kind: np.ndarray, text_of: np.ndarray, labels: np.ndarray, many: int) -> Lexicons:
        """From the distinct ``words``, which of them each token is (``kind``), its text, and the texts' labels."""
        once = np.unique(kind.astype(np.int64) * max(1, len(labels)) + text_of)
        seen = np.zeros((len(words), many), dtype=np.float32)
        np.add.at(seen, (once // max(1, len(labels)), labels[once % max(1, len(labels))]), 1)
        texts = seen.sum(axis=1)
        share = seen / np.maximum(np.bincount(labels, minlength=many), 1)
        best = share.argmax(axis=1)
        owned = (texts >= LEXICON_TEXTS) & (share[np.arange(len(words)), best] >= LEXICON_SHARE * share.sum(axis=1))
        return cls(words[owned], best[owned])  # np.unique has sorted them

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are in a lexicon, and in whose."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        own = np.flatnonzero(self.words[at] == hashes)
        return own, self.labels[at[own]]


def _features(spans: Spans, starts: np.ndarray, ends: np.ndarray, lexicons: Lexicons, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, word, value): the word itself, its lexicon, affixes of 1 to 4 letters, and its 3-letter grams, which weigh 2 in all."""
    n = ends - starts
    every = np.arange(len(n))
    hashes = spans(starts, ends)
    listed, label = lexicons.find(hashes)
    feats, words = [hashes, mix((label + 1000).astype(np.uint64))], [every, listed]
    values = [np.ones(len(n) + len(listed), dtype=np.float32)]
    for k in range(1, 5):
        own = every[n >= k]
        for kind, (s, e) in ((2 * k, (starts[own], starts[own] + k)), (2 * k + 1, (ends[own] - k, ends[own]))):
            feats.append(mix(spans(s, e) + U64(kind)))
            words.append(own)
            values.append(np.ones(len(own), dtype=np.float32))
    grams = np.maximum(n - 2, 0)
    own = np.repeat(every, grams)
    at = starts[own] + np.arange(len(own)) - np.repeat(np.cumsum(grams) - grams, grams)
    feats.append(mix(spans(at, at + 3) + U64(99)))
    words.append(own)
    values.append((2 / np.maximum(grams, 1))[own].astype(np.float32))
    return (np.concatenate(feats) >> U64(64 - bits)).astype(np.int64), np.concatenate(words), np.concatenate(values)


def _bits(labels: int) -> int:
    """Bits of a label's table of weights."""
    return min(BITS, ALL_BITS - max(1, labels - 1).bit_length())


def _emissions(weights: np.ndarray, feats: tuple[np.ndarray, np.ndarray, np.ndarray], words: int) -> np.ndarray:
    f, w, v = feats
    return np.stack([np.bincount(w, weights=weights[f, k] * v, minlength=words) for k in range(weights.shape[1])], axis=1)


def chain(emissions: np.ndarray, offsets: np.ndarray, moves: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Label probabilities of every word by forward-backward, texts laid end to end.

    ``moves`` are log weights of (label, next label). A text's segments first give their transfer matrices;
    chaining those gives the state before and behind each segment, and all segments are then worked out at once.
    """
    n, labels = emissions.shape
    if not n:
        return np.zeros((0, labels))
    step = np.exp(moves - moves.max())
    x = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    lengths = np.diff(offsets)
    parts = -(-lengths // segment)
    first_part = np.concatenate([[0], np.cumsum(parts)])
    total = int(first_part[-1])
    own = np.repeat(np.arange(len(lengths)), parts)
    rank = np.arange(total) - first_part[own]
    start = offsets[own] + rank * segment
    size = np.minimum(segment, offsets[own + 1] - start)
    opening = rank == 0
    at = np.minimum(start[None, :] + np.arange(segment)[:, None], n - 1)
    live = np.arange(segment)[:, None] < size[None, :]
    padded = x[at]

    scale = lambda a: a / np.maximum(a.max(axis=tuple(range(1, a.ndim)), keepdims=True), 1e-300)
    transfer = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for t in range(segment):
        moved = transfer if t == 0 else transfer @ step
        if t == 0:
            moved = np.where(opening[:, None, None], transfer, transfer @ step)
        transfer = np.where(live[t][:, None, None], scale(moved * padded[t][:, None, :]), transfer)

    order = np.argsort(-parts, kind="stable")
    active = np.searchsorted(-parts[order], -np.arange(1, int(parts.max()) + 1), side="right")
    into, behind = np.ones((total, labels)), np.ones((total, labels))
    a = np.ones((len(lengths), labels))
    for k, many in enumerate(active.tolist()):
        seg = first_part[order[:many]] + k
        into[seg] = a[:many]
        a[:many] = scale(np.einsum("ij,ijk->ik", a[:many], transfer[seg]))
    b = np.ones((len(lengths), labels))
    for k in range(len(active) - 1, -1, -1):
        seg = first_part[order[: active[k]]] + k
        behind[seg] = b[: active[k]]
        b[: active[k]] = scale(np.einsum("ijk,ik->ij", transfer[seg], b[: active[k]]))

    forward = np.empty((segment, total, labels))
    a = into
    for t in range(segment):
        moved = np.where(opening[:, None], a, a @ step) if t == 0 else a @ step
        a = np.where(live[t][:, None], scale(moved * padded[t]), a)
        forward[t] = a
    out = np.empty((n, labels))
    b = behind
    for t in range(segment - 1, -1, -1):
        on = live[t]
        both = forward[t] * b
        out[at[t][on]] = (both / both.sum(axis=1, keepdims=True))[on]
        b = np.where(on[:, None], scale((padded[t] * b) @ step.T), b)
    return out


def _expected(x: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities and expected moves of a batch of sequences of one length: x is (time, sequence, label)."""
    time, many, labels = x.shape
    a, b = np.empty_like(x), np.ones_like(x)
    a[0] = x[0] / x[0].sum(axis=1, keepdims=True)
    for t in range(1, time):
        v = (a[t - 1] @ step) * x[t]
        a[t] = v / v.sum(axis=1, keepdims=True)
    moves = np.zeros((labels, labels))
    for t in range(time - 1, 0, -1):
        v = x[t] * b[t]
        both = a[t - 1][:, :, None] * step[None] * v[:, None, :]
        moves += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        v = v @ step.T
        b[t - 1] = v / v.sum(axis=1, keepdims=True)
    both = a * b
    return both / both.sum(axis=2, keepdims=True), moves


def fit(texts: list[str], labels: np.ndarray, many: int, most_words: int = FIT_WORDS) -> tuple[np.ndarray, np.ndarray, Lexicons]:
    """Weights (feature, label), moves (label, next label) and lexicons from lower-cased texts with label numbers below ``many``."""
    rng = np.random.default_rng(SEED)
    bits = _bits(many)
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    points, starts, ends, bounds = _letters(data, bounds)
    spans = Spans(points)
    text_of = np.searchsorted(bounds, starts, side="right") - 1
    words, first, kind = np.unique(spans(starts, ends), return_index=True, return_inverse=True)
    lexicons = Lexicons.learned(words, kind, text_of, labels, many)
    f, w, v = _features(spans, starts[first], ends[first], lexicons, bits)
    by_word = np.argsort(w, kind="stable")
    f, v = f[by_word], v[by_word]
    edge = np.searchsorted(w[by_word], np.arange(len(first) + 1))
    # pieces of 4 to 24 words of one text, shuffled and laid end to end: languages switch where pieces meet
    pieces, edges = [], np.searchsorted(text_of, np.arange(len(texts) + 1))
    for k in range(len(texts)):
        at = int(edges[k])
        while at < edges[k + 1]:
            stop = min(int(edges[k + 1]), at + int(rng.integers(4, 25)))
            pieces.append((at, stop))
            at = stop
    weights, squares = np.zeros((1 << bits, many), dtype=np.float32), np.full((1 << bits, many), 1e-6, dtype=np.float32)
    moves, move_squares = np.zeros((many, many)), np.full((many, many), 1e-6)
    rng.shuffle(pieces)
    line = np.concatenate([np.arange(a, b) for a, b in pieces])[:most_words] if pieces else np.zeros(0, np.int64)
    line = np.resize(line, -(-len(line) // LENGTH) * LENGTH).reshape(-1, LENGTH)  # the last line is filled up from the start
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(line)), max(1, len(line) // BATCH)):
            if not len(batch):
                continue
            seq = line[batch].T
            used, place = np.unique(kind[seq], return_inverse=True)
            rows = np.concatenate([np.arange(edge[u], edge[u + 1]) for u in used.tolist()])
            feats = (f[rows], np.repeat(np.arange(len(used)), edge[used + 1] - edge[used]), v[rows])
            e = _emissions(weights, feats, len(used))[place.reshape(seq.shape)]
            truth = labels[text_of[seq]]
            prob, expected = _expected(np.exp(e - e.max(axis=2, keepdims=True)), np.exp(moves - moves.max()))
            grad = -prob
            np.put_along_axis(grad, truth[:, :, None], 1 + np.take_along_axis(grad, truth[:, :, None], 2), 2)
            per_word = np.stack([np.bincount(place.reshape(-1), weights=grad[:, :, k].reshape(-1), minlength=len(used)) for k in range(many)], axis=1)
            own, inv = np.unique(feats[0], return_inverse=True)
            g = np.stack([np.bincount(inv, weights=per_word[feats[1], k] * feats[2], minlength=len(own)) for k in range(many)], axis=1)
            g = (g / len(batch) - 1e-5 * weights[own]).astype(np.float32)
            squares[own] += g * g
            weights[own] += RATE * g / np.sqrt(squares[own])
            seen = np.zeros((many, many))
            np.add.at(seen, (truth[:-1].reshape(-1), truth[1:].reshape(-1)), 1)
            g = (seen - expected) / len(batch)
            move_squares += g * g
            moves += RATE * g / np.sqrt(move_squares)
    return weights, moves, lexicons


class LanguageId:
    """A model fitted on the labelled rows of ``docs`` for which ``train`` holds."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", train: Column | None = None):
        small_batches(docs.sparkSession)
        known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
        known = (known if train is None else known.where(train)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
        counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(FIT_LABELS).collect()}
        self.labels = sorted(counts)
        names = list(self.labels)
        if not names:
            self.model = None
            return
        quota = max(1, FIT_TEXTS // len(names))
        share = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, quota / n) * (1 << 20))))), F.col("lang"))
        sample = known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share)
        # a text once, however many copies it has, and no more of it than the fit may hold
        sample = sample.groupBy("lang", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2")).agg(F.min(F.substring("text", 1, FIT_CHARS)).alias("text")).select("lang", _plain(F.col("text")).alias("text")).where("text IS NOT NULL")

        def run(batches):
            texts, langs = [], []
            for batch in batches:
                langs += batch.column(0).to_pylist()
                texts += batch.column(1).to_pylist()
            place = {name: k for k, name in enumerate(names)}
            order = sorted(range(len(texts)), key=lambda k: (texts[k], langs[k]))  # as rows arrive in any order
            weights, moves, lexicons = fit([texts[k] for k in order], np.array([place[langs[k]] for k in order], dtype=np.int64), len(names))
            parts = (weights, moves, lexicons.words, lexicons.labels)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["weights", "moves", "words", "labels"])

        row = sample.repartition(1).mapInArrow(lean(run), "weights binary, moves binary, words binary, labels binary").first()
        many = len(names)
        lexicons = Lexicons(np.frombuffer(row["words"], np.uint64), np.frombuffer(row["labels"], np.int64))
        self.model = docs.sparkSession.sparkContext.broadcast((np.frombuffer(row["weights"], np.float32).reshape(-1, many), np.frombuffer(row["moves"], np.float64).reshape(many, many), lexicons))

    def predict(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Adds lang_pred and score, and ``switches``: how often the most likely label changes from word to word."""
        veil = Veil(docs)
        return veil.lift(self._predicted(veil.docs, veil.name(text_col)))

    def _predicted(self, docs: DataFrame, text_col: str) -> DataFrame:
        added = ("lang_pred", "score", "switches")
        kept = [c for c in docs.columns if c not in added]
        if self.model is None:
            return docs.select(*(docs[c] for c in kept), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("switches"))
        at, model, names = len(kept), self.model, np.array(self.labels, dtype=object)
        marked = docs.select(*(docs[c] for c in kept), _plain(docs[text_col]).alias("__text"))

        def run(batches):
            weights, moves, lexicons = model.value
            bits = _bits(len(names))
            for batch in batches:
                data, offsets = buffers(batch.column(at))
                for i, j in runs(offsets):
                    lo = int(offsets[i])
                    bounds = offsets[i : j + 1] - lo
                    points, starts, ends, bounds = _letters(data[lo : int(offsets[j])], bounds)
                    spans = Spans(points)
                    _, first, kind = np.unique(spans(starts, ends), return_index=True, return_inverse=True)
                    e = _emissions(weights, _features(spans, starts[first], ends[first], lexicons, bits), len(first))[kind]
                    words = np.searchsorted(starts, bounds)
                    prob = chain(e, words, moves)
                    n = np.diff(words)
                    full = n > 0
                    mean = np.zeros((j - i, len(names)))
                    switches = np.zeros(j - i, dtype=np.int64)
                    if full.any():
                        at_start = words[:-1][full]
                        mean[full] = np.add.reduceat(prob, at_start, axis=0) / n[full][:, None]
                        best = prob.argmax(axis=1)
                        change = np.concatenate([[False], best[1:] != best[:-1]])
                        change[at_start] = False
                        switches[full] = np.add.reduceat(change.astype(np.int64), at_start)
                    pred = np.where(full, names[mean.argmax(axis=1)], "und")
                    score = np.clip(np.where(full, mean.max(axis=1), 0.0), 0.0, 1.0)
                    own = batch.slice(i, j - i)
                    yield pa.RecordBatch.from_arrays([*(own.column(k) for k in range(at)), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(switches)], names=[*kept, *added])

        fields = [docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("switches", T.LongType())]
        return marked.mapInArrow(lean(run), T.StructType(fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document's language, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = LanguageId(docs, train=~held_out(F.col("doc_id")))
    texts = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return model.predict(texts).select("doc_id", "held_out", "lang_pred", "score", "switches")


QUERIES = {"op6_crf_language_id": query}

ORACLE_SQL: dict[str, str] = {}
