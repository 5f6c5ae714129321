"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Tokens are lower-cased words and one end per text. Uni- and bigrams of the training texts are counted in
buckets of their hash; every bucket turns its counts into levels (two an octave) and sets, for each n-gram,
the bits of all levels up to its own in its slice of the filter. A count is read back by probing level after
level until one is missing. The slices are broadcast if together they stay below ``BROADCAST_BYTES``; a larger
filter stays where it is, bucket by bucket, and the texts' distinct probes are sent to it, block by block of texts, with the same results.

P(w | h) = (c(hw) + mu * P(w)) / (c(h) + mu), P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)); mu is fitted on all
training texts, with the token at hand left out of the counts. A token's likelihood depends on three levels alone, so
it is enough to count how often each three occur; where the scored texts hold those of the training, that is done in passing.

``base_score`` uses exact counts: frequent tokens by a broadcast table of at most ``FREQUENT`` entries, the
rest by a join. Tokens are told apart by 64-bit hashes. Null texts count as empty and have the end alone; null
ids are hashed as empty text, which holds them out. Without training texts N and V are 0. Repeated rows get a
row each; an empty table gives an empty table; columns named like the added
ones are replaced, others are kept whatever their names. Long texts are scored
as they are, but for the levels of a filter that isn't broadcast, which travel with their text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.names import Veil
from kinweave.llm.storage import cut, small_batches
from kinweave.llm.words import U64, lean, lean_group, mix, word_hashes

#: Most bytes of a filter that is broadcast; every Python worker of an executor holds a copy.
BROADCAST_BYTES = 96 << 20
#: Bytes of the texts that ask a filter that isn't broadcast together, and most bytes of n-grams that one task is asked.
BLOCK_BYTES, ASKED_BYTES = 4 << 20, 32 << 20
#: Most tokens whose exact counts are broadcast (12 bytes each).
FREQUENT = 1 << 18
MUS = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 512.0, 2048.0, 16384.0, 1e6)
BITS_PER_EVENT, PROBES = 8, 4
#: Bytes of text for each bucket of the counts, so that a bucket stays of one size as the input grows.
BUCKET_BYTES = 8 << 20
LEVELS = np.array(sorted({int(x) for k in range(48) for x in (2.0**k, 1.5 * 2.0**k)}), dtype=np.int64)
#: The count that a level stands for: the middle of its range in the logarithm.
STANDS = np.concatenate([[0.0], np.sqrt(LEVELS[:-1] * np.maximum(LEVELS[:-1], LEVELS[1:] - 1.0))])
END, START = U64(0x51AFD7ED558CCD01), U64(0x2545F4914F6CDD1D)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def _tokens(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of consecutive texts with their ends, the tokens before them, and the texts' offsets."""
    texts = len(offsets) - 1
    tok = np.full(len(words) + texts, END, dtype=np.uint64)
    tok[np.arange(len(words)) + np.repeat(np.arange(texts), np.diff(offsets))] = words
    starts = offsets + np.arange(texts + 1)
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[starts[:-1]] = START
    return tok, before, starts


def _bigrams(before: np.ndarray, tok: np.ndarray) -> np.ndarray:
    return mix(before * U64(0x9FB21C651E98DF25) + mix(tok))


def _distinct(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often they occur, or the sums of their counts; without counts, ``values`` are sorted in place."""
    if counts is None:
        values.sort()
    else:
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    if counts is None:
        return values[first], np.diff(np.append(first, len(values)))
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def _short(grams: np.ndarray, bits: int) -> np.ndarray:
    """40 bits of a hash, behind those that choose its bucket."""
    return (grams << U64(bits)) >> U64(24)


_COUNTED = T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("tok", "tok_n", "low", "high", "n"))])
_COUNT_NAMES = _COUNTED.names


def _count(bits: int, most: int = 1_000_000):
    """Counts of the tokens and bigrams of about a million tokens, a row for each bucket."""

    def emit(toks, bigs):
        tok, big = np.concatenate(toks), np.concatenate(bigs)
        toks.clear()
        bigs.clear()
        (tok, tok_n), (big, big_n) = _distinct(tok), _distinct(big)
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << U64(64 - bits)
        a, b = (np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in (tok, big))
        short = _short(big, bits)
        low, high = short.astype(np.uint32), (short >> U64(32)).astype(np.uint8)
        tok_n, big_n = tok_n.astype(np.int64), big_n.astype(np.int64)
        rows = [k for k in range(1 << bits) if a[k] < a[k + 1] or b[k] < b[k + 1]]
        cols = [[x[e[k] : e[k + 1]].tobytes() for k in rows] for x, e in ((tok, a), (tok_n, a), (low, b), (high, b), (big_n, b))]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=_COUNT_NAMES)

    def run(batches):
        toks, bigs, n = [], [], 0
        for batch in batches:
            for _, _, words, offsets in word_hashes(batch.column(0)):
                tok, before, _ = _tokens(words, offsets)
                toks.append(tok)
                bigs.append(_bigrams(before, tok))
                n += len(tok)
                if n >= most:
                    yield emit(toks, bigs)
                    toks, bigs, n = [], [], 0
        if n:
            yield emit(toks, bigs)

    return run


def _places(keys: np.ndarray, kind: int, level: int, size: np.ndarray | int):
    """Bit places of (n-gram, level) in a slice of ``size`` bits."""
    h = mix(keys * U64(4) + U64((kind + level * 0xD6E8FEB86659FD93) % (1 << 64)))
    step = mix(h) | U64(1)
    for k in range(PROBES):
        yield (h + U64(k) * step) % np.asarray(size, dtype=np.uint64)


_SLICE = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("slice", T.BinaryType()),
        T.StructField("tok", T.BinaryType()),
        T.StructField("tok_n", T.BinaryType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("types", T.LongType()),
        T.StructField("sizes", T.ArrayType(T.LongType())),
    ]
)


def _fill(bits: int):
    """A bucket's slice of the filter, its exact token counts, and how many types each level has."""

    def run(table: pa.Table) -> pa.Table:
        whole = lambda name, kind: np.concatenate([np.frombuffer(b, dtype=kind) for b in table[name].to_pylist()] or [np.zeros(0, kind)])
        tok, tok_n = _distinct(whole("tok", np.uint64), whole("tok_n", np.int64))
        big, big_n = _distinct(whole("low", np.uint32).astype(np.uint64) | whole("high", np.uint8).astype(np.uint64) << U64(32), whole("n", np.int64))
        grams = [(0, _short(tok, bits), np.searchsorted(LEVELS, tok_n, "right")), (1, big, np.searchsorted(LEVELS, big_n, "right"))]
        events = sum(int(levels.sum()) for _, _, levels in grams)
        size = max(64, -(-events * BITS_PER_EVENT // 64) * 64)
        on = np.zeros(size, dtype=bool)
        for kind, keys, levels in grams:
            for level in range(1, int(levels.max(initial=0)) + 1):
                for p in _places(keys[levels >= level], kind, level, size):
                    on[p.astype(np.int64)] = True
        sizes = np.bincount(grams[0][2], minlength=1)
        return pa.table(
            [table["bucket"].slice(0, 1), [np.packbits(on, bitorder="little").tobytes()], [tok.tobytes()], [tok_n.tobytes()], pa.array([int(tok_n.sum())], pa.int64()), pa.array([len(tok)], pa.int64()), pa.array([sizes.tolist()], pa.list_(pa.int64()))],
            names=_SLICE.names,
        )

    return run


class Filter:
    """Slices of the filter by bucket: bytes end to end, offsets in bits, sizes in bits."""

    def __init__(self, slices: Iterable[tuple[int, bytes]], bits: int, total: int):
        self.bits = bits
        self.size = np.full(1 << bits, 64, dtype=np.uint64)
        self.start = np.zeros(1 << bits, dtype=np.uint64)
        self.data = np.zeros(8 + total, dtype=np.uint8)
        at = 8
        for k, s in slices:
            self.size[k], self.start[k] = len(s) * 8, at * 8
            self.data[at : at + len(s)] = np.frombuffer(s, dtype=np.uint8)
            at += len(s)

    def levels(self, grams: np.ndarray, kind: int) -> np.ndarray:
        """The highest level that each n-gram reaches by membership probes, 0 if it isn't held."""
        found, place = np.unique(grams, return_inverse=True)
        return self._probed(found, kind)[place]

    def _probed(self, grams: np.ndarray, kind: int) -> np.ndarray:
        bucket = (grams >> U64(64 - self.bits)).astype(np.int64)
        keys, size, start = _short(grams, self.bits), self.size[bucket], self.start[bucket]
        out = np.zeros(len(grams), dtype=np.int64)
        live = np.arange(len(grams))
        for level in range(1, len(LEVELS)):
            for k, p in enumerate(_places(keys[live], kind, level, size[live])):
                at = p + start[live]
                on = (self.data[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
                if k == 0:
                    ok = on
                else:
                    ok &= on
            live = live[ok]
            if not len(live):
                break
            out[live] = level
        return out


def _probabilities(uni, ctx, big, mu, total, types):
    """P(w | h) from the counts that the filter gives."""
    base = (uni + 0.1) / (total + 0.1 * (types + 1))
    return (big + mu * base) / (np.maximum(ctx, big) + mu)


def _context(uni: np.ndarray, starts: np.ndarray, texts: int) -> np.ndarray:
    ctx = np.empty_like(uni)
    ctx[1:] = uni[:-1]
    ctx[starts[:-1]] = texts
    return ctx


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts[:-1]) if len(starts) > 1 else np.zeros(0)


#: Bits of a level in a key of three, and what stands for the level before a text's first token.
_LEVEL_BITS = 7
_FIRST = (1 << _LEVEL_BITS) - 1


def _tally(parts):
    """How often each (token, token before, bigram) of levels occurs, from (levels of tokens, levels of bigrams, offsets of texts)."""

    def run(batches):
        counts = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for lu, lb, starts in parts(batch):
                before = np.empty_like(lu)
                before[1:] = lu[:-1]
                before[starts[:-1]] = _FIRST
                more = np.bincount(lu << 2 * _LEVEL_BITS | before << _LEVEL_BITS | lb)
                counts, more = (counts, more) if len(counts) >= len(more) else (more, counts)
                counts[: len(more)] += more
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["levels", "n"])

    return run


_ADDED = [
    T.StructField("held_out", T.BooleanType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("__levels", T.BinaryType()),
    T.StructField("__known", T.LongType()),
    T.StructField("__base", T.DoubleType()),
    T.StructField("__rare", T.BinaryType()),
]


class LanguageModel:
    """Trained on ``docs`` (text column) where ``train`` holds."""

    def __init__(self, docs: DataFrame, text_col: str = "text", train: Column | None = None, broadcast_bytes: int | None = None):
        spark = docs.sparkSession
        small_batches(spark)
        self.spark, self.limit = spark, BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
        texts = (docs if train is None else docs.where(train)).select(F.coalesce(docs[text_col], F.lit("")).alias("text"))
        r = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        self.texts = r[0]
        self.bits = max(3, ((r[1] or 0) // BUCKET_BYTES).bit_length())
        counted = texts.mapInArrow(lean(_count(self.bits)), _COUNTED)
        self.slices = cut(counted.groupBy("bucket").applyInArrow(lean_group(_fill(self.bits)), _SLICE))
        r = self.slices.agg(F.sum("tokens"), F.sum("types"), F.sum(F.length("slice"))).first()
        self.total, self.types, self.filter_bytes = (x or 0 for x in r)
        self.filter = None
        if self.filter_bytes <= self.limit:
            rows = self.slices.select("bucket", "slice").toLocalIterator()
            self.filter = spark.sparkContext.broadcast(Filter(((r["bucket"], r["slice"]) for r in rows), self.bits, self.filter_bytes))
        self._frequent()
        self._trained, self._mu = texts, None

    def _frequent(self) -> None:
        """Exact counts of the most frequent tokens: all from the lowest level on at which they are few enough."""
        sizes = np.zeros(len(LEVELS) + 1, dtype=np.int64)
        for r in self.slices.select(F.posexplode("sizes")).groupBy("pos").agg(F.sum("col").alias("n")).collect():  # a row for each level
            sizes[r["pos"]] = r["n"]
        above = np.cumsum(sizes[::-1])[::-1]
        level = int(np.argmax(above <= FREQUENT))
        least = int(LEVELS[level - 1]) if level else 0
        found = self.counts().where(F.col("c") >= least).toArrow()
        h, c = found["h"].to_numpy().view(np.uint64), found["c"].to_numpy()
        order = np.argsort(h)
        self.least = least
        self.frequent = self.spark.sparkContext.broadcast((h[order], c[order]))

    def counts(self) -> DataFrame:
        """(h, c): exact counts of all tokens of the training texts."""

        def run(batches):
            for batch in batches:
                for tok, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(tok, dtype=np.int64)), pa.array(np.frombuffer(n, dtype=np.int64))], names=["h", "c"])

        return self.slices.select("tok", "tok_n").mapInArrow(lean(run), "h long, c long")

    @property
    def mu(self) -> float:
        """Fitted on all training texts when first asked for."""
        if self._mu is None:
            held, texts = self.filter, self._trained
            if held is None:
                texts = self._routed(texts.withColumnRenamed("text", "__text"))

            def parts(batch):
                for i, j, words, offsets in word_hashes(batch.column(0)):
                    tok, before, starts = _tokens(words, offsets)
                    own = _answered(batch.column(1).slice(i, j - i)) if held is None else (held.value.levels(tok, 0), held.value.levels(_bigrams(before, tok), 1))
                    yield *own, starts

            self._mu = self._fitted(texts.mapInArrow(lean(_tally(parts)), "levels long, n long"))
        return self._mu

    def _fitted(self, tallies: DataFrame) -> float:
        """The mu under which the tokens are likeliest, each taken out of the counts that it is scored with."""
        found = tallies.groupBy("levels").agg(F.sum("n").alias("n")).orderBy("levels").toArrow()  # a row for each three levels
        at, n = found["levels"].to_numpy(), found["n"].to_numpy()
        if not len(n):
            return MUS[-1]
        uni, before, big = (at >> k * _LEVEL_BITS & _FIRST for k in (2, 1, 0))
        ctx = np.where(before == _FIRST, float(self.texts), STANDS[np.where(before == _FIRST, 0, before)])
        less = [np.maximum(x - 1, 0) for x in (STANDS[uni], ctx, STANDS[big])]
        return MUS[int(np.argmax([(n * np.log10(_probabilities(*less, mu, self.total, self.types))).sum() for mu in MUS]))]

    def score(self, docs: DataFrame, held: Column, text_col: str = "text", keep: Iterable[str] | None = None, own: bool = False) -> DataFrame:
        """Adds held_out, n_tokens, n_known, train_tokens, base_score and score to the columns ``keep``, or to all.

        With ``own``, the rows that aren't held out are the training texts, and mu is fitted on their levels as they are found."""
        marked = docs.withColumn("held out", held)
        veil = Veil(marked if keep is None else marked.select(*dict.fromkeys((*keep, text_col)), "held out"))
        kept = veil.docs.columns[:-1] if keep is None else [veil.name(c) for c in keep]
        return veil.lift(self._scored(veil.docs, F.col(veil.name("held out")), veil.name(text_col), kept, own))

    def _scored(self, docs: DataFrame, held: Column, text_col: str, keep: Iterable[str], own: bool) -> DataFrame:
        added = {f.name for f in _ADDED} | {"n_known", "train_tokens", "base_score", "score"}
        kept = [c for c in keep if c not in added]
        at = len(kept)
        fields = [docs.schema[c] for c in kept]
        marked = docs.select(*(docs[c] for c in kept), docs[text_col].alias("__text"), held.alias("__held"))
        routed = self.filter is None
        if routed:
            marked = self._routed(marked)
        held_filter, frequent = self.filter, self.frequent
        texts, total, types = self.texts, self.total, self.types
        z = total + 0.1 * (types + 1)

        def run(batches):
            top, top_n = frequent.value
            model = None if routed else held_filter.value
            for batch in batches:
                for i, j, words, offsets in word_hashes(batch.column(at)):
                    rows = batch.slice(i, j - i)
                    tok, before, starts = _tokens(words, offsets)
                    if routed:
                        lu, lb = _answered(rows.column(at + 2))
                    else:
                        lu, lb = model.levels(tok, 0), model.levels(_bigrams(before, tok), 1)
                    levels = [x.astype(np.uint8) for x in (lu, lb)]
                    levels = [b"".join(x[a:b].tobytes() for x in levels) for a, b in itertools.pairwise(starts.tolist())]
                    place = np.minimum(np.searchsorted(top, tok), max(0, len(top) - 1))
                    known = top[place] == tok if len(top) else np.zeros(len(tok), dtype=bool)
                    c = np.where(known, top_n[place], 0) if len(top) else np.zeros(len(tok), np.int64)
                    base = _sums(np.where(known, np.log10((c + 0.1) / z), 0.0), starts)
                    rare = [tok[a:b][~known[a:b]].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                    cols = [rows.column(at + 1), pa.array(np.diff(starts), pa.int64()), pa.array(levels, pa.binary()), pa.array(_sums(known.astype(np.int64), starts).astype(np.int64)), pa.array(base), pa.array(rare, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(at)), *cols], names=[*kept, *(f.name for f in _ADDED)])

        found = cut(marked.mapInArrow(lean(run), T.StructType([*fields, *_ADDED])))
        if own and self._mu is None:

            def parts(batch):
                for lo in range(0, batch.num_rows, 1000):
                    rows = batch.slice(lo, 1000)
                    yield *_answered(rows.column(1)), np.concatenate([[0], np.cumsum(rows.column(0).to_numpy())])

            self._mu = self._fitted(found.where("not held_out").select("n_tokens", "__levels").mapInArrow(lean(_tally(parts)), "levels long, n long"))
        mu, names = self.mu, [f.name for f in found.schema if f.name not in ("__levels", "__rare")]

        def weigh(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    rows = batch.slice(lo, 1000)
                    starts = np.concatenate([[0], np.cumsum(rows.column(at + 1).to_numpy())])
                    lu, lb = _answered(rows.column(rows.schema.names.index("__levels")))
                    uni = STANDS[lu]
                    p = _probabilities(uni, _context(uni, starts, texts), STANDS[lb], mu, total, types)
                    yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.names.index(c)) for c in (*names, "__row")), pa.array(_sums(np.log10(p), starts))], names=[*names, "__row", "score"])

        scored = found.withColumn("__row", F.monotonically_increasing_id())
        weighed = scored.drop("__rare").mapInArrow(lean(weigh), T.StructType([*(found.schema[c] for c in names), T.StructField("__row", T.LongType()), T.StructField("score", T.DoubleType())]))

        def unpack(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    own = batch.slice(lo, 1000)
                    h, n, rows = [], [], []
                    for row, raw in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
                        a, b = _distinct(np.frombuffer(raw, dtype=np.uint64).copy())
                        h.append(a)
                        n.append(b)
                        rows.append(np.full(len(a), row, dtype=np.int64))
                    if h:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(n).astype(np.int64))], names=["__row", "h", "n"])

        rare = scored.where(F.length("__rare") > 0).select("__row", "__rare").mapInArrow(lean(unpack), "__row long, h long, n long")
        joined = rare.join(self.counts().where(F.col("c") < self.least), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        sums = joined.groupBy("__row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("__more"), F.sum(F.col("n") * F.log10((F.col("c") + 0.1) / F.lit(z))).alias("__rest"))
        whole = weighed.join(sums, "__row", "left")
        return whole.select(
            *kept, "held_out", "n_tokens", (F.col("__known") + F.coalesce("__more", F.lit(0))).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"), (F.col("__base") + F.coalesce("__rest", F.lit(0.0))).alias("base_score"), "score",
        )

    def _asked(self, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``marked`` in blocks of bounded size, and the distinct n-grams of each block by bucket."""
        bits, most, at = self.bits, BLOCK_BYTES, marked.columns.index("__text")

        def deal(batches):
            block, size = None, 0
            for batch in batches:
                text, rows = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                for k, n in enumerate(text):
                    if block is None or size + n + 1 > most:
                        block, size = rows[k], 0
                    size += n + 1
                    rows[k] = block
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.int64())], names=batch.schema.names)

        numbered = marked.withColumn("__block", F.monotonically_increasing_id())
        blocks = cut(numbered.mapInArrow(lean(deal), numbered.schema))

        def emit(block, *grams):
            grams = [np.unique(np.concatenate(g)) for g in grams]
            edges = np.arange(1, 1 << bits, dtype=np.uint64) << U64(64 - bits)
            ends = [np.concatenate([[0], np.searchsorted(g, edges), [len(g)]]) for g in grams]
            rows = [k for k in range(1 << bits) if any(e[k] < e[k + 1] for e in ends)]
            cols = [pa.array([g[e[k] : e[k + 1]].tobytes() for k in rows], pa.binary()) for g, e in zip(grams, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array(rows, pa.int32()), *cols], names=["__block", "bucket", "uni", "big"])

        def ask(batches):
            block, toks, bigs = None, [], []
            for batch in batches:
                blocks = batch.column(0).to_numpy()
                for i, j, words, offsets in word_hashes(batch.column(1)):
                    tok, before, starts = _tokens(words, offsets)
                    big = _bigrams(before, tok)
                    edges = [0, *(np.flatnonzero(np.diff(blocks[i:j])) + 1).tolist(), j - i]
                    for a, b in itertools.pairwise(edges):
                        if blocks[i + a] != block:
                            if toks:
                                yield emit(block, toks, bigs)
                            block, toks, bigs = int(blocks[i + a]), [], []
                        toks.append(tok[starts[a] : starts[b]])
                        bigs.append(big[starts[a] : starts[b]])
            if toks:
                yield emit(block, toks, bigs)

        return blocks, blocks.select("__block", "__text").mapInArrow(lean(ask), "__block long, bucket int, uni binary, big binary")

    def _routed(self, marked: DataFrame) -> DataFrame:
        """Adds ``__levels``: the answers of a filter that isn't broadcast, for the text's tokens and then its bigrams.

        A block asks for each n-gram once; a bucket's questions are dealt over as many copies of its slice as keep
        them below ``ASKED_BYTES`` together.
        """
        bits = self.bits
        blocks, asked = self._asked(marked)
        r = blocks.agg(F.count("*"), F.sum(F.octet_length("__text"))).first()
        grams = (r[1] or 0) // 2 + 2 * r[0]  # at most: a word and a space have two bytes
        copies = max(1, -(-16 * grams // (ASKED_BYTES << bits)))

        def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
            slices = list(zip(held["bucket"].to_pylist(), held["slice"].to_pylist(), strict=True))
            f = Filter(slices, bits, sum(len(s) for _, s in slices))

            def reply(name, kind):
                raw = asked[name].to_pylist()
                levels = f.levels(np.frombuffer(b"".join(raw), dtype=np.uint64), kind).astype(np.uint8).tobytes()
                ends = np.cumsum([0, *(len(b) // 8 for b in raw)]).tolist()
                return pa.array([levels[a:b] for a, b in itertools.pairwise(ends)], pa.binary())

            return pa.table([asked["__block"], asked["bucket"], reply("uni", 0), reply("big", 1)], names=["__block", "bucket", "uni", "big"])

        def attach(own: pa.Table, replies: pa.Table) -> pa.Table:
            replies = replies.sort_by("bucket")  # so that the levels stand in the order of the n-grams
            parts = [_tokens(words, offsets) for _, _, words, offsets in word_hashes(own["__text"].combine_chunks())]
            found = []
            for name, grams in (("uni", [p[0] for p in parts]), ("big", [_bigrams(p[1], p[0]) for p in parts])):
                levels, keys = np.frombuffer(b"".join(replies[name].to_pylist()), dtype=np.uint8), np.unique(np.concatenate(grams))
                found.append([levels[np.searchsorted(keys, g)] for g in grams])
            rows = [lu[a:b].tobytes() + lb[a:b].tobytes() for lu, lb, p in zip(*found, parts, strict=True) for a, b in itertools.pairwise(p[2].tolist())]
            return own.drop_columns(["__block"]).append_column("__levels", pa.array(rows, pa.binary()))

        salted = asked.withColumn("salt", F.pmod(F.xxhash64("__block"), F.lit(copies)).cast("int"))
        slices = self.slices.select("bucket", "slice", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("salt"))
        replies = salted.groupBy("bucket", "salt").cogroup(slices.groupBy("bucket", "salt")).applyInArrow(answer, "__block long, bucket int, uni binary, big binary")
        schema = T.StructType([*marked.schema.fields, T.StructField("__levels", T.BinaryType())])
        return blocks.groupBy("__block").cogroup(replies.groupBy("__block")).applyInArrow(attach, schema)


def _answered(levels: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Levels of the tokens and of the bigrams of consecutive texts."""
    raw = [np.frombuffer(x, dtype=np.uint8) for x in levels.to_pylist()]
    return tuple(np.concatenate([x[: len(x) // 2] if k == 0 else x[len(x) // 2 :] for x in raw]).astype(np.int64) for k in range(2))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document, learning from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = held_out(F.col("doc_id"))
    return LanguageModel(docs, train=~held).score(docs, held, keep=["doc_id"], own=True)


QUERIES = {"op7_bloom_lm": query}

ORACLE_SQL: dict[str, str] = {}
