"""Jaccard self-join of word-shingle sets by PartEnum signatures, and its connected components.

Two texts link when 100 * intersection >= 75 * union of their sets of 5-word shingles. The steps:

1. Texts with equal sets form a class; only classes are compared.
2. Of a set of size s, a link misses at most s // 4 shingles. The s // 4 + 1 + s // 10 smallest hashes are
   looked up among all classes; a class with too few of them elsewhere can't link and is done.
3. PartEnum: sizes fall into bands [l, 4 l // 3]; sets of one band, or of it and the band below, differ in at
   most k = 2 r // 7 shingles. The domain is cut into k // 2 + 1 parts, one of which differs in at most one
   shingle, and every part into 3; of those, 2 are equal, so each subset of 2 is a signature. Where more parts than one
   must be so much alike, those of the fewest shingles, which unlike sets share, are left out. A set signs for its own
   band and, as a guest, for the next; two guests meet in their own band, too, so each pair needs a host.
4. Classes that share a signature are candidates: each with the group's first and with the one before it, in
   groups of up to 4 with all. Candidates pass an exact bound on the difference (parities of the sets' buckets,
   fewer of them first, then all), then the intersection itself; links give components.
5. In larger groups what lies in different components is compared through these parities, too: the fewer tell which
   rows any other of the group may link with, all of them which pairs may, and the intersection decides. Groups
   above ``GROUP_LIMIT`` are first split by the signatures of further, independent enumerations, which linked sets
   share as well, and where that doesn't help into blocks, so no pair is lost.

Texts with fewer words than 5 have their whole sequence as one shingle; without words or text the set is
empty and linked with nothing. Repeated rows get a row each. An id that is null doesn't lend its value to a
component unless all its ids are null. Shingles are told apart by 64-bit hashes, classes by 128 bits.
An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm import bloom
from kinweave.llm.components import components, merged
from kinweave.llm.names import Veil
from kinweave.llm.storage import cut, drop_path, fresh_path, small_batches
from kinweave.llm.words import U64, lean, lean_group, mix, shingle_sets, word_hashes

WIDTH = 5
#: Groups in which star, chain and next but one are all pairs.
PAIRS_UP_TO = 4
GROUP_LIMIT = 4096
#: Least buckets of a sketch for each element.
SKETCH = 4
#: Ids in a look-up that is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 1_000_000
#: Bytes of text for each bucket of the look-up in step 2.
BUCKET_BYTES = 24 << 20


def _bands(most: int = 1 << 40) -> np.ndarray:
    out, low = [], 1
    while low < most:
        out.append((low, 4 * low // 3))
        low = out[-1][1] + 1
    return np.array(out, dtype=np.int64)


BANDS = _bands()


def _sample(size: int) -> int:
    return min(size, size // 4 + 1 + size // 10)


def _sets(column: pa.Array):
    """(row, sorted shingle hashes) of every text."""
    for i, j, words, offsets in word_hashes(column):
        h, edges = shingle_sets(words, offsets, WIDTH)
        for k in range(j - i):
            yield i + k, h[edges[k] : edges[k + 1]]


def _digest(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


_READ = T.StructType(
    [
        *(T.StructField(n, T.LongType()) for n in ("m1", "m2", "n", "low")),
        *(T.StructField(n, T.BinaryType()) for n in ("c",)),
        T.StructField("bucket", T.IntegerType()),
        *(T.StructField(n, T.BinaryType()) for n in ("h", "who", "times")),
    ]
)


def _edges(h: np.ndarray, bits: int) -> np.ndarray:
    """Where the hashes of each bucket begin in sorted ``h``."""
    return np.concatenate([[0], np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << U64(64 - bits)), [len(h)]])


def _by_class(who: np.ndarray, shared: np.ndarray, times: np.ndarray, bits: int) -> list[tuple[int, bytes]]:
    """Counts of classes, packed by part."""
    order = np.argsort(who, kind="stable")
    who, shared, times = who[order], shared[order].astype(np.int64), times[order].astype(np.int64)
    edges = _edges(who, bits)
    return [(k, np.concatenate([x[edges[k] : edges[k + 1]] for x in (who.view(np.int64), shared, times)]).tobytes()) for k in range(1 << bits) if edges[k] < edges[k + 1]]


def _packed(h: np.ndarray, who: np.ndarray, marked: np.ndarray, bits: int) -> tuple[bytes, bytes, bytes]:
    """A bucket's entries by class: 31 bits behind those that choose the bucket and the mark, classes, and entries of each."""
    order = np.argsort(who, kind="stable")
    classes, times = np.unique(who, return_counts=True)
    short = ((h << U64(bits)) >> U64(33)).astype(np.uint32) << np.uint32(1) | marked
    return short[order].tobytes(), classes.tobytes(), times.astype(np.uint32).tobytes()


def _read(bits: int, ident: T.StructField, most: int = 400_000):
    """A row for each text, with its set's size, smallest hash and class, and rows for step 2: of the buckets, the hashes of classes;
    and counts of what is known already, in bucket -1 - part.

    Of a hash that several classes of the batch have, one goes on, marked, so that common shingles send
    a row a batch. Hashes are shortened, which may only let more classes pass.
    """
    names = [ident.name, *_READ.names]

    def rows(**cols):
        many = len(next(iter(cols.values())))
        kinds = {f.name: pa.int64() if isinstance(f.dataType, T.LongType) else pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.binary() for f in _READ}
        return [pa.array(cols[f], kinds[f]) if f in cols else pa.nulls(many, kinds[f]) for f in _READ.names]

    def emit(kind, parts, classes):
        own = np.array(classes, dtype=np.uint64)
        h = np.concatenate(parts)
        who = np.repeat(own, [len(p) for p in parts])
        order = np.argsort(h, kind="stable")
        h, who = h[order], who[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        many = np.diff(np.append(start, len(h)))
        known, counts = np.unique(who[np.repeat(many > 1, many)], return_counts=True)
        tell = _by_class(np.concatenate([own, known]), np.concatenate([np.zeros(len(own), np.int64), counts]), np.concatenate([np.ones(len(own), np.int64), np.zeros(len(known), np.int64)]), bits)
        cols = rows(bucket=[-1 - k for k, _ in tell], h=[b for _, b in tell])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(tell), kind), *cols], names=names)
        h, who, marked = h[start], who[start], (many > 1).astype(np.uint32)
        edges = _edges(h, bits)
        full = [k for k in range(1 << bits) if edges[k] < edges[k + 1]]
        blobs = list(zip(*(_packed(*(x[edges[k] : edges[k + 1]] for x in (h, who, marked)), bits) for k in full), strict=True))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(full), kind), *rows(bucket=full, h=blobs[0], who=blobs[1], times=blobs[2])], names=names)

    def run(batches):
        parts, classes, seen, total = [], [], set(), 0
        for batch in batches:
            kind = batch.schema.field(0).type
            n, low, c = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.uint64), [None] * batch.num_rows
            for row, h in _sets(batch.column(3)):
                n[row] = len(h)
                if not len(h):
                    continue
                low[row] = h[0]
                c[row] = _digest(h)
                if c[row] in seen:
                    continue
                seen.add(c[row])
                parts.append(h[: _sample(len(h))].copy())
                classes.append(int.from_bytes(c[row][:8], "little"))
                total += len(parts[-1])
                if total >= most:
                    yield from emit(kind, parts, classes)
                    parts, classes, seen, total = [], [], set(), 0
            cols = rows(m1=batch.column(1), m2=batch.column(2), n=n, low=low.view(np.int64), c=c)
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)
        if total:
            yield from emit(kind, parts, classes)

    return run


def _shared_in_bucket(bits: int):
    """How many of each class's hashes in a bucket other classes have, packed by part."""

    def run(table: pa.Table) -> pa.Table:
        whole = lambda name, kind: np.concatenate([np.frombuffer(b, dtype=kind) for b in table[name].to_pylist()])
        h, who = whole("h", np.uint32), np.repeat(whole("who", np.uint64), whole("times", np.uint32))
        h, marked = h >> np.uint32(1), (h & np.uint32(1)).astype(np.uint8)
        order = np.argsort(h, kind="stable")
        h, who, marked = h[order], who[order], marked[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        low, high, any_marked = (f.reduceat(x, start) for f, x in ((np.minimum, who), (np.maximum, who), (np.maximum, marked)))
        shared = np.repeat((low != high) | (any_marked > 0), np.diff(np.append(start, len(h)))) & (marked == 0)
        found, counts = np.unique(who[shared], return_counts=True)
        packed = _by_class(found, counts, np.zeros(len(found), np.int64), bits)
        return pa.table([pa.array([k for k, _ in packed], pa.int32()), pa.array([b for _, b in packed], pa.binary())], names=["part", "h"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    """(who, shared, times): the counts of a part's classes."""
    who, shared, times = np.concatenate([np.frombuffer(b, dtype=np.int64).reshape(3, -1) for b in table["h"].to_pylist()], axis=1)
    found, place = np.unique(who, return_inverse=True)
    sums = [np.bincount(place, weights=x, minlength=len(found)).astype(np.int64) for x in (shared, times)]
    return pa.table([pa.array(found), *map(pa.array, sums)], names=["who", "shared", "times"])


def _signatures(h: np.ndarray, band: int, family: int) -> np.ndarray:
    """PartEnum signatures of a set for its own band or the next, as 64-bit hashes.

    A link misses so few shingles that some parts more than one differ in at most one, unless both sets are as large as
    the band allows. If a set has no more parts than those to spare in which 2 subsets hold ``light`` shingles or fewer, signatures
    of so few are left out: another part's, of more shingles, is shared, and neither set leaves that out.
    """
    high = int(BANDS[band][1])
    k = 2 * high // 7
    parts = k // 2 + 1
    p = mix(h ^ U64((band * 0x9E3779B97F4A7C15 + family * 0xD6E8FEB86659FD93 + 1) % (1 << 64)))
    cell = (((p >> U64(32)) * U64(parts)) >> U64(32)) * U64(3) + (p & U64(0xFFFFFF)) % U64(3)
    cell = cell.astype(np.int64)
    order = np.argsort(cell, kind="stable")
    value, cell = mix(p + U64(0x632BE59BD9B4E019))[order], cell[order]
    edges = np.searchsorted(cell, np.arange(3 * parts + 1))
    sums = np.zeros(len(value) + 1, dtype=np.uint64)
    np.cumsum(value, out=sums[1:])
    many = np.diff(edges)
    content = mix((sums[edges[1:]] - sums[edges[:-1]]) + many.astype(np.uint64)).reshape(parts, 3)
    many = many.reshape(parts, 3)
    held = many.sum(axis=1)[:, None] - many[:, ::-1]  # of the pairs below, in their order
    spare, light = parts - 1 - (len(h) + min(4 * len(h) // 3, high)) // 7 // 2, -1
    while (held.min(axis=1) <= light + 1).sum() <= spare:
        light += 1
    tag = U64((family * 1009 + band) % (1 << 64)) + np.arange(parts, dtype=np.uint64) * U64(0xA0761D6478BD642F)
    pairs = [mix(content[:, i] * U64(3) + content[:, j] * U64(5) + tag + U64(i * 3 + j)) for i, j in ((0, 1), (0, 2), (1, 2))]
    return np.concatenate(pairs)[held.T.ravel() > light]


def _all_signatures(h: np.ndarray, family: int) -> tuple[np.ndarray, int]:
    """Signatures for the set's own band and for the next, and how many are for its own."""
    band = int(np.searchsorted(BANDS[:, 0], len(h), side="right")) - 1
    own, next_ = _signatures(h, band, family), _signatures(h, band + 1, family)
    return np.concatenate([own, next_]), len(own)


def _sign(family: int, most: int = 200_000):
    """(sig, cid, own): the signatures of sets; ``own`` tells those for the set's own band."""

    def emit(ids, sigs, owns):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(owns))], names=["sig", "cid", "own"])

    def run(batches):
        for batch in batches:
            ids, sigs, owns, n = [], [], [], 0
            for cid, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s, own = _all_signatures(np.frombuffer(blob.as_buffer(), dtype=np.uint64), family)
                ids.append(np.full(len(s), cid, dtype=np.int64))
                sigs.append(s)
                owns.append(np.arange(len(s)) < own)
                n += len(s)
                if n > most:
                    yield emit(ids, sigs, owns)
                    ids, sigs, owns, n = [], [], [], 0
            if n:
                yield emit(ids, sigs, owns)

    return run


def _sketch(h: np.ndarray) -> bytes:
    """Whether the elements in each of ``SKETCH`` to 2 * ``SKETCH`` times size buckets of the hash are odd in number, a bit each."""
    m = max(8, (SKETCH * len(h)).bit_length())
    at = (mix(h + U64(0x1F83D9ABFB41BD6B)) >> U64(64 - m)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=1 << m) & 1).astype(bool)).tobytes()


def _coarse(sketch: bytes) -> bytes:
    """A sketch with a fourth of the buckets; the bound on the difference still holds, if less tightly."""
    return np.packbits(np.bitwise_xor.reduce(np.unpackbits(np.frombuffer(sketch, dtype=np.uint8)).reshape(-1, 4), axis=1)).tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches at the resolution of the coarsest, in words of 64 bits."""
    size = min(len(s) for s in sketches)
    out = np.empty((len(sketches), size), dtype=np.uint8)
    for k, s in enumerate(sketches):
        own = np.frombuffer(s, dtype=np.uint8)
        out[k] = own if len(own) == size else np.packbits(np.bitwise_xor.reduce(np.unpackbits(own).reshape(8 * size, -1), axis=1))
    return out.view(np.uint64)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound on how many elements sets differ in: an element more or less turns one bit."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _sift(batches):
    """(a, b) of the candidates that the bound lets pass."""
    for batch in batches:
        a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
        sa, sb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        keep = np.zeros(len(a), dtype=bool)
        for k in np.flatnonzero(4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)).tolist():
            x, y = _folded([sa[k], sb[k]])
            keep[k] = 7 * _differ(x, y) <= na[k] + nb[k]
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def _linked(batches):
    """(a, b) of the pairs whose sets link."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            inter = int((both[1:] == both[:-1]).sum())
            keep.append(100 * inter >= 75 * (len(x) + len(y) - inter))
        keep = np.array(keep, dtype=bool)
        yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[keep]), pa.array(batch.column(1).to_numpy()[keep])], names=["a", "b"])


def _near(table: pa.Table, sketch: str):
    """Of a group in order of size: the columns, and (row, rows behind it in other components that may link by the bound of
    ``sketch``), one of the two in its own band."""
    cid, comp, n, own = (table[c].to_numpy() for c in ("cid", "comp", "n", "own"))
    order = np.lexsort((cid, n))
    cid, comp, n, own = cid[order], comp[order], n[order], own[order]
    sketches = table[sketch].to_pylist()
    sketches = _folded([sketches[k] for k in order.tolist()])
    reach = np.searchsorted(n, 4 * n // 3, side="right")

    def each():
        for k in range(len(cid) - 1):
            other = np.arange(k + 1, reach[k])
            other = other[(comp[other] != comp[k]) & (own[other] | own[k])]
            other = other[7 * _differ(sketches[other], sketches[k]) <= n[k] + n[other]]
            if len(other):
                yield k, other

    return cid, comp, own, each()


def _some_near(table: pa.Table) -> pa.Table:
    """The rows of a group that the coarse bound lets link with any row of another component."""
    cid, comp, own, near = _near(table, "coarse")
    keep = np.zeros(len(cid), dtype=bool)
    for k, other in near:
        keep[k] = keep[other] = True
    columns = [pa.array(np.full(int(keep.sum()), table["key"][0].as_py(), dtype=np.int64)), *(pa.array(x[keep]) for x in (cid, comp, own))]
    return pa.table(columns, names=["key", "cid", "comp", "own"])


def _across(table: pa.Table) -> pa.Table:
    """(a, b) of a group that lie in different components and may link; one of them is in its own band."""
    cid, _, _, near = _near(table, "sketch")
    a, b = [], []
    for k, other in near:
        a.append(np.minimum(cid[other], cid[k]))
        b.append(np.maximum(cid[other], cid[k]))
    return pa.table([pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *x])) for x in (a, b)], names=["a", "b"])


class ShingleJoin:
    """Components of the links among the texts of ``docs``.

    ``rows`` has (doc_id, n_shingles, component_id) for each text; ``classes`` (c, n, ident, root, component) for each
    class of equal sets, and ``root``, the smallest digest of the component; ``kept()`` the documents that stay.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT, pairs_up_to: int = PAIRS_UP_TO):
        small_batches(docs.sparkSession)
        self.group_limit, self.pairs_up_to = group_limit, pairs_up_to
        self._veil = Veil(docs)
        docs, id_col, text_col = self._veil.docs, self._veil.name(id_col), self._veil.name(text_col)
        self._docs, self._id = docs, docs[id_col]
        text = F.coalesce(docs[text_col], F.lit(""))
        self._marks = [F.xxhash64(text).alias("m1"), F.xxhash64(text, F.lit(1)).alias("m2")]
        texts = docs.select(docs[id_col].alias("ident"), *self._marks, text.alias("text"))
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = max(3, (size // BUCKET_BYTES).bit_length())
        ident = texts.schema["ident"]
        read = cut(texts.mapInArrow(lean(_read(bits, ident)), T.StructType([ident, *_READ.fields])))
        meta = read.where("bucket is null").select("ident", "m1", "m2", "n", "low", "c")
        classes = cut(meta.where("c is not null").groupBy("c").agg(F.first("n").alias("n"), F.first("low").alias("low"), F.min("ident").alias("ident")))
        alive = self._alive(read.where("bucket is not null").select("bucket", "h", "who", "times"), classes, bits)
        comps = self._components(self._read_sets(texts, alive))
        with_comp = alive.join(comps.withColumnRenamed("v", "cid"), "cid").select("c", "comp", "ident")
        names = with_comp.groupBy("comp").agg(F.min("ident").alias("component"), F.min("c").alias("root"))
        found = with_comp.join(names, "comp").select("c", "component", "root")
        self.classes = cut(classes.join(found, "c", "left").select("c", "n", "ident", F.coalesce("root", "c").alias("root"), F.coalesce("component", "ident").alias("component")))
        self._joined = meta.where("c is not null").join(self.classes.select("c", "root", "component"), "c")
        empty = meta.where("c is null").select(F.col("ident").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("ident").alias("component_id"))
        self.rows = self._joined.select(F.col("ident").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).unionByName(empty)

    def kept(self) -> DataFrame:
        """The documents of which one stays for each component, with all their columns: a text with the component's id,
        that of the smallest hash where several texts have it, and of repeated rows one.

        Texts without words aren't linked with anything and stay. Rows are matched by id and text, so other texts
        that share an id are left alone.
        """
        key = ["ident", "m1", "m2"]
        texts = cut(self._joined.groupBy(*key, "root", "component").agg(F.count("*").alias("many")))
        first = texts.where(F.col("ident").eqNullSafe(F.col("component"))).groupBy("root").agg(F.min(F.struct("m1", "m2")).alias("first"))
        marked = texts.join(first, "root").withColumn("stays", F.col("ident").eqNullSafe(F.col("component")) & (F.struct("m1", "m2") == F.col("first")))
        listed = cut(marked.where("not stays or many > 1").select(*key, "stays"))
        docs, ident = self._docs, self._id

        def matched(which: DataFrame, how: str) -> DataFrame:
            side = which.select(*(F.col(k).alias(f"__{k}") for k in key))
            side = F.broadcast(side) if which.count() <= BROADCAST_ROWS else side
            m1, m2 = self._marks
            return docs.join(side, ident.eqNullSafe(F.col("__ident")) & (m1 == F.col("__m1")) & (m2 == F.col("__m2")), how)

        out = matched(listed, "left_anti")
        twins = listed.where("stays")
        if twins.isEmpty():
            return self._veil.lift(out)
        again = matched(twins, "left_semi").withColumns({"__m1": self._marks[0], "__m2": self._marks[1], "__ident": ident}).dropDuplicates(["__ident", "__m1", "__m2"]).drop("__ident", "__m1", "__m2")
        return self._veil.lift(out.unionByName(again))

    def _alive(self, dealt: DataFrame, classes: DataFrame, bits: int) -> DataFrame:
        """The classes with enough shingles that others have, with a number ``cid`` each, in order of their smallest hashes,
        so that of a group's classes those that follow each other are likely alike."""
        told = dealt.where("bucket < 0").select((-1 - F.col("bucket")).alias("part"), "h")
        other = dealt.where("bucket >= 0").groupBy("bucket").applyInArrow(lean_group(_shared_in_bucket(bits)), "part int, h binary")
        counts = told.union(other).groupBy("part").applyInArrow(lean_group(_summed), "who long, shared long, times long")
        who = F.conv(F.concat(*(F.hex(F.substring("c", k, 1)) for k in range(8, 0, -1))), 16, -10).cast("long")
        misses = F.floor(F.col("n") / 4)
        tested = F.least(F.col("n"), misses + 1 + F.floor(F.col("n") / 10))
        found = classes.withColumn("who", who).join(counts, "who").where(F.col("shared") >= F.col("times") * (tested - misses))
        order = found.select("c", "n", "ident", "low").repartitionByRange("low", "c").sortWithinPartitions("low", "c")
        return cut(order.drop("low")).withColumn("cid", F.monotonically_increasing_id())

    def _read_sets(self, texts: DataFrame, alive: DataFrame) -> DataFrame:
        """(cid, n, blob, sketch, coarse) of the classes that are left: only texts that may stand for one are read again."""
        marks = [F.xxhash64("ident").alias("h1"), F.xxhash64("ident", F.lit(1)).alias("h2")]
        words = bloom.build(alive.select(*marks), alive.count())

        def run(batches):
            for batch in batches:
                high, low = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
                near = batch.filter(pa.array(bloom.passes(words, high, low)))
                c, blobs, sketches, coarse = [], [], [], []
                for _, h in _sets(near.column(2)):
                    if len(h):
                        c.append(_digest(h))
                        blobs.append(h.tobytes())
                        sketches.append(_sketch(h))
                        coarse.append(_coarse(sketches[-1]))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (c, blobs, sketches, coarse)], names=["c", "blob", "sketch", "coarse"])

        read = texts.select(*marks, "text").mapInArrow(lean(run), "c binary, blob binary, sketch binary, coarse binary")
        return cut(read.join(alive.select("c", "cid", "n"), "c").groupBy("c", "cid", "n").agg(*(F.first(x).alias(x) for x in ("blob", "sketch", "coarse"))).drop("c"))

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        blobs = sets.select("cid", "blob")
        one = pairs.join(blobs.select(F.col("cid").alias("a"), F.col("blob").alias("x")), "a")
        two = one.join(blobs.select(F.col("cid").alias("b"), F.col("blob").alias("y")), "b")
        return two.select("a", "b", "x", "y").mapInArrow(lean(_linked), "a long, b long")

    def _sifted(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that the bound lets pass: that of the coarse sketches, which are cheap to send, then that of the fine ones."""
        for sketch in ("coarse", "sketch"):
            pairs = self._bounded_by(sketch, pairs, sets)
        return pairs

    @staticmethod
    def _bounded_by(sketch: str, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        light = sets.select("cid", "n", F.col(sketch).alias("s"))
        one = pairs.join(light.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a")
        two = one.join(light.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b")
        return two.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(_sift), "a long, b long")

    @staticmethod
    def _compared(rows: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs of groups that the bound lets pass: coarse sketches, cheap to send, first tell which rows may be in any."""
        some = rows.join(sets.select("cid", "n", "coarse"), "cid").groupBy("key").applyInArrow(lean_group(_some_near), "key long, cid long, comp long, own boolean")
        return some.join(sets.select("cid", "n", "sketch"), "cid").groupBy("key").applyInArrow(lean_group(_across), "a long, b long")

    @staticmethod
    def _apart(rows: DataFrame) -> DataFrame:
        """The groups (key, cid, comp, own) with several components and one that is in its own band, and ``many`` rows each;
        of groups with the same rows one, as the others hold the same pairs."""
        same = [F.bit_xor(F.xxhash64("cid", "own", F.lit(k))).alias(f"x{k}") for k in range(2)]
        sizes = rows.groupBy("key").agg(F.count("*").alias("many"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("own").alias("some"), *same).where("low != high and some")
        return rows.join(sizes.groupBy("many", "x0", "x1").agg(F.min("key").alias("key")).select("key", "many"), "key")

    def _blocks(self, large: DataFrame) -> DataFrame:
        """Large groups in blocks of half the limit, every two of which meet under a key of their own."""
        blocks = F.ceil(F.col("many") * 2 / self.group_limit * 1.5).cast("long")
        mine = F.pmod(F.xxhash64("cid", F.lit("block")), blocks)
        other = large.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        return other.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "cid", "comp", "own")

    def _components(self, sets: DataFrame) -> DataFrame:
        """(v, comp) of the classes that are linked with others."""
        spark = sets.sparkSession
        group = Window.partitionBy("sig")
        order = group.orderBy(F.col("own").desc(), "cid")
        every = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        signed = sets.select("cid", "blob").mapInArrow(lean(_sign(0)), "sig long, cid long, own boolean")
        met = signed.select(
            "sig", "cid", "own", F.count("*").over(every).alias("many"), F.min(F.when(F.col("own"), F.col("cid"))).over(every).alias("lead"),
            F.lag("cid").over(order).alias("one"), F.lag("own").over(order).alias("one_own"), F.lag("cid", 2).over(order).alias("two"), F.lag("own", 2).over(order).alias("two_own"),
        ).where("many > 1 and lead is not null")
        # of those before it: the group's first host, the nearest, and in small groups the next
        partners = [F.col("lead"), F.when(F.col("own") | F.col("one_own"), F.col("one")), F.when((F.col("many") <= self.pairs_up_to) & (F.col("own") | F.col("two_own")), F.col("two"))]
        met = met.select(F.when(F.col("many") > self.pairs_up_to, F.col("sig")).alias("key"), "cid", "own", F.array_distinct(F.array_compact(F.array(*partners))).alias("near"))
        path = fresh_path(spark, "partenum-groups")
        met.where(F.col("key").isNotNull() | (F.size("near") > 0)).write.parquet(path)
        shared = spark.read.parquet(path)
        pairs = shared.select("cid", F.explode("near").alias("other")).where("cid != other").select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct()
        links = cut(self._verified(self._sifted(pairs, sets), sets))
        comps = components(links)
        large = shared.where("key is not null").select("key", "cid", "own")
        rows = large.join(comps.withColumnRenamed("v", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        more, family, last = [], 1, None
        while True:
            open_ = cut(self._apart(rows))
            small = open_.where(F.col("many") <= self.group_limit)
            more.append(self._compared(small.select("key", "cid", "comp", "own"), sets))
            large = open_.where(F.col("many") > self.group_limit)
            left = large.count()
            if left and last is not None and left >= last:  # splitting doesn't help: whole blocks against each other
                more.append(self._compared(self._blocks(large), sets))
                left = 0
            if not left:
                break
            again = sets.join(large.select("cid").distinct(), "cid", "left_semi").select("cid", "blob").mapInArrow(lean(_sign(family)), "sig long, cid long, own boolean")
            rows = large.select("key", "cid", "comp", "own").join(again.select("cid", "sig"), "cid").select(F.xxhash64("key", "sig").alias("key"), "cid", "comp", "own")
            family, last = family + 1, left
        drop_path(spark, path)
        between = more[0]
        for m in more[1:]:
            between = between.union(m)
        new = cut(self._verified(cut(between.distinct()), sets))
        return comps if new.isEmpty() else merged(comps, new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document with its set's size and its component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ShingleJoin(docs).rows


QUERIES = {"op5_partenum_join": query}

ORACLE_SQL: dict[str, str] = {}
