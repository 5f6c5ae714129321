"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts texts into chunks; those that several texts (or places) share are encoded once, and their
ids travel to the texts. What is not shared is encoded where it stands. Where two separately encoded parts
meet, the join is re-encoded over a window that grows until both neighbours' tokens end exactly at its ends
and these ends are places where no pre-token can cross (a visible character before, white space behind).

Every row is joined by its text's digest, and what is joined is written first, so that a skewed join can split
the copies of one text. Null texts count as empty and have no ids. A long text costs what its chunks do; its shared
chunks and its ids are one row. Equal texts have equal ids. Empty tables give empty tables; columns
whose names clash with the added ones are replaced, others are kept whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm import bloom
from kinweave.llm.names import Veil
from kinweave.llm.storage import cut, small_batches
from kinweave.llm.words import BLOCK, _BYTES, _power, buffers, lean, mix, runs

WINDOW = 32
#: Chunks: a cut where the hash has so many zero bits (512 bytes on average), least and most bytes.
BITS, LEAST, MOST = 9, 128, 8192
#: Bytes encoded at once.
AT_ONCE = 1 << 19
#: Bytes without a space from which on a text counts as having a long run.
LONG_RUN = 2000

_AHEAD = np.zeros(256, dtype=bool)
_AHEAD[[9, 10, 13, 32]] = True
_BEHIND = np.zeros(256, dtype=bool)
_BEHIND[33:127] = True
_BEHIND[128:] = True
# last bytes of white space beyond ASCII, in UTF-8: taken for white space wherever they end a character
_BEHIND[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = False


def default_tokenizer() -> str:
    """The 50k byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _longest_run(raw: bytes) -> int:
    """Bytes between ASCII spaces that follow visible characters, at most."""
    data = np.frombuffer(raw, dtype=np.uint8)
    at = np.flatnonzero(_AHEAD[data[1:]] & _BEHIND[data[:-1]]) + 1
    return int(np.diff(np.concatenate([[0], at, [len(data)]])).max())


class Codec:
    """A byte-level BPE tokenizer file, with the bytes of every id."""

    _loaded: dict[str, Codec] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        of_char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        table = {i: bytes(of_char[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in of_char for c in t)}
        table |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.fast = self._ranked(spec, table)
        self.bytes = [table.get(i, b"") for i in range(max(table) + 1)]
        self.narrow = np.dtype("<u2" if len(self.bytes) <= 1 << 16 else "<u4")  # of ids that travel
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)

    @classmethod
    def load(cls, path: str) -> Codec:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @staticmethod
    def _ranked(spec: dict, table: dict[int, bytes]):
        """The same vocabulary as ranks, which another library encodes with several times faster; None if it isn't one.

        The ids of merged tokens must follow the order of the merges, and the texts be split by the usual pattern.
        """
        import public_tokenizers
        import tiktoken

        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {table[i]: i for i in spec["model"]["vocab"].values() if i in table}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        own = [spec["model"]["vocab"].get(a + b) for a, b in merges]
        plain = spec["normalizer"] is None and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        split = spec["pre_tokenizer"]
        if not plain or own != sorted(x for x in own if x is not None) or len(ranks) != len(own) + 256 or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            return None
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of each part; long runs without a space go to the library whose time doesn't grow with their square."""
        out: list[np.ndarray | None] = [None] * len(parts)
        rest = []
        for k, p in enumerate(parts):
            if self.fast is None or (len(p) > LONG_RUN and _longest_run(p) > LONG_RUN):
                rest.append(k)
            else:
                out[k] = np.asarray(self.fast.encode_to_numpy(p.decode(), allowed_special="all"), dtype=np.uint32)
        for k, ids in zip(rest, self._slowly([parts[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def _slowly(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of each part, a bounded number of bytes at a time."""
        out: list[np.ndarray] = []
        i = 0
        while i < len(parts):
            j, n = i, 0
            while j < len(parts) and (j == i or n + len(parts[j]) <= AT_ONCE) and j - i < 4096:
                n += len(parts[j])
                j += 1
            found = self.tokenizer.encode_batch_fast([p.decode() for p in parts[i:j]], add_special_tokens=False)
            out += [np.array(e.ids, dtype=np.uint32) for e in found]
            i = j
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that aren't UTF-8 become U+FFFD."""
        table = self.bytes
        raw = b"".join([table[i] for i in ids.tolist()])
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Chunk ends of every text of a run (offsets from 0), at character boundaries."""
    n = len(data)
    up, down = _power(BLOCK + WINDOW + 1)
    ends: list[list[int]] = []
    places = [np.zeros(0, dtype=np.int64)]
    for s in range(0, n - WINDOW, BLOCK):  # windows that end in (s + WINDOW, s + WINDOW + BLOCK]
        part = data[s : s + BLOCK + WINDOW]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[part] * up[: len(part)], out=sums[1:])
        h = mix((sums[WINDOW:-1] - sums[: -WINDOW - 1]) * down[: len(part) - WINDOW])
        places.append(np.flatnonzero((h >> np.uint64(64 - BITS)) == 0) + WINDOW + s)
    at = np.concatenate(places)
    at = at[(data[at] & 0xC0) != 0x80]
    edges = np.searchsorted(at, offsets)
    found = at.tolist()
    for k in range(len(offsets) - 1):
        a, b = int(offsets[k]), int(offsets[k + 1])
        last, own = a, []
        for p in [*found[edges[k] : edges[k + 1]], b]:
            if p - a < WINDOW and p < b:  # the window would reach into the text before
                continue
            while p - last > MOST:
                last += MOST
                while data[last] & 0xC0 == 0x80:
                    last -= 1
                own.append(last)
            if (p - last >= LEAST and p < b) or (p == b and p > last):
                own.append(p)
                last = p
        ends.append(own)
    return ends


def chunks(column: pa.Array) -> Iterator[tuple[int, bytes, list[int]]]:
    """(row, bytes of the text, chunk ends within it) of every row."""
    data, offsets = buffers(column)
    for i, j in runs(offsets, BLOCK):
        lo = int(offsets[i])
        own = offsets[i : j + 1] - lo
        part = data[lo : int(offsets[j])]
        for k, ends in enumerate(cuts(part, own)):
            a = int(own[k])
            yield i + k, part[a : int(own[k + 1])].tobytes(), [e - a for e in ends]


def _pieces(raw: bytes, ends: list[int]) -> tuple[list[bytes], list[bytes]]:
    parts = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return parts, [xxhash.xxh3_128_digest(p) for p in parts]


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)


_PAIR = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])


def _columns(pairs: np.ndarray) -> list[pa.Array]:
    both = np.ascontiguousarray(pairs.T).view(np.int64)
    return [pa.array(both[0]), pa.array(both[1])]


def _chunk_hashes(batches):
    """(h1, h2) of every chunk: twice for one that its batch has more often, which is all that counts."""
    for batch in batches:
        seen: dict[bytes, int] = {}
        for _, raw, ends in chunks(batch.column(0)):
            for d in _pieces(raw, ends)[1]:
                seen[d] = seen.get(d, 0) + 1
        if seen:
            yield pa.RecordBatch.from_arrays(_columns(_pairs([d for d, n in seen.items() for _ in range(min(n, 2))])), names=["h1", "h2"])


def _shared_texts(words: np.ndarray):
    """(h1, h2, text) of the chunks that the filter passes, each once a batch."""

    def run(batches):
        for batch in batches:
            found: dict[bytes, bytes] = {}
            for _, raw, ends in chunks(batch.column(0)):
                parts, digests = _pieces(raw, ends)
                if digests:
                    pairs = _pairs(digests)
                    for k in np.flatnonzero(bloom.passes(words, pairs[:, 0], pairs[:, 1])).tolist():
                        found.setdefault(digests[k], parts[k])
            if found:
                yield pa.RecordBatch.from_arrays([*_columns(_pairs(list(found))), pa.array(list(found.values()), pa.binary())], names=["h1", "h2", "part"])

    return run


def _encode_chunks(path: str):
    def run(batches):
        codec = Codec.load(path)
        for batch in batches:
            ids = codec.encode(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.astype(codec.narrow).tobytes() for i in ids], pa.binary())], names=["h1", "h2", "ids"])

    return run


def _key(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


def _refs(words: np.ndarray):
    """(key of the text, h1, h2) of the chunks that the filter passes."""

    def run(batches):
        for batch in batches:
            keys, pairs = [], []
            seen = set()
            for _, raw, ends in chunks(batch.column(0)):
                key = _key(raw)
                if key in seen:
                    continue
                seen.add(key)
                digests = _pieces(raw, ends)[1]
                if digests:
                    own = _pairs(list(dict.fromkeys(digests)))
                    own = own[bloom.passes(words, own[:, 0], own[:, 1])]
                    keys += [key] * len(own)
                    pairs.append(own)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *_columns(np.concatenate(pairs))], names=["key", "h1", "h2"])

    return run


def repair(codec: Codec, raw: bytes, parts: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Ids of ``raw`` from those of its consecutive parts (start, end, ids encoded alone)."""
    if len(parts) == 1:
        return parts[0][2]
    data = np.frombuffer(raw, dtype=np.uint8)
    safe = np.flatnonzero(_AHEAD[data[1:]] & _BEHIND[data[:-1]]) + 1
    done: list[np.ndarray] = []  # settled ids, up to byte `at` of the text
    start, at = 0, 0  # the part that is being joined begins at `at`, its ids are `ids`
    start, end, ids = parts[0]
    for a, b, right in parts[1:]:
        left_ends = start + np.cumsum(codec.lengths[ids])
        right_ends = a + np.cumsum(codec.lengths[right])
        k = int(np.searchsorted(safe, a, side="right"))
        low = [a] if k and safe[k - 1] == a else [p for p in safe[:k].tolist()[::-1] if p > start]
        q, cut_left = start, 0
        for p in low:  # the nearest safe place at which a token of the left part ends
            i = int(np.searchsorted(left_ends, p))
            if i < len(left_ends) and left_ends[i] == p:
                q, cut_left = p, i + 1
                break
        r, cut_right = b, len(right)
        for p in safe[int(np.searchsorted(safe, a)) :].tolist():
            if p >= b:
                break
            if p == a:
                r, cut_right = a, 0
                break
            i = int(np.searchsorted(right_ends, p))
            if i < len(right_ends) and right_ends[i] == p:
                r, cut_right = p, i + 1
                break
        middle = codec.encode([raw[q:r]])[0] if r > q else np.zeros(0, np.uint32)
        if r < b and q > start:
            done += [ids[:cut_left], middle]
            start, end, ids = r, b, right[cut_right:]
        else:  # nothing safe in the part that follows, or before: keep the join open
            ids = np.concatenate([ids[:cut_left], middle, right[cut_right:]])
            end = b
    done.append(ids)
    return np.concatenate(done)


_OUT = T.StructType([T.StructField("__key", T.BinaryType()), T.StructField("__packed", T.BinaryType())])


def _results(codec: Codec, ids: list[np.ndarray | None], digest_only: bool) -> list[pa.Array]:
    """Columns of n_tokens and of the ids or their digests; null where there are no ids yet."""
    counts = pa.array([None if i is None else len(i) for i in ids], pa.int64())
    raws = [None if i is None else i.astype("<u4").tobytes() for i in ids]
    if not digest_only:
        return [counts, pa.array(raws, pa.binary())]
    sha = lambda b: None if b is None else hashlib.sha256(b).hexdigest()
    return [counts, pa.array([sha(r) for r in raws], pa.string()), pa.array([sha(None if i is None else codec.decode(i)) for i in ids], pa.string())]


def _place(path: str, words: np.ndarray, kept: list[int], text_at: int, names: list[str], digest_only: bool):
    """Texts without a chunk that the filter passes are encoded here; the others go on packed. All have their key."""

    def run(batches):
        codec, pack = Codec.load(path), zstandard.ZstdCompressor(1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                own = batch.slice(lo, 1000)
                keys, packed, plain = [None] * own.num_rows, [None] * own.num_rows, []
                for row, raw, ends in chunks(own.column(text_at)):
                    keys[row], digests = _key(raw), _pieces(raw, ends)[1]
                    pairs = _pairs(digests) if digests else None
                    if digests and bloom.passes(words, pairs[:, 0], pairs[:, 1]).any():
                        packed[row] = pack.compress(raw)
                    else:
                        plain.append((row, raw))
                ids = [None] * own.num_rows
                for (row, _), found in zip(plain, codec.encode([raw for _, raw in plain]), strict=True):
                    ids[row] = found
                yield pa.RecordBatch.from_arrays([*(own.column(i) for i in kept), pa.array(keys, pa.binary()), pa.array(packed, pa.binary()), *_results(codec, ids, digest_only)], names=names)

    return run


def _join(path: str, kept: int, names: list[str], digest_only: bool):
    """The ids of packed texts from those of their shared chunks and of what lies between."""

    def texts(own):
        packed, shared = own.column(kept + 1).to_pylist(), own.column(own.num_columns - 1).to_pylist()
        codec, unpack = Codec.load(path), zstandard.ZstdDecompressor()
        open_, gaps = [], []
        for row, blob in enumerate(packed):
            if blob is None:
                continue
            raw = unpack.decompress(blob) if blob else b""
            known = {(s["h1"], s["h2"]): s["ids"] for s in shared[row] or ()}
            ends = cuts(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))[0]
            pairs = _pairs(_pieces(raw, ends)[1]).view(np.int64).tolist()
            parts: list[list] = []
            for a, b, pair in zip([0, *ends], ends, pairs, strict=False):
                found = known.get(tuple(pair))
                if found is not None:
                    parts.append([a, b, np.frombuffer(found, dtype=codec.narrow).astype(np.uint32)])
                elif parts and parts[-1][2] is None:
                    parts[-1][1] = b
                else:
                    parts.append([a, b, None])
            gaps += [(p, raw[p[0] : p[1]]) for p in parts if p[2] is None]
            open_.append((row, raw, parts))
        for (p, _), found in zip(gaps, codec.encode([g for _, g in gaps]), strict=True):
            p[2] = found
        out: list[np.ndarray | None] = [None] * own.num_rows
        for row, raw, parts in open_:
            out[row] = repair(codec, raw, [tuple(p) for p in parts])
        return codec, out

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                own = batch.slice(lo, 500)
                codec, found = texts(own)
                cols = [pc.coalesce(c, own.column(kept + 2 + k)) for k, c in enumerate(_results(codec, found, digest_only))]
                yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(kept)), *cols], names=names)

    return run


def encode(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, digest_only: bool = False) -> DataFrame:
    """Adds n_tokens and ids (little-endian unsigned 32-bit); with ``digest_only``, the digests of ids and decoded text instead."""
    veil = Veil(docs)
    return veil.lift(_encoded(veil.docs, veil.name(text_col), tokenizer, digest_only))


def _encoded(docs: DataFrame, text_col: str, tokenizer: str | None, digest_only: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    extra = [T.StructField("n_tokens", T.LongType())]
    extra += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digest_only else [T.StructField("ids", T.BinaryType())]
    gone = {f.name for f in extra}
    keep = [i for i, f in enumerate(docs.schema.fields) if f.name not in gone and not (digest_only and f.name == text_col)]
    fields = [docs.schema.fields[i] for i in keep]
    text = docs.select(text_col)
    hashes = text.mapInArrow(lean(_chunk_hashes), _PAIR)
    shared = cut(hashes.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"))
    words = bloom.build(shared, shared.count())
    parts = text.mapInArrow(lean(_shared_texts(words)), T.StructType([*_PAIR.fields, T.StructField("part", T.BinaryType())]))
    once = parts.join(shared, ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("part").alias("part"))
    coded = cut(once.mapInArrow(lean(_encode_chunks(path)), T.StructType([*_PAIR.fields, T.StructField("ids", T.BinaryType())])))
    refs = text.mapInArrow(lean(_refs(words)), T.StructType([T.StructField("key", T.BinaryType()), *_PAIR.fields])).distinct()
    per_text = cut(refs.join(coded, ["h1", "h2"]).groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("h1", "h2", "ids")).alias("__shared")))
    names = [f.name for f in fields]
    done = [f.name for f in extra]
    placed = docs.mapInArrow(lean(_place(path, words, keep, docs.columns.index(text_col), [*names, *_OUT.names, *done], digest_only)), T.StructType([*fields, *_OUT.fields, *extra]))
    whole = placed.join(per_text, "__key", "left").select(*names, "__key", "__packed", *done, "__shared")
    return whole.mapInArrow(lean(_join(path, len(fields), [*names, *(f.name for f in extra)], digest_only)), T.StructType([*fields, *extra]))


def decode(encoded: DataFrame, ids_col: str = "ids", text_col: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """Adds the decoded text of ids as ``encode`` gives them; null ids decode to the empty text."""
    path = tokenizer or default_tokenizer()
    at = encoded.columns.index(ids_col)
    fields = [f for f in encoded.schema.fields if f.name != text_col]
    keep = [i for i, f in enumerate(encoded.schema.fields) if f.name != text_col]

    def run(batches):
        codec = Codec.load(path)
        for batch in batches:
            texts = [codec.decode(np.frombuffer(i or b"", dtype="<u4")).decode() for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string())], names=[*(f.name for f in fields), text_col])

    return encoded.mapInArrow(lean(run), T.StructType([*fields, T.StructField(text_col, T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document encoded and decoded with the 50k byte-level vocabulary."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, digest_only=True)


QUERIES = {"op8_bpe_chunks": query}

ORACLE_SQL: dict[str, str] = {}
