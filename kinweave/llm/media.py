"""MPEG audio columns: resynchronised frames, tags, variable-bitrate tables, checksums, durations, seek offsets.

``parse_audio`` adds the parsed columns to a table with a binary column; ``store_payload`` writes texts
losslessly as MPEG-1 Layer III streams whose frames decode to silence and carry the bytes as ancillary data.

Nulls and empty content give no frames, zero duration and an empty seek table; null texts count as empty.
Repeated rows give equal values, and a table without rows gives a table without rows. Extra columns pass
through; where one bears the name of an added column, the added column replaces it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.words import lean

# Fixed values of the MPEG audio header (ISO/IEC 11172-3 and 13818-3): kbit/s by (version 1?, layer), sample rates.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

_CRC = []
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = ((_c << 1) ^ 0x8005) & 0xFFFF if _c & 0x8000 else (_c << 1) & 0xFFFF
    _CRC.append(_c)


def crc16(data: bytes) -> int:
    """The checksum of an MPEG audio frame: polynomial 0x8005, start 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


_headers: dict[bytes, tuple | None] = {}


def header(four: bytes) -> tuple | None:
    """(version bits, layer, bytes, samples, rate, checked?, bytes of side information) of a frame header, or None."""
    if four in _headers:
        return _headers[four]
    found = None
    if len(four) == 4 and four[0] == 0xFF and four[1] & 0xE0 == 0xE0:
        version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
        rate, code, pad = four[2] >> 2 & 3, four[2] >> 4, four[2] >> 1 & 1
        if version != 1 and layer != 4 and rate != 3 and code not in (0, 15):
            one, hz = version == 3, RATES[version][rate]
            kbit = BITRATES[one, layer][code]
            samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
            size = (12_000 * kbit // hz + pad) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hz + pad
            mono = four[3] >> 6 == 3
            side = 0 if layer != 3 else (17 if mono else 32) if one else (9 if mono else 17)
            found = (version, layer, size, samples, hz, not four[1] & 1, side)
    if len(_headers) < 4096:
        _headers[four] = found
    return found


_sums: dict[bytes, int] = {}


def _checked(data: bytes, at: int, head: tuple) -> bool | None:
    """Whether a frame's checksum holds; None if it has none, or its layer's protected bits aren't read here."""
    if not head[5]:
        return None
    if head[1] != 3:
        return None
    key = data[at + 2 : at + 4] + data[at + 6 : at + 6 + head[6]]
    want = _sums.get(key)
    if want is None:
        want = crc16(key)
        if len(_sums) < 4096:
            _sums[key] = want
    return want == data[at + 4] << 8 | data[at + 5]


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def read_tags(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of an ID3v2.3/2.4 tag at the start, and the offset behind it."""
    tags: dict[str, str] = {}
    if len(data) < 10 or data[:3] != b"ID3":
        return tags, 0
    end = 10 + _syncsafe(data[6:10])
    at = 10
    while at + 10 <= min(end, len(data)) and data[at] != 0:
        name = data[at : at + 4].decode("latin-1")
        size = _syncsafe(data[at + 4 : at + 8]) if data[3] >= 4 else struct.unpack(">I", data[at + 4 : at + 8])[0]
        body = data[at + 10 : at + 10 + size]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 3: "utf-8"}.get(body[0], "utf-16"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value.rstrip("\0")
        at += 10 + size
    return tags, end + 10 * bool(data[5] & 0x10)


def parse_stream(data: bytes) -> dict:
    """Walk one stream. In sync, frames follow by their lengths; else the next header is taken whose checksum
    holds (where it has one) and that the next frame, a tag or the end of the data follows."""
    tags, at = read_tags(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    offsets, bodies, samples, rate, bad, skipped, sync, vbr = [], [], 0, 0, 0, 0, False, None
    while at + 4 <= end:
        head = header(data[at : at + 4])
        if head is not None and at + head[2] <= end:
            ok = _checked(data, at, head)
            next_at = at + head[2]
            if not sync and (ok is False or not (next_at == end or header(data[next_at : next_at + 4]))):
                head = None
        else:
            head = None
        if head is None:
            found = data.find(b"\xff", at + 1)
            found = end if found < 0 else min(found, end)
            skipped += found - at
            at, sync = found, False
            continue
        sync = True
        body = at + 4 + 2 * head[5] + head[6]
        if ok is False:
            bad += 1
        if not offsets and vbr is None and data[body : body + 4] in (b"Xing", b"Info"):
            flags = struct.unpack(">I", data[body + 4 : body + 8])[0]
            p, vbr = body + 8, {"frames": None, "bytes": None, "toc": b""}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    vbr[name] = struct.unpack(">I", data[p : p + 4])[0]
                    p += 4
            if flags & 4:
                vbr["toc"] = data[p : p + 100]
        elif not offsets and vbr is None and data[at + 36 : at + 40] == b"VBRI":
            size, count = struct.unpack(">II", data[at + 46 : at + 54])
            vbr = {"frames": count, "bytes": size, "toc": b""}
        else:
            offsets.append(at)
            bodies.append((body, at + head[2], ok))
            samples, rate = samples + head[3], rate or head[4]
        at += head[2]
    return {"tags": tags, "offsets": offsets, "bodies": bodies, "samples": samples, "rate": rate, "bad": bad, "skipped": skipped + max(0, end - at), "vbr": vbr}


# What store_payload writes: 32 kHz mono, with checksum; bytes of a frame by bitrate code.
_SIDE = bytes(17)
_LEAST = 4 + 2 + len(_SIDE)


def _frame_head(code: int) -> bytes:
    head = bytes((0xFF, 0xFA, code << 4 | 2 << 2, 0xC0))
    return head + struct.pack(">H", crc16(head[2:] + _SIDE)) + _SIDE


_HEADS = {code: (_frame_head(code), 144 * BITRATES[True, 3][code] * 1000 // 32000 - _LEAST) for code in range(1, 15)}


def _text_frame(key: str, value: str) -> bytes:
    body = b"\x03" + key.encode() + b"\0" + value.encode()
    return b"TXXX" + struct.pack(">IH", len(body), 0) + body


def encode_stream(payload: bytes, unpadded: int) -> bytes:
    """A tag with the lengths, a frame with the variable-bitrate table, and frames that carry the payload."""
    tag = _text_frame("payload_bytes", str(len(payload))) + _text_frame("text_bytes", str(unpadded))
    n = len(tag)
    parts = [b"ID3\x03\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + tag]
    head, room = _HEADS[14]
    frames = [head + payload[i : i + room] for i in range(0, len(payload) - len(payload) % room, room)]
    if rest := payload[len(payload) - len(payload) % room :]:
        small, fit = next(_HEADS[c] for c in range(1, 15) if _HEADS[c][1] >= len(rest))
        frames.append(small + rest + bytes(fit - len(rest)))
    sizes = [len(f) for f in frames]
    total, at, starts = sum(sizes), 0, []
    for s in sizes:
        starts.append(at)
        at += s
    toc = bytes(min(255, 256 * starts[min(len(starts) - 1, i * len(starts) // 100)] // max(1, total)) for i in range(100))
    first, room = _HEADS[5]
    table = b"Xing" + struct.pack(">III", 7, len(frames), total + len(first) + room) + toc
    parts.append(first + table + bytes(room - len(table)))
    return b"".join(parts + frames)


def read_payload(data: bytes, parsed: dict) -> bytes:
    """The bytes that encode_stream stored, from frames whose checksum holds."""
    out = b"".join([data[a:b] for a, b, ok in parsed["bodies"] if ok is not False])
    return out[: int(parsed["tags"].get("payload_bytes", len(out)))]


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _added(df: DataFrame, fields: list[T.StructField], make) -> DataFrame:
    """``make(batch) -> arrays`` adds ``fields``; columns of those names go."""
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    keep = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in names]

    def run(batches):
        for batch in _batches(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *make(batch)], names=[*(f.name for f in kept), *(f.name for f in fields)])

    return df.mapInArrow(lean(run), T.StructType([*kept, *fields]))


def store_payload(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Adds ``media_col``: the UTF-8 bytes of the text, zeros up to a positive multiple of 64, as an MPEG stream."""
    at = df.columns.index(text_col)

    def make(batch):
        out = []
        for text in batch.column(at).to_pylist():
            raw = (text or "").encode()
            size = max(64, -(-len(raw) // 64) * 64)
            out.append(encode_stream(raw.ljust(size, b"\0"), len(raw)))
        return [pa.array(out, pa.binary())]

    return _added(df, [T.StructField(media_col, T.BinaryType())], make)


_PARSED = [
    T.StructField("frames", T.LongType()),
    T.StructField("samples", T.LongType()),
    T.StructField("sample_rate", T.IntegerType()),
    T.StructField("duration_s", T.DoubleType()),
    T.StructField("frame_offsets", T.ArrayType(T.LongType())),
    T.StructField("bad_checksums", T.LongType()),
    T.StructField("skipped_bytes", T.LongType()),
    T.StructField("vbr_frames", T.LongType()),
    T.StructField("vbr_bytes", T.LongType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("payload", T.BinaryType()),
]


def parse_audio(df: DataFrame, media_col: str = "media", payload: bool = True) -> DataFrame:
    """Adds the parsed columns of a binary column with an MPEG stream; ``payload`` also reads stored bytes back.

    ``duration_s`` is samples / sample_rate, and ``frame_offsets`` the byte offset of each audio frame.
    """
    at = df.columns.index(media_col)
    fields = _PARSED if payload else _PARSED[:-1]

    def make(batch):
        rows = []
        for data in batch.column(at).to_pylist():
            data = data or b""
            p = parse_stream(data)
            vbr = p["vbr"] or {}
            row = (len(p["offsets"]), p["samples"], p["rate"] or None, p["samples"] / p["rate"] if p["rate"] else 0.0, p["offsets"], p["bad"], p["skipped"], vbr.get("frames"), vbr.get("bytes"), list(p["tags"].items()))
            rows.append((*row, read_payload(data, p)) if payload else row)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        return [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(fields))]

    return _added(df, fields, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document as an MPEG stream, read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = store_payload(docs).select("doc_id", "media")
    parsed = parse_audio(stored)
    return parsed.select(
        "doc_id",
        F.col("tags")["text_bytes"].cast("long").alias("n_bytes"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";", F.lit("mpeg1-layer3"), F.concat(F.lit("frames="), "frames"), F.concat(F.lit("samples="), "samples"), F.concat(F.lit("rate="), "sample_rate"),
            F.concat(F.lit("bad="), "bad_checksums"), F.concat(F.lit("skipped="), "skipped_bytes"), F.concat(F.lit("last="), F.element_at("frame_offsets", -1)),
        ).alias("feature"),
        "frames",
        "duration_s",
        "frame_offsets",
    )


QUERIES = {"op3_mpeg_audio": query}

ORACLE_SQL: dict[str, str] = {}
