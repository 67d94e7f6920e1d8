"""ISO media containers in a binary column: boxes, sample tables, keyframe ranges.

`inspect` walks nested boxes and decodes the sample tables of every track to
codec, duration and the byte ranges of its keyframes; payloads are not
decoded. `store` writes bytes losslessly as one track of fixed-size units, so
that what is stored can be read back through the tables alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64
CHUNK_UNITS = 32
KEY_EVERY = 16
TIMESCALE = 8000
#: Boxes that hold boxes whose content matters here (fixed values of the format).
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"mvex", b"moof", b"traf"}
#: Bit of a fragment's sample flags that says "no sync sample", and the optional fields of its headers in their order (fixed values of the format).
NOT_SYNC = 0x10000
TFHD_FIELDS = ((0x1, ">Q"), (0x2, ">I"), (0x8, ">I"), (0x10, ">I"), (0x20, ">I"))
TRUN_FIELDS = (0x100, 0x200, 0x400, 0x800)


@dataclass
class Track:
    """What the tables say of one track; times are in units of the timescale, `times` when a sample is shown."""

    codec: str = ""
    timescale: int = 0
    duration: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def boxes(data: bytes, lo: int, hi: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(type, start, start of content, end) of the boxes in data[lo:hi]; sizes 0 (to the end) and 1 (64-bit) are read, zeros after the last box passed over."""
    while lo + 8 <= hi:
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            if lo + 16 > hi:
                raise ValueError("box header cut short")
            size = struct.unpack_from(">Q", data, lo + 8)[0]
            head = 16
        elif size == 0:
            size = hi - lo
        if size < head or lo + size > hi:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield kind, lo, lo + head, lo + size
        lo += size
    if any(data[lo:hi]):
        raise ValueError("bytes after the last box")


def _walk(data: bytes, lo: int, hi: int, found: list, depth: int = 0) -> list:
    """Nested boxes as (type, start, content or list of boxes)."""
    if depth > 16:
        raise ValueError("boxes nested too deeply")
    for kind, start, a, b in boxes(data, lo, hi):
        if kind in NESTED:
            found.append((kind, start, _walk(data, a, b, [], depth + 1)))
        elif kind != b"mdat":
            found.append((kind, start, data[a:b]))
    return found


def _leaves(tree: list) -> dict:
    """The first content of each kind of box that holds data, at any depth."""
    out: dict = {}
    for kind, _, content in tree:
        for k, c in (_leaves(content) if isinstance(content, list) else {kind: content}).items():
            out.setdefault(k, c)
    return out


def _table(raw: bytes | None, width: int, kind: str = ">u4") -> np.ndarray:
    """Rows of a full box whose content is a count and that many entries; the count is held against the bytes first."""
    if raw is None or len(raw) < 8:
        return np.zeros((0, width), np.int64)
    n = struct.unpack_from(">I", raw, 4)[0]
    if len(raw) < 8 + n * width * np.dtype(kind).itemsize:
        raise ValueError("table cut short")
    return np.frombuffer(raw, dtype=kind, count=n * width, offset=8).astype(np.int64).reshape(n, width)


def _sizes(raw: dict, most: int) -> np.ndarray:
    """Sample sizes of a stsz or stz2 box; no file has more samples than bytes."""
    if b"stz2" in raw and b"stsz" not in raw:
        bits, count = struct.unpack_from(">II", raw[b"stz2"], 4)
        bits &= 0xFF
        body = np.frombuffer(raw[b"stz2"], dtype=np.uint8, offset=12)
        if bits not in (4, 8, 16) or len(body) * 8 < count * bits:
            raise ValueError("table cut short")
        if bits == 4:
            body = np.stack([body >> 4, body & 15], axis=1).ravel()
        elif bits == 16:
            body = body[: len(body) // 2 * 2].view(">u2")
        return body[:count].astype(np.int64)
    box = raw.get(b"stsz", bytes(12))
    fixed, count = struct.unpack_from(">II", box, 4)
    if fixed:
        if count > most:
            raise ValueError("more samples than bytes")
        return np.full(count, fixed, np.int64)
    if len(box) < 12 + 4 * count:
        raise ValueError("table cut short")
    return np.frombuffer(box, dtype=">u4", count=count, offset=12).astype(np.int64)


def _runs(spans: np.ndarray, count: int) -> np.ndarray:
    """Values of (repeats, value) rows, `count` in all."""
    if int(spans[:, 0].sum()) != count:
        raise ValueError("times and samples disagree")
    return np.repeat(spans[:, 1], spans[:, 0])


def _decode(raw: dict, most: int) -> Track:
    track = Track()
    if b"mdhd" in raw:
        long = raw[b"mdhd"][0] == 1
        track.timescale, track.duration = struct.unpack_from(">IQ" if long else ">II", raw[b"mdhd"], 20 if long else 12)
    if len(raw.get(b"stsd", b"")) >= 16:
        track.codec = raw[b"stsd"][12:16].decode("latin-1")
    track.sizes = _sizes(raw, most)
    count = len(track.sizes)
    chunks = _table(raw[b"co64"], 1, ">u8") if b"co64" in raw else _table(raw.get(b"stco"), 1)
    runs = _table(raw.get(b"stsc"), 3)
    if count:
        if not len(runs) or not len(chunks) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or (chunks < 0).any():
            raise ValueError("samples without chunks")
        until = np.minimum(np.append(runs[1:, 0], len(chunks) + 1), len(chunks) + 1)
        per_chunk = np.repeat(runs[:, 1], np.maximum(until - np.minimum(runs[:, 0], until), 0))
        if int(per_chunk.sum()) != count:
            raise ValueError("chunks and samples disagree")
        chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)
        before = np.cumsum(track.sizes) - track.sizes
        first = np.cumsum(per_chunk) - per_chunk
        track.offsets = chunks[chunk, 0] + before - before[np.minimum(first[chunk], count - 1)]
    track.times = np.zeros(count, np.int64)
    spans = _table(raw.get(b"stts"), 2)
    if len(spans):
        lasts = _runs(spans, count)
        track.duration = int(lasts.sum())
        track.times = np.cumsum(lasts) - lasts
    if b"ctts" in raw:
        shift = _runs(_table(raw[b"ctts"], 2), count)
        track.times = track.times + np.where(shift >= 1 << 31, shift - (1 << 32), shift)
    keys = _table(raw[b"stss"], 1)[:, 0] - 1 if b"stss" in raw else np.arange(count)
    if len(keys) and (keys.min() < 0 or keys.max() >= count):
        raise ValueError("keyframe without a sample")
    track.keys = keys
    return track


def _fragment(track: Track, traf: list, start: int, defaults: tuple, most: int) -> None:
    """Append the samples of one traf, whose movie fragment begins at `start`, to its track."""
    head = next(c for k, _, c in traf if k == b"tfhd")
    flags, at, given = struct.unpack_from(">I", head)[0] & 0xFFFFFF, 8, {}
    for bit, kind in TFHD_FIELDS:
        if flags & bit:
            given[bit] = struct.unpack_from(kind, head, at)[0]
            at += struct.calcsize(kind)
    lasts0, size0, flags0 = (given.get(b, d) for b, d in zip((0x8, 0x10, 0x20), defaults))
    base = place = given.get(0x1, start)
    clock = track.duration
    for kind, _, raw in traf:
        if kind == b"tfdt":
            clock = struct.unpack_from(">Q" if raw[0] == 1 else ">I", raw, 4)[0]
        if kind != b"trun":
            continue
        flags, n = struct.unpack_from(">II", raw)
        flags, at = flags & 0xFFFFFF, 8
        if flags & 0x1:
            place = base + struct.unpack_from(">i", raw, at)[0]
            at += 4
        first = None
        if flags & 0x4:
            first = struct.unpack_from(">I", raw, at)[0]
            at += 4
        have = [b for b in TRUN_FIELDS if flags & b]
        if len(raw) < at + 4 * n * len(have) or n > most or n + len(track.sizes) > most:
            raise ValueError("table cut short")
        rows = np.frombuffer(raw, dtype=">u4", count=n * len(have), offset=at).astype(np.int64).reshape(n, len(have))
        col = {b: rows[:, i] for i, b in enumerate(have)}
        lasts, sizes = col.get(0x100, np.full(n, lasts0)), col.get(0x200, np.full(n, size0))
        marks = col.get(0x400, np.full(n, flags0)).copy()
        if first is not None and n:
            marks[0] = first
        shift = col.get(0x800, np.zeros(n, np.int64))
        shift = np.where(shift >= 1 << 31, shift - (1 << 32), shift)
        offsets = place + np.cumsum(sizes) - sizes
        if n and (place < 0 or offsets.min() < 0):
            raise ValueError("sample before the file")
        track.keys = np.append(track.keys, len(track.sizes) + np.flatnonzero(marks & NOT_SYNC == 0))
        track.offsets, track.sizes = np.append(track.offsets, offsets), np.append(track.sizes, sizes)
        track.times = np.append(track.times, clock + np.cumsum(lasts) - lasts + shift)
        clock += int(lasts.sum())
        place += int(sizes.sum())
    track.duration = max(track.duration, clock)


def tracks_of(data: bytes) -> list[Track]:
    """Tracks of a container, movie fragments included, decoded from its tables; an exception of BROKEN where it is broken."""
    tree = _walk(data, 0, len(data), [])
    movie = [c for k, _, c in tree if k == b"moov"]
    out, by_id, defaults = [], {}, {}
    for kind, _, content in (x for m in movie for x in m):
        if kind == b"trak":
            raw = _leaves(content)
            out.append(_decode(raw, len(data)))
            head = raw.get(b"tkhd", b"")
            if len(head) >= 24:
                by_id[struct.unpack_from(">I", head, 20 if head[0] == 1 else 12)[0]] = out[-1]
        elif kind == b"mvex":
            for k, _, raw in content:
                if k == b"trex":
                    track_id, _, *rest = struct.unpack_from(">IIIII", raw, 4)
                    defaults[track_id] = rest
    for kind, start, content in tree:
        if kind != b"moof":
            continue
        for k, _, traf in content:
            heads = [c for x, _, c in traf if x == b"tfhd"] if k == b"traf" else []
            track_id = struct.unpack_from(">I", heads[0], 4)[0] if heads else None
            if track_id in by_id:
                _fragment(by_id[track_id], traf, start, defaults.get(track_id, (0, 0, 0)), len(data))
    return out


#: What reading broken content may raise.
BROKEN = (ValueError, struct.error, IndexError, OverflowError)


def _box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *content: bytes) -> bytes:
    return _box(kind, bytes(4), *content)


def store(payload: bytes) -> bytes:
    """A container whose only track holds `payload` (a multiple of UNIT bytes) as 8-bit mono samples in units of UNIT."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"payload is not a positive multiple of {UNIT} bytes")
    units = len(payload) // UNIT
    chunks = -(-units // CHUNK_UNITS)
    u32 = lambda *x: struct.pack(f">{len(x)}I", *x)
    runs = [(1, CHUNK_UNITS, 1)] if units % CHUNK_UNITS == 0 else [(1, CHUNK_UNITS, 1), (chunks, units % CHUNK_UNITS, 1)]
    if runs[-1][0] == 1:
        runs = runs[-1:]
    keys = np.arange(1, units + 1, KEY_EVERY, dtype=">u4")
    sound = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHH", 1, 8, 0, 0), u32(TIMESCALE << 16))
    stbl = lambda base: _box(
        b"stbl",
        _full(b"stsd", u32(1), sound),
        _full(b"stts", u32(1, units, UNIT)),
        _full(b"stsc", u32(len(runs)), *[u32(*r) for r in runs]),
        _full(b"stsz", u32(UNIT, units)),
        _full(b"co64", u32(chunks), (base + np.arange(chunks, dtype=np.int64) * CHUNK_UNITS * UNIT).astype(">u8").tobytes()),
        _full(b"stss", u32(len(keys)), keys.tobytes()),
    )
    ticks = min(units * UNIT, 0xFFFFFFFF)

    def movie(base: int) -> bytes:
        handler = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0")
        media = _box(b"mdia", _full(b"mdhd", u32(0, 0, TIMESCALE, ticks), bytes(4)), handler, _box(b"minf", _full(b"smhd", bytes(4)), stbl(base)))
        return _box(b"moov", _full(b"mvhd", u32(0, 0, TIMESCALE, ticks), bytes(80)), _box(b"trak", _full(b"tkhd", u32(0, 0, 1, 0, ticks), bytes(60)), media))

    brand = _box(b"ftyp", b"isom", bytes(4), b"isom")
    large = len(payload) + 8 > 0xFFFFFFFF
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", len(payload) + 8, b"mdat")
    base = len(brand) + len(movie(0)) + len(head)
    return brand + movie(base) + head + payload


def read_back(data: bytes, track: Track) -> bytes:
    """The samples of a track, in order."""
    if len(track.offsets) and np.array_equal(track.offsets[1:], (track.offsets + track.sizes)[:-1]):
        return data[int(track.offsets[0]) : int(track.offsets[-1] + track.sizes[-1])]
    return b"".join(data[o : o + n] for o, n in zip(track.offsets.tolist(), track.sizes.tolist()))


INSPECTED = "codec string, timescale bigint, duration bigint, n_samples bigint, keyframes array<struct<start:bigint,size:bigint,time:bigint>>"


def inspect(files: DataFrame, content_col: str = "content", out: str = "tracks") -> DataFrame:
    """Add the tracks of each container: codec, timescale, duration, samples, and byte range and time of every keyframe.

    Sample tables and movie fragments are read. Null, empty or broken content has null tracks; all other columns stay.
    """

    @F.pandas_udf(f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in INSPECTED.split(', '))}>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = []
            for data in batch:
                try:
                    got = tracks_of(bytes(data)) if data is not None else []
                except BROKEN:
                    got = []
                found.append(
                    [
                        {
                            "codec": t.codec,
                            "timescale": t.timescale,
                            "duration": t.duration,
                            "n_samples": len(t.sizes),
                            "keyframes": [{"start": a, "size": b, "time": c} for a, b, c in zip(t.offsets[t.keys].tolist(), t.sizes[t.keys].tolist(), t.times[t.keys].tolist())],
                        }
                        for t in got
                    ]
                    or None
                )
            yield pd.Series(found, dtype=object)

    return files.withColumn(out, run.asNondeterministic()(F.col(content_col)))


def digest(text: str | None) -> tuple:
    """Store a text, read it back, and describe what was stored."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    payload = raw + bytes((-len(raw) % UNIT) if raw else UNIT)
    media = store(payload)
    track = tracks_of(media)[0]
    back = read_back(media, track)
    starts, sizes = track.offsets[track.keys].tolist(), track.sizes[track.keys].tolist()
    ranges = ",".join(f"{a}+{b}" for a, b in zip(starts, sizes))
    return (
        len(raw),
        len(back),
        hashlib.sha256(back).hexdigest(),
        zlib.crc32(back[-UNIT:]),
        len(media),
        hashlib.sha256(media).hexdigest(),
        f"{track.codec.strip()};{track.duration}/{track.timescale};keys={ranges}",
        track.codec.strip(),
        track.duration,
        track.timescale,
        [{"start": a, "size": b} for a, b in zip(starts, sizes)],
    )


DIGEST = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "timescale", "keyframes")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text stored as a container, read back through its tables and described, the byte range of every keyframe included.

    A null text counts as empty and stores one unit of zeros; equal texts have
    equal values; repeated rows each get theirs; an empty table gives no rows.
    Other columns are not read.
    """
    kinds = ("bigint", "bigint", "string", "bigint", "bigint", "string", "string", "string", "bigint", "bigint", "array<struct<start:bigint,size:bigint>>")

    @F.pandas_udf(", ".join(f"{c} {k}" for c, k in zip(DIGEST, kinds)))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([digest(t) for t in batch], columns=list(DIGEST))

    slim = docs.select(F.col(id_col).alias("doc_id"), run.asNondeterministic()(F.col(text_col).cast("string")).alias("_d"))
    return slim.select("doc_id", "_d.*")
