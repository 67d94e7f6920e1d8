"""Containers and packing: exact round trips and brute force."""

import hashlib
import itertools
import struct
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidex.llm import media, packing
from evidex.llm import queries as q


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=20_000))
def test_container_round_trip(raw):
    payload = raw + bytes(-len(raw) % media.UNIT)
    data = media.store(payload)
    (track,) = media.tracks_of(data)
    assert media.read_back(data, track) == payload
    assert track.codec == "raw " and track.duration == len(payload)
    for k in track.keys:
        lo = int(track.offsets[k])
        assert data[lo : lo + media.UNIT] == payload[k * media.UNIT : (k + 1) * media.UNIT]
    assert list(track.keys) == list(range(0, len(payload) // media.UNIT, media.KEY_EVERY))


def test_broken_containers(spark):
    good = media.store(bytes(640))
    rows = [(1, good), (2, good[:100]), (3, b""), (4, None), (5, b"\0\0\0\1mdat"), (6, struct.pack(">I4s", 0, b"free") + b"x")]
    got = {r.i: r.tracks for r in media.inspect(spark.createDataFrame(rows, "i int, content binary")).collect()}
    assert got[1][0].n_samples == 10 and got[1][0].keyframes[0].size == 64
    assert all(got[i] is None for i in (2, 3, 4, 5, 6))


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def u32(*x):
    return struct.pack(f">{len(x)}I", *x)


def movie(stbl, extra=b"", scale=1000):
    """A one-track movie around the sample tables `stbl`, written out by hand."""
    mdia = box(b"mdia", box(b"mdhd", u32(0, 0, 0, scale, 0), bytes(4)), box(b"minf", box(b"stbl", stbl)))
    return box(b"moov", box(b"trak", box(b"tkhd", u32(0, 0, 0, 7, 0, 0), bytes(60)), mdia), extra)


STSD = box(b"stsd", u32(0, 1), box(b"avc1", bytes(8)))


def test_sample_tables_by_hand():
    stbl = STSD + box(b"stts", u32(0, 2, 2, 100, 3, 50)) + box(b"ctts", u32(0, 1, 5, 10)) + box(b"stss", u32(0, 2, 1, 4))
    stbl += box(b"stsc", u32(0, 2, 1, 2, 1, 2, 3, 1)) + box(b"stsz", u32(0, 0, 5, 10, 20, 30, 40, 50)) + box(b"stco", u32(0, 2, 1000, 5000))
    (t,) = media.tracks_of(movie(stbl + bytes(4)))
    assert (t.codec, t.timescale, t.duration) == ("avc1", 1000, 350)
    assert t.offsets.tolist() == [1000, 1010, 5000, 5030, 5070] and t.sizes.tolist() == [10, 20, 30, 40, 50]
    assert t.keys.tolist() == [0, 3] and t.times.tolist() == [10, 110, 210, 260, 310]


def test_compact_sizes_and_user_data():
    stbl = STSD + box(b"stsc", u32(0, 1, 1, 3, 1)) + box(b"stz2", u32(0, 4, 3), bytes([0x35, 0x70])) + box(b"stco", u32(0, 1, 100))
    (t,) = media.tracks_of(movie(stbl, box(b"udta", box(b"name", b"x"), bytes(4))))
    assert t.sizes.tolist() == [3, 5, 7] and t.offsets.tolist() == [100, 103, 108]


def test_movie_fragments():
    head = movie(STSD, box(b"mvex", box(b"trex", u32(0, 7, 1, 40, 8, 0x10000))))
    run = box(b"trun", u32(0x205, 3, 200, 0, 11, 12, 13))
    moof = box(b"moof", box(b"mfhd", u32(0, 1)), box(b"traf", box(b"tfhd", u32(0x20000, 7)), box(b"tfdt", u32(0, 500)), run, box(b"trun", u32(0, 2))))
    (t,) = media.tracks_of(head + moof + box(b"mdat", bytes(300)))
    at = len(head) + 200
    assert t.offsets.tolist() == [at, at + 11, at + 23, at + 36, at + 44] and t.sizes.tolist() == [11, 12, 13, 8, 8]
    assert t.keys.tolist() == [0] and t.times.tolist() == [500, 540, 580, 620, 660] and t.duration == 700


def test_huge_counts_are_refused():
    for stsz in (u32(0, 1, 0xFFFFFFFF), u32(0, 0, 0xFFFFFFFF)):
        with pytest.raises(media.BROKEN):
            media.tracks_of(movie(STSD + box(b"stsc", u32(0, 1, 1, 0xFFFFFFFF, 1)) + box(b"stsz", stsz) + box(b"stco", u32(0, 1, 8))))
    with pytest.raises(media.BROKEN):
        media.tracks_of(movie(STSD) + box(b"moof", box(b"traf", box(b"tfhd", u32(0, 7)), box(b"trun", u32(0, 0xFFFFFFFF)))))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 255)), min_size=1, max_size=6), st.integers(0, 4000))
def test_random_edits_decode_or_are_refused(edits, cut_at):
    good = bytearray(media.store(bytes(range(256)) * 10))
    for place, value in edits:
        good[place % len(good)] = value
    try:
        for t in media.tracks_of(bytes(good[: len(good) - cut_at] if cut_at < 1000 else good)):
            assert len(t.offsets) == len(t.sizes) == len(t.times) and (t.offsets >= 0).all()
    except media.BROKEN:
        pass


def test_op7_query(spark, sf):
    got = q.op7_media(spark, sf).toPandas().set_index("doc_id")
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        raw = r.text.encode()
        payload = raw + bytes((-len(raw) % 64) if raw else 64)
        x = got.loc[r.doc_id]
        assert (x.n_bytes, x.payload_bytes) == (len(raw), len(payload))
        assert x.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert x.tail_crc32 == zlib.crc32(payload[-64:])
        # the container: the payload is its last box, so sample n of 64 bytes lies at a known place
        head = x.media_bytes - len(payload)
        want = [(head + k * 64, 64) for k in range(0, len(payload) // 64, 16)]
        assert [(k["start"], k["size"]) for k in x.keyframes] == want
        assert x.feature == f"raw;{len(payload)}/8000;keys=" + ",".join(f"{a}+{b}" for a, b in want)


def test_dynamic_program_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        at = np.concatenate(([0], np.cumsum(rng.integers(1, 9, rng.integers(2, 9)))))
        cost = rng.integers(0, 30, len(at))
        length = 16

        def price(cuts):
            total = 0
            for a, b in itertools.pairwise(cuts):
                size = at[b] - at[a]
                if size > length:
                    return None
                total += (0 if size & (size - 1) == 0 else length - size) + packing.WINDOW_COST + cost[b]
            return total

        inner = range(1, len(at) - 1)
        every = [price([0, *c, len(at) - 1]) for k in range(len(at)) for c in itertools.combinations(inner, k)]
        got = packing.best_cuts(at, cost, length)
        index = {int(v): i for i, v in enumerate(at)}
        assert price([index[x] for x in got]) == min(p for p in every if p is not None)


def test_words_give_the_tokenizer_s_ids(spark, sf):
    words = packing.Words(packing.word_vocabulary())
    odd = ["", "it's, they'll! A<|endoftext|> b", "naïve—test…", "x́ ́b ΑΣ. Σ İx", "tab\tnew\nline\x0bfeed", "a b c", "abc123,,, 4.5%"]
    for text in odd + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]:
        want = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert words.ids(text).tolist() == [*want, 2]


def test_every_letter_and_digit_before_a_mark_has_the_tokenizer_s_ids():
    words = packing.Words(packing.word_vocabulary())
    marks = [".", ":", "?!", "#$"]
    letters = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum() and unicodedata.category(chr(c)) not in ("Lo", "Cn")]
    letters += [chr(c) for c in [*range(0x900, 0x1200), *range(0xF00, 0x1000), *range(0xF900, 0xFC00), *range(0x3040, 0x3100), *range(0x1D400, 0x1D800)] if chr(c).isalnum()]
    odd = [f"a{c}{marks[i % 4]}" for i, c in enumerate(letters)] + ["İ:", "दिल्ली क़:", "שׁ.", "ড়?"]
    for lo in range(0, len(odd), 512):
        text = " ".join(odd[lo : lo + 512])
        assert words.ids(text).tolist() == [*words.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_op8_every_id_once_with_little_padding(spark):
    sf = "/root/testdata/sf0.01"
    tokenizer = packing.Words(packing.word_vocabulary()).tokenizer
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = q.op8_packing(spark, sf).toPandas()
    for i, part in got.sort_values("start").groupby("doc_id"):
        assert part.start.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() == len(ids[i])
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[i][r.start : r.start + r.length].astype("<u4").tobytes())
            assert r.doc_tokens == len(ids[i])
    assert set(got.doc_id) == set(ids)
    padding = total = 0
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]]
        size = int(part.length.sum())
        assert size <= 4096
        padding += 0 if size & (size - 1) == 0 else 4096 - size
        total += size
    assert padding < 0.02 * total


def test_long_sentence_is_cut():
    packer = packing.Packer(0, np.array([9], dtype=np.uint32))
    pieces = [*packer.add("a", np.full(30_000, 5, dtype=np.uint32)), *packer.solve(True)]
    assert sum(p[2] for p in pieces) == 30_000 and max(p[2] for p in pieces) <= 4096


@pytest.mark.parametrize("size", [1, 100, 4095, 4096])
def test_power_tail(size):
    cuts = [0, *packing.power_tail(0, size), size]
    parts = np.diff(cuts)
    assert parts.sum() == size and (len(parts) == 1 or all(p & (p - 1) == 0 for p in parts))
