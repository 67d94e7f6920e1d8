"""Fill-in-middle rearrangement on seekable compressed frames.

A text is stored as independent zstandard frames of a fixed number of code
points, one after the other, with the code points and bytes before the end of
each. A range of the text is read by decompressing the frames it meets alone.
Rearranging copies whole frames as they are and decompresses only those that a
cut falls in; digests stream the frames in order, so no text is rebuilt whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points in a frame, and the marks before the three parts.
FRAME = 16_384
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
STORED = "struct<data:binary,units:array<bigint>,ends:array<bigint>>"


class Writer:
    """Collects frames: texts are compressed, frames of another store copied."""

    def __init__(self, frame: int = FRAME, level: int = 3):
        self.frame, self.zip = frame, zstandard.ZstdCompressor(level=level)
        self.parts: list[bytes] = []
        self.units: list[int] = []
        self.ends: list[int] = []

    def _append(self, data: bytes, units: int) -> None:
        self.parts.append(data)
        self.units.append(units + (self.units[-1] if self.units else 0))
        self.ends.append(len(data) + (self.ends[-1] if self.ends else 0))

    def text(self, text: str) -> None:
        for lo in range(0, len(text), self.frame):
            piece = text[lo : lo + self.frame]
            self._append(self.zip.compress(piece.encode("utf-8", "surrogatepass")), len(piece))

    def copy(self, store: Store, lo: int, hi: int) -> None:
        """Code points lo to hi of another store; frames that lie inside stay compressed."""
        for k, a, b in store.spans(lo, hi):
            if b - a == store.length(k):
                self._append(store.raw(k), b - a)
            else:
                self.text(store.read(k)[a - store.start(k) : b - store.start(k)])

    def stored(self) -> tuple[bytes, list[int], list[int]]:
        return b"".join(self.parts), self.units, self.ends


class Store:
    """Reads frames; only those asked for are decompressed."""

    def __init__(self, data: bytes, units: Iterable[int], ends: Iterable[int]):
        self.data, self.units, self.ends = bytes(data), [int(x) for x in units], [int(x) for x in ends]
        self.size = self.units[-1] if self.units else 0
        self.unzip = zstandard.ZstdDecompressor()

    def start(self, k: int) -> int:
        return self.units[k - 1] if k else 0

    def length(self, k: int) -> int:
        return self.units[k] - self.start(k)

    def raw(self, k: int) -> bytes:
        return self.data[self.ends[k - 1] if k else 0 : self.ends[k]]

    def read(self, k: int) -> str:
        return self.unzip.decompress(self.raw(k)).decode("utf-8", "surrogatepass")

    def spans(self, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """(frame, from, to) of each frame that the range meets."""
        k = bisect_right(self.units, lo)
        while lo < hi and k < len(self.units):
            upto = min(hi, self.units[k])
            yield k, lo, upto
            lo, k = upto, k + 1

    def pieces(self, lo: int, hi: int) -> Iterator[str]:
        """The range's text, a frame at a time."""
        for k, a, b in self.spans(lo, hi):
            yield self.read(k)[a - self.start(k) : b - self.start(k)]

    def marks(self) -> dict[str, int]:
        """Where each mark first stands, found while streaming; a mark may lie across frames."""
        found: dict[str, int] = {}
        held, before = "", 0
        for piece in self.pieces(0, self.size):
            held += piece
            for mark in MARKS:
                if mark not in found and (at := held.find(mark)) >= 0:
                    found[mark] = before + at
            before += max(0, len(held) - 2)
            held = held[-2:]
        return found


def sha256(pieces: Iterable[str]) -> str:
    whole = hashlib.sha256()
    for piece in pieces:
        whole.update(piece.encode("utf-8", "surrogatepass"))
    return whole.hexdigest()


def rearranged(source: Store, form: str, first: int, second: int) -> Writer:
    """The output of a form: parts cut after `first` and `second` code points, each behind its mark; plain is the text."""
    out = Writer()
    ranges = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, source.size)}
    for mark in {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}.get(form, ()):
        out.text(mark)
        out.copy(source, *ranges[mark])
    if form not in ("psm", "spm"):
        out.copy(source, 0, source.size)
    return out


def restored(output: Store, form: str) -> Iterator[str]:
    """The text again, from the output and its form alone."""
    if form == "plain":
        yield from output.pieces(0, output.size)
        return
    at = output.marks()
    order = sorted(at, key=at.get)
    stop = dict(zip(order, [at[m] for m in order[1:]] + [output.size]))
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.pieces(at[mark] + len(mark), stop[mark])


def stored(text: Column, frame: int = FRAME) -> Column:
    """A text column as frames (null: none)."""

    @F.pandas_udf(STORED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                out = Writer(frame)
                out.text(text or "")
                rows.append(out.stored())
            yield pd.DataFrame(rows, columns=["data", "units", "ends"])

    return run.asNondeterministic()(text)


def rearrange(frames: Column, form: Column, first: Column, second: Column) -> Column:
    """Frames of each output, from the frames of its text."""

    @F.pandas_udf(STORED)
    def run(batches: Iterator[tuple[pd.DataFrame, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for frames, form, first, second in batches:
            rows = [
                rearranged(Store(data, units, ends), kind, int(a), int(b)).stored()
                for data, units, ends, kind, a, b in zip(frames["data"], frames["units"], frames["ends"], form, first, second)
            ]
            yield pd.DataFrame(rows, columns=["data", "units", "ends"])

    return run.asNondeterministic()(frames, form, first, second)


def digests(frames: Column, form: Column) -> Column:
    """sha256 of each output and of the text rebuilt from it, as struct<output, restored>."""

    @F.pandas_udf("struct<output:string,restored:string>")
    def run(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        for frames, form in batches:
            rows = []
            for data, units, ends, kind in zip(frames["data"], frames["units"], frames["ends"], form):
                out = Store(data, units, ends)
                rows.append((sha256(out.pieces(0, out.size)), sha256(restored(out, kind))))
            yield pd.DataFrame(rows, columns=["output", "restored"])

    return run.asNondeterministic()(frames, form)


def text_of(frames: Column) -> Column:
    """The whole text of each row's frames."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frames in batches:
            opened = (Store(*row) for row in zip(frames["data"], frames["units"], frames["ends"]))
            yield pd.Series(["".join(s.pieces(0, s.size)) for s in opened], dtype=object)

    return run(frames)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain_from: int = 90, spm_below: int = 20, frame: int = FRAME
) -> DataFrame:
    """Each text with a random middle moved to its end, as frames.

    Cuts and form come from the sha256 of `<seed>:<id>`: of its first four
    groups of eight hex digits the first two cut the text, the third leaves it
    plain from `plain_from` of 100 on, the fourth puts the suffix first below
    `spm_below` of 100. A text is plain too if it is empty or holds a mark.

    A null text counts as empty and a null id as empty text; repeated rows each
    get theirs, and equal ids the same numbers; a text of any length is read a
    frame at a time; an empty table gives no rows. Returns doc_id, n (code
    points), form, prefix_chars and middle_chars (null if plain) and output
    (frames of the result). Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(text).cast("long").alias("n"),
        text.rlike("<[PSM]>").alias("_marked"),
        *[F.conv(F.substring(seeded, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)],
        stored(text, frame).alias("_frames"),
    )
    plain = (F.col("n") == 0) | F.col("_marked") | (F.col("_h3") % 100 >= plain_from)
    one, two = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    formed = slim.select(
        "doc_id",
        "n",
        F.when(plain, "plain").when(F.col("_h4") % 100 < spm_below, "spm").otherwise("psm").alias("form"),
        F.least(one, two).alias("_first"),
        F.greatest(one, two).alias("_second"),
        "_frames",
    )
    cut = F.col("form") != "plain"
    return formed.select(
        "doc_id",
        "n",
        "form",
        F.when(cut, F.col("_first")).alias("prefix_chars"),
        F.when(cut, F.col("_second") - F.col("_first")).alias("middle_chars"),
        rearrange(F.col("_frames"), F.col("form"), F.col("_first"), F.col("_second")).alias("output"),
    )


def fill_in_middle_digests(docs: DataFrame, **options) -> DataFrame:
    """`fill_in_middle` with the sha256 of each output and of the text rebuilt from output and form, in place of the frames."""
    out = fill_in_middle(docs, **options)
    told = out.withColumn("_d", digests(F.col("output"), F.col("form")))
    return told.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("_d.output").alias("output_sha256"), F.col("_d.restored").alias("restored_sha256"))
