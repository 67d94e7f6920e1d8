"""Order-preserving packing by dynamic programming.

Documents are laid out by id in range partitions. Inside a partition the
token stream is cut into windows at document or sentence ends so that padding
plus penalties for cutting a document is least. A window from cut i to cut j
costs a constant less its length, so the best i for each j is the minimum of
a sliding range, kept in a monotone queue; windows whose length is a power of
two need no padding and are tried apart. Streams are solved in bounded
stretches; the last windows of a stretch are solved again with the next.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 4096
END_OF_DOCUMENT = 2
#: Costs in tokens: of any window, of a cut at a sentence end, and of a cut elsewhere in a sentence.
WINDOW_COST, SENTENCE_COST, FREE_COST = 24, 12, 96
#: Places within long sentences at which a cut is considered, and tokens solved at a time.
FREE_STEP, STRETCH = 256, 400_000
CACHE = 800_000
SENTENCE_ENDS = (".", "!", "?")
MARKS = b".,;:!?#$%&*|"


class Words:
    """Token ids of texts by way of bounded caches of words.

    White space of ASCII always separates tokens in this vocabulary's rules,
    so a text's ids are those of its words in turn. ASCII punctuation after a
    letter or digit is a token group of its own, and case is folded, so words
    new to the cache are encoded without their closing marks and in lower case.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}
        ends = [self.tokenizer.token_to_id(e + "</w>") for e in SENTENCE_ENDS]
        self.ends = np.array([e for e in ends if e is not None], dtype=np.uint32)

    @staticmethod
    def split(word: bytes) -> tuple[bytes, bytes]:
        """(stem in lower case, closing marks), or the whole word where this could change its ids."""
        stem = word.rstrip(MARKS)
        if stem.isalnum():  # ASCII letters and digits only
            return stem.lower(), word[len(stem) :]
        if len(stem) == len(word):  # no closing marks
            return word, b""
        text = stem.decode("utf-8", "replace")
        if text.isalnum():  # what the vocabulary makes of its last letter may end in a mark that joins the others
            folded = unicodedata.normalize("NFC", text).lower()
            if folded and unicodedata.category(folded[-1])[0] in "LN":
                return stem, word[len(stem) :]
        return word, b""

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not in the cache."""
        parts = [self.split(w) for w in words]
        new = list({x for part in parts for x in part if x and x not in self.stems})
        got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)
        stems = {w: np.array(x.ids, dtype="<u4").tobytes() for w, x in zip(new, got)}
        find = lambda x: b"" if not x else stems[x] if x in stems else self.stems[x]
        fresh = {w: find(a) + find(b) for w, (a, b) in zip(words, parts)}
        if len(self.stems) < CACHE:
            self.stems.update(stems)
        if len(self.known) < CACHE:
            self.known.update(fresh)
        return fresh

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of the whole text and the end of document."""
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        found = list(map(self.known.get, words))
        if None in found:
            fresh = self.learn(list({w for w, x in zip(words, found) if x is None}))
            found = [fresh[w] if x is None else x for w, x in zip(words, found)]
        found.append(END_OF_DOCUMENT.to_bytes(4, "little"))
        return np.frombuffer(b"".join(found), dtype="<u4")


@lru_cache(maxsize=2)
def words_of(file: str) -> Words:
    """One per worker process, so that its caches serve all its tasks."""
    return Words(file)


def best_cuts(at: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """Places (increasing, from at[0] to at[-1]) that cut the stream at least cost.

    `at` holds the allowed places, no two neighbours more than `length` apart;
    `cost` the penalty of a cut at each.
    """
    n = len(at)
    exact: list[list[int]] = [[] for _ in range(n)]
    size = 1
    while size <= length:
        i = np.searchsorted(at, at - size)
        for j in np.flatnonzero((at - size >= at[0]) & (at[i] == at - size)).tolist():
            exact[j].append(int(i[j]))
        size *= 2
    place, penalty = at.tolist(), (cost + WINDOW_COST).tolist()
    best, back = [0.0] * n, [0] * n
    queue = deque([(0.0 + place[0], 0)])  # (best + place, index), increasing in both
    for j in range(1, n):
        here = place[j]
        while here - place[queue[0][1]] > length:
            queue.popleft()
        least, i = queue[0]
        total = least + length - here
        for k in exact[j]:
            if best[k] < total:
                total, i = best[k], k
        total += penalty[j]
        best[j], back[j] = total, i
        key = total + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return [place[i] for i in reversed(cuts)]


def places(stream: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts of a stream and their penalties; long sentences get further places."""
    after = np.flatnonzero(np.isin(stream, sentence_ends)) + 1
    at = np.unique(np.concatenate(([0], after, doc_ends)))
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > FREE_STEP)
    free = [np.arange(at[i] + FREE_STEP, at[i + 1], FREE_STEP) for i in wide]
    at = np.unique(np.concatenate([at, *free]))
    cost = np.full(len(at), FREE_COST)
    cost[np.isin(at, after)] = SENTENCE_COST
    cost[np.isin(at, doc_ends)] = 0
    cost[0] = 0
    return at, cost


def power_tail(lo: int, hi: int, length: int = LENGTH) -> list[int]:
    """Further cuts in a last window: powers of two, largest first, where that costs less than its padding."""
    size = hi - lo
    parts = [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]
    if len(parts) < 2 or len(parts) * (WINDOW_COST + FREE_COST) >= length - size:
        return []
    return (lo + np.cumsum(parts)[:-1]).tolist()


class Packer:
    """Packs one stream of documents, in order, into sequences numbered from `first`."""

    def __init__(self, first: int, sentence_ends: np.ndarray):
        self.next, self.sentence_ends = first, sentence_ends
        self.docs: list[tuple] = []  # (id, tokens of the document, tokens of it already placed)
        self.ids: list[np.ndarray] = []  # what is left of each
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        """Take a document; gives pieces when a stretch is full."""
        self.docs.append((doc_id, len(ids), 0))
        self.ids.append(ids)
        self.size += len(ids)
        if self.size >= STRETCH:
            yield from self.solve(last=False)

    def solve(self, last: bool) -> Iterator[tuple]:
        """Pieces of what is held; unless it is the last, some windows stay for the next stretch."""
        if not self.docs:
            return
        stream = np.concatenate(self.ids)
        ends = np.cumsum([len(x) for x in self.ids])
        cuts = best_cuts(*places(stream, ends, self.sentence_ends))
        if last:
            cuts[-1:-1] = power_tail(cuts[-2], cuts[-1])
        else:
            cuts = cuts[: max(2, len(cuts) - 4)]
        cut = np.array(cuts)
        stop = int(cut[-1])
        starts = np.concatenate(([0], ends[:-1]))
        bounds = np.unique(np.concatenate((cut, ends[ends < stop])))
        doc = np.searchsorted(ends, bounds[:-1], side="right")
        window = np.searchsorted(cut, bounds[:-1], side="right") - 1
        for a, b, d, w in zip(bounds[:-1].tolist(), bounds[1:].tolist(), doc.tolist(), window.tolist()):
            name, tokens, placed = self.docs[d]
            yield name, placed + a - int(starts[d]), b - a, zlib.crc32(stream[a:b].tobytes()), tokens, self.next + w, a - int(cut[w])
        self.next += len(cut) - 1
        rest = int(np.searchsorted(ends, stop, side="right"))
        if rest < len(self.docs):
            name, tokens, placed = self.docs[rest]
            gone = max(0, stop - int(starts[rest]))
            self.docs = [(name, tokens, placed + gone), *self.docs[rest + 1 :]]
            self.ids = [self.ids[rest][gone:], *self.ids[rest + 1 :]]
        else:
            self.docs, self.ids = [], []
        self.size = sum(map(len, self.ids))


PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_file: Callable[[], str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most LENGTH tokens, in id order.

    `tokenizer_file` gives the vocabulary's path on the machine that calls it.
    A null text counts as empty and has the end-of-document id alone; a null id
    comes first; repeated rows are documents of their own; an empty table gives
    no rows; a sentence of any length is cut where it must be. Returns doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id (partition, then number)
    and offset. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    laid = slim.withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    laid = laid.drop("_tie").withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = packer = None
        for pdf in batches:
            if words is None:
                words = words_of(tokenizer_file())
                packer = Packer(int(pdf["_part"].iloc[0]) << 32 if len(pdf) else 0, words.ends)
            out: list[tuple] = []
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                out += packer.add(doc_id, words.ids(text))
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=list(PIECE))
                    out = []
            if out:
                yield pd.DataFrame(out, columns=list(PIECE))
        if packer is not None:
            out = list(packer.solve(last=True))
            if out:
                yield pd.DataFrame(out, columns=list(PIECE))

    return laid.mapInPandas(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def word_vocabulary() -> str:
    """Where the default vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
