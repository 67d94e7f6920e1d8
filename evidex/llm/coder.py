"""Context mixing over the running words of texts (numpy).

A text is a run of words and one end. The next word is told by binary
decisions: first, where the word before was seen earlier in the text, whether
the word that followed it then follows again; otherwise the path of a code
tree over the commonest words, one leaf of which stands for all others. Each
decision on a path has three bit predictors: its own node, and two hashed
contexts that reach back across words - the ending of the word before with the
last non-ASCII character so far, and the word before itself. Their logits are
mixed with weights that a gate picks by how often the contexts were seen, and
the mix is refined by an adaptive table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd

#: Slots of each hashed context's table, as a power of two.
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
HASHED = 2
#: Counts that part the confidence levels of a context.
SURE = np.array([0.5, 2.5, 8.5, 32.5, 128.5])
LEVELS_SURE = len(SURE) + 1
GATES = LEVELS_SURE**HASHED
INPUTS = HASHED + 2
#: Cells of the refinement table: by level of the decision in its path, and by the mix.
DEPTHS, CELLS = 16, 33
LIMIT = 10.0
#: Contexts of the decision to repeat: how long repeats have lasted, and whether the two words before agree.
REPEATS = 8
STEP = 0.1
#: Decisions that teach the mixer at a time, and decisions added to the counts at a time.
LESSON, ADDED = 60_000, 4_000_000
EMPTY = np.zeros(0, dtype=np.int64)


@dataclass
class Tree:
    """Code tree over words: the path of leaf i lies at start[i] : start[i] + length[i] of the arrays below it; the last leaf is any other word.

    A path has each node's hash, the bit taken, the first cell of its level in
    the refinement table, and the logit that the words' counts give.
    """

    places: dict[bytes, int]
    start: np.ndarray
    length: np.ndarray
    hashes: np.ndarray
    bits: np.ndarray
    cells: np.ndarray
    base: np.ndarray


def tree_of(words: list[bytes], counts: list[float], others: float) -> Tree:
    """Huffman tree of the words and one leaf of weight `others`."""
    weight = [max(float(c), 1.0) for c in counts] + [max(float(others), 1.0)]
    n = len(weight)
    heap = [(w, i) for i, w in enumerate(weight)]
    heapq.heapify(heap)
    parent, side, total = [0] * (2 * n), [0] * (2 * n), weight + [0.0] * n
    ones = [0.0] * n
    new = n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], parent[j], side[j], total[new] = new, new, 1, a + b
        ones[new - n] = b
        heapq.heappush(heap, (a + b, new))
        new += 1
    root, nodes, bits, length = new - 1, [], [], []
    for leaf in range(n):
        path, at = [], leaf
        while at != root:
            path.append((parent[at] - n, side[at]))
            at = parent[at]
        length.append(len(path))
        nodes += [p for p, _ in reversed(path)]
        bits += [s for _, s in reversed(path)]
    length = np.array(length, dtype=np.int64)
    inner = np.array(total[n : max(new, n + 1)])
    one = np.array(ones[: len(inner)])
    base = np.log((one + 0.5) / (inner - one + 0.5)).astype(np.float32)
    start = np.cumsum(length) - length
    depth = np.arange(int(length.sum())) - np.repeat(start, length)
    nodes = np.array(nodes, dtype=np.int64)
    hashes = nodes.astype(np.uint32) * np.uint32(0xC2B2AE35)
    return Tree({w: i for i, w in enumerate(words)}, start, length, hashes, np.array(bits, dtype=np.uint8), np.minimum(depth, DEPTHS - 1) * CELLS, base[nodes])


def _stir(x: np.ndarray) -> np.ndarray:
    """Mix 32-bit values, in place."""
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return x


@dataclass
class Stream:
    """The running words of some texts: distinct words, their number at each place, texts' first places, and what came before."""

    distinct: list[bytes]
    at: np.ndarray
    text: np.ndarray
    leaf: np.ndarray
    ending: np.ndarray
    before: np.ndarray
    candidate: np.ndarray
    repeats: np.ndarray
    context: np.ndarray


def stream_of(words: list[list[bytes]], tree: Tree) -> Stream:
    """Lay out the texts' words, each text closed by its end (the empty word)."""
    flat = [w for text in words for w in (*text, b"")]
    size = np.array([len(text) + 1 for text in words], dtype=np.int64)
    at, distinct = pd.factorize(np.array(flat, dtype=object)) if flat else (EMPTY, [])
    distinct, n = list(distinct), len(flat)
    other = len(tree.places)
    leaf = np.fromiter(map(tree.places.get, distinct, repeat(other)), dtype=np.int64, count=len(distinct))
    # endings and last non-ASCII characters of the distinct words
    sizes = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct)) + 2
    raw = np.frombuffer(b"\0\0" + b"\0\0".join(distinct) if distinct else b"", dtype=np.uint8)
    end = np.cumsum(sizes)
    pair = lambda i: raw[i].astype(np.uint32) | raw[np.maximum(i - 1, 0)].astype(np.uint32) << np.uint32(8)
    ending = pair(end - 1)
    high = np.where(raw >= 128, np.arange(len(raw)), -1)
    last = np.maximum.reduceat(high, end - sizes) if len(raw) else EMPTY
    mark = np.where(last >= 0, pair(np.maximum(last, 0)), 0).astype(np.uint32) if len(raw) else np.zeros(0, np.uint32)

    text = np.repeat(np.arange(len(words)), size)
    first = np.repeat(np.cumsum(size) - size, size)
    place = np.arange(n)
    begins = place == first
    before = np.where(begins, 0, np.roll(at, 1) + 1) if n else EMPTY  # zero: the text begins
    seen = np.maximum.accumulate(np.where(mark[at] > 0, place, -1)) if n else EMPTY
    seen = np.where(begins, -1, np.roll(seen, 1)) if n else EMPTY
    marks = np.where(seen >= first, mark[at[np.maximum(seen, 0)]], 0).astype(np.uint32) if n else np.zeros(0, np.uint32)
    endings = np.where(begins, 1, ending[np.roll(at, 1)]).astype(np.uint32) if n else np.zeros(0, np.uint32)
    previous = np.where(begins, np.uint32(0xFFFFFFFF), np.where(leaf[np.roll(at, 1)] == other, endings + np.uint32(1 << 24), leaf[np.roll(at, 1)].astype(np.uint32))) if n else np.zeros(0, np.uint32)
    # the latest place in the same text with the same word before it
    key = text * (len(distinct) + 1) + before
    order = np.argsort(key, kind="stable")
    same = np.zeros(n, dtype=bool)
    same[1:] = key[order][1:] == key[order][:-1]
    candidate = np.full(n, -1)
    candidate[order[same]] = order[np.flatnonzero(same) - 1]
    candidate[begins] = -1
    there = candidate >= 0
    hit = there & (at[np.maximum(candidate, 0)] == at) if n else np.zeros(0, bool)
    # repeats in a row before this place, within the text
    missed = np.maximum.accumulate(np.where(hit, -1, place)) if n else EMPTY
    run = np.where(begins, 0, np.roll(place - missed, 1)) if n else EMPTY
    run = np.minimum(run, place - first)
    deep = there & (candidate > first + 1) & (before[np.maximum(candidate - 1, 0)] == before[np.maximum(place - 1, 0)]) if n else hit
    context = np.minimum(run, REPEATS // 2 - 1) * 2 + deep
    return Stream(distinct, at, text, leaf, _stir(endings ^ (marks << np.uint32(16)) ^ np.uint32(0x5BD1E995)), _stir(previous.astype(np.uint32)), there, hit, context)


def decisions(s: Stream, tree: Tree, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(place, path index, bit, slots of each hashed context) of the decisions of the words at the places `pick`."""
    leaf = s.leaf[s.at[pick]]
    size = tree.length[leaf]
    index = np.arange(int(size.sum())) + np.repeat(tree.start[leaf] - (np.cumsum(size) - size), size)
    node = tree.hashes.take(index)
    slots = []
    for hashed in (s.ending, s.before):
        x = np.repeat(hashed[pick], size)
        x += node
        slots.append((_stir(x) >> np.uint32(32 - SLOT_BITS)).astype(np.int64))
    return np.repeat(pick, size), index, tree.bits.take(index), slots


def coded(s: Stream) -> np.ndarray:
    """Places whose word is told by its path."""
    return np.flatnonzero(~s.repeats)


def decided(s: Stream, tree: Tree, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(path index, bit, slots) of the stream's decisions, about `budget` at a time."""
    pick = coded(s)
    for part in np.array_split(pick, max(1, len(pick) * 12 // budget)):
        _, index, bit, slots = decisions(s, tree, part)
        if len(bit):
            yield index, bit, slots


def settled(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits and confidence of every slot (HASHED, SLOTS) by its counts of both bits (HASHED, SLOTS, 2)."""
    zeros, ones = n[..., 0], n[..., 1]
    logits = np.clip(np.log((ones + np.float32(0.3)) / (zeros + np.float32(0.3))), -LIMIT, LIMIT).astype(np.float32)
    total = zeros + ones
    return logits, sum((total >= least).view(np.uint8) for least in SURE)


def mixed(tree: Tree, index: np.ndarray, slots: list[np.ndarray], logits: np.ndarray, sure: np.ndarray, weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(inputs but the constant one, gate, mix) of each decision; weights are (INPUTS, GATES)."""
    x = [tree.base.take(index), *(c.take(at) for c, at in zip(logits, slots))]
    gate = sure[0].take(slots[0]) * np.uint8(LEVELS_SURE) + sure[1].take(slots[1])
    z = np.float32(0.3) * weights[-1].take(gate)
    for each, w in zip(x, weights):
        z += each * w.take(gate)
    return x, gate, z


class Counts:
    """What is learnt from texts: counts of both bits in every slot, of repeats, the gated weights and the refinement table."""

    def __init__(self) -> None:
        self.slots = np.zeros((HASHED, SLOTS * 2), dtype=np.float32)
        self.repeat = np.zeros((2, REPEATS))
        start = np.zeros((GATES, INPUTS))
        start[:, 0] = 1.0
        for g in range(GATES):
            for c, sure in enumerate((g // LEVELS_SURE, g % LEVELS_SURE)):
                start[g, 1 + c] = 0.15 * sure / (LEVELS_SURE - 1)
        self.weights, self.steep, self.taught = start, np.full((GATES, INPUTS), 1e-3), np.zeros(GATES)
        self.refine = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, CELLS))), (DEPTHS, 1))
        self.refined = np.zeros((DEPTHS, CELLS))

    def teach(self, s: Stream, tree: Tree) -> None:
        """One online pass over the stream: predict from what was counted so far, then move weights and refinement."""
        known = settled(self.slots.reshape(HASHED, SLOTS, 2))
        for index, bit, slots in decided(s, tree, LESSON):
            self._lesson(known, tree, index, bit, slots)

    def count(self, s: Stream, tree: Tree) -> None:
        """Add the stream's decisions."""
        self._repeats(s)
        for _, bit, slots in decided(s, tree, ADDED):
            self._add([(bit, slots)])

    def read(self, s: Stream, tree: Tree) -> None:
        """Teach, then count: the decisions are laid out once, and all are told from what was counted before the stream."""
        self._repeats(s)
        known, held, n = settled(self.slots.reshape(HASHED, SLOTS, 2)), [], 0
        for index, bit, slots in decided(s, tree, LESSON):
            self._lesson(known, tree, index, bit, slots)
            held.append((bit, slots))
            n += len(bit)
            if n >= ADDED:
                self._add(held)
                held, n = [], 0
        self._add(held)

    def _repeats(self, s: Stream) -> None:
        self.repeat += np.stack([np.bincount(s.context[s.candidate & (s.repeats == hit)], minlength=REPEATS) for hit in (False, True)])

    def _add(self, held: list[tuple[np.ndarray, list[np.ndarray]]]) -> None:
        for c in range(HASHED if held else 0):
            self.slots[c] += np.bincount(np.concatenate([2 * slots[c] + bit for bit, slots in held]), minlength=2 * SLOTS)

    def _lesson(self, known: tuple[np.ndarray, np.ndarray], tree: Tree, index: np.ndarray, bit: np.ndarray, slots: list[np.ndarray]) -> None:
        x, gate, z = mixed(tree, index, slots, *known, np.ascontiguousarray(self.weights.T, dtype=np.float32))
        gate = gate.astype(np.int64)
        err = bit - 1 / (1 + np.exp(-np.clip(z, -LIMIT, LIMIT)))
        n = np.bincount(gate, minlength=GATES)
        mass = np.maximum(n, 1e-9)
        for i in range(INPUTS):
            slope = np.bincount(gate, weights=err * x[i] if i < len(x) else 0.3 * err, minlength=GATES) / mass
            self.steep[:, i] += slope**2
            self.weights[:, i] += STEP * slope / np.sqrt(self.steep[:, i])
        self.taught += n
        low, share = cells(z)
        low += tree.cells.take(index)
        at, size = 2 * low + bit, 2 * DEPTHS * CELLS
        above = np.bincount(at, weights=share, minlength=size)
        below = np.bincount(at, minlength=size) - above
        below[2:] += above[:-2]  # the cell above is the next one; the last cell of a level is never `low`
        zeros, hit = below.reshape(DEPTHS, CELLS, 2).transpose(2, 0, 1)
        mass = zeros + hit
        rate = np.where(mass > 0, np.maximum(0.02, 1 / (self.refined + 32)), 0) * np.minimum(mass, 1.0)
        self.refine += rate * (np.where(mass > 0, hit / np.maximum(mass, 1e-9), self.refine) - self.refine)
        self.refined += mass

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """(sums over parts, averages over parts weighted by `taught`) as flat arrays that add up between tasks."""
        trust = self.taught[:, None] + 1e-3
        seen = self.refined + 1e-3
        return self.slots.ravel(), np.concatenate([self.repeat.ravel(), (self.weights * trust).ravel(), trust.ravel(), (self.refine * seen).ravel(), seen.ravel()])


def cells(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of the refinement table below each logit, and the share of the one above."""
    spot = z * ((CELLS - 1) / 16)
    spot += (CELLS - 1) / 2
    np.minimum(spot, CELLS - 1.001, out=spot)
    np.maximum(spot, 0, out=spot)
    low = spot.astype(np.int64)
    spot -= low.astype(spot.dtype)
    return low, spot


@dataclass
class Model:
    """For scoring: logits and confidence of every slot, the mixer, and the chance of a repeat."""

    logits: np.ndarray
    sure: np.ndarray
    weights: np.ndarray
    refine: np.ndarray
    repeat: np.ndarray

    @classmethod
    def of(cls, slots: np.ndarray, rest: np.ndarray) -> Model:
        """From the summed parts of all tasks."""
        sizes = [2 * REPEATS, GATES * INPUTS, GATES, DEPTHS * CELLS, DEPTHS * CELLS]
        repeat, weights, trust, refine, seen = np.split(rest, np.cumsum(sizes)[:-1])
        n = slots.reshape(HASHED, SLOTS, 2)
        repeat = repeat.reshape(2, REPEATS)
        return cls(
            *settled(n),
            np.ascontiguousarray((weights.reshape(GATES, INPUTS) / trust[:, None]).T.astype(np.float32)),
            np.clip(refine / seen, 1e-6, 1 - 1e-6).reshape(DEPTHS, CELLS).astype(np.float32),
            (repeat[1] + 0.4) / (repeat.sum(axis=0) + 0.8),
        )

    def bit_probability(self, tree: Tree, index: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
        """Chance of a one at each decision."""
        _, _, z = mixed(tree, index, slots, self.logits, self.sure, self.weights)
        low, share = cells(z)
        low += tree.cells.take(index)
        flat = self.refine.ravel()
        refined = flat.take(low)
        refined += share * (flat.take(low + 1) - refined)
        np.negative(z, out=z)
        refined += 1 / (1 + np.exp(z, out=z))
        refined *= np.float32(0.5)
        return refined

    def log10(self, s: Stream, tree: Tree, spelt: np.ndarray, n_texts: int, budget: int = 60_000) -> np.ndarray:
        """log10 probability of each text; `spelt` has that of spelling each distinct word where the tree does not name it."""
        p = self.repeat[s.context]
        told = np.where(s.candidate, np.log10(np.where(s.repeats, p, 1 - p)), 0.0)
        pick = coded(s)
        told[pick] += np.where(s.leaf[s.at[pick]] == len(tree.places), spelt[s.at[pick]], 0.0)
        out = np.bincount(s.text, weights=told, minlength=n_texts)
        for part in np.array_split(pick, max(1, len(pick) * 12 // budget)):
            place, index, bit, slots = decisions(s, tree, part)
            q = self.bit_probability(tree, index, slots)
            out += np.bincount(s.text[place], weights=np.log(np.abs(q - (1 - bit))), minlength=n_texts) / np.log(10)
        return out
