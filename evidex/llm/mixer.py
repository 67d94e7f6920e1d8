"""Byte model of words outside the code tree: hashed-context bit predictors, gated mixing, adaptive refinement (numpy).

A word is spelt as its bytes and a closing space, each byte as eight binary
decisions. For every decision several contexts (two and four bytes before, the
whole prefix) address hashed counters of zeros and ones; their logits are
combined with weights chosen by a gate, and the mix is refined by an adaptive
table of the byte before and the mix itself. Each decision has a probability
below one, so the words' probabilities sum to one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Slots of each context's table, as powers of two: 2 and 4 bytes before, prefix.
SLOT_BITS = (18, 20, 21)
#: Weight of the prefix at first, by how often it was seen; the rest goes to the other contexts, longer ones first.
TRUST, SHARES = (0.0, 0.3, 0.6, 0.9, 1.0), np.array([0.4, 0.6])
STARTS = np.concatenate(([0], np.cumsum([1 << b for b in SLOT_BITS])))
SLOTS = int(STARTS[-1])
CONTEXTS = len(SLOT_BITS)
CHUNK = 1 << 15
INPUTS = CONTEXTS + 1
CONFIDENCE = 5
GATES = 8 * CONFIDENCE
LEVELS = 33
LIMIT = 12.0
TERMINATOR = 32
STEP_SIZE = 0.1
#: Bytes of words whose decisions are counted at a time, about; more than that are learnt from bit by bit.
LAID = 1 << 19
#: Counts that part the confidence levels of a prefix.
SURE = (0.5, 1.5, 4.5, 32.5)
ODD = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0x100000001B3)


def decisions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(byte, context hashes (CONTEXTS, n), byte before, word) for every byte of every word and its end."""
    sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
    flat = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8) if words else np.zeros(0, np.uint8)
    n = len(flat)
    owner = np.repeat(np.arange(len(words)), sizes)
    start = (np.cumsum(sizes) - sizes)[owner]
    place = np.arange(n) - start
    wide = flat.astype(np.uint64)
    before = []
    for k in range(1, 5):
        b = np.zeros(n, dtype=np.uint64)
        b[k:] = wide[:-k] + np.uint64(1)
        b[place < k] = 0
        before.append(b)
    # the hash of a prefix is a sum of bytes times powers, taken relative to the word's start
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(sizes.max(initial=1)) + 1, STEP, dtype=np.uint64))
        run = np.cumsum((wide + np.uint64(1)) * power[place], dtype=np.uint64)
        before_all = np.concatenate((np.zeros(1, np.uint64), run))
        prefix = before_all[np.arange(n)] - before_all[start]
        joined = np.zeros((5, n), dtype=np.uint64)
        for k, b in enumerate(before):
            joined[k + 1] = joined[k] * np.uint64(257) + b
        context = np.stack([joined[2], joined[4], prefix])
    return flat, context, before[0].astype(np.int64), owner


def slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """(CONTEXTS, n) table slots of a decision; node is 1 followed by the bits already known."""
    out = np.empty(context.shape, dtype=np.int64)
    with np.errstate(over="ignore"):
        for c, bits in enumerate(SLOT_BITS):
            h = (context[c] * np.uint64(256) + node.astype(np.uint64) + np.uint64(1)) * ODD
            h ^= h >> np.uint64(29)
            h *= ODD
            out[c] = STARTS[c] + (h >> np.uint64(64 - bits)).astype(np.int64)
    return out


def laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bits (8, n), slots (CONTEXTS, 8, n), byte before, word) of the words' decisions, the eight of a byte apart."""
    flat, context, prev, owner = decisions(words)
    bits, at = np.empty((8, len(flat)), dtype=np.uint8), np.empty((CONTEXTS, 8, len(flat)), dtype=np.int32)
    node = np.ones(len(flat), dtype=np.int64)
    for k in range(8):
        at[:, k] = slots(context, node)
        bits[k] = (flat >> (7 - k)) & 1
        node = node * 2 + bits[k]
    return bits, at, prev, owner


def count_laid(table: np.ndarray, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
    """Add decisions (bits, slots, weight of each byte) to a (2, SLOTS) table of zeros and ones; about LAID bytes at a time."""
    parts, n = [], 0
    for i, (bits, at, w) in enumerate(held):
        for k in [slice(0, 8)] if len(w) <= LAID else [slice(k, k + 1) for k in range(8)]:
            parts.append((bits[k], at[:, k], w))
            n += bits[k].size
            if n < 8 * LAID and (i + 1 < len(held) or k.stop < 8):
                continue
            weight = np.concatenate([np.tile(w, len(b)) for b, _, w in parts])
            for c in range(CONTEXTS):
                lo, hi = STARTS[c], STARTS[c + 1]
                cell = np.concatenate([((x[c].astype(np.int64) - lo) * 2 + b).ravel() for b, x, _ in parts])
                table[:, lo:hi] += np.bincount(cell, weights=weight, minlength=2 * (hi - lo)).reshape(-1, 2).T
            parts, n = [], 0


def count_into(table: np.ndarray, words: list[bytes], weight: np.ndarray) -> None:
    """Add the words' decisions, `weight` times each, to a (2, SLOTS) table of zeros and ones."""
    bits, at, _, owner = laid_out(words)
    count_laid(table, [(bits, at, weight[owner])])


def chunks(flat: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(number, compressed content) of the chunks of a flat array that are not all zero, as 32-bit numbers."""
    for i in range(0, len(flat), CHUNK):
        part = flat[i : i + CHUNK].astype(np.float32)
        if part.any():
            yield i // CHUNK, zlib.compress(part.tobytes(), 1)


def added(parts: list[bytes]) -> bytes:
    """The sum of chunk contents, as a chunk content."""
    total = sum(np.frombuffer(zlib.decompress(x), dtype=np.float32).astype(np.float64) for x in parts)
    return zlib.compress(total.astype(np.float32).tobytes(), 1)


def from_chunks(parts: list[tuple[int, bytes]], size: int) -> np.ndarray:
    """The flat array of its chunks."""
    flat = np.zeros(size, dtype=np.float32)
    for i, raw in parts:
        x = np.frombuffer(zlib.decompress(raw), dtype=np.float32)
        flat[i * CHUNK : i * CHUNK + len(x)] = x
    return flat


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -LIMIT, LIMIT)))


def inputs(table: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits (n, INPUTS) and the gate's confidence."""
    zeros, ones = table[0].take(at), table[1].take(at)
    x = np.empty((at.shape[1], INPUTS))
    x[:, :CONTEXTS] = (np.log((ones + 0.05) / (zeros + 0.05))).T
    x[:, CONTEXTS] = 0.3
    return np.clip(x, -LIMIT, LIMIT), np.digitize(zeros[-1] + ones[-1], SURE)


@dataclass
class Mixer:
    """Counters, the gated weights, the refinement table, and the squared slopes so far (when settled: confidence of the prefix's slots)."""

    table: np.ndarray
    weights: np.ndarray
    refine: np.ndarray
    steepness: np.ndarray

    @classmethod
    def fresh(cls, table: np.ndarray) -> Mixer:
        start = np.zeros((8, CONFIDENCE, INPUTS))
        for sure, trust in enumerate(TRUST):
            start[:, sure, :CONTEXTS] = np.append((1 - trust) * SHARES, trust)
        grid = squash(np.linspace(-8, 8, LEVELS))
        return cls(table.astype(np.float32), start.reshape(GATES, INPUTS), np.tile(grid, (257, 1)), np.full((GATES, INPUTS), 1e-4))

    def _refined(self, z: np.ndarray, prev: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spot = (np.clip(z, -7.999, 7.999) + 8) * (LEVELS - 1) / 16
        low = spot.astype(np.int64)
        part = spot - low
        return self.refine[prev, low] * (1 - part) + self.refine[prev, low + 1] * part, low, part

    def learn(self, words: list[bytes], weight: np.ndarray, step: float = STEP_SIZE) -> float:
        """One online step: predict words not counted yet, then move weights and refinement.

        Returns bits per byte before the step.
        """
        bits, at, prev, owner = laid_out(words)
        return self._learn(bits, at, prev, (weight / weight.sum())[owner], len(words), step)

    def read(self, words: list[bytes], weight: np.ndarray, lesson: int, step: float = STEP_SIZE) -> None:
        """Learn from `lesson` words at a time, then count all: decisions are laid out once."""
        held = []
        for lo in range(0, len(words), lesson):
            part, n = words[lo : lo + lesson], weight[lo : lo + lesson]
            bits, at, prev, owner = laid_out(part)
            self._learn(bits, at, prev, (n / n.sum())[owner], len(part), step)
            held.append((bits, at, n[owner]))
        count_laid(self.table, held)

    def _learn(self, bits: np.ndarray, at: np.ndarray, prev: np.ndarray, w: np.ndarray, n_words: int, step: float) -> float:
        """The step for decisions laid out. Gates of different bits are apart, so all bits go at once, or where there are many one by one."""
        levels = [slice(0, 8)] if len(w) <= LAID else [slice(k, k + 1) for k in range(8)]
        return sum(self._step(k.start, bits[k], at[:, k], prev, w, n_words, step) for k in levels) / max(1e-9, float(w.sum()))

    def _step(self, first: int, bits: np.ndarray, at: np.ndarray, prev: np.ndarray, w: np.ndarray, n_words: int, step: float) -> float:
        n = len(bits)
        x, sure = inputs(self.table, at.reshape(CONTEXTS, -1))
        bit, each = bits.ravel().astype(np.float64), np.tile(w, n)
        gate = np.repeat(np.arange(first, first + n) * CONFIDENCE, bits.shape[1]) + sure
        z = np.einsum("ni,ni->n", x, self.weights[gate])
        p = squash(z)
        q, low, part = self._refined(z, np.tile(prev, n))
        mixed = np.clip((p + q) / 2, 1e-6, 1 - 1e-6)
        told = -float((each * np.log2(np.where(bit == 1, mixed, 1 - mixed))).sum())
        err = (bit - p) * each
        mass = np.maximum(np.bincount(gate, weights=each, minlength=GATES), 1e-9)
        for i in range(INPUTS):
            slope = np.bincount(gate, weights=err * x[:, i], minlength=GATES) / mass
            self.steepness[:, i] += slope**2
            self.weights[:, i] += step * slope / np.sqrt(self.steepness[:, i])
        key, size = np.tile(prev * LEVELS, n) + low, self.refine.size
        key += np.repeat(np.arange(n) * size, bits.shape[1])
        shares = [(s * each, key + shift) for shift, s in ((0, 1 - part), (1, part))]
        masses = [np.bincount(k, weights=s, minlength=n * size + 1)[: n * size].reshape(n, size) for s, k in shares]
        hits = [np.bincount(k, weights=s * bit, minlength=n * size + 1)[: n * size].reshape(n, size) for s, k in shares]
        flat = self.refine.reshape(-1)
        for k in range(n):
            for mass, hit in zip(masses, hits):
                met = np.flatnonzero(mass[k])
                m = mass[k][met]
                flat[met] += 0.02 * np.minimum(1.0, m * n_words) * (hit[k][met] / np.maximum(m, 1e-12) - flat[met])
        return told

    def settled(self) -> Mixer:
        """For scoring alone: a table of logits, and how sure the prefix's slots are."""
        zeros, ones = self.table
        sure = np.digitize((zeros + ones)[STARTS[-2] :], SURE).astype(np.int8)
        return Mixer(np.clip(np.log((ones + 0.05) / (zeros + 0.05)), -LIMIT, LIMIT).astype(np.float32), self.weights, self.refine, sure)

    def log10(self, words: list[bytes], budget: int = 40_000) -> np.ndarray:
        """log10 probability of each word with its end; the model must be settled."""
        out = np.zeros(len(words))
        flat, context, prev, owner = decisions(words)
        for lo in range(0, len(flat), budget):
            part = slice(lo, lo + budget)
            total = np.zeros(len(flat[part]))
            node = np.ones(len(total), dtype=np.int64)
            for k in range(8):
                bit = (flat[part] >> (7 - k)) & 1
                at = slots(context[:, part], node)
                w = self.weights[k * CONFIDENCE + self.steepness[at[-1] - STARTS[-2]]]
                z = np.einsum("in,ni->n", self.table.take(at), w[:, :CONTEXTS]) + 0.3 * w[:, CONTEXTS]
                q, _, _ = self._refined(z, prev[part])
                mixed = np.clip((squash(z) + q) / 2, 1e-6, 1 - 1e-6)
                total += np.log10(np.where(bit == 1, mixed, 1 - mixed))
                node = node * 2 + bit
            out += np.bincount(owner[part], weights=total, minlength=len(words))
        return out
