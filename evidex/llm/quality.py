"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

The machine scores w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j; the
pair term is half of (sum v x)^2 - sum (v x)^2 per factor, so a text is scored
in time linear in its features. Learning uses a bounded labelled sample; every
document is scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidex.llm._shared import remainder, row_sample, slices

WORDS = 1 << 15
BINS = 12
CACHE = 1_000_000
CLASSES = {
    "capitals": bytes(range(65, 91)),
    "digits": b"0123456789",
    "stops": b".?!",
    "shouts": b"!",
    "symbols": b"#*$%&<>@^~_=+\\/",
    "bars": b"|",
    "commas": b",;:",
    "spaces": b" \t\n\x0b\x0c\r",
}
STATS = [*CLASSES, "line_repeats", "word_variety", "word_length", "longest", "n_words", "line_words", "n_chars"]
WIDTH = WORDS + len(STATS) * BINS


def _level(x: float) -> int:
    """Share (0 to 1) as one of BINS levels, finer near zero."""
    return min(BINS - 1, int(BINS * min(1.0, x) ** 0.5))


def _size(n: float) -> int:
    return min(BINS - 1, int(np.log2(1 + max(0.0, n))) * BINS // 20)


def structure(text: str, raw: bytes, words: list, n_chars: float) -> list[int]:
    """One feature id for each entry of STATS."""
    n = max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    levels = [_level((len(raw) - len(raw.translate(None, c))) / n) for c in CLASSES.values()]
    levels += [
        _level(1 - len(set(lines)) / max(1, len(lines))),
        _level(len(set(words)) / max(1, len(words))),
        min(BINS - 1, int(len(text) / max(1, len(words)))),
        _size(max(map(len, words), default=0) * 32),
        _size(len(words)),
        _size(len(words) / max(1, len(lines)) * 16),
        _size(n_chars),
    ]
    return [WORDS + i * BINS + x for i, x in enumerate(levels)]


def encode(texts: list, n_chars: list, cache: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, feature, value): l2-normalised log counts of hashed words, and ones for structure."""
    parts_row, parts_col, parts_val = [], [], []
    for r, (text, size) in enumerate(zip(texts, n_chars)):
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.lower().split()
        ids = []
        for w in words:
            h = cache.get(w)
            if h is None:
                h = zlib.crc32(w.strip(b".,;:!?")) % WORDS
                if len(cache) < CACHE:
                    cache[w] = h
            ids.append(h)
        col, count = np.unique(np.array(ids, dtype=np.int64), return_counts=True)
        val = np.log1p(count)
        val /= max(1e-9, np.sqrt((val * val).sum()))
        known = len(text) if size is None or size != size else size
        extra = structure(text, raw, words, known)
        parts_row.append(np.full(len(col) + len(extra), r))
        parts_col.append(np.concatenate((col, extra)))
        parts_val.append(np.concatenate((val, np.full(len(extra), 0.5))))
    if not parts_row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(parts_row), np.concatenate(parts_col).astype(np.int64), np.concatenate(parts_val)


@dataclass
class Machine:
    """Parameters: bias, linear weights and factors."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw_scores(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and the factor sums of n rows; `row` is sorted."""
        out = np.bincount(row, weights=self.linear[col] * val, minlength=n) + self.bias
        vx = self.factors[col] * val[:, None]
        sums = np.stack([np.bincount(row, weights=vx[:, f], minlength=n) for f in range(vx.shape[1])], axis=1)
        squares = np.bincount(row, weights=(vx * vx).sum(axis=1), minlength=n)
        return out + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def scores(self, texts: list, n_chars: list, cache: dict[bytes, int]) -> np.ndarray:
        row, col, val = encode(texts, n_chars, cache)
        z, _ = self.raw_scores(row, col, val, len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 4, epochs: int = 8, rate: float = 0.05, decay: float = 1e-5, batch: int = 64) -> Machine:
    """Adagrad on the logistic loss over (features, values) rows. Without both classes, a constant."""
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    rng = np.random.default_rng(7)
    fm = Machine(float(np.log(share / (1 - share))), np.zeros(WIDTH), rng.normal(0, 0.01, (WIDTH, rank)))
    if len(set(labels.tolist())) < 2:
        fm.factors[:] = 0
        return fm
    sq_lin, sq_fac, sq_bias = np.full(WIDTH, 1e-6), np.full((WIDTH, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            row = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            col = np.concatenate([rows[i][0] for i in pick])
            val = np.concatenate([rows[i][1] for i in pick])
            z, sums = fm.raw_scores(row, col, val, len(pick))
            err = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels[pick]
            ids, place = np.unique(col, return_inverse=True)
            g = err[row] * val
            g_lin = np.bincount(place, weights=g, minlength=len(ids)) / len(pick) + decay * fm.linear[ids]
            grad = g[:, None] * (sums[row] - fm.factors[col] * val[:, None])
            g_fac = np.stack([np.bincount(place, weights=grad[:, f], minlength=len(ids)) for f in range(rank)], axis=1) / len(pick) + decay * fm.factors[ids]
            sq_lin[ids] += g_lin**2
            sq_fac[ids] += g_fac**2
            sq_bias += err.mean() ** 2
            fm.linear[ids] -= rate * g_lin / np.sqrt(sq_lin[ids])
            fm.factors[ids] -= rate * g_fac / np.sqrt(sq_fac[ids])
            fm.bias -= rate * err.mean() / np.sqrt(sq_bias)
    return fm


@F.pandas_udf(T.BinaryType())
def _encoded(text: pd.Series, n_chars: pd.Series) -> pd.Series:
    cache: dict[bytes, int] = {}
    out = []
    for t, n in zip(text.tolist(), n_chars.tolist()):
        _, col, val = encode([t], [n], cache)
        out.append(col.astype(np.float32).tobytes() + val.astype(np.float32).tobytes())
    return pd.Series(out)


def _slim(docs: DataFrame, id_col: str, text_col: str, size_col: str | None) -> DataFrame:
    size = F.expr(f"try_cast(`{size_col}` as double)") if size_col and size_col in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"), size.alias("_size"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", max_rows: int = 8000) -> Machine:
    """Learn from at most `max_rows` labelled documents (doc_id, quality 0/1) of the training folds, in hash order."""
    known = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & (remainder("doc_id", 3) != 1))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("_y"))
    sample = row_sample(_slim(docs, id_col, text_col, size_col), max_rows, "fm", "doc_id", "_text", among=known)
    got = sorted(sample.select(F.xxhash64("doc_id", "_text").alias("_order"), "_y", _encoded("_text", "_size").alias("x")).collect())  # max_rows at most
    rows = []
    for r in got:
        x = np.frombuffer(r["x"], dtype=np.float32)
        rows.append((x[: len(x) // 2].astype(np.int64), x[len(x) // 2 :].astype(np.float64)))
    return train(rows, np.array([float(r["_y"]) for r in got]))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", cut_off: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document row.

    Inputs of a score are the text and, as metadata, its recorded length
    `size_col` (absent or null: measured). A null text counts as empty and gets
    a score; null labels are not used; repeated rows score alike; an empty
    table gives no rows; without labels of both classes all get one score.
    """
    slim = _slim(docs, id_col, text_col, size_col)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, size_col))  # WIDTH parameters and factors

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cache: dict[bytes, int] = {}
        for text, size in batches:
            texts, sizes = text.tolist(), size.tolist()
            parts = [sent.value.scores(texts[lo:hi], sizes[lo:hi], cache) for lo, hi in slices(texts, 500_000)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    scored = slim.withColumn("score", run.asNondeterministic()("_text", "_size"))
    return scored.select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= cut_off).cast("int").alias("predicted"),
    )
