"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the unlabelled text is drawn from
all documents, positives included, as the risk estimator supposes. A logistic
model over hashed words and word stems minimises the risk corrected by the
class prior; where its unlabelled part would fall below zero, the gradient of
that part is reversed. An l1 penalty in the size of the sample's noise lets the
risk choose the features; a second fit with the same risk on these alone takes
the penalty's shrinkage off. Learning uses bounded samples; every document is
scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidex.llm._shared import remainder, row_sample, written

LETTERS = re.compile(r"[^\W\d_]+")
#: Hashed features.
WIDTH = 1 << 20
#: Words remembered with their weight by a worker.
CACHE = 1_000_000


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of the word and of its first four and five letters."""
    raw = [f"w:{word}"] + [f"{k}:{word[:k]}" for k in (4, 5) if len(word) >= k]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % WIDTH for x in raw)


def features(text: str | None) -> np.ndarray:
    """Distinct features of a whole text, sorted: WIDTH at most."""
    words = set(LETTERS.findall(text.lower())) if text else ()
    return np.unique(np.array([h for w in words for h in word_features(w)], dtype=np.uint32))


@dataclass
class PuModel:
    """Weights of the selected features, and the bias."""

    weights: dict[int, float]
    bias: float

    def scores(self, texts: list, cache: dict[str, float]) -> np.ndarray:
        """Probability of toxicity of whole texts; null counts as empty."""
        out = np.full(len(texts), self.bias)
        get, find = self.weights.get, LETTERS.findall
        for i, text in enumerate(texts):
            if not text:
                continue
            total = 0.0
            for w in set(find(text.lower())):
                g = cache.get(w)
                if g is None:
                    g = sum(get(h, 0.0) for h in word_features(w))
                    if len(cache) < CACHE:
                        cache[w] = g
                total += g
            out[i] += total
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def pu_risk(z: np.ndarray, is_pos: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(risk of positives, risk left for negatives, gradient to follow) of logits z.

    With the logistic loss, prior * mean over positives of l(z) plus the rest:
    mean over unlabelled of l(-z) less prior * mean over positives of l(-z). A
    rest below zero is overfitting: its gradient is then reversed and nothing
    else is followed.
    """
    n_pos, n_unl = int(is_pos.sum()), int((~is_pos).sum())
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
    neg = np.logaddexp(0.0, z)
    kept = prior * float(np.logaddexp(0.0, -z[is_pos]).mean())
    rest = float(neg[~is_pos].mean() - prior * neg[is_pos].mean())
    rest_grad = np.where(is_pos, -prior * p / n_pos, p / n_unl)
    if rest < 0:
        return kept, rest, -rest_grad
    return kept, rest, rest_grad + np.where(is_pos, prior * (p - 1.0) / n_pos, 0.0)


def descend(col: np.ndarray, row: np.ndarray, size: int, is_pos: np.ndarray, prior: float, l1: float, l2: float, steps: int, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias by proximal full-batch Adagrad on the risk with l1 and l2 penalties on the weights."""
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    sq, sq_b = np.full(size, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(row, weights=w[col], minlength=len(is_pos)) + b
        _, _, g = pu_risk(z, is_pos, prior)
        grad = np.bincount(col, weights=g[row], minlength=size) + l2 * w
        sq += grad**2
        sq_b += g.sum() ** 2
        step = rate / np.sqrt(sq)
        w -= step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0.0)
        b -= rate * g.sum() / np.sqrt(sq_b)
    return w, b


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, min_docs: int = 5, noise: float = 0.3, decay: float = 1e-3, steps: int = 120) -> PuModel:
    """Fit the model on the features of positive and unlabelled documents.

    Features in fewer than `min_docs` documents of the sample are left out. The
    l1 penalty is prior * sqrt(noise / positives), the size of a gradient that
    chance alone gives; the second fit is over the features that pull towards
    toxic, with a small l2 penalty. Without positives, unlabelled text or such
    features the model gives the prior everywhere.
    """
    prior = min(max(prior, 1e-3), 0.999)
    empty = PuModel({}, float(np.log(prior / (1 - prior))))
    if not positive or not unlabelled:
        return empty
    rows = positive + unlabelled
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    vocab, col, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    is_pos = np.arange(len(rows)) < len(positive)

    def only(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = kept[col]
        return vocab[kept], (np.cumsum(kept) - 1)[col[at]], row[at]

    vocab, col, row = only(n >= min_docs)
    w, _ = descend(col, row, len(vocab), is_pos, prior, prior * float(np.sqrt(noise / len(positive))), 0.0, steps)
    if not (w > 0).any():
        return empty
    vocab, col, row = only(w > 0)
    w, b = descend(col, row, len(vocab), is_pos, prior, 0.0, decay, 2 * steps)
    return PuModel(dict(zip(vocab.tolist(), w.tolist())), b)


@F.pandas_udf(T.BinaryType())
def _features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([features(t).tobytes() for t in batch])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_positive: int = 2000,
    max_unlabelled: int = 6000,
    max_values: int = 8_000_000,
    prior: float | None = None,
) -> PuModel:
    """Learn from `labels` (doc_id, toxic 0/1) and `docs`.

    At most `max_positive` labelled toxic documents and `max_unlabelled`
    documents of the training folds are used, in hash order, and of these only
    as many as have `max_values` features together, which bounds what the
    driver holds. `prior`, where not given, is the share of toxic among the
    labels of those folds: an estimate that takes the labelled documents for a
    random draw.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text")).where(remainder("doc_id", 3) != 1)
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & (remainder("doc_id", 3) != 1))
    share = known.agg(F.avg("toxic")).first()[0]
    if share is None:
        return train_nnpu([], [], prior or 0.1)
    toxic = known.where("toxic = 1").select("doc_id").distinct()
    parts = [row_sample(slim, n, s, "doc_id", "_text", among=a).withColumn("_kind", F.lit(i)) for i, (n, s, a) in enumerate(((max_positive, "pu-p", toxic), (max_unlabelled, "pu-u", None)))]
    sample = written(parts[0].unionByName(parts[1]).select("_kind", F.xxhash64("doc_id", "_text").alias("_order"), _features("_text").alias("x")))
    last, upto = {}, {}
    for kind, order, n in sorted(tuple(r) for r in sample.select("_kind", "_order", (F.length("x") / 4).cast("long")).collect()):  # the sample's sizes
        upto[kind] = upto.get(kind, 0) + n
        if upto[kind] <= max_values // 2:
            last[kind] = order
    inside = F.lit(False)
    for kind, order in last.items():
        inside = inside | ((F.col("_kind") == kind) & (F.col("_order") <= order))
    got = sorted(tuple(r) for r in sample.where(inside).select("_kind", "_order", "x").collect())  # max_values features
    found = [[np.frombuffer(x, dtype=np.uint32) for kind, _, x in got if kind == k] for k in (0, 1)]
    return train_nnpu(found[0], found[1], float(share if prior is None else prior))


def score(docs: DataFrame, model: PuModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of toxicity; null and empty texts get that of a text without features."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as long as the vocabulary of the bounded sample

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, float] = {}
        for batch in batches:
            yield pd.Series(sent.value.scores(batch.tolist(), cache))

    return docs.withColumn(out, run.asNondeterministic()(F.col(text_col).cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut_off: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document row.

    Nulls: a null id counts as empty text for the fold, a null text as empty,
    null labels are not used. Repeated rows score alike; an empty table gives
    no rows; without toxic labels all get one score. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    scored = score(slim, fit(docs, labels, id_col, text_col), "_text")
    return scored.select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= cut_off).cast("int").alias("predicted"),
    )
