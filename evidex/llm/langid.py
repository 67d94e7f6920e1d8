"""Language identification by a small convolutional network over bytes.

Texts are lower-cased, encoded as UTF-8 and cut into fixed-length windows. A
byte embedding feeds filters of several widths, each max-pooled over the
window, and a softmax. A document's probabilities are the mean over all its
windows, weighted by their bytes. Training is numpy on a bounded sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.llm._shared import cut, remainder, slices, wrapped

WINDOW = 128
WIDTHS = (2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass
class ByteNet:
    """classes, embedding (256, e), one kernel (4 e, filters) for all widths, and the output layer."""

    classes: list[str]
    embed: np.ndarray
    kernel: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Max-pooled rectified filter responses of (n, WINDOW) bytes."""
        n, widest = len(windows), max(WIDTHS)
        e = self.embed.shape[1]
        x = self.embed[windows]
        flat = np.lib.stride_tricks.sliding_window_view(x.reshape(n, -1), widest * e, axis=1)[:, ::e]
        y = flat.reshape(-1, widest * e) @ self.kernel
        return np.maximum(y.reshape(n, WINDOW - widest + 1, -1).max(axis=1) + self.shift, 0.0)

    def probabilities(self, windows: np.ndarray, block: int = 128) -> np.ndarray:
        """Softmax over classes of each window."""
        parts = [self.pooled(windows[i : i + block]) for i in range(0, len(windows), block)]
        z = np.concatenate(parts) @ self.out + self.out_shift
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of whole texts, the row each belongs to, and its bytes of text; the last is filled with zeros."""
    raws = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    counts = -(-sizes // WINDOW)
    joined = b"".join(r + bytes(-len(r) % WINDOW) for r in raws)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    nth = np.arange(len(owner)) - first[owner]
    weight = np.minimum(WINDOW, sizes[owner] - nth * WINDOW)
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, WINDOW), owner, weight


def predict(net: ByteNet, texts: list) -> tuple[list[str], np.ndarray]:
    """Language and its mean probability for whole texts."""
    win, owner, weight = windows_of(texts)
    total = np.zeros((len(texts), len(net.classes)))
    if len(win) and len(net.classes):
        p = net.probabilities(win) * weight[:, None]
        for c in range(len(net.classes)):
            total[:, c] = np.bincount(owner, weights=p[:, c], minlength=len(texts))
    total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
    best = total.argmax(axis=1) if len(net.classes) else np.zeros(len(texts), dtype=int)
    known = [bool(t) and bool(net.classes) and LETTER.search(t) is not None for t in texts]
    names = [net.classes[b] if k else UNKNOWN for b, k in zip(best, known)]
    score = np.where(known, total[np.arange(len(texts)), best] if len(net.classes) else 0.0, 0.0)
    return names, score


def train(windows: np.ndarray, target: np.ndarray, classes: list[str], e: int = 6, filters: int = 8, epochs: int = 12, batch: int = 32, rate: float = 0.004) -> ByteNet:
    """Adam on the cross-entropy; filters narrower than the widest keep zeros in their tail."""
    rng = np.random.default_rng(3)
    widest, n_filters = max(WIDTHS), filters * len(WIDTHS)
    mask = np.zeros((widest * e, n_filters), dtype=np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * e, i * filters : (i + 1) * filters] = 1.0
    f32 = lambda a: a.astype(np.float32)
    net = ByteNet(
        classes,
        f32(rng.normal(0, 0.5, (256, e))),
        f32(rng.normal(0, 0.3, mask.shape)) * mask,
        np.zeros(n_filters, np.float32),
        f32(rng.normal(0, 0.1, (n_filters, len(classes)))),
        np.zeros(len(classes), np.float32),
    )
    if len(classes) < 2:
        return net
    names = ("embed", "kernel", "shift", "out", "out_shift")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    t, places = 0, WINDOW - widest + 1
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            n = len(pick)
            x = net.embed[windows[pick]]
            flat = np.lib.stride_tricks.sliding_window_view(x.reshape(n, -1), widest * e, axis=1)[:, ::e]
            y = (flat.reshape(-1, widest * e) @ net.kernel).reshape(n, places, n_filters) + net.shift
            at = y.argmax(axis=1)
            top = np.take_along_axis(y, at[:, None, :], axis=1)[:, 0]
            h = np.maximum(top, 0.0)
            z = h @ net.out + net.out_shift
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), target[pick]] -= 1.0
            p /= n
            dh = (p @ net.out.T) * (top > 0)
            seen = flat[np.arange(n)[:, None], at]  # (n, filters, widest e): what each winner saw
            dx = np.zeros_like(x)
            back = (dh[:, :, None] * net.kernel.T[None]).reshape(n, n_filters, widest, e)
            for j in range(widest):
                np.add.at(dx, (np.arange(n)[:, None], at + j), back[:, :, j])
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, windows[pick], dx)
            grads = {"embed": d_embed, "kernel": np.einsum("nf,nfk->kf", dh, seen) * mask, "shift": dh.sum(axis=0), "out": h.T @ p, "out_shift": p.sum(axis=0)}
            t += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                setattr(net, k, f32(getattr(net, k) - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)))
    return net


#: Rows of the training sample that are broadcast, as hashes.
SMALL_SAMPLE = 200_000


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = 300, windows_per_doc: int = 4) -> ByteNet:
    """Learn from text and non-null language of the training folds.

    At most `per_class` documents of each language are used, first by hash
    order and repeated rows once, with at most `windows_per_doc` evenly spaced windows each.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).alias("_lang"))
    slim = slim.where((remainder("doc_id", 4) != 2) & F.col("_lang").isNotNull())
    slim = slim.withColumn("_key", F.xxhash64(F.lit("cnn"), F.col("doc_id").cast("string"), "_text"))
    order = Window.partitionBy("_lang").orderBy("_key")
    chosen = slim.select("_lang", "_key").distinct().withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= per_class)
    chosen = cut(chosen.select("_lang", "_key"))
    if chosen.count() <= SMALL_SAMPLE:
        chosen = F.broadcast(chosen)
    sample = slim.join(chosen, ["_lang", "_key"]).groupBy("_lang", "_key").agg(F.first("_text").alias("_text"))

    @F.pandas_udf("binary")
    def some(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            win, _, weight = windows_of([t])
            win = win[weight >= min(WINDOW, 24)]
            keep = np.unique(np.linspace(0, len(win) - 1, windows_per_doc).astype(int)) if len(win) else []
            out.append(win[keep].tobytes() if len(win) else b"")
        return pd.Series(out)

    got = sorted((r["_lang"], r["x"]) for r in sample.select("_lang", some("_text").alias("x")).collect())
    classes = sorted({lang for lang, x in got if x})
    win = [np.frombuffer(x, dtype=np.uint8).reshape(-1, WINDOW) for _, x in got if x]
    target = [np.full(len(w), classes.index(lang)) for w, (lang, x) in zip(win, ((lang, x) for lang, x in got if x))]
    if not win:
        return train(np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), [])
    return train(np.concatenate(win), np.concatenate(target), classes)


def add_language(docs: DataFrame, net: ByteNet, text_col: str = "text", out: str = "_lid") -> DataFrame:
    """Add a struct (lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand parameters

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            names, scores = [], [np.zeros(0)]
            for lo, hi in slices(texts):
                a, b = predict(sent.value, texts[lo:hi])
                names += a
                scores.append(b)
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": np.concatenate(scores)})

    return docs.withColumn(out, run.asNondeterministic()(F.col(text_col).cast("string")))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document row.

    A text that is null or has no letter is `und` with score 0, as are all
    where nothing was learnt. Very long texts are read in full, window by
    window; repeated rows and ties get the same answer (the first class by
    name); an empty table gives no rows. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    tagged = add_language(slim, fit(docs, id_col, text_col, lang_col), "_text")
    return tagged.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "_lid.lang_pred", "_lid.score")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", floor: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, with a language predicted at `floor` or more."""
    tagged = add_language(wrapped(docs, _text=text_col), fit(docs, id_col, text_col, lang_col), "_text")
    return tagged.where((F.col("_lid.lang_pred") != UNKNOWN) & (F.col("_lid.score") >= floor)).select("_row.*")
