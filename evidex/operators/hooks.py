"""Models from outside: embedders and re-rankers as plain callables, broadcast and run on Arrow batches.

An embedder takes a list of texts and gives an array of vectors; a re-ranker
takes a list of (query, text) pairs and gives their scores. Both have a `name`.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.operators.postings import InvertedIndex
from evidex.operators.retrieval import dense_topk
from evidex.sources.tables import stored

Embedder = Callable[[list[str]], np.ndarray]
Reranker = Callable[[list[tuple[str, str]]], np.ndarray]


@lru_cache(maxsize=1 << 16)
def _place(term: str, width: int) -> tuple[int, int]:
    digits = hashlib.md5(term.encode()).hexdigest()
    return int(digits[:4], 16) % width, 1 - 2 * (int(digits[4], 16) % 2)


class HashedWords:
    """Signed counts of words in `width` places by md5: an embedder that needs no training."""

    def __init__(self, width: int = 64):
        self.width, self.name = width, f"hashed-words-{width}"

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for i, text in enumerate(texts):
            for term in re.findall("[a-z0-9]+", text.lower()):
                at, sign = _place(term, self.width)
                out[i, at] += sign
        return out


class SharedWords:
    """Share of the query's distinct words that the text has: the re-ranker where no model is given."""

    name = "shared-words"

    def __call__(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        words = lambda t: set(re.findall("[a-z0-9]+", t.lower()))
        return np.array([len(words(q) & words(t)) / max(1, len(words(q))) for q, t in pairs])


def embedded(rows: DataFrame, text_col: str, model: Embedder, out: str = "vec") -> DataFrame:
    """Add each text's vector; a null text counts as empty."""
    sent = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # its size does not depend on the data

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = pickle.loads(sent.value)
        for batch in batches:
            yield pd.Series(list(model([t or "" for t in batch])) if len(batch) else [], dtype=object)

    return rows.withColumn(out, run(F.col(text_col)))


def reranked(pairs: DataFrame, query_col: str, text_col: str, model: Reranker, out: str = "rel") -> DataFrame:
    """Add the model's score of each (query, text); nulls count as empty."""
    sent = pairs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # as above

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = pickle.loads(sent.value)
        for queries, texts in batches:
            both = [(q or "", t or "") for q, t in zip(queries, texts)]
            yield pd.Series(np.asarray(model(both), dtype=np.float64) if both else [], dtype="float64")

    return pairs.withColumn(out, run(F.col(query_col), F.col(text_col)))


def vectors(index: InvertedIndex, model: Embedder) -> DataFrame:
    """(chunk_id, source, vec) of the index's chunks, beside them on disk; written at the first use of a model."""
    made = lambda: embedded(index.chunks().select("chunk_id", "source", "chunk_text"), "chunk_text", model).select("chunk_id", "source", "vec")
    return index.spark.read.schema("chunk_id string, source string, vec array<double>").parquet(index.once(f"vectors-{model.name}", made))


def dense_search(index: InvertedIndex, queries: DataFrame, k: int, model: Embedder, own_guideline: bool = False) -> DataFrame:
    """(qid, chunk_id, score, rank): the k chunks of nearest vectors for each query (qid bigint, text, guideline).

    Exact by cosine to nine decimals, ties by id. With `own_guideline` as in
    the index's own search: queries are searched guideline by guideline, each
    among its own chunks; sources are few.
    """
    asked, rows = stored(embedded(queries.select("qid", "text", "guideline"), "text", model)), vectors(index, model)
    named = rows.select("vec", F.col("chunk_id").alias("id"), "source")
    groups = []
    if own_guideline:
        groups = [r[0] for r in asked.select("guideline").distinct().join(rows.select(F.col("source").alias("guideline")).distinct(), "guideline", "left_semi").collect()]
    parts = [dense_topk(asked.where(F.col("guideline") == g).select("qid", "vec"), named.where(F.col("source") == g), k) for g in sorted(groups)]
    rest = asked.where(~F.coalesce(F.col("guideline").isin(groups), F.lit(False))) if groups else asked
    found = dense_topk(rest.select("qid", "vec"), named, k)
    for p in parts:
        found = found.unionByName(p)
    return stored(found).select("qid", F.col("vec_id").alias("chunk_id"), "score", "rank")
