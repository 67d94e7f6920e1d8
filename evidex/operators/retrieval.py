"""Retrieval for a whole table of queries at once: dense and keyword search (BM25 has an index of its own).

Every search here reads the queries in blocks and holds a block against all rows,
next to the data: a partition keeps its k best rows of each query, and only
those are shuffled. Pairs of query and row are never laid out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.text import tokens, words_at_least
from evidex.sources.tables import checkpoint_folder, stored

K1, B = 1.5, 0.75
#: Queries of a block, and cells of a block's table of terms and queries (one query at least).
BLOCK_QUERIES, BLOCK_CELLS = 1_024, 1 << 23
#: Cells of one matrix of rows and queries.
SMALL_MATRIX = 1 << 21


def top_k(scored: DataFrame, k: int | Column, by: tuple[str, ...] = ("qid",), score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best rows per key, with `rank` from 1: score (to nine decimals) descending, then id."""
    w = Window.partitionBy(*by).orderBy(F.round(score, 9).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def term_weights(frequencies: DataFrame, n_chunks: DataFrame) -> DataFrame:
    """(term, df, idf) over all terms of `frequencies` (term, df).

    Okapi: ln(N - df + 0.5) - ln(df + 0.5); where that is negative, a quarter
    of the mean over the vocabulary. `n_chunks` is one row (n, avgdl).
    """
    df = frequencies.crossJoin(F.broadcast(n_chunks))
    df = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw").alias("mean_raw"))
    return df.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, 0.25 * F.col("mean_raw")).otherwise(F.col("raw")).alias("idf"), "avgdl")


def query_terms(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """(qid, term, qtf): repeated tokens count repeatedly."""
    return queries.select("qid", F.explode(tokens(text_col)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


# blocks of queries against all rows -----------------------------------------------------------


@dataclass
class Block:
    """Queries of one block: ids, guidelines, and a table of term weights, one row a term and one column a query.

    `asked` marks the terms that a query has, and is none where every weight is above zero and tells it.
    """

    ids: list
    guidelines: list
    places: dict[str, int]
    table: np.ndarray
    asked: np.ndarray | None = None


def blocks_of(queries: DataFrame, weighted: DataFrame) -> Iterator[Block]:
    """Blocks of `queries` (qid unique, guideline) with the terms of `weighted` (qid, term, w); one block is on the driver at a time."""
    listed = weighted.groupBy("qid").agg(F.collect_list(F.struct("term", "w")).alias("terms"))  # as long as the query's text
    rows = queries.select("qid", "guideline").join(listed, "qid", "left").orderBy("qid").toLocalIterator()
    held, terms = [], set()

    def made() -> Block:
        places = {t: i for i, t in enumerate(sorted(terms))}
        table, asked = np.zeros((len(places), len(held))), np.zeros((len(places), len(held)), dtype=bool)
        for j, r in enumerate(held):
            for t in r["terms"] or ():
                table[places[t["term"]], j] += t["w"]
                asked[places[t["term"]], j] = True
        told = (table[asked] > 0).all()
        return Block([r["qid"] for r in held], [r["guideline"] for r in held], places, table, None if told else asked)

    for r in rows:
        grown = terms | {t["term"] for t in r["terms"] or ()}
        if held and (len(held) == BLOCK_QUERIES or len(grown) * (len(held) + 1) > BLOCK_CELLS):
            yield made()
            held, grown = [], {t["term"] for t in r["terms"] or ()}
        held.append(r)
        terms = grown
    if held:
        yield made()


class Best:
    """The k best rows of each of n queries seen so far, ties by id; minus infinity is no row."""

    def __init__(self, n: int, k: int):
        self.k, self.kept = k, pd.DataFrame({"q": np.zeros(0, np.int64), "id": [], "key": np.zeros(0), "score": np.zeros(0)})
        self.floor, self.last = np.full(n, -np.inf), [None] * n

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows `ids` with their `scores` (rows, queries)."""
        order = np.argsort(ids, kind="stable")
        ids, scores = ids[order], scores[order]
        key = np.round(scores, 9)
        cell = key > self.floor
        place = np.array([0 if x is None else np.searchsorted(ids, x) for x in self.last])
        cell |= (key == self.floor) & np.isfinite(key) & (np.arange(len(ids))[:, None] < place)
        if len(ids) > 4 * self.k:  # of many candidates, none beyond the batch's own k best can stay
            many = np.flatnonzero(cell.sum(axis=0) > 4 * self.k)
            if len(many):
                first = np.argsort(np.where(cell[:, many], -key[:, many], np.inf), axis=0, kind="stable")[: self.k]
                only = np.zeros((len(ids), len(many)), dtype=bool)
                np.put_along_axis(only, first, True, axis=0)
                cell[:, many] &= only
        row, q = np.nonzero(cell)
        if not len(row):
            return
        new = pd.DataFrame({"q": q, "id": ids[row], "key": key[row, q], "score": scores[row, q]})
        both = pd.concat([self.kept, new], ignore_index=True) if len(self.kept) else new
        both = both.sort_values(["q", "key", "id"], ascending=[True, False, True], kind="stable")
        nth = both.groupby("q").cumcount()
        self.kept = both[nth < self.k].reset_index(drop=True)
        full = both[nth == self.k - 1]
        for j, x, s in zip(full["q"], full["id"], full["key"]):
            self.floor[j], self.last[j] = s, x


def kept(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def in_blocks(blocks: Iterator, run: Callable, empty: DataFrame) -> DataFrame:
    """Union of run(block) -> (DataFrame, broadcast); with several blocks each result is cut, and its block let go."""
    out, after = None, next(blocks, None)
    while after is not None:
        part, after = after, next(blocks, None)
        best, sent = run(part)
        if after is not None or out is not None:
            best = kept(best)
            sent.destroy()
        out = best if out is None else out.unionByName(best)
    return empty if out is None else out


def automaton_of(terms: Iterable[str]) -> ahocorasick.Automaton:
    """Finds every one of the distinct terms, by its place among them, inside a text in one pass."""
    found = ahocorasick.Automaton()
    for place, term in enumerate(terms):
        if term:
            found.add_word(term, place)
    found.make_automaton()
    return found


def contained(found: ahocorasick.Automaton, text: str) -> list[int]:
    """Places of the terms that the text contains."""
    return list({p for _, p in found.iter(text)}) if len(found) else []


def scanned(queries: DataFrame, weighted: DataFrame, chunks: DataFrame, each: Callable, schema: str, *more: Column, after: Callable = lambda df: df) -> DataFrame:
    """Rows of each(block, batches, step) over all chunks (chunk_id, source, low, *more) for every block of queries, then `after` of a block's rows; written."""
    spark = chunks.sparkSession
    slim = chunks.select("chunk_id", "source", F.lower(F.coalesce("chunk_text", F.lit(""))).alias("low"), *more)

    def run(block: Block):
        sent = spark.sparkContext.broadcast(block)  # BLOCK_CELLS weights
        step = max(1, SMALL_MATRIX // len(block.ids))
        return after(slim.mapInPandas(lambda batches: each(sent.value, batches, step), schema)), sent

    empty = after(spark.createDataFrame([], schema))
    return stored(in_blocks(blocks_of(queries, weighted), run, empty))


def searched(queries: DataFrame, weighted: DataFrame, chunks: DataFrame, k: int, scorer: Callable, *more: Column) -> DataFrame:
    """top_k of every query by scorer(block) -> (texts, sources, *more) -> scores, minus infinity where a chunk is no candidate."""
    kind = queries.schema["qid"].dataType.simpleString()

    def best(block: Block, batches: Iterator[pd.DataFrame], step: int) -> Iterator[pd.DataFrame]:
        top, score = Best(len(block.ids), k), scorer(block)
        for pdf in batches:
            for lo in range(0, len(pdf), step):
                part = pdf.iloc[lo : lo + step]
                rest = [part[c].tolist() for c in part.columns[1:]]
                top.add(part["chunk_id"].to_numpy(dtype=str), score(rest[1], rest[0], *rest[2:]))
        got = top.kept
        if len(got):
            yield pd.DataFrame({"qid": [block.ids[j] for j in got["q"]], "chunk_id": got["id"], "score": got["score"]})

    ranked = lambda df: top_k(df, k).select("qid", "chunk_id", "score", "rank")
    return scanned(queries, weighted, chunks, best, f"qid {kind}, chunk_id string, score double", *more, after=ranked)


def normalised(ranked: DataFrame) -> DataFrame:
    """Scores over the query's best, where that is positive; rows at or below zero go."""
    best = F.max("score").over(Window.partitionBy("qid"))
    return ranked.where("score > 0").withColumn("score", F.round(F.col("score") / best, 6))


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int, least: int = 4) -> DataFrame:
    """One point per query word of `least` letters or more that the text contains, two for the guideline; the best k above zero.

    Queries without any hit get the first k chunks at 0.5. Scores are tenths.
    A word that a query repeats counts repeatedly; words are found anywhere in
    the text, inside other words too.
    """
    words = queries.select("qid", F.explode(F.split(F.lower("text"), r"\s+")).alias("term")).where(F.length("term") >= least)
    weighted = words.groupBy("qid", "term").agg(F.count("*").cast("double").alias("w"))

    def scorer(block: Block):
        found, guideline = automaton_of(block.places), np.array([g or "" for g in block.guidelines], dtype=object)

        def run(texts: list, sources: list) -> np.ndarray:
            bonus = {x: 2.0 * ((guideline == x) & (guideline != "")) for x in set(sources)}
            s = np.stack([block.table[contained(found, t)].sum(axis=0) + bonus[x] for t, x in zip(texts, sources)])
            s[s <= 0] = -np.inf
            return s

        return run

    found = searched(queries, weighted, chunks, k, scorer)
    missed = queries.select("qid").join(found.select("qid").distinct(), "qid", "left_anti")
    first = chunks.select("chunk_id").orderBy("chunk_id").limit(k)  # k rows
    first = first.withColumn("rank", F.row_number().over(Window.orderBy("chunk_id")))
    rest = missed.crossJoin(F.broadcast(first)).select("qid", "chunk_id", F.lit(0.5).alias("score"), "rank")
    return found.unionByName(rest).withColumn("score", F.round(F.col("score") / 10, 4))


def keyword_boost(terms: DataFrame, chunks: DataFrame, guideline: str, k: int = 4) -> DataFrame:
    """Best chunks for keyword sets.

    terms (qid, term), distinct; chunks (chunk_id, source, chunk_text,
    keywords). A point for each pair of term and keyword that are equal or
    whose text contains the term; the guideline's own chunks count 2.5 times
    plus 2, even without a point, others 0.8 times.
    """
    weighted = terms.select("qid", "term", F.lit(1.0).alias("w"))
    asked = terms.select("qid", F.lit(guideline).alias("guideline")).distinct()

    def scorer(block: Block):
        found = automaton_of(block.places)

        def run(texts: list, sources: list, keywords: list) -> np.ndarray:
            s = np.zeros((len(texts), len(block.ids)))
            for i, (text, words) in enumerate(zip(texts, keywords)):
                inside = contained(found, text)
                n = dict.fromkeys(inside, len(words))
                for w in words:
                    p = block.places.get(w)
                    if p is not None and p not in n:
                        n[p] = sum(x == w for x in words)
                s[i] = np.array(list(n.values()), dtype=np.float64) @ block.table[list(n)] if n else 0.0
            own = np.array([x == guideline for x in sources])[:, None]
            s = np.where(own, s * 2.5 + 2, s * 0.8)
            return np.where(s > 0, s, -np.inf)

        return run

    return searched(asked, weighted, chunks, k, scorer, "keywords").select("qid", "chunk_id", "rank", "score")


def term_share(pairs: DataFrame, queries: DataFrame, chunks: DataFrame, weights: DataFrame) -> DataFrame:
    """`pairs` (qid, chunk_id, ...) with `rel`: the share of the query's idf weight, by `weights` (term, idf), that the chunk's terms cover."""
    terms = query_terms(queries).join(weights.select("term", "idf"), "term")
    listed = terms.groupBy("qid").agg(F.collect_list(F.struct("term", "idf")).alias("_terms"))  # as long as the query's text
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x["idf"])
    pairs = stored(pairs)
    texts = named(chunks, pairs).select("chunk_id", tokens("chunk_text").alias("_toks"))
    both = pairs.join(listed, "qid").join(texts, "chunk_id")
    here = F.filter("_terms", lambda x: F.array_contains("_toks", x["term"]))
    return stored(both.withColumn("rel", add(here) / add(F.col("_terms"))).drop("_terms", "_toks"))


def named(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """The chunks that `pairs`, a table at rest, names: texts are read once and only those of named chunks go on."""
    return stored(chunks.join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi"))


# dense vectors --------------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; zero norms count as 1e-10."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(norm == 0, 1e-10).otherwise(norm)


def vector_blocks(queries: DataFrame, limit: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, vectors) of `limit` queries at most."""
    held = []
    for r in queries.select("qid", "vec").orderBy("qid").toLocalIterator():
        held.append(r)
        if len(held) == limit:
            yield [x["qid"] for x in held], np.array([x["vec"] for x in held], dtype=np.float64)
            held = []
    if held:
        yield [x["qid"] for x in held], np.array([x["vec"] for x in held], dtype=np.float64)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines (rows of x, rows of q); zero norms count as 1e-10."""
    norm = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((q * q).sum(axis=1))[None]
    return x @ q.T / np.where(norm == 0, 1e-10, norm)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, limit: int = BLOCK_QUERIES) -> DataFrame:
    """The k nearest vectors of each query by cosine, exactly.

    queries (qid, vec), qid unique, are read in blocks of `limit`; each block
    is held against all vectors (id, vec) by matrix products next to the data.
    """
    spark = vectors.sparkSession
    slim, kind = vectors.select("id", "vec"), vectors.schema["id"].dataType.simpleString()

    def run(part):
        sent = spark.sparkContext.broadcast(part)  # `limit` vectors
        step = max(1, SMALL_MATRIX // len(part[0]))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, mat = sent.value
            top = Best(len(ids), k)
            for pdf in batches:
                for lo in range(0, len(pdf), step):
                    x = np.array(pdf["vec"].iloc[lo : lo + step].tolist(), dtype=np.float64)
                    if len(x):
                        top.add(pdf["id"].iloc[lo : lo + step].to_numpy(dtype=str if kind == "string" else None), cosines(mat, x))
            got = top.kept
            if len(got):
                yield pd.DataFrame({"qid": [ids[j] for j in got["q"]], "vec_id": got["id"], "score": got["key"]})

        return top_k(slim.mapInPandas(best, f"qid bigint, vec_id {kind}, score double"), k, tie="vec_id"), sent

    empty = queries.select(F.col("qid").cast("long").alias("qid"), F.lit("0").cast(kind).alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return in_blocks(vector_blocks(queries, limit), run, empty)


@dataclass
class Index:
    """Inverted lists: unit centres, and how many lists a query looks into."""

    centres: np.ndarray
    probes: int

    def distances(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
        return (self.centres**2).sum(axis=1)[None] - 2 * x @ self.centres.T

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The list of each row of x; SMALL_MATRIX distances are held at a time."""
        step = max(1, SMALL_MATRIX // len(self.centres))
        return np.concatenate([self.distances(x[lo : lo + step]).argmin(axis=1) for lo in range(0, len(x), step)]).astype(np.int32)

    def probed(self, x: np.ndarray, probes: int | None = None) -> np.ndarray:
        """(queries, lists): whether a query looks into a list."""
        near = np.argsort(self.distances(x), axis=1, kind="stable")[:, : probes or self.probes]
        out = np.zeros((len(x), len(self.centres)), dtype=bool)
        np.put_along_axis(out, near, True, axis=1)
        return out

    @staticmethod
    def nearest_list(sent):
        @F.pandas_udf("int")
        def run(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype="int32")
            return pd.Series(sent.value.nearest(np.array(v.tolist(), dtype=np.float64)))

        return run


def ann_index(vectors: DataFrame, k: int = 10, recall: float = 0.97, lists: int | None = None, sample: int = 20_000, seed: int = 7) -> Index:
    """Centres by k-means over a bounded sample, about the square root of the number of vectors (1,024 at most).

    The number of probes is the least with which 200 sampled vectors find
    `recall` of their k nearest in the sample; in a larger table the nearest lie
    nearer, so this errs to the safe side.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.feature import Normalizer

    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("raw"))
    unit = kept(Normalizer(inputCol="raw", outputCol="features", p=2.0).transform(rows).select("id", "features"))
    lists = lists or int(min(1024, max(1, round(vectors.count() ** 0.5))))
    index = Index(np.array(KMeans(k=max(2, lists), seed=seed, maxIter=15).fit(unit).clusterCenters()), 1)
    x = np.array([r["features"].toArray() for r in unit.orderBy(F.xxhash64("id"), "id").toLocalIterator()])  # `sample` rows
    asked = x[:200]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(np.argsort(index.distances(asked), axis=1, kind="stable"), axis=1)
    at = index.nearest(x)
    needed = np.sort(np.take_along_axis(order, at[near], axis=1).ravel()) + 1  # probes after which each neighbour is found
    index.probes = int(needed[int(np.ceil(recall * len(needed))) - 1])
    return index


def chunk_keywords(text_col: str = "chunk_text") -> Column:
    """Keywords of a chunk: its distinct words of four letters or more."""
    return words_at_least(text_col, 4)
