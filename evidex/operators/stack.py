"""The retrieval stack put together from switches: which legs search, and what follows them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions import query as Q
from evidex.functions.text import has_any
from evidex.operators import fusion as X
from evidex.operators.hooks import Embedder, HashedWords, Reranker, dense_search, reranked
from evidex.operators.postings import InvertedIndex
from evidex.operators.retrieval import named, term_share, top_k
from evidex.sources.tables import stored


@dataclass(frozen=True)
class Switches:
    """What a plan does; `pool` is how deep each leg looks, `k` how much comes back."""

    sparse: bool = True
    dense: bool = True
    mask: bool = True
    adaptive: bool = True
    expanded: bool = True
    forced: int = 5
    diverse: bool = True
    grown: bool = True
    pool: int = 10
    k: int = 5


#: The arms of an ablation that need no graph.
SPARSE_ONLY = Switches(dense=False, diverse=False, grown=False)
DENSE_ONLY = Switches(sparse=False, diverse=False, grown=False)
VECTOR = Switches(grown=False)


@dataclass
class Stack:
    """An index with its models; every method takes queries (qid bigint and unique, text, guideline)."""

    index: InvertedIndex
    baseline: tuple[str, ...] = ()
    embedder: Embedder = HashedWords()
    reranker: Reranker | None = None

    def chunks(self) -> DataFrame:
        return self.index.chunks().drop("dl")

    def groups(self) -> DataFrame:
        """(chunk_id, group_key) of all chunks, written beside the index once."""
        return self.index.spark.read.schema("chunk_id string, group_key string").parquet(self.index.once("groups", lambda: X.retrieval_groups(self.chunks())))

    @staticmethod
    def understood(queries: DataFrame) -> DataFrame:
        """(qid, text, guideline, intent), null texts empty; written, as what follows uses the intent many times."""
        text = F.coalesce("text", F.lit(""))
        return stored(queries.select("qid", text.alias("text"), "guideline", Q.intent(text).alias("intent")))

    def legs(self, queries: DataFrame, s: Switches) -> DataFrame:
        """(qid, list, chunk_id, rank) of the legs that are on; each query keeps as many as its intent asks for."""
        asked = self.understood(queries)
        wide = int(2.5 * s.pool) if s.adaptive else s.pool  # the deepest that adaptive_k gives
        limits = asked.select("qid", (Q.adaptive_k(F.col("text"), F.col("intent"), s.pool) if s.adaptive else F.lit(s.pool)).alias("depth"))
        lists = []
        if s.dense:
            lists.append(dense_search(self.index, asked, wide, self.embedder, s.mask).withColumn("list", F.lit("dense")))
        if s.sparse:
            words = asked.withColumn("text", Q.expand(F.col("text"))) if s.expanded else asked
            lists.append(self.index.search(words.select("qid", "text", "guideline"), wide, s.mask).withColumn("list", F.lit("sparse")))
        both = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
        return stored(both.join(limits, "qid").where(F.col("rank") <= F.col("depth")).select("qid", "list", "chunk_id", "rank"))

    def relevance(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """`pairs` (qid, chunk_id, ...) with `rel`: the re-ranker's score, or the share of the query's idf weight without one."""
        if self.reranker is None:
            told = term_share(pairs.select("qid", "chunk_id"), queries, self.chunks(), self.index.terms())
            return pairs.join(told.select("qid", "chunk_id", "rel"), ["qid", "chunk_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)))
        pairs = stored(pairs)
        texts = pairs.join(queries.select("qid", F.col("text").alias("_q")), "qid").join(named(self.chunks(), pairs).select("chunk_id", F.col("chunk_text").alias("_t")), "chunk_id")
        return reranked(texts, "_q", "_t", self.reranker).drop("_q", "_t")

    def forced(self, queries: DataFrame, most: int) -> DataFrame:
        """(qid, chunk_id): up to `most` baseline chunks of a query's guideline, ranked once for each guideline."""
        c = self.chunks().where(has_any(F.col("chunk_text"), self.baseline))
        first = Window.partitionBy("source").orderBy(X.section_weight(F.col("chunk_type"), F.lit("other")).desc(), "chunk_id")
        best = c.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).select(F.col("source").alias("guideline"), "chunk_id")
        return queries.select("qid", "guideline").join(best, "guideline").select("qid", "chunk_id")

    def scored(self, candidates: DataFrame, queries: DataFrame) -> DataFrame:
        """Candidates (qid, chunk_id) with their metadata score and what it was made of."""
        q = self.understood(queries).select("qid", F.col("text").alias("_text"), F.col("intent").alias("_intent"), "guideline")
        told = stored(self.relevance(candidates, queries))
        p = told.join(named(self.chunks(), told), "chunk_id").join(q, "qid")
        own, base = F.coalesce(F.col("source") == F.col("guideline"), F.lit(False)), has_any(F.col("chunk_text"), self.baseline)
        age = X.age_band_match(F.col("_text"), F.col("chunk_text"))
        tier = X.tier_score(X.tier_of_text(F.col("_text")), X.tier_of_chunk(F.col("page"), F.col("chunk_text")))
        score = X.metadata_score(F.col("rel"), X.section_weight(F.col("chunk_type"), F.col("_intent")), age, F.when(own, 0.15).otherwise(0.0), tier, F.when(base, 1.0).otherwise(0.0))
        return p.select("qid", "chunk_id", own.alias("own"), F.col("chunk_type").alias("section"), base.alias("baseline"), "chunk_text", F.round(score, 9).alias("score"))

    def retrieve(self, queries: DataFrame, s: Switches = Switches()) -> DataFrame:
        """(qid, chunk_id, score, rank, group_rank): the plan that the switches describe.

        Legs, fusion, forced candidates, metadata scores, guideline top-up, the
        best of each group, then diversity and coverage or the plain best k,
        and last the rest of the groups (rank of the chosen) and siblings (0).
        """
        fused = X.rrf(self.legs(queries, s)).select("qid", "chunk_id")
        if s.forced and self.baseline:
            fused = fused.unionByName(self.forced(queries, s.forced)).distinct()
        groups = self.groups()
        pool = X.group_best(X.top_up(self.scored(fused, queries), s.k), groups, X.pool_size(s.k)).drop("rank", "group_key")
        pool = stored(pool)
        if s.diverse:
            picked = X.mmr(pool.select("qid", "chunk_id", "score", "chunk_text"), s.k)
            picked = X.coverage_swap(picked, pool.select("qid", "chunk_id", "score", "section", "baseline"))
        else:
            picked = top_k(pool.select("qid", "chunk_id", "score"), s.k)
        picked = stored(picked.select("qid", "chunk_id", "score", "rank"))
        chosen = picked.withColumn("group_rank", F.col("rank"))
        if not s.grown:
            return chosen
        members = X.group_expand(picked, groups).join(picked.select("qid", F.col("rank").alias("group_rank"), "score"), ["qid", "group_rank"])
        near = X.siblings(members.select("qid", "chunk_id", "score"), self.chunks()).select("qid", "chunk_id", "score", F.lit(None).cast("int").alias("rank"), "group_rank")
        members = members.join(picked.select("qid", "chunk_id", "rank"), ["qid", "chunk_id"], "left").select("qid", "chunk_id", "score", "rank", "group_rank")
        return members.unionByName(near)

    def basic(self, queries: DataFrame, s: Switches = Switches(adaptive=False, expanded=False, mask=False)) -> DataFrame:
        """(qid, chunk_id, score, rank): both legs fused, the best `pool` re-ranked, the best k kept; from a corpus without chunks, none."""
        fused = X.rrf(self.legs(queries, s)).where(F.col("rank") <= s.pool).select("qid", "chunk_id")
        return top_k(self.relevance(fused, queries).withColumnRenamed("rel", "score").select("qid", "chunk_id", "score"), s.k)

    def hybrid(self, queries: DataFrame, graph: DataFrame, k: int = 5) -> DataFrame:
        """(qid, chunk_id, score, rank): the vector arm and a graph arm (qid, chunk_id, rank), fused from pools of several times k."""
        deep = X.pool_size(k)
        vector = self.retrieve(queries, replace(VECTOR, k=deep)).where("rank is not null")
        lists = vector.select("qid", F.lit("vector").alias("list"), "chunk_id", "rank").unionByName(graph.where(F.col("rank") <= deep).select("qid", F.lit("graph").alias("list"), "chunk_id", "rank"))
        return X.rrf(lists).where(F.col("rank") <= k).select("qid", "chunk_id", "score", "rank")
