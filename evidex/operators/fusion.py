"""Fusing, re-ranking and grouping ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.text import has_any, words_at_least
from evidex.operators.retrieval import top_k

#: Age bands, tiers and baseline phrases: fixed values.
AGE_0_6 = ("0-6 day", "0 to 6 day", "day 0", "day 1", "day 2", "day 3", "day 4", "day 5", "day 6", "first day", "first week", "newborn", "neonate", "age < 7")
AGE_7_59 = ("7-59 day", "7 to 59 day", "week 1", "week 2", "week 3", "day 7", "day 14", "day 21", "day 28", "young infant", "1 month", "2 month", "1-2 month")
TIER_CRITICAL = ("critical illness", "recommendation a.2", "a.2 (updated)", "a.2(updated)")
TIER_SEVERE = ("clinical severe infection", "recommendation a.3", "a.3a", "a.3b", "possible serious bacterial infection", "psbi")
TIER_PAGES = (("critical", 1, 8), ("clinical_severe", 9, 13))
SECTION_SCORE = (("recommendation", 0.15), ("algorithm", 0.12), ("risk_factor", 0.08), ("table", 0.05), ("remarks", -0.02), ("background", -0.05), ("overview", -0.08))
INTENT_MULT = {
    "treatment": {"recommendation": 1.20, "algorithm": 1.10, "background": 0.90, "overview": 0.80, "remarks": 0.95},
    "diagnosis": {"recommendation": 1.10, "background": 1.00, "overview": 0.95},
    "risk_assessment": {"risk_factor": 1.20, "background": 1.05, "recommendation": 1.10},
    "monitoring": {"recommendation": 1.10, "remarks": 1.05, "background": 0.95},
    "definition": {"background": 1.10, "overview": 1.05, "recommendation": 0.90},
}


def rrf(lists: DataFrame, k: int = 60, id_col: str = "chunk_id") -> DataFrame:
    """Reciprocal-rank fusion of (qid, list, chunk_id, rank): sum of 1 / (k + rank), best first.

    Within a list an id counts at its best rank.
    """
    once = lists.groupBy("qid", "list", id_col).agg(F.min("rank").alias("rank"))
    fused = once.groupBy("qid", id_col).agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), id_col)
    return fused.withColumn("rank", F.row_number().over(w))


def pool_size(k: int) -> int:
    return max(3 * k, k + 5)


def section_weight(chunk_type: Column, intent: Column) -> Column:
    """Weight of the first declared section kind that the type contains, times the intent's multiplier."""
    t = F.lower(F.trim(F.coalesce(chunk_type, F.lit(""))))
    out = None
    for kind, base in SECTION_SCORE:
        mult = F.lit(1.0)
        for name, by_kind in INTENT_MULT.items():
            if kind in by_kind:
                mult = F.when(intent == name, F.lit(by_kind[kind])).otherwise(mult)
        value = F.lit(base) * mult
        out = F.when(t.contains(kind), value) if out is None else out.when(t.contains(kind), value)
    return out.otherwise(F.lit(0.0))


def age_band_match(query: Column, text: Column) -> Column:
    """0.12 where both name the same band only, -0.04 where they name opposite bands, else 0."""
    q, t = F.lower(query), F.lower(text)
    qa, qb, ca, cb = has_any(q, AGE_0_6), has_any(q, AGE_7_59), has_any(t, AGE_0_6), has_any(t, AGE_7_59)
    same = (qa & ca & ~cb) | (qb & cb & ~ca)
    wrong = (qa & cb & ~ca) | (qb & ca & ~cb)
    return F.when(same, 0.12).when(wrong, -0.04).otherwise(0.0)


def tier_of_text(text: Column) -> Column:
    """Severity tier whose phrases the text has; null where it has both or none."""
    t = F.lower(text)
    a, b = has_any(t, TIER_CRITICAL), has_any(t, TIER_SEVERE)
    return F.when(a & ~b, "critical").when(b & ~a, "clinical_severe")


def tier_of_chunk(page: Column, text: Column) -> Column:
    """Tier by page range, else by phrases."""
    out = F.lit(None).cast("string")
    for name, lo, hi in TIER_PAGES:
        out = F.when(page.between(lo, hi), name).otherwise(out)
    return F.coalesce(out, tier_of_text(text))


def tier_score(case_tier: Column, chunk_tier: Column) -> Column:
    """1 for the same tier, -1 for the other, 0 where either is unknown."""
    return F.when(case_tier.isNull() | chunk_tier.isNull(), 0.0).when(case_tier == chunk_tier, 1.0).otherwise(-1.0)


def metadata_score(relevance: Column, section: Column, age: Column, guideline: Column, tier: Column, baseline: Column) -> Column:
    """Weighted sum of the relevance and what is known of the chunk."""
    return 0.65 * relevance + 0.10 * section + 0.05 * age + 0.05 * guideline + 0.15 * tier + 0.05 * baseline


def force_candidates(ranked: DataFrame, forced: DataFrame) -> DataFrame:
    """Ranked (qid, chunk_id, score) plus the forced (qid, chunk_id) that it missed, at score 0."""
    extra = forced.join(ranked.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    return ranked.select("qid", "chunk_id", "score").unionByName(extra.select("qid", "chunk_id", "score"))


def top_up(ranked: DataFrame, k: int) -> DataFrame:
    """On-guideline rows (`own`), and where they are fewer than k the best others up to k."""
    side = Window.partitionBy("qid", "own").orderBy(F.round("score", 9).desc(), "chunk_id")
    n_own = F.sum(F.col("own").cast("int")).over(Window.partitionBy("qid"))
    return ranked.withColumn("_n", F.row_number().over(side)).withColumn("_own", n_own).where(F.col("own") | (F.col("_n") <= k - F.col("_own"))).drop("_n", "_own")


def retrieval_groups(chunks: DataFrame) -> DataFrame:
    """(chunk_id, group_key): a page's recommendation takes in its supporting chunks.

    With several recommendations on a page, a chunk joins one only where its
    subsection matches that one alone; tables and pages below 0 stay single.
    """
    paged = chunks.where("page >= 0")
    recs = paged.where("recommendation_id <> ''").groupBy("source", "page").agg(F.count_distinct("recommendation_id").alias("n_recs"), F.min("recommendation_id").alias("only_rec"))
    by_sub = paged.where("recommendation_id <> ''").groupBy("source", "page", "subsection").agg(F.count_distinct("recommendation_id").alias("n_sub"), F.min("recommendation_id").alias("sub_rec"))
    c = chunks.join(recs, ["source", "page"], "left").join(by_sub, ["source", "page", "subsection"], "left")
    plain = (F.col("recommendation_id") == "") & (F.col("chunk_type") != "table") & (F.col("page") >= 0)
    rec = (
        F.when((F.col("recommendation_id") != "") & (F.col("page") >= 0), F.col("recommendation_id"))
        .when(plain & (F.col("n_recs") == 1), F.col("only_rec"))
        .when(plain & (F.col("n_sub") == 1) & (F.coalesce("subsection", F.lit("")) != ""), F.col("sub_rec"))
    )
    key = F.concat("source", F.lit("_pg"), F.col("page").cast("string"), F.lit("_"), rec)
    return c.select("chunk_id", F.coalesce(key, F.col("chunk_id")).alias("group_key"))


def group_best(scored: DataFrame, groups: DataFrame, pool: int) -> DataFrame:
    """Best member of each group, and of these the best `pool` of each query."""
    in_group = top_k(scored.join(groups, "chunk_id"), 1, by=("qid", "group_key")).drop("rank")
    return top_k(in_group, pool)


def group_expand(chosen: DataFrame, groups: DataFrame) -> DataFrame:
    """Every member of a chosen group, with the group's rank."""
    keyed = chosen.join(groups, "chunk_id").select("qid", F.col("rank").alias("group_rank"), "group_key")
    return keyed.join(groups, "group_key").select("qid", "group_rank", "chunk_id").distinct()


def siblings(chosen: DataFrame, chunks: DataFrame, most: int = 2) -> DataFrame:
    """Up to `most` chunks per chosen one on its page with its subsection, not chosen yet: 0.8 of its score, group_rank 0."""
    c = chunks.select("chunk_id", "source", "page", "subsection")
    here = chosen.select("qid", "chunk_id", "score").join(c, "chunk_id").withColumnRenamed("chunk_id", "seed")
    near = here.join(c, ["source", "page", "subsection"]).where(F.col("seed") != F.col("chunk_id")).join(chosen.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    w = Window.partitionBy("qid", "seed").orderBy("chunk_id")
    near = near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return near.groupBy("qid", "chunk_id").agg(F.round(F.max(F.col("score") * 0.8), 6).alias("score")).withColumn("group_rank", F.lit(0))


def mmr(pool: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over each query's bounded pool (qid, chunk_id, score, chunk_text).

    Greedy: weight * score (min-max over the pool) less (1 - weight) * the
    largest Jaccard overlap of words with what is chosen. A pool of k or fewer
    comes back in score order. The pool must hold at most pool_size(k) rows a query.
    """
    import pandas as pd

    slim = pool.select("qid", "chunk_id", "score", words_at_least("chunk_text", 4).alias("words"))
    bound = pool_size(k)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > bound:
            raise ValueError(f"pool of {len(pdf)} rows; at most {bound} are allowed")
        pdf = pdf.assign(_s=pdf["score"].round(9)).sort_values(["_s", "chunk_id"], ascending=[False, True])
        left = [(c, s, set(w)) for c, s, w in zip(pdf["chunk_id"], pdf["score"], pdf["words"])]
        lo, hi = pdf["score"].min(), pdf["score"].max()
        span = (hi - lo) or 1.0
        chosen = [left.pop(0)] if len(left) > k else left
        while len(pdf) > k and len(chosen) < k and left:

            def value(x):
                overlap = max((len(x[2] & y[2]) / len(x[2] | y[2]) if x[2] and y[2] else 0.0) for y in chosen)
                return weight * (x[1] - lo) / span - (1 - weight) * overlap

            chosen.append(left.pop(max(range(len(left)), key=lambda i: (value(left[i]), -i))))
        return pd.DataFrame([(pdf["qid"].iloc[0], c, s, n) for n, (c, s, _) in enumerate(chosen, 1)], columns=["qid", "chunk_id", "score", "rank"])

    kind = slim.schema["qid"].dataType.simpleString()
    return slim.groupBy("qid").applyInPandas(pick, f"qid {kind}, chunk_id string, score double, rank int")


def coverage_swap(chosen: DataFrame, pool: DataFrame, swaps: int = 2) -> DataFrame:
    """Up to `swaps` times a baseline section not yet present takes the place of the lowest-scored pick that is no baseline.

    chosen (qid, chunk_id, score, rank); pool (qid, chunk_id, score, section,
    baseline), bounded per query.
    """
    import pandas as pd

    flags = pool.join(chosen.select("qid", "chunk_id", "rank"), ["qid", "chunk_id"], "left")

    def swap(pdf: pd.DataFrame) -> pd.DataFrame:
        picks = pdf[pdf["rank"].notna()].sort_values("rank").to_dict("records")
        seen = {p["section"] for p in picks if p["baseline"]}
        rest = pdf[pdf["rank"].isna() & pdf["baseline"]].sort_values(["score", "chunk_id"], ascending=[False, True]).to_dict("records")
        done = 0
        for r in rest:
            plain = [p for p in picks if not p["baseline"]]
            if done == swaps or not plain:
                break
            if r["section"] in seen:
                continue
            worst = min(plain, key=lambda p: (p["score"], -p["rank"]))
            picks[picks.index(worst)] = {**r, "rank": worst["rank"]}
            seen.add(r["section"])
            done += 1
        return pd.DataFrame([(p["qid"], p["chunk_id"], p["score"], int(p["rank"])) for p in picks], columns=["qid", "chunk_id", "score", "rank"])

    kind = chosen.schema["qid"].dataType.simpleString()
    return flags.select("qid", "chunk_id", "score", "section", "baseline", "rank").groupBy("qid").applyInPandas(swap, f"qid {kind}, chunk_id string, score double, rank int")
