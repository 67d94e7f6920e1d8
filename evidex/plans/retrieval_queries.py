"""Queries: candidate generation, fusion and re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import query as Q
from evidex.functions.text import has_any, tokens
from evidex.operators import fusion as X
from evidex.operators import retrieval as R
from evidex.operators.lists import opened
from evidex.plans.registry import query, sql_list
from evidex.sources import views as V
from evidex.sources.tables import stored, table

#: Phrases that mark a chunk as baseline on the given invented texts.
BASELINE = ("the the", "thnt", "tion of")

POSTINGS = "v_post AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM (SELECT chunk_id, regexp_extract_all(lower(chunk_text), '[a-z0-9]+') AS t FROM v_chunks)) GROUP BY chunk_id, term)"
IDF = """v_size AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(chunk_text), '[a-z0-9]+'))) AS avgdl FROM v_chunks),
  v_raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM v_size) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM v_post GROUP BY term),
  v_idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM v_raw) ELSE raw END AS idf FROM v_raw)"""
BM25 = f"""{POSTINGS}, {IDF}, v_qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM v_queries) GROUP BY qid, term),
  v_bm AS (SELECT qid, chunk_id, sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM v_size))))) AS score FROM v_qt JOIN v_post USING (term) JOIN v_idf USING (term) GROUP BY qid, chunk_id)"""


def ranked_sql(src: str, k: int, by: str = "qid", tie: str = "chunk_id", cols: str = "*") -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC, {tie}) AS rank FROM ({src})) WHERE rank <= {k}"


BMTOP = f"v_top AS ({ranked_sql('SELECT * FROM v_bm', 10)})"


@query("bm25_index", f"WITH {POSTINGS}, {IDF} SELECT term, df, round(idf, 6) AS idf FROM v_idf")
def bm25_index(spark, sf):
    return V.index(spark, sf).terms().select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", f"WITH {BM25}, {BMTOP} SELECT qid, chunk_id, rank, round(score / max(score) OVER (PARTITION BY qid), 6) AS score FROM v_top WHERE score > 0")
def bm25_topk(spark, sf):
    return R.normalised(V.index(spark, sf).search(V.queries(spark, sf), 10)).select("qid", "chunk_id", "rank", "score")


def vector_tables(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return e.where("id % 25 = 0").select(F.col("id").alias("qid"), "vec"), e


COS = """v_cos AS (SELECT q.vec_id AS qid, e.vec_id AS vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / greatest(1e-10, sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 9) AS score
  FROM (SELECT * FROM embeddings WHERE vec_id % 25 = 0) q, embeddings e)"""


@query("dense_topk", f"WITH {COS} {ranked_sql('SELECT * FROM v_cos', 10, tie='vec_id', cols='qid, vec_id, rank, round(score, 6) AS score')}")
def dense_topk(spark, sf):
    return R.dense_topk(*vector_tables(spark, sf)).select("qid", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("ann_ivf_topk")
def ann_ivf_topk(spark, sf):
    queries, vectors = vector_tables(spark, sf)
    return opened(spark, table(spark, sf, "embeddings"), lambda: vectors).search(queries, 10).select("qid", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("guideline_mask", f"WITH {BM25} {ranked_sql('SELECT b.* FROM v_bm b JOIN v_chunks c USING (chunk_id) JOIN v_queries q USING (qid) WHERE c.source = q.guideline', 10, cols='qid, chunk_id, rank, round(score, 6) AS score')}")
def guideline_mask(spark, sf):
    return V.index(spark, sf).search(V.queries(spark, sf), 10, own_guideline=True).select("qid", "chunk_id", "rank", F.round("score", 6).alias("score"))


KEYWORD = """v_kw AS (SELECT qid, guideline, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM v_queries),
  v_kh AS (SELECT qid, chunk_id, count(*) AS points FROM (SELECT * FROM v_kw WHERE length(w) >= 4) k JOIN v_chunks c ON contains(lower(c.chunk_text), k.w) GROUP BY qid, chunk_id),
  v_ks AS (SELECT q.qid, c.chunk_id, (coalesce(points, 0) + CASE WHEN c.source = q.guideline THEN 2 ELSE 0 END)::DOUBLE AS score FROM v_queries q CROSS JOIN v_chunks c LEFT JOIN v_kh h ON h.qid = q.qid AND h.chunk_id = c.chunk_id)"""


@query("keyword_fallback", f"WITH {KEYWORD} {ranked_sql('SELECT * FROM v_ks WHERE score > 0', 5, cols='qid, chunk_id, rank, round(score / 10, 4) AS score')}")
def keyword_fallback(spark, sf):
    return R.keyword_search(V.queries(spark, sf), V.stored_chunks(spark, sf), 5)


@query("offline_search", f"WITH {KEYWORD} {ranked_sql('SELECT * FROM v_ks WHERE score > 0', 3, cols='qid, chunk_id, rank, round(score / 10, 4) AS score')}")
def offline_search(spark, sf):
    return R.keyword_search(V.queries(spark, sf), V.stored_chunks(spark, sf), 3)


@query(
    "keyword_boost",
    """WITH v_terms AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM v_queries),
      v_kwd AS (SELECT chunk_id, chunk_text, len(list_distinct(regexp_extract_all(chunk_text, '[a-z0-9]{4,}'))) AS n_kw FROM v_chunks),
      v_pts AS (SELECT qid, chunk_id, sum(n_kw) AS n FROM v_kwd JOIN v_terms ON contains(chunk_text, term) GROUP BY qid, chunk_id),
      v_all AS (SELECT q.qid, c.chunk_id, CASE WHEN source = 'EN' THEN coalesce(n, 0) * 2.5 + 2 ELSE coalesce(n, 0) * 0.8 END::DOUBLE AS score
        FROM (SELECT DISTINCT qid FROM v_terms) q CROSS JOIN v_chunks c LEFT JOIN v_pts p ON p.qid = q.qid AND p.chunk_id = c.chunk_id)
      """
    + ranked_sql("SELECT * FROM v_all WHERE score > 0", 4, cols="qid, chunk_id, rank, round(score, 6) AS score"),
)
def keyword_boost(spark, sf):
    terms = V.queries(spark, sf).select("qid", F.explode(tokens("text")).alias("term")).distinct()
    c = V.stored_chunks(spark, sf).withColumn("keywords", R.chunk_keywords())
    return R.keyword_boost(terms, c, "EN").select("qid", "chunk_id", "rank", F.round("score", 6).alias("score"))


def intent_sql(col: str) -> str:
    counts = {n: f"len(list_filter({sql_list(p)}, lambda p: contains({col}, p)))" for n, p in Q.INTENTS.items()}
    most = f"greatest({', '.join(counts.values())})"
    return f"CASE WHEN {most} = 0 THEN 'other' " + " ".join(f"WHEN {c} = {most} THEN '{n}'" for n, c in counts.items()) + " END"


#: Texts in which clinical phrases occur, made from the events' fields.
CLINICAL = "v_clin AS (SELECT event_id AS qid, ['what is the dose of ampicillin and gentamicin', 'monitor crp and repeat blood culture', 'risk factor gbs rom and iap plus fever', 'compare nice versus who regimen', 'newborn day 3 early-onset sepsis', 'young infant day 14 psbi critical illness', 'recommendation a.2 for neonate', 'overview'][event_id % 8 + 1] || ' ' || event_type AS text FROM events)"
_CLIN = ("what is the dose of ampicillin and gentamicin", "monitor crp and repeat blood culture", "risk factor gbs rom and iap plus fever", "compare nice versus who regimen", "newborn day 3 early-onset sepsis", "young infant day 14 psbi critical illness", "recommendation a.2 for neonate", "overview")


def clinical(spark, sf):
    pick = F.element_at(F.array(*[F.lit(x) for x in _CLIN]), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf, "events").select(F.col("event_id").alias("qid"), F.concat(pick, F.lit(" "), "event_type").alias("text"), "event_type")


@query("query_intent", f"WITH {CLINICAL} SELECT qid, {intent_sql('lower(text)')} AS intent FROM v_clin")
def query_intent(spark, sf):
    return clinical(spark, sf).select("qid", Q.intent(F.col("text")).alias("intent"))


@query(
    "adaptive_k",
    f"""WITH {CLINICAL} SELECT qid, CASE WHEN len(list_filter({sql_list(Q.CROSS_TERMS)}, lambda p: contains(lower(text), p))) >= 2 THEN 25
      WHEN len(list_filter({sql_list(Q.MULTI_TERMS)}, lambda p: contains(lower(text), p))) >= 2 OR i IN ('risk_assessment', 'monitoring') THEN 20 WHEN i = 'treatment' THEN 15 ELSE 10 END AS k
      FROM (SELECT *, {intent_sql('lower(text)')} AS i FROM v_clin)""",
)
def adaptive_k(spark, sf):
    return clinical(spark, sf).select("qid", Q.adaptive_k(F.col("text"), Q.intent(F.col("text")), 10).alias("k"))


def _expand_sql() -> str:
    parts = []
    for cluster in Q.SYNONYMS:
        hits = [f"contains(l, '{t}')" if " " in t or ":" in t else f"regexp_matches(l, '\\b{t}\\b')" for t in cluster]
        parts.append(f"CASE WHEN {' OR '.join(hits)} THEN {sql_list(cluster)} ELSE [] END")
    flat = f"flatten([{', '.join(parts)}])"
    return f"""WITH {CLINICAL}, v_d AS (SELECT DISTINCT text FROM v_clin), v_x AS (SELECT text, list_filter({flat}, lambda t: NOT list_contains(s, t))[1:12] AS extra FROM (SELECT text, lower(text) AS l, regexp_extract_all(lower(text), '[a-z0-9:]+') AS s FROM v_d))
      SELECT text, CASE WHEN len(extra) = 0 THEN text ELSE text || ' ' || array_to_string(extra, ' ') END AS expanded FROM v_x"""


@query("expand_query", _expand_sql())
def expand_query(spark, sf):
    return clinical(spark, sf).select("text").distinct().select("text", Q.expand(F.col("text")).alias("expanded"))


@query("subquery_fanout", f"WITH {CLINICAL}, v_r AS (SELECT qid, text, CASE qid % 4 WHEN 0 THEN 'rewrite' WHEN 1 THEN 'decompose' WHEN 2 THEN 'HyDE' ELSE 'bad' END AS action, CASE WHEN qid % 3 = 0 THEN [] ELSE string_split(text, ' ') END AS subs FROM v_clin) SELECT qid, CASE WHEN action = 'bad' THEN 'pass_through' ELSE action END AS action, unnest(CASE WHEN len(subs) = 0 THEN [trim(text)] WHEN action = 'decompose' THEN subs[1:5] ELSE subs END) AS sub_query FROM v_r")
def subquery_fanout(spark, sf):
    c = clinical(spark, sf).withColumn("raw", F.element_at(F.array(*[F.lit(x) for x in ("rewrite", "decompose", "HyDE", "bad")]), (F.col("qid") % 4 + 1).cast("int")))
    c = c.withColumn("subs", F.when(F.col("qid") % 3 == 0, F.array().cast("array<string>")).otherwise(F.split("text", " ")))
    action = F.when(F.col("raw").isin("rewrite", "decompose", "HyDE"), F.col("raw")).otherwise("pass_through")
    subs = F.when(F.size("subs") == 0, F.array(F.trim("text"))).when(F.col("raw") == "decompose", F.slice("subs", 1, 5)).otherwise(F.col("subs"))
    return c.select("qid", action.alias("action"), F.explode(subs).alias("sub_query"))


@query(
    "widened_queries",
    f"""WITH {BM25}, v_att AS (SELECT qid, 1 AS attempt, chunk_id FROM v_bm WHERE score > 60 UNION ALL SELECT qid, 2, chunk_id FROM v_bm WHERE score > 30 UNION ALL SELECT qid, 3, chunk_id FROM v_bm WHERE score > 10),
      v_first AS (SELECT qid, min(attempt) AS attempt FROM v_att GROUP BY qid) SELECT qid, attempt, count(*) AS n FROM v_att JOIN v_first USING (qid, attempt) GROUP BY qid, attempt""",
)
def widened_queries(spark, sf):
    tries = V.index(spark, sf).counts(V.queries(spark, sf), {1: 60.0, 2: 30.0, 3: 10.0})
    first = tries.groupBy("qid").agg(F.min("attempt").alias("attempt"))
    return tries.join(first, ["qid", "attempt"]).select("qid", "attempt", "n")


# fusion ---------------------------------------------------------------------------------------

LISTS = f"""{BM25}, {KEYWORD}, v_l1 AS ({ranked_sql('SELECT * FROM v_bm', 10)}), v_l2 AS ({ranked_sql('SELECT * FROM v_ks WHERE score > 0', 10)}),
  v_lists AS (SELECT qid, 'bm25' AS list, chunk_id, rank FROM v_l1 UNION ALL SELECT qid, 'keyword', chunk_id, rank FROM v_l2),
  v_rrf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM v_lists GROUP BY qid, chunk_id))"""


def bm25_list(spark, sf):
    return V.index(spark, sf).search(V.queries(spark, sf), 10).select("qid", F.lit("bm25").alias("list"), "chunk_id", "rank")


def lists(spark, sf):
    b = R.keyword_search(V.queries(spark, sf), V.stored_chunks(spark, sf), 10).select("qid", F.lit("keyword").alias("list"), "chunk_id", "rank")
    return bm25_list(spark, sf).unionByName(b)


@query("rrf_fuse", f"WITH {LISTS} SELECT qid, chunk_id, rank, round(score, 6) AS score FROM v_rrf")
def rrf_fuse(spark, sf):
    return X.rrf(lists(spark, sf)).select("qid", "chunk_id", "rank", F.round("score", 6).alias("score"))


OVERLAP = f"""{LISTS}, v_pair AS (SELECT r.qid, r.chunk_id, r.rank, coalesce(sum(i.idf) FILTER (WHERE p.chunk_id IS NOT NULL), 0) / sum(i.idf) AS rel
  FROM v_rrf r JOIN v_qt t USING (qid) JOIN v_idf i USING (term) LEFT JOIN v_post p ON p.chunk_id = r.chunk_id AND p.term = t.term GROUP BY r.qid, r.chunk_id, r.rank)"""


def pair_scores(spark, sf):
    """Share of the query's idf weight that the chunk covers, for fused candidates."""
    q, c = V.queries(spark, sf), V.stored_chunks(spark, sf)
    return R.term_share(X.rrf(lists(spark, sf)).select("qid", "chunk_id", "rank"), q, c, V.index(spark, sf).terms())


@query("pair_score", f"WITH {OVERLAP} SELECT qid, chunk_id, round(coalesce(rel, 1 - 0.01 * (rank - 1)), 6) AS score FROM v_pair")
def pair_score(spark, sf):
    return pair_scores(spark, sf).select("qid", "chunk_id", F.round(F.coalesce("rel", 1 - 0.01 * (F.col("rank") - 1)), 6).alias("score"))


def section_sql(kind: str, intent: str) -> str:
    cases = []
    for k, base in X.SECTION_SCORE:
        mult = "CASE " + " ".join(f"WHEN {intent} = '{n}' THEN {m[k]}::DOUBLE" for n, m in X.INTENT_MULT.items() if k in m) + " ELSE 1.0::DOUBLE END"
        if not any(k in m for m in X.INTENT_MULT.values()):
            mult = "1.0::DOUBLE"
        cases.append(f"WHEN contains(lower({kind}), '{k}') THEN {base}::DOUBLE * ({mult})")
    return f"CASE {' '.join(cases)} ELSE 0.0::DOUBLE END"


@query("section_weight", f"WITH {CLINICAL}, v_i AS (SELECT DISTINCT {intent_sql('lower(text)')} AS intent FROM v_clin) SELECT chunk_type, intent, round({section_sql('chunk_type', 'intent')}, 6) AS weight FROM (SELECT DISTINCT chunk_type FROM v_chunks), v_i")
def section_weight(spark, sf):
    kinds = V.stored_chunks(spark, sf).select("chunk_type").distinct()
    intents = clinical(spark, sf).select(Q.intent(F.col("text")).alias("intent")).distinct()
    return kinds.crossJoin(F.broadcast(intents)).select("chunk_type", "intent", F.round(X.section_weight(F.col("chunk_type"), F.col("intent")), 6).alias("weight"))


def any_sql(col: str, pats) -> str:
    return f"len(list_filter({sql_list(pats)}, lambda p: contains({col}, p))) > 0"


@query(
    "age_band_match",
    f"""WITH {CLINICAL}, v_d AS (SELECT DISTINCT text FROM v_clin), v_f AS (SELECT a.text AS query, b.text AS chunk, {any_sql('a.text', X.AGE_0_6)} AS qa, {any_sql('a.text', X.AGE_7_59)} AS qb, {any_sql('b.text', X.AGE_0_6)} AS ca, {any_sql('b.text', X.AGE_7_59)} AS cb FROM v_d a, v_d b)
      SELECT query, chunk, CASE WHEN qa AND ca AND NOT cb OR qb AND cb AND NOT ca THEN 0.12 WHEN qa AND cb AND NOT ca OR qb AND ca AND NOT cb THEN -0.04 ELSE 0.0 END::DOUBLE AS score FROM v_f""",
)
def age_band_match(spark, sf):
    """The score of every query with every chunk text."""
    d = clinical(spark, sf).select("text").distinct()
    both = d.select(F.col("text").alias("query")).crossJoin(d.select(F.col("text").alias("chunk")))
    return both.select("query", "chunk", X.age_band_match(F.col("query"), F.col("chunk")).alias("score"))


def tier_sql(col: str) -> str:
    a, b = any_sql(col, X.TIER_CRITICAL), any_sql(col, X.TIER_SEVERE)
    return f"CASE WHEN {a} AND NOT {b} THEN 'critical' WHEN {b} AND NOT {a} THEN 'clinical_severe' END"


@query(
    "severity_tier",
    f"""WITH {CLINICAL} SELECT qid, coalesce(CASE WHEN qid % 20 BETWEEN 1 AND 8 THEN 'critical' WHEN qid % 20 BETWEEN 9 AND 13 THEN 'clinical_severe' END, {tier_sql('text')}) AS tier,
      CASE WHEN t IS NULL OR c IS NULL THEN 0.0 WHEN t = c THEN 1.0 ELSE -1.0 END::DOUBLE AS score FROM (SELECT *, coalesce(CASE WHEN qid % 20 BETWEEN 1 AND 8 THEN 'critical' WHEN qid % 20 BETWEEN 9 AND 13 THEN 'clinical_severe' END, {tier_sql('text')}) AS t,
      CASE WHEN qid % 3 = 0 THEN 'critical' WHEN qid % 3 = 1 THEN 'clinical_severe' END AS c FROM v_clin)""",
)
def severity_tier(spark, sf):
    c = clinical(spark, sf).withColumn("tier", X.tier_of_chunk(F.col("qid") % 20, F.col("text")))
    case = F.when(F.col("qid") % 3 == 0, "critical").when(F.col("qid") % 3 == 1, "clinical_severe")
    return c.select("qid", "tier", X.tier_score(case, F.col("tier")).alias("score"))


@query("baseline_flag", f"SELECT chunk_id, {any_sql('chunk_text', BASELINE)} AS baseline FROM v_chunks")
def baseline_flag(spark, sf):
    return V.stored_chunks(spark, sf).select("chunk_id", has_any(F.col("chunk_text"), BASELINE).alias("baseline"))


def age_sql(query: str, chunk: str) -> str:
    qa, qb, ca, cb = any_sql(query, X.AGE_0_6), any_sql(query, X.AGE_7_59), any_sql(chunk, X.AGE_0_6), any_sql(chunk, X.AGE_7_59)
    return f"CASE WHEN {qa} AND {ca} AND NOT {cb} OR {qb} AND {cb} AND NOT {ca} THEN 0.12::DOUBLE WHEN {qa} AND {cb} AND NOT {ca} OR {qb} AND {ca} AND NOT {cb} THEN -0.04::DOUBLE ELSE 0.0::DOUBLE END"


SCORED = f"""{OVERLAP}, v_sq AS (SELECT qid, lower(coalesce(text, '')) AS l, {intent_sql("lower(coalesce(text, ''))")} AS intent, {tier_sql("lower(coalesce(text, ''))")} AS qt FROM v_queries),
  v_st AS (SELECT *, coalesce(CASE WHEN page BETWEEN 1 AND 8 THEN 'critical' WHEN page BETWEEN 9 AND 13 THEN 'clinical_severe' END, {tier_sql('chunk_text')}) AS ct FROM v_chunks),
  v_sc AS (SELECT p.qid, p.chunk_id, c.source = 'EN' AS own, c.chunk_type AS section, {any_sql('c.chunk_text', BASELINE)} AS baseline, c.chunk_text,
  round(0.65 * rel + 0.10 * ({section_sql('c.chunk_type', 'q.intent')}) + 0.05 * ({age_sql('q.l', 'c.chunk_text')}) + 0.05 * CASE WHEN c.source = 'EN' THEN 0.15 ELSE 0 END
    + 0.15 * CASE WHEN qt IS NULL OR ct IS NULL THEN 0.0 WHEN qt = ct THEN 1.0 ELSE -1.0 END + 0.05 * CASE WHEN {any_sql('c.chunk_text', BASELINE)} THEN 1 ELSE 0 END, 9)::DOUBLE AS score FROM v_pair p JOIN v_st c USING (chunk_id) JOIN v_sq q ON q.qid = p.qid)"""


def scored(spark, sf):
    """Fused candidates with their metadata score: relevance, section by the query's intent, age band, guideline, tier and baseline."""
    text = F.coalesce("text", F.lit(""))
    q = V.queries(spark, sf).select("qid", text.alias("_text"), Q.intent(text).alias("_intent"))
    told = pair_scores(spark, sf)
    p = told.join(R.named(V.stored_chunks(spark, sf), told), "chunk_id").join(q, "qid")
    own, base = F.col("source") == "EN", has_any(F.col("chunk_text"), BASELINE)
    age = X.age_band_match(F.col("_text"), F.col("chunk_text"))
    tier = X.tier_score(X.tier_of_text(F.col("_text")), X.tier_of_chunk(F.col("page"), F.col("chunk_text")))
    score = X.metadata_score(F.col("rel"), X.section_weight(F.col("chunk_type"), F.col("_intent")), age, F.when(own, 0.15).otherwise(0.0), tier, F.when(base, 1.0).otherwise(0.0))
    return stored(p.select("qid", "chunk_id", own.alias("own"), F.col("chunk_type").alias("section"), base.alias("baseline"), "chunk_text", F.round(score, 9).alias("score")))


@query("metadata_score", f"WITH {SCORED} SELECT qid, chunk_id, round(score, 6) AS score FROM v_sc")
def metadata_score(spark, sf):
    return scored(spark, sf).select("qid", "chunk_id", F.round("score", 6).alias("score"))


@query("force_candidates", f"WITH {SCORED}, v_force AS (SELECT q.qid, c.chunk_id FROM v_queries q JOIN v_chunks c ON c.source = q.guideline WHERE {any_sql('c.chunk_text', BASELINE)}) SELECT qid, chunk_id, round(score, 6) AS score FROM v_sc UNION ALL SELECT qid, chunk_id, 0.0 FROM v_force f WHERE NOT EXISTS (SELECT 1 FROM v_sc s WHERE s.qid = f.qid AND s.chunk_id = f.chunk_id)")
def force_candidates(spark, sf):
    c = V.stored_chunks(spark, sf).where(has_any(F.col("chunk_text"), BASELINE))
    forced = V.queries(spark, sf).join(c, F.col("source") == F.col("guideline")).select("qid", "chunk_id")
    return X.force_candidates(scored(spark, sf), forced).select("qid", "chunk_id", F.round("score", 6).alias("score"))


@query("filter_topup", f"WITH {SCORED}, v_n AS (SELECT *, row_number() OVER (PARTITION BY qid, own ORDER BY round(score, 9) DESC, chunk_id) AS n, sum(own::INT) OVER (PARTITION BY qid) AS n_own FROM v_sc) SELECT qid, chunk_id, own, round(score, 6) AS score FROM v_n WHERE own OR n <= 12 - n_own")
def filter_topup(spark, sf):
    return X.top_up(scored(spark, sf), 12).select("qid", "chunk_id", "own", F.round("score", 6).alias("score"))


GROUPS = """v_rp AS (SELECT source, page, count(DISTINCT recommendation_id) AS n_recs, min(recommendation_id) AS only_rec FROM v_chunks WHERE recommendation_id <> '' GROUP BY source, page),
  v_grp AS (SELECT chunk_id, coalesce(c.source || '_pg' || c.page || '_' || CASE WHEN recommendation_id <> '' THEN recommendation_id WHEN chunk_type <> 'table' AND n_recs = 1 THEN only_rec END, chunk_id) AS group_key FROM v_chunks c LEFT JOIN v_rp USING (source, page))"""


@query("retrieval_groups", f"WITH {GROUPS} SELECT * FROM v_grp")
def retrieval_groups(spark, sf):
    return X.retrieval_groups(V.stored_chunks(spark, sf))


BEST = f"{SCORED}, {GROUPS}, v_g1 AS ({ranked_sql('SELECT s.*, g.group_key FROM v_sc s JOIN v_grp g USING (chunk_id)', 1, by='qid, group_key', cols='* EXCLUDE (rank)')}), v_best AS ({ranked_sql('SELECT * FROM v_g1', 15)})"


def best_groups(spark, sf, pool=15):
    return stored(X.group_best(scored(spark, sf), X.retrieval_groups(V.stored_chunks(spark, sf)), pool))


@query("group_best", f"WITH {BEST} SELECT qid, chunk_id, group_key, rank, round(score, 6) AS score FROM v_best")
def group_best(spark, sf):
    return best_groups(spark, sf).select("qid", "chunk_id", "group_key", "rank", F.round("score", 6).alias("score"))


@query("mmr_select")
def mmr_select(spark, sf):
    return X.mmr(best_groups(spark, sf).select("qid", "chunk_id", "score", "chunk_text"), 5)


@query("coverage_swap")
def coverage_swap(spark, sf):
    pool = best_groups(spark, sf)
    return X.coverage_swap(pool.where("rank <= 5").select("qid", "chunk_id", "score", "rank"), pool.select("qid", "chunk_id", "score", "section", "baseline"))


@query("group_expand", f"WITH {BEST} SELECT DISTINCT b.qid, b.rank AS group_rank, g.chunk_id FROM v_best b JOIN v_grp g USING (group_key) WHERE b.rank <= 3")
def group_expand(spark, sf):
    return X.group_expand(best_groups(spark, sf).where("rank <= 3").drop("group_key"), X.retrieval_groups(V.stored_chunks(spark, sf)))


@query(
    "sibling_expand",
    f"""WITH {BEST}, v_ch AS (SELECT * FROM v_best WHERE rank <= 3), v_sib AS (SELECT h.qid, h.chunk_id AS seed, h.score, s.chunk_id, row_number() OVER (PARTITION BY h.qid, h.chunk_id ORDER BY s.chunk_id) AS n
        FROM v_ch h JOIN v_chunks c ON c.chunk_id = h.chunk_id JOIN v_chunks s ON s.source = c.source AND s.page = c.page AND s.subsection = c.subsection AND s.chunk_id <> c.chunk_id
        WHERE NOT EXISTS (SELECT 1 FROM v_ch x WHERE x.qid = h.qid AND x.chunk_id = s.chunk_id))
      SELECT qid, chunk_id, round(max(score * 0.8), 6) AS score, 0 AS group_rank FROM v_sib WHERE n <= 2 GROUP BY qid, chunk_id""",
)
def sibling_expand(spark, sf):
    return X.siblings(best_groups(spark, sf).where("rank <= 3").select("qid", "chunk_id", "score"), V.stored_chunks(spark, sf))


def arms(spark, sf, k=10):
    """The ranked lists of several arms: bm25, keyword, and both fused."""
    both = lists(spark, sf)
    fused = X.rrf(both).where(F.col("rank") <= k).select("qid", F.lit("hybrid").alias("arm"), "chunk_id", "rank")
    return both.select("qid", F.col("list").alias("arm"), "chunk_id", "rank").unionByName(fused)


@query("rank_to_score", f"WITH {BM25}, {BMTOP} SELECT qid, chunk_id, round(0.9 - 0.1 * rank, 6)::DOUBLE AS score FROM v_top WHERE rank <= 5")
def rank_to_score(spark, sf):
    t = V.index(spark, sf).search(V.queries(spark, sf), 5)
    return t.select("qid", "chunk_id", F.round(F.lit(0.9) - 0.1 * F.col("rank"), 6).alias("score"))
