"""Queries: evaluation metrics and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.operators import metrics as M
from evidex.operators.retrieval import cosine, named
from evidex.plans import retrieval_queries as RQ
from evidex.plans.registry import query
from evidex.sources import views as V
from evidex.sources.tables import stored, table


def hits(spark, sf):
    return M.phrase_hits(V.stored_chunks(spark, sf), V.phrases(spark, sf))


def gold(spark, sf, found=None):
    """Gold chunks from the phrase hits `found`, or from those of all chunks."""
    return stored(M.rebuild_gold(hits(spark, sf) if found is None else found, "EN"))


def cases(spark, sf):
    arms = spark.createDataFrame([("bm25",), ("keyword",), ("hybrid",)], "arm string")
    return V.queries(spark, sf).select("qid").crossJoin(F.broadcast(arms))


@query("gold_rebuild", "SELECT qid, chunk_id, hits FROM v_gold")
def gold_rebuild(spark, sf):
    return gold(spark, sf)


ARMS = f"{RQ.LISTS}, v_arms AS (SELECT qid, list AS arm, chunk_id, rank FROM v_lists UNION ALL SELECT qid, 'hybrid', chunk_id, rank FROM v_rrf WHERE rank <= 10), v_cases AS (SELECT qid, arm FROM v_queries, (SELECT unnest(['bm25', 'keyword', 'hybrid']) AS arm))"


def counts_sql(ret: str, gold_sql: str, key: str) -> str:
    return f"""SELECT c.qid, c.arm, coalesce(n_ret, 0) AS n_ret, coalesce(n_gold, 0) AS n_gold, coalesce(n_both, 0) AS n_both FROM v_cases c
      LEFT JOIN (SELECT qid, arm, count(DISTINCT {key}) AS n_ret FROM {ret} GROUP BY qid, arm) r ON r.qid = c.qid AND r.arm = c.arm
      LEFT JOIN (SELECT qid, count(DISTINCT {key}) AS n_gold FROM {gold_sql} GROUP BY qid) g ON g.qid = c.qid
      LEFT JOIN (SELECT a.qid, a.arm, count(DISTINCT a.{key}) AS n_both FROM {ret} a JOIN {gold_sql} b ON a.qid = b.qid AND a.{key} = b.{key} GROUP BY a.qid, a.arm) x ON x.qid = c.qid AND x.arm = c.arm"""


PRF = """SELECT qid, arm, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT qid, arm,
  CASE WHEN n_gold = 0 THEN CASE WHEN n_ret = 0 THEN 1.0 ELSE 0.0 END WHEN n_ret = 0 THEN 0.0 ELSE n_both / n_ret END::DOUBLE AS p,
  CASE WHEN n_gold = 0 THEN CASE WHEN n_ret = 0 THEN 1.0 ELSE 0.0 END ELSE n_both / n_gold END::DOUBLE AS r FROM ({counts}))"""


def rounded(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("prf_exact", f"WITH {ARMS} {PRF.format(counts=counts_sql('v_arms', 'v_gold', 'chunk_id'))}")
def prf_exact(spark, sf):
    out = M.prf(M.overlap_counts(RQ.arms(spark, sf), gold(spark, sf), cases(spark, sf), ["arm"]))
    return rounded(out.select("qid", "arm", "precision", "recall", "f1"), "precision", "recall", "f1")


PAGED = "v_apg AS (SELECT qid, arm, regexp_extract(chunk_id, '^(.*?_pg[0-9]+)_', 1) AS pk FROM v_arms), v_gpg AS (SELECT qid, regexp_extract(chunk_id, '^(.*?_pg[0-9]+)_', 1) AS pk FROM v_gold)"


@query("prf_section", f"WITH {ARMS}, {PAGED} {PRF.format(counts=counts_sql('v_apg', 'v_gpg', 'pk'))}")
def prf_section(spark, sf):
    from evidex.functions.text import page_key

    k = page_key(F.col("chunk_id")).alias("pk")
    out = M.prf(M.overlap_counts(RQ.arms(spark, sf).select("qid", "arm", k), gold(spark, sf).select("qid", k), cases(spark, sf), ["arm"], "pk"))
    return rounded(out.select("qid", "arm", "precision", "recall", "f1"), "precision", "recall", "f1")


MRR = "SELECT c.qid, c.arm, CASE WHEN NOT EXISTS (SELECT 1 FROM v_gold g WHERE g.qid = c.qid) THEN 'NaN'::DOUBLE ELSE coalesce(round(1.0 / (SELECT min(rank) FROM v_arms a JOIN v_gold g USING (qid, chunk_id) WHERE a.qid = c.qid AND a.arm = c.arm), 6), 0)::DOUBLE END AS mrr FROM v_cases c"


@query("mrr", f"WITH {ARMS} {MRR}")
def mrr(spark, sf):
    return rounded(M.mrr(RQ.arms(spark, sf), gold(spark, sf), cases(spark, sf), ["arm"]), "mrr")


NDCG = """SELECT qid, arm, round(CASE WHEN sum(rel / log2(ideal + 1)) > 0 THEN sum(rel / log2(rank + 1)) / sum(rel / log2(ideal + 1)) ELSE 0 END, 6) AS ndcg FROM (
  SELECT *, row_number() OVER (PARTITION BY qid, arm ORDER BY rel DESC, rank) AS ideal FROM (SELECT a.*, CASE WHEN g.chunk_id IS NULL THEN 0 ELSE 1 END AS rel FROM v_arms a LEFT JOIN v_gold g USING (qid, chunk_id))) GROUP BY qid, arm"""


@query("ndcg_at_k", f"WITH {ARMS} {NDCG}")
def ndcg_at_k(spark, sf):
    return rounded(M.ndcg(RQ.arms(spark, sf), gold(spark, sf), ["arm"]), "ndcg")


@query("anchor_hit", "WITH v_n AS (SELECT qid, count(*) AS n FROM v_phrases GROUP BY qid) SELECT h.qid, h.chunk_id, count(*) AS found, count(*) >= ceil(0.6 * any_value(n.n)) AS hit FROM v_hits h JOIN v_n n USING (qid) GROUP BY h.qid, h.chunk_id")
def anchor_hit(spark, sf):
    n = V.phrases(spark, sf).groupBy("qid").agg(F.count("*").alias("n"))
    h = hits(spark, sf).groupBy("qid", "chunk_id").agg(F.count("*").alias("found")).join(n, "qid")
    return h.select("qid", "chunk_id", "found", (F.col("found") >= F.ceil(F.lit(0.6) * F.col("n"))).alias("hit"))


@query("slots", f"WITH {ARMS}, v_s AS (SELECT qid, chunk_id, rank AS pos, CASE WHEN rank % 3 = 0 THEN 0 ELSE rank // 4 + 1 END AS group_rank FROM v_arms WHERE arm = 'bm25'), v_k AS (SELECT *, CASE WHEN group_rank > 0 THEN 'g' || group_rank ELSE 'p' || pos END AS k FROM v_s) SELECT qid, chunk_id, dense_rank() OVER (PARTITION BY qid ORDER BY f) AS slot FROM (SELECT *, min(pos) OVER (PARTITION BY qid, k) AS f FROM v_k)")
def slots(spark, sf):
    return M.slots(slot_rows(spark, sf)).select("qid", "chunk_id", "slot")


def slot_rows(spark, sf):
    r = RQ.bm25_list(spark, sf)
    return r.select("qid", "chunk_id", F.col("rank").alias("pos"), F.when(F.col("rank") % 3 == 0, 0).otherwise(F.floor(F.col("rank") / 4).cast("int") + 1).alias("group_rank"))


SLOTTED = f"""{ARMS}, v_s AS (SELECT qid, chunk_id, rank AS pos, CASE WHEN rank % 3 = 0 THEN 0 ELSE rank // 4 + 1 END AS group_rank FROM v_arms WHERE arm = 'bm25'), v_k AS (SELECT *, CASE WHEN group_rank > 0 THEN 'g' || group_rank ELSE 'p' || pos END AS k FROM v_s),
  v_slot AS (SELECT qid, chunk_id, dense_rank() OVER (PARTITION BY qid ORDER BY f) AS slot FROM (SELECT *, min(pos) OVER (PARTITION BY qid, k) AS f FROM v_k)),
  v_sh AS (SELECT s.qid, s.slot, s.chunk_id, g.chunk_id IS NOT NULL AS hit FROM v_slot s LEFT JOIN v_gold g USING (qid, chunk_id))"""


def slot_hits(spark, sf, gold):
    g = gold.select("qid", "chunk_id", F.lit(True).alias("g"))
    return M.slots(slot_rows(spark, sf)).join(g, ["qid", "chunk_id"], "left").select("qid", "slot", "chunk_id", F.coalesce("g", F.lit(False)).alias("hit"))


@query("prf_anchor", f"WITH {SLOTTED} SELECT qid, round(avg(h::INT), 6)::DOUBLE AS slot_precision, round(any_value(found) / greatest(any_value(n_gold), 1), 6)::DOUBLE AS key_recall FROM (SELECT qid, slot, bool_or(hit) AS h FROM v_sh GROUP BY qid, slot) JOIN (SELECT qid, count(DISTINCT chunk_id) FILTER (WHERE hit) AS found FROM v_sh GROUP BY qid) USING (qid) JOIN (SELECT q.qid, count(g.chunk_id) AS n_gold FROM v_queries q LEFT JOIN v_gold g USING (qid) GROUP BY q.qid) USING (qid) GROUP BY qid")
def prf_anchor(spark, sf):
    g = gold(spark, sf)
    s = slot_hits(spark, sf, g)
    n = V.queries(spark, sf).select("qid").join(g, "qid", "left").groupBy("qid").agg(F.count("chunk_id").alias("n_gold"))
    per = s.groupBy("qid", "slot").agg(F.bool_or("hit").alias("h")).groupBy("qid").agg(F.round(F.avg(F.col("h").cast("int")), 6).alias("slot_precision"))
    found = s.groupBy("qid").agg(F.count_distinct(F.when(F.col("hit"), F.col("chunk_id"))).alias("found"))
    return per.join(found, "qid").join(n, "qid").select("qid", "slot_precision", F.round(F.col("found") / F.greatest("n_gold", F.lit(1)), 6).alias("key_recall"))


@query("mrr_anchor", f"WITH {SLOTTED} SELECT qid, coalesce(round(1.0 / min(slot) FILTER (WHERE hit), 6), 0)::DOUBLE AS mrr FROM v_sh GROUP BY qid")
def mrr_anchor(spark, sf):
    return slot_hits(spark, sf, gold(spark, sf)).groupBy("qid").agg(F.coalesce(F.round(1.0 / F.min(F.when(F.col("hit"), F.col("slot"))), 6), F.lit(0.0)).alias("mrr"))


@query(
    "anchor_recall",
    f"""WITH {ARMS}, v_blob AS (SELECT qid, arm, string_agg(chunk_text, ' ' ORDER BY rank) AS blob FROM v_arms JOIN v_chunks USING (chunk_id) GROUP BY qid, arm)
      SELECT p.qid, b.arm, round(avg(CASE WHEN contains(b.blob, p.phrase) THEN 1 ELSE 0 END), 6)::DOUBLE AS anchor_recall FROM v_phrases p JOIN v_blob b USING (qid) GROUP BY p.qid, b.arm""",
)
def anchor_recall(spark, sf):
    found = stored(RQ.arms(spark, sf))
    rows = found.join(named(V.stored_chunks(spark, sf).select("chunk_id", "chunk_text"), found), "chunk_id")
    blob = rows.groupBy("qid", "arm").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_text"))), lambda x: x["chunk_text"]), " ").alias("blob"))
    j = V.phrases(spark, sf).join(blob, "qid")
    return j.groupBy("qid", "arm").agg(F.round(F.avg(F.col("blob").contains(F.col("phrase")).cast("int")), 6).alias("anchor_recall"))


@query("gold_audit", "SELECT q.qid, count(g.chunk_id) AS n_gold, count(DISTINCT h.chunk_id) AS n_supported FROM v_queries q LEFT JOIN v_gold g USING (qid) LEFT JOIN (SELECT DISTINCT qid, chunk_id FROM v_hits) h ON h.qid = g.qid AND h.chunk_id = g.chunk_id GROUP BY q.qid")
def gold_audit(spark, sf):
    found = stored(hits(spark, sf))
    h = found.select("qid", "chunk_id").distinct().withColumn("ok", F.lit(1))
    g = V.queries(spark, sf).select("qid").join(gold(spark, sf, found), "qid", "left").join(h, ["qid", "chunk_id"], "left")
    return g.groupBy("qid").agg(F.count("chunk_id").alias("n_gold"), F.count("ok").alias("n_supported"))


@query("metric_ceilings", "SELECT qid, k, round(least(k, n) / n, 6)::DOUBLE AS recall_ceiling, round(least(k, n) / k, 6)::DOUBLE AS precision_ceiling FROM (SELECT qid, count(*) AS n FROM v_gold GROUP BY qid), (SELECT unnest([1, 3, 5, 10]) AS k)")
def metric_ceilings(spark, sf):
    n = gold(spark, sf).groupBy("qid").agg(F.count("*").alias("n")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 10)])))
    low = F.least(F.col("k").cast("long"), F.col("n"))
    return n.select("qid", "k", F.round(low / F.col("n"), 6).alias("recall_ceiling"), F.round(low / F.col("k"), 6).alias("precision_ceiling"))


def case_metrics(spark, sf):
    """One row per case and arm with its retrieval metrics."""
    ret, g, c = RQ.arms(spark, sf), gold(spark, sf), cases(spark, sf)
    p = M.prf(M.overlap_counts(ret, g, c, ["arm"])).select("qid", "arm", "precision", "recall", "f1")
    return p.join(M.mrr(ret, g, c, ["arm"]), ["qid", "arm"])


CASE = f"{ARMS}, v_prf AS ({PRF.format(counts=counts_sql('v_arms', 'v_gold', 'chunk_id'))}), v_mrr AS ({MRR}), v_case AS (SELECT * FROM v_prf JOIN v_mrr USING (qid, arm))"


@query("retrieval_eval", f"WITH {CASE} SELECT arm, round(avg(recall), 5) AS recall, round(avg(f1), 5) AS f1, round(avg(mrr) FILTER (WHERE NOT isnan(mrr)), 5) AS mrr, count(*) AS n FROM v_case GROUP BY GROUPING SETS ((arm), ())")
def retrieval_eval(spark, sf):
    m = case_metrics(spark, sf)
    return m.rollup("arm").agg(F.round(F.avg("recall"), 5).alias("recall"), F.round(F.avg("f1"), 5).alias("f1"), F.round(F.avg(F.when(~F.isnan("mrr"), F.col("mrr"))), 5).alias("mrr"), F.count("*").alias("n"))


@query("group_means", f"WITH {CASE} SELECT arm, round(avg(mrr) FILTER (WHERE NOT isnan(mrr)), 4) AS mean_mrr FROM v_case GROUP BY arm")
def group_means(spark, sf):
    return case_metrics(spark, sf).groupBy("arm").agg(F.round(F.avg(F.when(~F.isnan("mrr"), F.col("mrr"))), 4).alias("mean_mrr"))


@query("arm_summary", f"WITH {CASE} SELECT arm, round(avg(recall), 5) AS mean_recall, round(stddev_samp(recall), 5) AS sd_recall, round(avg((recall > 0)::INT), 5) AS hit_rate FROM v_case GROUP BY arm")
def arm_summary(spark, sf):
    return case_metrics(spark, sf).groupBy("arm").agg(F.round(F.avg("recall"), 5).alias("mean_recall"), F.round(F.stddev_samp("recall"), 5).alias("sd_recall"), F.round(F.avg((F.col("recall") > 0).cast("int")), 5).alias("hit_rate"))


PAIRED = f"""{CASE}, v_d AS (SELECT a.arm AS arm_a, b.arm AS arm_b, round(a.mrr - b.mrr, 9) AS d FROM v_case a JOIN v_case b USING (qid) WHERE a.arm < b.arm AND NOT isnan(a.mrr) AND NOT isnan(b.mrr)),
  v_b AS (SELECT arm_a, arm_b, count(*) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd FROM v_d GROUP BY ALL),
  v_r AS (SELECT *, rank() OVER (PARTITION BY arm_a, arm_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY arm_a, arm_b, abs(d)) - 1) / 2.0::DOUBLE AS rk FROM v_d WHERE d <> 0),
  v_w AS (SELECT arm_a, arm_b, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS wm FROM v_r GROUP BY ALL),
  v_pair2 AS (SELECT arm_a, arm_b, n, mean_diff, CASE WHEN n >= 2 AND sd > 0 THEN sd END AS sd, wp, wm FROM v_b LEFT JOIN v_w USING (arm_a, arm_b))"""


def pairs_of_arms(spark, sf):
    return M.paired(case_metrics(spark, sf), "qid", "arm", "mrr")


@query("paired_compare", f"WITH {PAIRED} SELECT arm_a, arm_b, n, round(mean_diff, 6) AS mean_diff, round(mean_diff / (sd / sqrt(n)), 5) AS t, least(wp, wm) AS w FROM v_pair2")
def paired_compare(spark, sf):
    return pairs_of_arms(spark, sf).select("arm_a", "arm_b", "n", F.round("mean_diff", 6).alias("mean_diff"), F.round("t", 5).alias("t"), "w")


@query("paired_p")
def paired_p(spark, sf):
    p = pairs_of_arms(spark, sf).withColumn("p", M.normal_p(F.col("z"))).withColumn("family", F.lit("mrr"))
    return M.holm(p, ["family"]).select("arm_a", "arm_b", "z", "p", "p_holm")


@query("effect_sizes", f"WITH {PAIRED} SELECT arm_a, arm_b, round(mean_diff / sd, 5) AS d_z, round((wp - wm) / (wp + wm), 5) AS r_rb FROM v_pair2")
def effect_sizes(spark, sf):
    return pairs_of_arms(spark, sf).select("arm_a", "arm_b", F.round("d_z", 5).alias("d_z"), F.round("r_rb", 5).alias("r_rb"))


@query("holm_adjust", "SELECT family, id, round(least(1, max(s) OVER (PARTITION BY family ORDER BY p, id ROWS UNBOUNDED PRECEDING)), 6)::DOUBLE AS p_holm FROM (SELECT *, p * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, id) + 1) AS s FROM (SELECT user_id AS family, event_id AS id, value / 50000 + event_id / 1e12 AS p FROM events))")
def holm_adjust(spark, sf):
    p = table(spark, sf, "events").select(F.col("user_id").alias("family"), F.col("event_id").alias("id"), (F.col("value") / 50000 + F.col("event_id") / F.lit(1e12)).alias("p"))
    return rounded(M.holm(p, ["family"]).select("family", "id", "p_holm"), "p_holm")


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    m = case_metrics(spark, sf).where(~F.isnan("mrr"))
    wide = m.groupBy("qid").pivot("arm", ["bm25", "hybrid"]).agg(F.max("mrr"))
    return M.bootstrap_ci(wide.select("qid", (F.col("hybrid") - F.col("bm25")).alias("d")), "d", "qid")


@query("rate_by_arm", "SELECT event_type AS arm, round(avg((value > 100)::INT), 6) AS verified, round(avg(event_id % 4), 6) AS mean_steps, round(avg((value < 5)::INT), 6) AS incomplete FROM events GROUP BY event_type")
def rate_by_arm(spark, sf):
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("arm")).agg(share(F.col("value") > 100).alias("verified"), F.round(F.avg(F.col("event_id") % 4), 6).alias("mean_steps"), share(F.col("value") < 5).alias("incomplete"))


@query("backbone_pivot", "SELECT source AS backbone, round(avg(n_chars) FILTER (WHERE lang = 'de'), 4) AS de, round(avg(n_chars) FILTER (WHERE lang = 'en'), 4) AS en, round(avg(n_chars) FILTER (WHERE lang = 'es'), 4) AS es, round(avg(n_chars) FILTER (WHERE lang = 'fr'), 4) AS fr FROM documents GROUP BY source")
def backbone_pivot(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("backbone")).pivot("lang", ["de", "en", "es", "fr"]).agg(F.round(F.avg("n_chars"), 4))


def gram_sql() -> str:
    def grams(col: str, out: str) -> str:
        return f"SELECT pair_id, n, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i : i + n - 1], ' '))) AS g FROM (SELECT pair_id, t, unnest([1, 2, 3, 4]) AS n FROM (SELECT pair_id, regexp_extract_all(lower({col}), '[a-z0-9]+') AS t FROM v_text_pairs)) WHERE len(t) >= n"

    return f"""v_cg AS (SELECT pair_id, n, g, count(*) AS c FROM ({grams('candidate', 'c')}) GROUP BY ALL), v_rg AS (SELECT pair_id, n, g, count(*) AS r FROM ({grams('reference', 'r')}) GROUP BY ALL),
      v_ng AS (SELECT pair_id, n, sum(least(c, coalesce(r, 0))) AS clipped, sum(c) AS total FROM v_cg LEFT JOIN v_rg USING (pair_id, n, g) GROUP BY pair_id, n),
      v_len AS (SELECT pair_id, len(regexp_extract_all(lower(candidate), '[a-z0-9]+')) AS c, len(regexp_extract_all(lower(reference), '[a-z0-9]+')) AS r FROM v_text_pairs)"""


@query(
    "sentence_bleu",
    f"""WITH {gram_sql()}, v_l AS (SELECT pair_id, n, ln(CASE WHEN clipped = 0 THEN 1.0 / (2.0 * total) ELSE clipped / total END) AS l, clipped FROM v_ng),
      v_a AS (SELECT pair_id, CASE WHEN count(*) = 4 THEN avg(l) END AS l4, CASE WHEN count(*) = 4 AND min(clipped) > 0 THEN avg(l) END AS l0, max(l) FILTER (WHERE n = 1) AS l1, CASE WHEN count(*) FILTER (WHERE n <= 2) = 2 THEN avg(l) FILTER (WHERE n <= 2) END AS l2 FROM v_l GROUP BY pair_id)
      SELECT pair_id, round(coalesce(bp * exp(l4), 0), 6) AS bleu, round(coalesce(bp * exp(l0), 0), 6) AS bleu_no_smoothing, round(coalesce(bp * exp(l1), 0), 6) AS bleu_1, round(coalesce(bp * exp(l2), 0), 6) AS bleu_2
      FROM (SELECT pair_id, CASE WHEN c = 0 OR r = 0 THEN NULL WHEN c >= r THEN 1.0 ELSE exp(1 - r / c) END AS bp FROM v_len) LEFT JOIN v_a USING (pair_id)""",
)
def sentence_bleu(spark, sf):
    return rounded(M.bleu(V.text_pairs(spark, sf)), "bleu", "bleu_no_smoothing", "bleu_1", "bleu_2")


@query(
    "corpus_bleu",
    f"""WITH {gram_sql()}, v_s AS (SELECT n, sum(clipped) AS clipped, sum(total) AS total FROM v_ng GROUP BY n)
      SELECT round((SELECT CASE WHEN sum(c) >= sum(r) THEN 1 ELSE exp(1 - sum(r) / sum(c)) END FROM v_len) * (SELECT exp(avg(ln(CASE WHEN clipped = 0 THEN 1.0 / (2.0 * total) ELSE clipped / total END))) FROM v_s), 6)::DOUBLE AS corpus_bleu, (SELECT sum(c)::BIGINT FROM v_len) AS c, (SELECT sum(r)::BIGINT FROM v_len) AS r""",
)
def corpus_bleu(spark, sf):
    return rounded(M.corpus_bleu(V.text_pairs(spark, sf)), "corpus_bleu")


@query("meteor_lite")
def meteor_lite(spark, sf):
    return M.meteor_lite(V.text_pairs(spark, sf))


TOKV = "v_e AS (SELECT vec_id // 10 AS pair_id, vec_id % 10 AS tok, embedding::DOUBLE[] AS v FROM embeddings)"


@query(
    "bertscore_match",
    f"""WITH {TOKV}, v_s AS (SELECT c.pair_id, c.tok AS ct, r.tok AS rt, list_dot_product(c.v, r.v) / (sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(r.v, r.v))) AS s FROM v_e c JOIN v_e r USING (pair_id) WHERE c.tok < 5 AND r.tok >= 5),
      v_p AS (SELECT pair_id, avg(s) AS p FROM (SELECT pair_id, ct, max(s) AS s FROM v_s GROUP BY pair_id, ct) GROUP BY pair_id), v_q AS (SELECT pair_id, avg(s) AS r FROM (SELECT pair_id, rt, max(s) AS s FROM v_s GROUP BY pair_id, rt) GROUP BY pair_id)
      SELECT pair_id, round(p, 6) AS p, round(r, 6) AS r, round(2 * p * r / (p + r), 6) AS f1 FROM v_p JOIN v_q USING (pair_id)""",
)
def bertscore_match(spark, sf):
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("pair_id"), (F.col("vec_id") % 10).alias("tok"), F.col("embedding").alias("vec"))
    return rounded(M.greedy_match(e.where("tok < 5"), e.where("tok >= 5"), cosine(F.col("cv"), F.col("rv"))), "p", "r", "f1")


@query("gen_summary", "SELECT round(avg(value), 5) AS mean_all, round(avg(value) FILTER (WHERE event_id % 3 = 0), 5) AS mean_hit, round(avg(value) FILTER (WHERE event_id % 3 <> 0), 5) AS mean_miss, round(avg((event_type = 'error')::INT), 6) AS fallback_rate, count(*) AS n FROM events")
def gen_summary(spark, sf):
    hit = F.col("event_id") % 3 == 0
    return table(spark, sf, "events").agg(
        F.round(F.avg("value"), 5).alias("mean_all"),
        F.round(F.avg(F.when(hit, F.col("value"))), 5).alias("mean_hit"),
        F.round(F.avg(F.when(~hit, F.col("value"))), 5).alias("mean_miss"),
        F.round(F.avg((F.col("event_type") == "error").cast("int")), 6).alias("fallback_rate"),
        F.count("*").alias("n"),
    )


@query("entry", f"WITH {ARMS} SELECT qid, arm, mrr FROM ({MRR}) WHERE arm = 'bm25'")
def entry(spark, sf):
    """For every benchmark passage the ten best chunks by BM25, scored by reciprocal rank against gold from containment."""
    ret = V.index(spark, sf).search(V.queries(spark, sf), 10).withColumn("arm", F.lit("bm25"))
    return rounded(M.mrr(ret, gold(spark, sf), V.queries(spark, sf).select("qid", F.lit("bm25").alias("arm")), ["arm"]), "mrr")
