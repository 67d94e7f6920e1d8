"""Queries: the risk-model pipeline."""

from __future__ import annotations


from pyspark.sql import functions as F

from evidex.operators import models as M
from evidex.plans.registry import query
from evidex.sources import views as V
from evidex.sources.tables import checkpoint_folder, spread, stored

FEATURES = ["n_chars", "n_tokens", "distinct_ratio", "digit_ratio", "is_en"]
GRID = [round(0.01 + 0.005 * i, 4) for i in range(197)]
GRID_SQL = "(SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in GRID) + "]) AS threshold)"
WEIGHTS = {"n_chars": 0.001, "n_tokens": -0.01, "distinct_ratio": 2.0, "digit_ratio": -5.0, "is_en": 0.3}


@query(
    "leakage_audit",
    """SELECT label, n0, n1, lo, hi, NOT EXISTS (SELECT 1 FROM (SELECT label, min(toxic) AS lo, max(toxic) AS hi FROM v_ml GROUP BY label) b WHERE b.label <> a.label AND a.lo <= b.hi AND b.lo <= a.hi) AS separates
      FROM (SELECT label, count(*) FILTER (WHERE toxic = 0) AS n0, count(*) FILTER (WHERE toxic = 1) AS n1, min(toxic) AS lo, max(toxic) AS hi FROM v_ml GROUP BY label) a""",
)
def leakage_audit(spark, sf):
    return M.leakage(V.ml_rows(spark, sf), "label", "toxic")


@query("feature_pool", "SELECT doc_id, label, n_tokens, round(distinct_ratio, 6) AS distinct_ratio, round(digit_ratio, 6) AS digit_ratio, is_en FROM v_ml")
def feature_pool(spark, sf):
    r = lambda c: F.round(c, 6).alias(c)
    return V.ml_rows(spark, sf).select("doc_id", "label", "n_tokens", r("distinct_ratio"), r("digit_ratio"), "is_en")


def fitted_rows(spark, sf):
    """`ml_rows` at rest: a fit passes over its rows many times, and texts are read for them once."""
    return spread(stored(V.ml_rows(spark, sf)), "doc_id")


@query("lasso_select")
def lasso_select(spark, sf):
    rows = [(f, c, abs(c) > 1e-6) for f, c in M.lasso_select(V.ml_rows(spark, sf), FEATURES).items()]
    return spark.createDataFrame(rows, "feature string, coefficient double, kept boolean")


@query("boruta_select")
def boruta_select(spark, sf):
    rows = [(f, n, n >= 2) for f, n in M.boruta_select(fitted_rows(spark, sf), FEATURES).items()]
    return spark.createDataFrame(rows, "feature string, wins int, kept boolean")


#: Features that are known beforehand to matter.
DOMAIN = ["n_tokens", "distinct_ratio", "digit_ratio"]


@query("selection_compare")
def selection_compare(spark, sf):
    rows = fitted_rows(spark, sf)
    found = M.compare_selections(FEATURES, DOMAIN, M.lasso_select(rows, FEATURES), M.boruta_select(rows, FEATURES))
    return spark.createDataFrame(found, "feature string, domain boolean, lasso boolean, boruta boolean, chosen boolean")


@query("strat_splits", "SELECT split, id, rn <= floor(n * 0.8) AS is_train FROM (SELECT split, doc_id AS id, row_number() OVER (PARTITION BY split, label ORDER BY md5(split || ':' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY split, label) AS n FROM v_ml, (SELECT unnest(range(5)) AS split))")
def strat_splits(spark, sf):
    return M.strat_splits(V.ml_rows(spark, sf), "doc_id", "label")


@query("model_bench")
def model_bench(spark, sf):
    return M.bench_models(fitted_rows(spark, sf), FEATURES)


@query("soft_vote")
def soft_vote(spark, sf):
    return M.member_scores(V.ml_rows(spark, sf), FEATURES, 1).select("doc_id", *M.VOTERS, F.col("vote").alias("score"))


@query("isotonic_cv")
def isotonic_cv(spark, sf):
    return M.isotonic_cv(V.scores(spark, sf))


AUC = """SELECT round((sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 5)::DOUBLE AS auc, round(avg((score - label) * (score - label)), 6) AS brier, count(*) AS n
  FROM (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM v_scores)"""


@query("auc_brier", f"SELECT grp, a.* FROM (SELECT 'all' AS grp), ({AUC}) a")
def auc_brier(spark, sf):
    a = M.auc_brier(V.scores(spark, sf).withColumn("grp", F.lit("all")), ["grp"])
    return a.select("grp", F.round("auc", 5).alias("auc"), F.round("brier", 6).alias("brier"), "n")


@query("champion")
def champion(spark, sf):
    return M.champion(M.bench_models(fitted_rows(spark, sf), FEATURES))


@query("prior_correct", "SELECT id, round(1 / (1 + exp(-(ln(c / (1 - c)) + ln(0.4098 / (1 - 0.4098)) - ln(0.2 / 0.8)))), 6)::DOUBLE AS p FROM (SELECT id, least(1 - 1e-6, greatest(1e-6, score)) AS c FROM v_scores)")
def prior_correct(spark, sf):
    return V.scores(spark, sf).select("id", F.round(M.prior_correct(F.col("score"), 0.2, 0.4098), 6).alias("p"))


COUNTS = f"v_tc AS (SELECT threshold, count(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp, count(*) FILTER (WHERE label = 0 AND score >= threshold) AS fp, count(*) FILTER (WHERE label = 1 AND score < threshold) AS fn, count(*) FILTER (WHERE label = 0 AND score < threshold) AS tn FROM v_scores, {GRID_SQL} GROUP BY threshold)"


@query("threshold_eval", f"WITH {COUNTS} SELECT threshold, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 6) AS sens, round(tn / nullif(tn + fp, 0), 6) AS spec FROM v_tc")
def threshold_eval(spark, sf):
    r = M.rates(M.threshold_counts(V.scores(spark, sf), GRID))
    return r.select("threshold", "tp", "fp", "fn", "tn", F.round("sens", 6).alias("sens"), F.round("spec", 6).alias("spec"))


@query("threshold_search", f"WITH {COUNTS}, v_s AS (SELECT *, tp / (tp + fn) AS sens FROM v_tc) SELECT coalesce(max(threshold) FILTER (WHERE sens >= 0.85), max_by(threshold, sens)) AS threshold, max(threshold) FILTER (WHERE sens >= 0.85) IS NOT NULL AS reached FROM v_s")
def threshold_search(spark, sf):
    return M.best_threshold(M.rates(M.threshold_counts(V.scores(spark, sf), GRID)))


@query("bayes_ppv_npv", f"WITH {COUNTS}, v_s AS (SELECT threshold, tp / (tp + fn) AS se, tn / (tn + fp) AS sp FROM v_tc) SELECT threshold, round(se * 0.1 / nullif(se * 0.1 + (1 - sp) * 0.9, 0), 6)::DOUBLE AS ppv, round(sp * 0.9 / nullif(sp * 0.9 + (1 - se) * 0.1, 0), 6)::DOUBLE AS npv FROM v_s")
def bayes_ppv_npv(spark, sf):
    r = M.rates(M.threshold_counts(V.scores(spark, sf), GRID))
    ppv, npv = M.bayes(F.col("sens"), F.col("spec"), 0.1)
    return r.select("threshold", F.round(ppv, 6).alias("ppv"), F.round(npv, 6).alias("npv"))


SHAP = "v_shap AS (SELECT doc_id AS id, feature, value FROM (SELECT doc_id, " + ", ".join(f"({f} - avg({f}) OVER ()) * {w} AS {f}" for f, w in WEIGHTS.items()) + " FROM v_ml) UNPIVOT (value FOR feature IN (" + ", ".join(WEIGHTS) + ")))"


@query("linear_shap", f"WITH {SHAP} SELECT id, feature, round(value, 5) AS value FROM v_shap")
def linear_shap(spark, sf):
    return M.linear_contributions(V.ml_rows(spark, sf), "doc_id", WEIGHTS).select("id", "feature", F.round("value", 5).alias("value"))


@query("driver_payload", f"WITH {SHAP} SELECT id, feature, round(abs(value) * 100 / sum(abs(value)) OVER (PARTITION BY id), 4) AS percent FROM v_shap")
def driver_payload(spark, sf):
    return M.driver_payload(M.linear_contributions(V.ml_rows(spark, sf), "doc_id", WEIGHTS)).select("id", "feature", F.round("percent", 4).alias("percent"))


@query("model_io")
def model_io(spark, sf):
    """A fitted model written to the shared folder, read again and applied."""
    import uuid

    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.functions import vector_to_array

    data = M.assembled(V.ml_rows(spark, sf), FEATURES)
    base = checkpoint_folder(spark)
    path = f"{base}/model-{uuid.uuid4().hex}"
    LogisticRegression(maxIter=20).fit(data).write().save(path)
    return LogisticRegressionModel.load(path).transform(data).select("doc_id", vector_to_array("probability")[1].alias("p"))
