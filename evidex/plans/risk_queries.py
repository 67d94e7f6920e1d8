"""Queries: risk scores, ward rules and plan safety."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidex.functions import query as Q
from evidex.functions import risk as K
from evidex.operators import audit as A
from evidex.plans import retrieval_queries as RQ
from evidex.plans.registry import query, sql_list
from evidex.sources import views as V
from evidex.sources.tables import table


def scored(spark, sf):
    """Assessments with drivers, layer sums, total, category and concern levels."""
    a = V.assessments(spark, sf).withColumn("drivers", K.drivers())
    for i in (1, 2, 3):
        a = a.withColumn(f"l{i}", K.layer_sum(F.col("drivers"), i)).withColumn(f"c{i}", K.concern(F.col(f"l{i}")))
    a = a.withColumn("total", K.total_score(F.col("l1"), F.col("l2"), F.col("l3"), F.col("culture")))
    return a.withColumn("category", K.category(F.col("total")))


def layer_sql(n: int) -> str:
    return " + ".join(f"CASE WHEN {t} THEN {p} ELSE 0 END" for i, _, p, t in K.DRIVERS if i == n)


RISK = f"""v_l AS (SELECT *, {layer_sql(1)} AS l1, {layer_sql(2)} AS l2, {layer_sql(3)} AS l3 FROM v_assessments),
  v_t AS (SELECT *, CASE WHEN culture THEN greatest(l1 + l2 + l3, 10) ELSE l1 + l2 + l3 END AS total, {', '.join(f'CASE WHEN l{i} >= 5 THEN 2 WHEN l{i} >= 2 THEN 1 ELSE 0 END AS c{i}' for i in (1, 2, 3))} FROM v_l),
  v_risk AS (SELECT *, CASE WHEN total >= 10 THEN 'CRITICAL' WHEN total >= 7 THEN 'HIGH' WHEN total >= 4 THEN 'INTERMEDIATE' ELSE 'LOW' END AS category FROM v_t)"""


@query("layer_scores", f"WITH {RISK} SELECT event_id, l1, l2, l3 FROM v_risk")
def layer_scores(spark, sf):
    return scored(spark, sf).select("event_id", "l1", "l2", "l3")


@query("risk_category", f"WITH {RISK} SELECT event_id, total, category FROM v_risk")
def risk_category(spark, sf):
    return scored(spark, sf).select("event_id", "total", "category")


@query("risk_probability", f"WITH {RISK} SELECT event_id, round(least(50.0, greatest(0.1, 1000 / (1 + exp(-(-7.0 + {' + '.join(f'CASE WHEN {t} THEN {w} ELSE 0 END' for t, w in K.LOGIT)}))))) * (1.0 + l2 * 0.15::DOUBLE + l3 * 0.25::DOUBLE), 2) AS per_1000 FROM v_risk")
def risk_probability(spark, sf):
    return scored(spark, sf).select("event_id", K.probability(F.col("l2"), F.col("l3")).alias("per_1000"))


@query("layer_concern", f"WITH {RISK} SELECT event_id, c1, c2, c3, CASE {' '.join(f'WHEN {t} THEN {chr(39)}{n}{chr(39)}' for n, t in K.NOTES)} END AS note FROM v_risk")
def layer_concern(spark, sf):
    return scored(spark, sf).withColumn("note", K.combination_note()).select("event_id", "c1", "c2", "c3", "note")


_DRV = "[" + ", ".join(f"CASE WHEN {t} THEN {{'name': '{n}', 'points': {p}}} END" for _, n, p, t in K.DRIVERS) + "]"


@query("driver_share", f"WITH {RISK} SELECT event_id, d.name AS name, CASE WHEN total = 0 THEN 0.0 ELSE round(d.points * 100.0 / total, 4) END::DOUBLE AS percent FROM (SELECT event_id, total, unnest(list_filter({_DRV}, lambda x: x IS NOT NULL)) AS d FROM v_risk)")
def driver_share(spark, sf):
    return scored(spark, sf).select("event_id", F.explode(K.shares(F.col("drivers"), F.col("total"))).alias("d")).select("event_id", "d.name", "d.percent")


@query("driver_scale", f"WITH {RISK}, v_dr AS (SELECT event_id, d.name AS name, d.points AS points FROM (SELECT event_id, unnest(list_filter({_DRV}, lambda x: x IS NOT NULL)) AS d FROM v_risk)) SELECT event_id, name, round(least(1, greatest(0.05, abs(points) / max(abs(points)) OVER (PARTITION BY event_id))), 6)::DOUBLE AS width FROM v_dr WHERE points <> 0")
def driver_scale(spark, sf):
    d = scored(spark, sf).select("event_id", F.explode("drivers").alias("d")).select("event_id", "d.name", "d.points").where("points <> 0")
    most = F.max(F.abs("points")).over(Window.partitionBy("event_id"))
    return d.select("event_id", "name", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.abs("points") / most)), 6).alias("width"))


@query("recommendation_lookup", f"WITH {RISK}, v_rec AS (SELECT * FROM (VALUES ('NICE', 'LOW', 'routine'), ('NICE', 'INTERMEDIATE', 'observe'), ('NICE', 'HIGH', 'treat'), ('NICE', 'CRITICAL', 'treat now'), ('WHO', 'LOW', 'support'), ('WHO', 'INTERMEDIATE', 'monitor'), ('WHO', 'HIGH', 'inject'), ('WHO', 'CRITICAL', 'inject and transfer')) t(g, c, advice)) SELECT event_id, advice FROM (SELECT event_id, category, CASE WHEN event_id % 3 = 0 THEN 'NICE' ELSE 'WHO' END AS g FROM v_risk) r JOIN v_rec ON v_rec.g = r.g AND v_rec.c = r.category")
def recommendation_lookup(spark, sf):
    rows = [("NICE", "LOW", "routine"), ("NICE", "INTERMEDIATE", "observe"), ("NICE", "HIGH", "treat"), ("NICE", "CRITICAL", "treat now"), ("WHO", "LOW", "support"), ("WHO", "INTERMEDIATE", "monitor"), ("WHO", "HIGH", "inject"), ("WHO", "CRITICAL", "inject and transfer")]
    advice = spark.createDataFrame(rows, "g string, category string, advice string")
    asked = F.element_at(F.array(F.lit("NICE"), F.lit("WHO"), F.lit("OTHER")), (F.col("event_id") % 3 + 1).cast("int"))
    known = F.when(asked.isin("NICE", "WHO"), asked).otherwise("WHO")
    return scored(spark, sf).withColumn("g", known).join(F.broadcast(advice), ["g", "category"]).select("event_id", "advice")


@query("scope_warnings", f"WITH {RISK} SELECT event_id, list_filter([CASE WHEN ga < 35 THEN 'below scope' END, CASE WHEN ga >= 35 AND ga < 37 THEN 'late preterm' END, CASE WHEN culture THEN 'positive culture' END], lambda x: x IS NOT NULL) AS warnings FROM v_risk")
def scope_warnings(spark, sf):
    return scored(spark, sf).select("event_id", K.warnings().alias("warnings"))


@query("category_counts", f"WITH {RISK} SELECT category, count(*) AS n FROM v_risk GROUP BY category")
def category_counts(spark, sf):
    return scored(spark, sf).groupBy("category").agg(F.count("*").alias("n"))


def alert_rows(rows):
    """One row per alert: risk, preterm, culture."""
    kinds = F.array_compact(F.array(F.when(F.col("category").isin("HIGH", "CRITICAL"), "risk"), F.when(F.col("ga") < 37, "preterm"), F.when(F.col("culture"), "culture")))
    return rows.select("event_id", "encounter", F.explode(kinds).alias("alert"))


@query("alerts", f"WITH {RISK} SELECT event_id, encounter, unnest(list_filter([CASE WHEN category IN ('HIGH', 'CRITICAL') THEN 'risk' END, CASE WHEN ga < 37 THEN 'preterm' END, CASE WHEN culture THEN 'culture' END], lambda x: x IS NOT NULL)) AS alert FROM v_risk")
def alerts(spark, sf):
    return alert_rows(scored(spark, sf))


@query("recent_top3", "SELECT encounter, event_id, rn FROM (SELECT encounter, event_id, row_number() OVER (PARTITION BY encounter ORDER BY ts DESC, event_id DESC) AS rn FROM v_assessments) WHERE rn <= 3")
def recent_top3(spark, sf):
    w = Window.partitionBy("encounter").orderBy(F.desc("ts"), F.desc("event_id"))
    return V.assessments(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("encounter", "event_id", "rn")


@query("upsert_delete", "SELECT event_id, round(CASE WHEN event_id % 10 = 1 THEN value + 1000 ELSE value END, 4) AS value FROM events WHERE event_id % 10 <> 2")
def upsert_delete(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    new = e.where("event_id % 10 = 1").select("event_id", (F.col("value") + 1000).alias("value"))
    gone = e.where("event_id % 10 = 2").select("event_id")
    kept = e.join(new.select("event_id").unionByName(gone), "event_id", "left_anti")
    return kept.unionByName(new).select("event_id", F.round("value", 4).alias("value"))


@query("timeline_series", f"WITH {RISK} SELECT encounter, event_id, round(least(72, greatest(0, (epoch_ms(ts) - min(epoch_ms(ts)) OVER (PARTITION BY encounter)) / 3600000.0)), 3)::DOUBLE AS age_h, total FROM v_risk")
def timeline_series(spark, sf):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    age = (ms - F.min(ms).over(Window.partitionBy("encounter"))) / 3600000.0
    return scored(spark, sf).select("encounter", "event_id", F.round(F.least(F.lit(72.0), F.greatest(F.lit(0.0), age)), 3).alias("age_h"), "total")


@query("stewardship_kpis", "SELECT drug, count(*) AS n, round(avg((hours BETWEEN 36 AND 48)::INT), 6) AS stop_36_48, round(avg(hours), 4) AS mean_hours, count(DISTINCT encounter) AS encounters FROM v_courses GROUP BY drug")
def stewardship_kpis(spark, sf):
    return V.courses(spark, sf).groupBy("drug").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hours").between(36, 48).cast("int")), 6).alias("stop_36_48"), F.round(F.avg("hours"), 4).alias("mean_hours"), F.count_distinct("encounter").alias("encounters"))


@query("longitudinal_deltas", f"WITH {RISK}, v_lag AS (SELECT *, total - lag(total) OVER w AS score_delta, CASE WHEN crp > lag(crp) OVER w THEN 1 ELSE 0 END AS up FROM v_risk WINDOW w AS (PARTITION BY encounter ORDER BY ts, event_id)), v_is AS (SELECT *, sum(1 - up) OVER (PARTITION BY encounter ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM v_lag) SELECT event_id, score_delta, sum(up) OVER (PARTITION BY encounter, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS crp_streak FROM v_is")
def longitudinal_deltas(spark, sf):
    return deltas(scored(spark, sf)).select("event_id", "score_delta", "crp_streak")


def deltas(rows):
    """Score change since the last assessment of the encounter, and the streak of rising CRP."""
    w = Window.partitionBy("encounter").orderBy("ts", "event_id")
    up = F.coalesce((F.col("crp") > F.lag("crp").over(w)).cast("long"), F.lit(0))
    d = rows.withColumn("score_delta", F.col("total") - F.lag("total").over(w)).withColumn("up", up)
    d = d.withColumn("island", F.sum(1 - F.col("up")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("encounter", "island").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("crp_streak", F.sum("up").over(run))


@query("trend_note", f"WITH {RISK}, v_lag AS (SELECT event_id, total - lag(total) OVER (PARTITION BY encounter ORDER BY ts, event_id) AS d FROM v_risk) SELECT event_id, CASE WHEN d >= 2 THEN 'deteriorating' WHEN d <= -2 THEN 'improving' ELSE '' END AS note FROM v_lag")
def trend_note(spark, sf):
    return deltas(scored(spark, sf)).select("event_id", K.trend_note(F.col("score_delta")).alias("note"))


@query("trend_terms", "SELECT event_id, list_filter([CASE WHEN c >= 2 THEN 'CRP rising ' || c || ' consecutive readings' END, CASE WHEN t >= 2 THEN 'temperature instability ' || t || ' consecutive readings' END, CASE WHEN a >= 1 THEN 'AKI stage ' || a END, CASE WHEN n >= 3 THEN 'multiple reassessments' END], lambda x: x IS NOT NULL) AS terms FROM (SELECT event_id, event_id % 4 AS c, event_id % 3 AS t, event_id % 5 AS a, event_id % 6 + 1 AS n FROM events)")
def trend_terms(spark, sf):
    k = F.col("event_id")
    line = lambda n, head, tail, least: F.when(n >= least, F.concat(F.lit(head), n.cast("string"), F.lit(tail)))
    terms = F.array_compact(F.array(line(k % 4, "CRP rising ", " consecutive readings", 2), line(k % 3, "temperature instability ", " consecutive readings", 2), line(k % 5, "AKI stage ", "", 1), F.when(k % 6 + 1 >= 3, "multiple reassessments")))
    return table(spark, sf, "events").select("event_id", terms.alias("terms"))


#: Rows of a segment in the registered query, so that a user's events make several.
AUDIT_SEGMENT = 32


@query(
    "audit_chain",
    f"""WITH RECURSIVE v_p AS (SELECT event_id, user_id, event_type || '|' || event_id || '|' || CAST(floor(value) AS BIGINT) AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
      v_c AS (SELECT event_id, user_id, n, payload, sha256('genesis' || payload) AS link FROM v_p WHERE n % {AUDIT_SEGMENT} = 0
        UNION ALL SELECT p.event_id, p.user_id, p.n, p.payload, sha256(c.link || p.payload) FROM v_c c JOIN v_p p ON p.user_id = c.user_id AND p.n = c.n + 1 WHERE p.n % {AUDIT_SEGMENT} <> 0),
      v_d AS (SELECT user_id, n // {AUDIT_SEGMENT} AS seg, max_by(link, n) AS digest FROM v_c GROUP BY user_id, n // {AUDIT_SEGMENT}),
      v_l AS (SELECT user_id, seg, sha256('genesis' || digest) AS up FROM v_d WHERE seg = 0 UNION ALL SELECT d.user_id, d.seg, sha256(l.up || d.digest) FROM v_l l JOIN v_d d ON d.user_id = l.user_id AND d.seg = l.seg + 1),
      v_h AS (SELECT c.*, sha256(coalesce(sha256('genesis' || up), 'genesis') || link) AS h FROM v_c c LEFT JOIN v_l l ON l.user_id = c.user_id AND l.seg = c.n // {AUDIT_SEGMENT} - 1),
      v_s AS (SELECT *, CASE WHEN event_id % 70 = 0 THEN sha256(h) ELSE h END AS stored, CASE WHEN event_id % 50 = 0 THEN payload || '!' ELSE payload END AS told FROM v_h),
      v_v AS (SELECT *, CASE WHEN n % {AUDIT_SEGMENT} = 0 THEN 'genesis' ELSE lag(link) OVER (PARTITION BY user_id ORDER BY n) END AS prev FROM v_s)
      SELECT event_id, h AS chain_hash, link = sha256(prev || told) AND stored = h AS valid FROM v_v""",
)
def audit_chain(spark, sf):
    """Chains of each user's events, then read again after some rows (every 50th id) and some hashes (every 70th) were altered."""
    k = F.col("event_id")
    payload = F.concat_ws("|", "event_type", k.cast("string"), F.floor("value").cast("long").cast("string"))
    chained = A.audit_chain(table(spark, sf, "events").select("user_id", k, "ts", payload.alias("payload")), "user_id", ["ts", "event_id"], "payload", AUDIT_SEGMENT)
    stored = F.when(k % 70 == 0, F.sha2("chain_hash", 256)).otherwise(F.col("chain_hash"))
    altered = chained.withColumns({"stored": stored, "payload": F.when(k % 50 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))})
    return A.audit_verify(altered, "user_id", "payload", stored="stored", segment=AUDIT_SEGMENT).select("event_id", "chain_hash", "valid")


@query("action_lookup", f"WITH {RISK} SELECT category, CASE category {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN {sql_list(a)}' for c, a in K.ACTIONS.items())} END AS actions FROM (SELECT DISTINCT category FROM v_risk)")
def action_lookup(spark, sf):
    return scored(spark, sf).select("category").distinct().select("category", K.actions(F.col("category")).alias("actions"))


@query("keyword_set", "SELECT event_id, list_filter([CASE WHEN maternal_temperature >= 38 THEN 'fever' END, CASE WHEN rom_hours >= 18 THEN 'rom' END, CASE WHEN gbs THEN 'gbs' END, CASE WHEN respiratory <> 'None' THEN 'respiratory' END, CASE WHEN crp >= 10 THEN 'crp' END, CASE WHEN culture THEN 'culture' END], lambda x: x IS NOT NULL) AS keywords FROM v_assessments")
def keyword_set(spark, sf):
    rules = (("maternal_temperature >= 38", "fever"), ("rom_hours >= 18", "rom"), ("gbs", "gbs"), ("respiratory <> 'None'", "respiratory"), ("crp >= 10", "crp"), ("culture", "culture"))
    return V.assessments(spark, sf).select("event_id", F.array_distinct(F.array_compact(F.array(*[F.when(F.expr(t), n) for t, n in rules]))).alias("keywords"))


def built(extended: bool):
    """Query text of an assessment: guideline, category and the phrases its fields call for."""
    s = Q.some
    parts = [
        s(F.lit(True), "EOS management", "neonatal sepsis guidelines", F.concat("category", F.lit(" risk")), "NICE NG195"),
        F.transform("drivers", lambda d: d["name"]),
        s(F.col("respiratory") != "None", "respiratory distress", "tachypnoea", "grunting"),
        s(F.col("rom_hours") >= 18, "prolonged ROM", "rupture of membranes"),
        s(F.col("maternal_temperature") >= 38, "maternal fever", "intrapartum fever"),
        s(F.col("gbs"), "GBS", "group B streptococcus", "intrapartum antibiotics"),
        s(F.col("crp") >= 10, "CRP", "inflammatory markers"),
        s(F.col("culture"), "blood culture", "bacteremia", "empirical antibiotics"),
        s(F.col("l2") >= 3, "clinical illness"),
        s(F.col("l3") >= 2, "laboratory evidence sepsis"),
        s(F.col("total") >= 7, "blood culture", "empirical antibiotics", "senior review"),
    ]
    if extended:
        parts += [s(F.col("neonatal_temperature") < 36.5, "hypothermia"), s(F.col("neonatal_temperature") > 37.5, "hyperthermia"), s(F.col("poor_perfusion"), "poor perfusion"), s(F.col("ga") < 37, "preterm"), s(F.col("score_delta") >= 2, "deteriorating trend"), s(F.col("crp_streak") >= 2, "CRP rising")]
    return Q.phrases(*parts)


_BUILD = [
    ("true", "['EOS management', 'neonatal sepsis guidelines', category || ' risk', 'NICE NG195']"),
    ("true", f"list_transform(list_filter({_DRV}, lambda x: x IS NOT NULL), lambda x: x.name)"),
    ("respiratory <> 'None'", "['respiratory distress', 'tachypnoea', 'grunting']"),
    ("rom_hours >= 18", "['prolonged ROM', 'rupture of membranes']"),
    ("maternal_temperature >= 38", "['maternal fever', 'intrapartum fever']"),
    ("gbs", "['GBS', 'group B streptococcus', 'intrapartum antibiotics']"),
    ("crp >= 10", "['CRP', 'inflammatory markers']"),
    ("culture", "['blood culture', 'bacteremia', 'empirical antibiotics']"),
    ("l2 >= 3", "['clinical illness']"),
    ("l3 >= 2", "['laboratory evidence sepsis']"),
    ("total >= 7", "['blood culture', 'empirical antibiotics', 'senior review']"),
]
_MORE = [("neonatal_temperature < 36.5", "['hypothermia']"), ("neonatal_temperature > 37.5", "['hyperthermia']"), ("poor_perfusion", "['poor perfusion']"), ("ga < 37", "['preterm']"), ("score_delta >= 2", "['deteriorating trend']"), ("crp_streak >= 2", "['CRP rising']")]


def distinct_in_order(flat: str) -> str:
    return f"array_to_string(list_filter({flat}, lambda x, i: list_position({flat}, x) = i), ' ')"


def flat_of(parts) -> str:
    return "flatten([" + ", ".join(f"CASE WHEN {t} THEN {v} ELSE [] END" for t, v in parts) + "])"


@query("build_query", f"WITH {RISK}, v_fl AS (SELECT event_id, {flat_of(_BUILD)} AS f FROM v_risk) SELECT event_id, {distinct_in_order('f')} AS text FROM v_fl")
def build_query(spark, sf):
    return scored(spark, sf).select("event_id", built(False).alias("text"))


@query("build_query_full", f"WITH {RISK}, v_lag AS (SELECT *, total - lag(total) OVER w AS score_delta, CASE WHEN crp > lag(crp) OVER w THEN 1 ELSE 0 END AS up FROM v_risk WINDOW w AS (PARTITION BY encounter ORDER BY ts, event_id)), v_is AS (SELECT *, sum(1 - up) OVER (PARTITION BY encounter ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM v_lag), v_st AS (SELECT *, sum(up) OVER (PARTITION BY encounter, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS crp_streak FROM v_is), v_fl AS (SELECT event_id, {flat_of(_BUILD + _MORE)} AS f FROM v_st) SELECT event_id, {distinct_in_order('f')} AS text FROM v_fl")
def build_query_full(spark, sf):
    return deltas(scored(spark, sf)).select("event_id", built(True).alias("text"))


@query("vignette_map", "SELECT event_id, list_filter([CASE WHEN rr >= 60 THEN 'fast breathing' END, CASE WHEN event_id % 5 = 0 THEN 'chest indrawing' END, CASE WHEN feeding IN ('poor', 'not feeding', 'unable to feed') THEN 'poor feeding' END, CASE WHEN event_id % 11 = 0 THEN 'convulsions' END, 'young infant ' || age || ' days old'], lambda x: x IS NOT NULL) AS drivers FROM (SELECT event_id, 40 + event_id % 40 AS rr, ['poor', 'well', 'not feeding'][event_id % 3 + 1] AS feeding, event_id % 60 AS age FROM events)")
def vignette_map(spark, sf):
    k = F.col("event_id")
    feeding = F.element_at(F.array(F.lit("poor"), F.lit("well"), F.lit("not feeding")), (k % 3 + 1).cast("int"))
    drivers = F.array_compact(F.array(F.when(40 + k % 40 >= 60, "fast breathing"), F.when(k % 5 == 0, "chest indrawing"), F.when(F.lower(feeding).isin("poor", "not feeding", "unable to feed"), "poor feeding"), F.when(k % 11 == 0, "convulsions"), F.concat(F.lit("young infant "), (k % 60).cast("string"), F.lit(" days old"))))
    return table(spark, sf, "events").select("event_id", drivers.alias("drivers"))


@query("deidentify", "SELECT event_id, ga IS NOT NULL AS has_ga, crp IS NOT NULL AS has_crp, 5 + (crp IS NOT NULL)::INT + (wbc IS NOT NULL)::INT AS n_fields FROM v_assessments")
def deidentify(spark, sf):
    """A whitelist of clinical fields as JSON; nulls and identifiers are left out."""
    fields = F.to_json(F.struct("ga", "maternal_temperature", "rom_hours", "gbs", "respiratory", "crp", "wbc"))
    keys = F.json_object_keys(fields)
    return V.assessments(spark, sf).select("event_id", F.array_contains(keys, "ga").alias("has_ga"), F.array_contains(keys, "crp").alias("has_crp"), F.size(keys).alias("n_fields"))


# plans -----------------------------------------------------------------------------------------

#: Plan fields made from events; regimens cover every branch of the rules.
REGIMENS = (
    (),
    ("Gentamicin 5 mg/kg once daily", "Benzylpenicillin 50 mg/kg every 12 hours"),
    ("Benzylpenicillin sodium 50 mg/kg every 12 hours",),
    ("gentamicin 4 mg/kg",),
    ("No specific antibiotic regimen is provided",),
    ("Clindamycin 10 mg/kg every 8 hours",),
    ("Ampicillin 50 mg/kg/dose every 12 hours", "gentamicin once a daily"),
)
_REG = "[" + ", ".join(sql_list(r) if r else "[]::VARCHAR[]" for r in REGIMENS) + "]"
EVIDENCE = "give 5 mg/kg once daily and 50 mg/kg every 12 hours"
PLANS = f"""v_plans AS (SELECT event_id AS id, {_REG}[event_id % 7 + 1] AS regimen, event_id % 4 <> 0 AS required, ['NICE', 'WHO', 'AAP', 'NICE', 'WHO'][event_id % 5 + 1] AS guideline,
  ['none', 'gentamicin_aki', 'penicillin_allergy'][event_id % 3 + 1] AS contra, array_to_string({_REG}[event_id % 7 + 1], ' || ') AS raw FROM events)"""


def plan_rows(spark, sf):
    k = F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (k % n + 1).cast("int"))
    regs = [F.array(*[F.lit(x) for x in r]) if r else F.array().cast("array<string>") for r in REGIMENS]
    return table(spark, sf, "events").select(k.alias("id"), pick(regs, 7).alias("regimen"), (k % 4 != 0).alias("required"), pick(("NICE", "WHO", "AAP", "NICE", "WHO"), 5).alias("guideline"), pick(("none", "gentamicin_aki", "penicillin_allergy"), 3).alias("contra"))


_MISSING = f"(len(regimen) = 0 OR len(list_filter({sql_list(K.PLACEHOLDERS)}, lambda p: contains(lower(raw), p))) > 0 AND len(list_filter({sql_list(K.DRUG_WORDS)}, lambda p: contains(lower(raw), p))) = 0)"
_INCOMPLETE = "(required AND (contains(lower(raw), 'gentamicin') OR contains(lower(raw), 'benzylpenicillin') OR contains(lower(raw), 'ampicillin')) AND NOT (contains(lower(raw), 'gentamicin') AND (contains(lower(raw), 'penicillin') OR contains(lower(raw), 'ampicillin'))) AND contra <> 'gentamicin_aki')"


@query("regimen_missing", f"WITH {PLANS} SELECT id, {_MISSING} AS missing FROM v_plans")
def regimen_missing(spark, sf):
    return plan_rows(spark, sf).select("id", K.regimen_missing(F.col("regimen")).alias("missing"))


@query("regimen_incomplete", f"WITH {PLANS} SELECT id, {_INCOMPLETE} AS incomplete FROM v_plans")
def regimen_incomplete(spark, sf):
    return plan_rows(spark, sf).select("id", K.regimen_incomplete(F.col("required"), F.col("regimen"), F.col("contra")).alias("incomplete"))


_DOSES = r"(?i)(" + K.DOSE + ")"


@query("ungrounded_doses", f"WITH {PLANS} SELECT id, list_filter(flatten(list_transform(regimen, lambda e: regexp_extract_all(e, '{_DOSES}', 1))), lambda t: NOT contains('{EVIDENCE}', lower(trim(t)))) AS tokens FROM v_plans")
def ungrounded_doses(spark, sf):
    return plan_rows(spark, sf).select("id", K.ungrounded(F.col("regimen"), F.lit(EVIDENCE)).alias("tokens"))


@query("strip_doses", f"WITH {PLANS} SELECT id, list_transform(regimen, lambda e: list_reduce(list_filter(regexp_extract_all(e, '{_DOSES}', 1), lambda t: NOT contains('{EVIDENCE}', lower(trim(t)))), lambda a, t: replace(a, t, '[dose/frequency not specified in retrieved evidence]'), e)) AS regimen FROM v_plans")
def strip_doses(spark, sf):
    return plan_rows(spark, sf).select("id", K.strip_doses(F.col("regimen"), F.lit(EVIDENCE)).alias("regimen"))


@query("regimen_safety_net", f"""WITH {PLANS}, v_m AS (SELECT *, '[DETERMINISTIC DEFAULT] IV ' AS m, CASE WHEN guideline = 'NICE' THEN 'benzylpenicillin' ELSE 'ampicillin' END AS beta, contra = 'penicillin_allergy' AS allergy FROM v_plans),
  v_2 AS (SELECT *, list_concat(regimen, CASE WHEN {_INCOMPLETE} THEN [m || CASE WHEN contains(lower(raw), 'gentamicin') THEN beta ELSE 'gentamicin' END] ELSE [] END) AS second FROM v_m),
  v_3 AS (SELECT *, CASE WHEN {_MISSING} THEN [m || CASE WHEN allergy THEN 'clindamycin' ELSE beta END, m || 'gentamicin'] WHEN allergy AND NOT contains(lower(array_to_string(second, ' || ')), 'clindamycin') THEN list_append(second, m || 'clindamycin') ELSE second END AS third FROM v_2)
  SELECT id, CASE WHEN NOT required THEN regimen WHEN guideline = 'WHO' THEN list_transform(third, lambda e: CASE WHEN contains(lower(e), 'ampicillin') THEN e ELSE regexp_replace(e, '\\bbenzylpenicillin(?:\\s+sodium)?\\b', 'ampicillin', 'gi') END) ELSE third END AS regimen FROM v_3""")
def regimen_safety_net(spark, sf):
    return plan_rows(spark, sf).select("id", K.safety_net(F.col("required"), F.col("regimen"), F.col("guideline"), F.col("contra")).alias("regimen"))


@query("force_urgency", f"WITH {RISK} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN u WHEN category = 'CRITICAL' THEN 'Immediate (within 1 hour)' WHEN u = '' THEN 'Within 1 hour' ELSE u END AS urgency FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'soon' END AS u FROM v_risk)")
def force_urgency(spark, sf):
    u = F.when(F.col("event_id") % 3 == 0, "").otherwise("soon")
    out = F.when(F.col("event_id") % 4 == 0, u).when(F.col("category") == "CRITICAL", "Immediate (within 1 hour)").when(u == "", "Within 1 hour").otherwise(u)
    return scored(spark, sf).select("event_id", out.alias("urgency"))


@query("contraindications", "SELECT id, drug, CASE WHEN drug = 'gentamicin' THEN CASE WHEN stage >= 2 THEN 'CRITICAL' ELSE 'HIGH' END ELSE 'CRITICAL' END AS severity, CASE WHEN drug <> 'gentamicin' THEN 'allergy' WHEN stage >= 1 THEN 'kidney stage' ELSE 'single reading' END AS rule FROM (SELECT event_id AS id, unnest(['gentamicin', 'ampicillin']) AS drug, event_id % 4 AS stage, CASE WHEN event_id % 3 = 0 THEN 0.4 ELSE 1.0 END AS urine, CASE WHEN event_id % 7 = 0 THEN 1.8 ELSE 0.5 END AS creat, event_id % 5 = 0 AS allergy FROM events) WHERE drug = 'gentamicin' AND (stage >= 1 OR urine < 0.5 OR creat > 1.5) OR drug = 'ampicillin' AND allergy")
def contraindications(spark, sf):
    k = F.col("event_id")
    flags = K.contraindications(F.array(F.lit(" Gentamicin "), F.lit("AMPICILLIN")), (k % 4).cast("int"), F.when(k % 3 == 0, 0.4).otherwise(1.0), F.when(k % 7 == 0, 1.8).otherwise(0.5), k % 5 == 0)
    return table(spark, sf, "events").select(k.alias("id"), F.explode(flags).alias("f")).select("id", "f.drug", "f.severity", "f.rule")


@query("outpatient_exclusions", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN list_filter([CASE WHEN event_id % 3000 < 1500 THEN 'birth weight' END, CASE WHEN event_id % 7 = 0 THEN 'recent hospital stay' END], lambda x: x IS NOT NULL) ELSE [] END AS reasons FROM events")
def outpatient_exclusions(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select("event_id", K.outpatient_exclusions(F.when(k % 2 == 0, "outpatient_no_referral").otherwise("hospital"), k % 3000, k % 7 == 0).alias("reasons"))


_FLAGS = "[CASE WHEN event_id % 2 = 0 THEN 'avoid gentamicin here' ELSE 'nothing' END]"


@query("overlay_flags", f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {_FLAGS} ELSE list_append({_FLAGS}, '[HIGH] gentamicin: kidney') END || ['[CRITICAL] ampicillin: allergy'] AS flags FROM events")
def overlay_flags(spark, sf):
    k = F.col("event_id")
    have = F.array(F.when(k % 2 == 0, "avoid gentamicin here").otherwise("nothing"))
    more = F.array(F.lit("[HIGH] gentamicin: kidney"), F.lit("[CRITICAL] ampicillin: allergy"), F.lit("[HIGH] Gentamicin: again"))
    return table(spark, sf, "events").select("event_id", K.overlay(have, more).alias("flags"))


@query("safety_recall", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE (event_id % 2) / 2.0 + 0.5 END::DOUBLE AS recall FROM events")
def safety_recall(spark, sf):
    k = F.col("event_id")
    want = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("gentamicin"), F.lit("ampicillin")))
    text = F.when(k % 2 == 1, "gentamicin and ampicillin").otherwise("only gentamicin")
    found = F.size(F.filter(want, lambda d: text.contains(d)))
    return table(spark, sf, "events").select("event_id", F.when(F.size(want) == 0, 1.0).otherwise(found / F.greatest(F.size(want), F.lit(1))).alias("recall"))


ACTIVE = ("EN", "FR", "DE", "ES")


@query(
    "guideline_conflict",
    f"""WITH {RQ.BM25}, {RQ.BMTOP}, v_src AS (SELECT DISTINCT qid, upper(trim(source)) AS source FROM v_top JOIN v_chunks USING (chunk_id)), v_act AS (SELECT unnest({sql_list(ACTIVE)}) AS active)
      SELECT qid, active, count(*) FILTER (WHERE source <> active AND source <> '') >= 2 AS conflict FROM v_src, v_act GROUP BY qid, active""",
)
def guideline_conflict(spark, sf):
    """For every query and each guideline that could be active: whether its evidence comes from two others or more."""
    q, c = V.queries(spark, sf), V.stored_chunks(spark, sf)
    found = V.index(spark, sf).search(q, 10).join(c.select("chunk_id", "source"), "chunk_id").groupBy("qid").agg(F.collect_set("source").alias("sources"))  # ten at most
    cases = found.withColumn("active", F.explode(F.array(*[F.lit(a) for a in ACTIVE])))
    return cases.select("qid", "active", K.guideline_conflict(F.col("sources"), F.col("active")).alias("conflict"))


@query("citation_labels", "SELECT user_id, event_type, 'E' || row_number() OVER (PARTITION BY user_id ORDER BY first_seen) AS label FROM (SELECT user_id, event_type, min(event_id) AS first_seen FROM events GROUP BY user_id, event_type)")
def citation_labels(spark, sf):
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_seen"))
    return first.select("user_id", "event_type", F.concat(F.lit("E"), F.row_number().over(Window.partitionBy("user_id").orderBy("first_seen")).cast("string")).alias("label"))


@query("judge_consistency", "SELECT event_id, confidence, NOT missed AND confidence >= 0.6 AS verified, CASE WHEN missed THEN list_prepend('MISSED_REQUIRED_DISCLOSURE', claims) WHEN confidence >= 0.6 THEN claims[1:2] ELSE claims[1:4] END AS claims FROM (SELECT event_id, least(1.0, greatest(0.0, value / 200))::DOUBLE AS confidence, event_id % 6 = 0 AS missed, ['a', 'b', 'c', 'd', 'e'][1 : 1 + event_id % 4] AS claims FROM events)")
def judge_consistency(spark, sf):
    e = table(spark, sf, "events")
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 200))
    missed = F.col("event_id") % 6 == 0
    claims = F.slice(F.array(*[F.lit(x) for x in "abcde"]), F.lit(1), (1 + F.col("event_id") % 4).cast("int"))
    kept = F.when(missed, F.concat(F.array(F.lit("MISSED_REQUIRED_DISCLOSURE")), claims)).when(conf >= 0.6, F.slice(claims, 1, 2)).otherwise(F.slice(claims, 1, 4))
    return e.select("event_id", conf.alias("confidence"), (~missed & (conf >= 0.6)).alias("verified"), kept.alias("claims"))


@query("route_claim", "SELECT event_id, CASE WHEN regexp_matches(c, 'cross_guideline|disambiguation|disclosure') THEN 'disambiguation' WHEN regexp_matches(c, 'dose|mg/kg|drug|antibiotic|regimen') THEN 'drug' ELSE 'generic' END AS route FROM (SELECT event_id, lower(['Dose of 5 mg/kg', 'missing Disclosure', 'monitoring plan', 'wrong DRUG'][event_id % 4 + 1]) AS c FROM events)")
def route_claim(spark, sf):
    c = F.lower(F.element_at(F.array(*[F.lit(x) for x in ("Dose of 5 mg/kg", "missing Disclosure", "monitoring plan", "wrong DRUG")]), (F.col("event_id") % 4 + 1).cast("int")))
    return table(spark, sf, "events").select("event_id", F.when(c.rlike("cross_guideline|disambiguation|disclosure"), "disambiguation").when(c.rlike("dose|mg/kg|drug|antibiotic|regimen"), "drug").otherwise("generic").alias("route"))


@query("thin_fields", "SELECT doc_id, field FROM (SELECT doc_id, unnest(['monitoring_plan', 'escalation_criteria']) AS field, unnest([text[1:doc_id % 30], source]) AS body FROM documents) WHERE length(trim(body)) <= 15")
def thin_fields(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr("substring(text, 1, cast(doc_id % 30 as int))").alias("monitoring_plan"), F.col("source").alias("escalation_criteria"))
    long = d.unpivot("doc_id", ["monitoring_plan", "escalation_criteria"], "field", "body")
    return long.where(F.length(F.trim("body")) <= 15).select("doc_id", "field")


@query("fallback_plan", f"WITH {RISK} SELECT event_id, category IN ('HIGH', 'CRITICAL') AS required, CASE WHEN category IN ('HIGH', 'CRITICAL') THEN ['Initiate empiric antibiotics per active guideline.', 'Obtain blood culture before first dose.'] ELSE ['Continue observation per active guideline.'] END AS actions FROM v_risk")
def fallback_plan(spark, sf):
    need = F.col("category").isin("HIGH", "CRITICAL")
    actions = F.when(need, F.array(F.lit("Initiate empiric antibiotics per active guideline."), F.lit("Obtain blood culture before first dose."))).otherwise(F.array(F.lit("Continue observation per active guideline.")))
    return scored(spark, sf).select("event_id", need.alias("required"), actions.alias("actions"))


@query("plan_defaults", f"WITH {PLANS} SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN 'text' END, '') AS summary, coalesce(CASE WHEN id % 2 = 0 THEN 'now' END, 'Within 1 hour') AS urgency FROM v_plans")
def plan_defaults(spark, sf):
    raw = F.to_json(F.struct(F.when(F.col("id") % 3 == 0, "text").alias("summary"), F.struct(F.when(F.col("id") % 2 == 0, "now").alias("urgency")).alias("antibiotic_plan")))
    p = F.from_json(raw, "summary string, antibiotic_plan struct<urgency string>")
    return plan_rows(spark, sf).select("id", F.coalesce(p["summary"], F.lit("")).alias("summary"), F.coalesce(p["antibiotic_plan"]["urgency"], F.lit("Within 1 hour")).alias("urgency"))


@query("plan_to_text", f"WITH {PLANS} SELECT id, md5('ANTIBIOTIC PLAN: required=' || required || chr(10) || array_to_string(list_transform(regimen, lambda e: '- ' || e), chr(10)) || chr(10) || 'GUIDELINE: ' || guideline) AS digest FROM v_plans")
def plan_to_text(spark, sf):
    lines = F.array_join(F.transform("regimen", lambda e: F.concat(F.lit("- "), e)), "\n")
    text = F.concat(F.lit("ANTIBIOTIC PLAN: required="), F.col("required").cast("string"), F.lit("\n"), lines, F.lit("\nGUIDELINE: "), F.col("guideline"))
    return plan_rows(spark, sf).select("id", F.md5(text.cast("binary")).alias("digest"))
