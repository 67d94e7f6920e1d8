"""Queries: graph tables and graph retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions.text import has_any
from evidex.operators import graph as G
from evidex.operators.retrieval import top_k
from evidex.plans import retrieval_queries as RQ
from evidex.plans.registry import query, sql_list
from evidex.sources import views as V
from evidex.sources.tables import table


@query(
    "edge_repair",
    """WITH v_b AS (SELECT from_id, CASE WHEN relationship = 'HAS_DOSE' AND from_id LIKE '%1' THEN 'RECOMMENDS' ELSE relationship END AS relationship, to_id FROM v_edges WHERE NOT (relationship = 'RECOMMENDS' AND to_id LIKE '%3')),
      v_f AS (SELECT from_id, CASE WHEN relationship = 'RECOMMENDS' AND to_id LIKE 'part:%' THEN 'PRESCRIBES' ELSE relationship END AS relationship, to_id FROM v_b),
      v_rep AS (SELECT * FROM v_f UNION ALL SELECT from_id, relationship, to_id FROM v_edges WHERE relationship = 'RECOMMENDS' AND to_id LIKE '%3'),
      v_sec AS (SELECT *, section_id || CASE row_number() OVER (PARTITION BY section_id ORDER BY section_type) WHEN 1 THEN '' WHEN 2 THEN '_b' ELSE '_c' END AS new_id
        FROM (SELECT DISTINCT 'nation:' || s_nationkey AS section_id, 'kind' || s_suppkey % 3 AS section_type FROM supplier)),
      v_ty AS (SELECT 'supplier:' || s_suppkey AS id, 'kind' || s_suppkey % 3 AS section_type FROM supplier)
      SELECT relationship, CASE WHEN relationship = 'SUPPORTED_BY' THEN coalesce(new_id, to_id) END AS section, count(*) AS n
      FROM v_rep LEFT JOIN v_ty ON v_ty.id = v_rep.from_id LEFT JOIN v_sec ON relationship = 'SUPPORTED_BY' AND v_sec.section_id = v_rep.to_id AND v_sec.section_type = v_ty.section_type GROUP BY ALL""",
)
def edge_repair(spark, sf):
    """Edges per relationship after the repair; nations stand for sections that occur once for each kind of supplier."""
    name = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    e = V.edges(spark, sf)
    roots = e.where("relationship = 'RECOMMENDS'").select("from_id", "to_id")
    broken = e.where("not (relationship = 'RECOMMENDS' and to_id like '%3')").withColumn("relationship", F.expr("case when relationship = 'HAS_DOSE' and from_id like '%1' then 'RECOMMENDS' else relationship end"))
    doses = table(spark, sf, "part").select(name("part:", "p_partkey").alias("id"))
    kinds = table(spark, sf, "supplier").select(name("supplier:", "s_suppkey").alias("id"), name("nation:", "s_nationkey").alias("section_id"), F.concat(F.lit("kind"), (F.col("s_suppkey") % 3).cast("string")).alias("section_type"))
    sections = G.unique_section_ids(kinds.select(F.lit("all").alias("guideline"), "section_id", "section_type").distinct())
    fixed = G.remap_targets(G.repair_edges(broken, doses, roots), sections, kinds.select("id", "section_type"))
    section = F.when(F.col("relationship") == "SUPPORTED_BY", F.col("to_id"))
    return fixed.groupBy("relationship", section.alias("section")).agg(F.count("*").alias("n"))


@query("derive_edges", "SELECT DISTINCT 'order:' || l_orderkey AS from_id, 'HAS_DOSE' AS relationship, 'part:' || l_partkey AS to_id FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_linenumber = 1 AND x.l_orderkey = lineitem.l_orderkey AND x.l_partkey = lineitem.l_partkey)")
def derive_edges(spark, sf):
    li = table(spark, sf, "lineitem").select("l_linenumber", F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("drug"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dose"))
    have = li.where("l_linenumber = 1").select(F.col("drug").alias("from_id"), F.lit("HAS_DOSE").alias("relationship"), F.col("dose").alias("to_id"))
    return G.derived_doses(have, li)


@query("build_graph", f"SELECT relationship, split_part(from_id, ':', 1) AS from_kind, split_part(to_id, ':', 1) AS to_kind, count(*) AS n FROM v_edges WHERE list_contains({sql_list(G.EDGE_TYPES)}, relationship) GROUP BY ALL")
def build_graph(spark, sf):
    kind = lambda c: F.split(c, ":")[0]
    return G.build(V.edges(spark, sf)).groupBy("relationship", kind("from_id").alias("from_kind"), kind("to_id").alias("to_kind")).agg(F.count("*").alias("n"))


@query("root_reachability", "SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def root_reachability(spark, sf):
    nodes = table(spark, sf, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    edges = V.edges(spark, sf).where("relationship = 'REQUIRES'").withColumn("relationship", F.lit("RECOMMENDS"))
    return G.unreachable_roots(nodes, edges)


@query(
    "typed_traversal",
    """WITH v_one AS (SELECT 'customer:' || o_custkey AS id, 'order:' || o_orderkey AS entity FROM orders),
      v_sup AS (SELECT from_id AS id, to_id AS entity FROM v_edges WHERE from_id LIKE 'supplier:%'),
      v_drug AS (SELECT id, e.from_id AS entity FROM v_sup JOIN v_edges e ON e.to_id = v_sup.entity AND e.relationship = 'RECOMMENDS' WHERE v_sup.entity LIKE 'nation:%')
      SELECT id, entity FROM v_one UNION SELECT id, e.to_id FROM v_one JOIN v_edges e ON e.from_id = v_one.entity AND e.relationship = 'HAS_DOSE'
      UNION SELECT * FROM v_sup UNION SELECT * FROM v_drug UNION SELECT id, e.to_id FROM v_drug JOIN v_edges e ON e.from_id = v_drug.entity""",
)
def typed_traversal(spark, sf):
    """Customers over orders to parts; suppliers as recommendations, with nations for doses and regions for the drugs that have them."""
    edges = V.edges(spark, sf)
    ids = lambda t, a, c: table(spark, sf, t).select(F.concat(F.lit(a), F.col(c).cast("string")).alias("id"))
    nations = ids("nation", "nation:", "n_nationkey").select(F.col("id").alias("node"), F.lit("nation").alias("kind"))
    bought = G.follow(edges, nations, ids("customer", "customer:", "c_custkey"), [(G.Step("REQUIRES"),), (G.Step("REQUIRES"), G.Step("HAS_DOSE"))])
    return bought.unionByName(G.recommendation_entities(edges, nations, ids("supplier", "supplier:", "s_suppkey"), "nation", "RECOMMENDS"))


def _named_sql(dictionary) -> str:
    parts = []
    for k, v in dictionary.items():
        words, name = ((k,), v) if isinstance(v, str) else (v, k)
        parts.append(f"CASE WHEN {' OR '.join(f'contains(l, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}' END")
    return f"list_sort(list_distinct(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)))"


@query("surface_entities", f"WITH {RQ.CLINICAL} SELECT qid, {_named_sql(G.SURFACE)} AS entities FROM (SELECT qid, lower(text) AS l FROM v_clin)")
def surface_entities(spark, sf):
    return RQ.clinical(spark, sf).select("qid", G.named(F.col("text"), G.SURFACE).alias("entities"))


@query("section_match", f"WITH {RQ.CLINICAL} SELECT qid, {_named_sql(G.SECTION_WORDS)} AS sections FROM (SELECT qid, lower(text) AS l FROM v_clin)")
def section_match(spark, sf):
    return RQ.clinical(spark, sf).select("qid", G.named(F.col("text"), G.SECTION_WORDS).alias("sections"))


CALIBRATE = """v_rw AS (SELECT rec_id, guideline_id AS source, page, unnest(list_distinct(regexp_extract_all(lower(text_summary), '[a-z]{5,}'))) AS w FROM v_recs), v_sh AS (SELECT rec_id, source, w, d AS shift, page - d AS page FROM v_rw, (SELECT unnest(range(-15, 16)) AS d)),
  v_cw AS (SELECT DISTINCT source, page, unnest(list_distinct(regexp_extract_all(lower(chunk_text), '[a-z]{5,}'))) AS w FROM v_chunks),
  v_n AS (SELECT source, shift, rec_id, count(*) AS n FROM v_sh JOIN v_cw USING (source, page, w) GROUP BY ALL), v_by AS (SELECT source, shift, sum(n)::BIGINT AS total, count(*) FILTER (WHERE n >= 3) AS hits FROM v_n GROUP BY ALL),
  v_cal AS (SELECT source, shift::INT AS shift, total, hits FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY total DESC, shift) AS rn FROM v_by) WHERE rn = 1)"""


@query("offset_calibrate", f"WITH {CALIBRATE} SELECT * FROM v_cal")
def offset_calibrate(spark, sf):
    return G.calibrate(V.recommendations(spark, sf), V.chunks(spark, sf))


def shifted(spark, sf):
    shift = F.when(F.col("guideline_id") == "EN", 8).when(F.col("guideline_id") == "FR", 13).otherwise(1)
    return V.stored_recommendations(spark, sf).withColumn("page", F.col("page") - shift)


BASELINE_KINDS = ("FirstLineAntibiotics", "Monitoring", "StoppingCriteria", "Duration")
_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z]{{4,}}'))"
CAND = f"""v_gq AS (SELECT qid, {_WORDS.format('text')} AS qw, {_named_sql(G.SURFACE)} AS qe, {_named_sql(G.SECTION_WORDS)} AS qs, {RQ.tier_sql('l')} AS qt FROM (SELECT *, lower(coalesce(text, '')) AS l FROM v_queries)),
  v_gr AS (SELECT rec_id, section_type, coalesce(list_contains({sql_list(BASELINE_KINDS)}, section_type), false) AS baseline, {_WORDS.format('text_summary')} AS rw, {_named_sql(G.SURFACE)} AS re, {RQ.tier_sql('l')} AS rt FROM (SELECT *, lower(text_summary) AS l FROM v_recs WHERE guideline_id = 'EN')),
  v_gm AS (SELECT *, list_has_any(qe, re) AS entity, list_contains(qs, section_type) AS section FROM v_gq, v_gr),
  v_gc AS (SELECT qid, rec_id, section_type, baseline, (100 * entity::INT + 10 * section::INT + CASE WHEN baseline AND NOT entity AND NOT section THEN 5 ELSE 0 END + len(list_intersect(qw, rw))
    + 20 * CASE WHEN qt IS NULL OR rt IS NULL THEN 0 WHEN qt = rt THEN 1 ELSE -1 END)::DOUBLE AS score FROM v_gm WHERE entity OR section OR baseline)"""


def candidates(spark, sf):
    """The ten best recommendations of the query's guideline of each kind, of those that match it or are baseline."""
    return G.candidates(V.queries(spark, sf), V.stored_recommendations(spark, sf).where("guideline_id = 'EN'"), BASELINE_KINDS)


@query("graph_candidates", f"WITH {CAND} SELECT qid, rec_id, baseline, score FROM v_gc")
def graph_candidates(spark, sf):
    found = G.all_candidates(V.queries(spark, sf), V.recommendations(spark, sf).where("guideline_id = 'EN'"), BASELINE_KINDS)
    return found.select("qid", "rec_id", "baseline", "score")


WINDOW = f"""{CAND}, v_gt AS (SELECT qid, rec_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rec_id) AS n FROM v_gc) WHERE n <= 10),
  v_rr AS (SELECT qid, rec_id, guideline_id AS source, page - 8 AS page, {_WORDS.format('text_summary')} AS hint, {_WORDS.format('text')} AS asked FROM v_gt JOIN v_recs USING (rec_id) JOIN v_queries USING (qid) WHERE guideline_id = 'EN'),
  v_cc AS (SELECT chunk_id, source, page, {_WORDS.format('chunk_text')} AS words FROM v_chunks),
  v_win AS (SELECT qid, rec_id, chunk_id, 3 * len(list_intersect(hint, words)) + len(list_intersect(asked, words)) AS score FROM v_rr r JOIN v_cc c ON r.source = c.source AND c.page BETWEEN r.page - 5 AND r.page + 5),
  v_wr AS (SELECT *, row_number() OVER (PARTITION BY qid, rec_id ORDER BY score DESC, chunk_id) AS rank FROM v_win)"""


def windows(spark, sf, pairs):
    """Ranked chunks near the recommendation of each (qid, rec_id)."""
    recs = shifted(spark, sf).where("guideline_id = 'EN'")
    return G.page_window(pairs.join(recs, "rec_id").join(V.queries(spark, sf).select("qid", "text"), "qid"), V.stored_chunks(spark, sf))


@query("page_window", f"WITH {WINDOW} SELECT qid, rec_id, chunk_id, score, rank FROM v_wr WHERE rank <= 4")
def page_window(spark, sf):
    best = top_k(candidates(spark, sf), 10, tie="rec_id").select("qid", "rec_id")
    return windows(spark, sf, best).where("rank <= 4")


@query("rationale_channel", "SELECT chunk_id FROM v_chunks WHERE source = 'EN' AND (contains(chunk_text, 'the the') OR contains(chunk_text, 'thnt')) OR source = 'FR' AND contains(chunk_text, 'tion de')")
def rationale_channel(spark, sf):
    c, t = V.chunks(spark, sf), F.col("chunk_text")
    return c.where(((F.col("source") == "EN") & has_any(t, ("the the", "thnt"))) | ((F.col("source") == "FR") & has_any(t, ("tion de",)))).select("chunk_id")


@query("graph_select")
def graph_select(spark, sf):
    c = top_k(candidates(spark, sf), 7, by=("qid", "section_type"), tie="rec_id").drop("rank")  # at most 42 recommendations a query
    w = windows(spark, sf, c.select("qid", "rec_id")).where("rank <= 2").select("qid", "rec_id", "chunk_id", "rank")
    return G.select_covering(c.withColumnRenamed("section_type", "kind").join(w, ["qid", "rec_id"]), 10)


@query("route_by_threshold", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'NICE' WHEN ga < 35 THEN 'AAP_PRETERM' ELSE 'AAP_TERM' END AS graph FROM v_assessments")
def route_by_threshold(spark, sf):
    return V.assessments(spark, sf).select("event_id", G.route(F.when(F.col("event_id") % 3 != 0, "NICE").otherwise("AAP"), F.col("ga")).alias("graph"))
