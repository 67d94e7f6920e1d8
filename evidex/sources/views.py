"""Views of the given tables in the shapes that the operators take.

Each view exists as a DataFrame function and as SQL for the oracle; `duck`
puts before a query the views that it names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions.text import tokens
from evidex.operators.postings import InvertedIndex, opened
from evidex.sources.tables import spread, table

WINDOW_TOKENS, STEP = 200, 180


def chunk_rows(docs: DataFrame, width: int = WINDOW_TOKENS, step: int = STEP) -> DataFrame:
    """Windows of `width` tokens every `step` of (doc_id, source, subsection, text).

    Texts without tokens have no chunk. Columns: chunk_id, source, page,
    subsection, recommendation_id, chunk_type, chunk_index, chunk_text.
    """
    n = F.greatest(F.lit(1), F.ceil((F.size("toks") - (width - step)) / F.lit(float(step)))).cast("int")
    kinds = F.array(*[F.lit(k) for k in ("recommendation", "table", "background", "remarks")])
    return (
        docs.select("doc_id", F.upper("source").alias("source"), "subsection", tokens("text").alias("toks"))
        .withColumn("idx", F.explode_outer(F.when(F.size("toks") > 0, F.sequence(F.lit(0), n - 1))))
        .where("idx is not null")  # after the fact, so that texts are split once
        .select(
            F.concat("source", F.lit("_pg"), F.col("doc_id").cast("string"), F.lit("_c"), F.col("idx").cast("string")).alias("chunk_id"),
            "source",
            F.col("doc_id").alias("page"),
            "subsection",
            F.when(F.col("idx") == 0, F.concat(F.lit("R"), F.col("doc_id").cast("string"))).otherwise("").alias("recommendation_id"),
            F.element_at(kinds, F.col("idx") % 4 + 1).alias("chunk_type"),
            F.col("idx").cast("long").alias("chunk_index"),
            F.array_join(F.slice("toks", F.col("idx") * step + 1, width), " ").alias("chunk_text"),
        )
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("source"), F.col("source").alias("subsection"), "text")
    return chunk_rows(spread(docs, "doc_id"))


def index(spark: SparkSession, sf: str) -> InvertedIndex:
    """The stored index of all chunks, built at its first use."""
    return opened(spark, table(spark, sf, "documents"), lambda: chunks(spark, sf))


def stored_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """`chunks`, read from the index."""
    return index(spark, sf).chunks().drop("dl")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as queries of the English guideline."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text", F.lit("EN").alias("guideline"))


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Anchor phrases: the four-token windows of each query, side by side."""
    toks = queries(spark, sf).select("qid", tokens("text").alias("toks")).where(F.size("toks") >= 4)
    return toks.select("qid", F.explode(F.sequence(F.lit(0), F.floor(F.size("toks") / 4).cast("int") - 1)).alias("nth"), "toks").select(
        "qid", F.col("nth").cast("long").alias("nth"), F.array_join(F.slice("toks", F.col("nth") * 4 + 1, 4), " ").alias("phrase")
    )


SHIFT = {"EN": 8, "FR": 13, "DE": 1, "ES": 1}


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """One recommendation for each document's first chunk; its page is off by a fixed shift per source."""
    return recommendation_rows(chunks(spark, sf))


def stored_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """`recommendations`, read from the index; for those who read them more than once."""
    return recommendation_rows(stored_chunks(spark, sf))


def recommendation_rows(chunks: DataFrame) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in SECTION_TYPES])
    shift = F.coalesce(*[F.when(F.col("source") == s, F.lit(d)) for s, d in SHIFT.items()], F.lit(0))
    return chunks.where("chunk_index = 0").select(
        F.col("recommendation_id").alias("rec_id"),
        F.col("source").alias("guideline_id"),
        F.element_at(kinds, (F.col("page") % 6 + 1).cast("int")).alias("section_type"),
        F.array_join(F.slice(F.split("chunk_text", " "), 1, 15), " ").alias("text_summary"),
        (F.col("page") + shift).alias("page"),
    )


SECTION_TYPES = ("FirstLineAntibiotics", "Monitoring", "StoppingCriteria", "RiskFactors", "Duration", "Diagnosis")


def assessments(spark: SparkSession, sf: str) -> DataFrame:
    return assessment_rows(table(spark, sf, "events"))


def assessment_rows(e: DataFrame) -> DataFrame:
    """Events, in a batch or stream, as assessments of encounters."""
    k = F.col("event_id")
    kind = F.col("event_type")
    return e.select(
        k,
        F.col("user_id").alias("encounter"),
        "ts",
        (F.lit(33.0) + (k % 90) / F.lit(10.0)).alias("ga"),
        (F.lit(36.5) + (k % 30) / F.lit(10.0)).alias("maternal_temperature"),
        ((k * 7) % 30).alias("rom_hours"),
        (k % 3 == 0).alias("gbs"),
        (k % 6 == 0).alias("iap"),
        (k % 11 == 0).alias("chorio"),
        (k % 10).alias("apgar"),
        (F.lit(35.5) + (k % 25) / F.lit(10.0)).alias("neonatal_temperature"),
        (k % 13 == 0).alias("poor_perfusion"),
        F.when(kind == "error", "Severe").when(kind == "click", "Mild").otherwise("None").alias("respiratory"),
        F.when(kind == "error", "CPAP/Ventilation").when(kind == "purchase", "Supplemental").otherwise("None").alias("oxygen"),
        F.when((kind == "error") & (k % 2 == 0), "Seizures").when(kind == "signup", "Irritable/Lethargic").otherwise("Normal").alias("neuro"),
        F.when(kind != "view", F.col("value") / F.lit(10.0)).alias("crp"),
        F.when(kind != "signup", F.col("value") * F.lit(100.0)).alias("wbc"),
        F.when(k % 4 == 0, (k % 50) / F.lit(100.0)).alias("it_ratio"),
        F.when(k % 5 == 0, ((k % 300) * 1000).cast("double")).alias("platelets"),
        F.when(k % 7 == 0, (k % 20) / F.lit(20.0)).alias("pct"),
        (k % 97 == 0).alias("culture"),
    )


def courses(spark: SparkSession, sf: str) -> DataFrame:
    """Events as antibiotic courses of whole hours."""
    e = table(spark, sf, "events")
    hours = F.floor("value").cast("long")
    return e.select(
        F.col("user_id").alias("encounter"), F.col("event_id").alias("course"), F.col("event_type").alias("drug"), F.col("ts").alias("start"), hours.alias("hours")
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Typed edges over the order tables."""
    t = lambda n: table(spark, sf, n)
    e = lambda d, a, x, r, b, y: d.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("from_id"), F.lit(r).alias("relationship"), F.concat(F.lit(b), F.col(y).cast("string")).alias("to_id"))
    return (
        e(t("nation"), "region:", "n_regionkey", "RECOMMENDS", "nation:", "n_nationkey")
        .unionByName(e(t("customer"), "nation:", "c_nationkey", "HAS_RISK_FACTOR", "customer:", "c_custkey"))
        .unionByName(e(t("orders"), "customer:", "o_custkey", "REQUIRES", "order:", "o_orderkey"))
        .unionByName(e(t("lineitem"), "order:", "l_orderkey", "HAS_DOSE", "part:", "l_partkey"))
        .unionByName(e(t("supplier"), "supplier:", "s_suppkey", "SUPPORTED_BY", "nation:", "s_nationkey"))
    )


def text_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns (candidate) with the user turn before them (reference)."""
    c = table(spark, sf, "conversations")
    user = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("candidate")).join(user, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "candidate", "reference"
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a label and a score in [0, 1]."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / F.lit(500.0))).alias("score"),
    )


def ml_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with plain features; `toxic` is the candidate for leakage."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", tokens("text").alias("toks"), F.length(F.regexp_replace("text", "[^0-9]", "")).alias("digits"), F.length("text").alias("len"))
    return table(spark, sf, "labels").join(d, "doc_id").select(
        "doc_id",
        F.col("quality").alias("label"),
        "toxic",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size("toks").cast("double").alias("n_tokens"),
        (F.size(F.array_distinct("toks")) / F.greatest(F.size("toks"), F.lit(1)).cast("double")).alias("distinct_ratio"),
        (F.col("digits") / F.greatest("len", F.lit(1)).cast("double")).alias("digit_ratio"),
        (F.col("lang") == "en").cast("double").alias("is_en"),
    )


#: The same views for the oracle.
DUCK = {
    "v_chunks": """
      SELECT source || '_pg' || doc_id || '_c' || idx AS chunk_id, source, doc_id AS page, subsection,
        CASE WHEN idx = 0 THEN 'R' || doc_id ELSE '' END AS recommendation_id,
        ['recommendation', 'table', 'background', 'remarks'][idx % 4 + 1] AS chunk_type,
        CAST(idx AS BIGINT) AS chunk_index, array_to_string(toks[idx * 180 + 1 : idx * 180 + 200], ' ') AS chunk_text
      FROM (SELECT *, unnest(range(greatest(1, CAST(ceil((len(toks) - 20) / 180.0) AS BIGINT)))) AS idx
            FROM (SELECT doc_id, upper(lang) AS source, source AS subsection, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS toks FROM documents)
            WHERE len(toks) > 0)""",
    "v_queries": "SELECT item_id AS qid, text, 'EN' AS guideline FROM benchmark",
    "v_phrases": """
      SELECT qid, nth, array_to_string(toks[nth * 4 + 1 : nth * 4 + 4], ' ') AS phrase
      FROM (SELECT qid, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks, unnest(range(len(regexp_extract_all(lower(text), '[a-z0-9]+')) // 4)) AS nth FROM v_queries)""",
    "v_hits": """
      SELECT p.qid, p.nth, c.chunk_id, c.source FROM v_phrases p JOIN v_chunks c ON contains(c.chunk_text, p.phrase)""",
    "v_gold": """
      SELECT qid, chunk_id, hits FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, chunk_id) AS rn FROM (
          SELECT *, max(hits) OVER (PARTITION BY qid) AS most FROM (
            SELECT qid, chunk_id, count(*) AS hits FROM v_hits WHERE source = 'EN' GROUP BY qid, chunk_id))
        WHERE hits >= 2 OR most < 2) WHERE rn <= 8""",
    "v_recs": """
      SELECT recommendation_id AS rec_id, source AS guideline_id,
        ['FirstLineAntibiotics', 'Monitoring', 'StoppingCriteria', 'RiskFactors', 'Duration', 'Diagnosis'][page % 6 + 1] AS section_type,
        array_to_string(string_split(chunk_text, ' ')[1:15], ' ') AS text_summary,
        page + CASE source WHEN 'EN' THEN 8 WHEN 'FR' THEN 13 WHEN 'DE' THEN 1 WHEN 'ES' THEN 1 ELSE 0 END AS page
      FROM v_chunks WHERE chunk_index = 0""",
    "v_assessments": """
      SELECT event_id, user_id AS encounter, ts, 33.0::DOUBLE + (event_id % 90) / 10.0::DOUBLE AS ga, 36.5::DOUBLE + (event_id % 30) / 10.0::DOUBLE AS maternal_temperature,
        (event_id * 7) % 30 AS rom_hours, event_id % 3 = 0 AS gbs, event_id % 6 = 0 AS iap, event_id % 11 = 0 AS chorio, event_id % 10 AS apgar,
        35.5::DOUBLE + (event_id % 25) / 10.0::DOUBLE AS neonatal_temperature, event_id % 13 = 0 AS poor_perfusion,
        CASE event_type WHEN 'error' THEN 'Severe' WHEN 'click' THEN 'Mild' ELSE 'None' END AS respiratory,
        CASE event_type WHEN 'error' THEN 'CPAP/Ventilation' WHEN 'purchase' THEN 'Supplemental' ELSE 'None' END AS oxygen,
        CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'Seizures' WHEN event_type = 'signup' THEN 'Irritable/Lethargic' ELSE 'Normal' END AS neuro,
        CASE WHEN event_type <> 'view' THEN value / 10.0::DOUBLE END AS crp, CASE WHEN event_type <> 'signup' THEN value * 100.0::DOUBLE END AS wbc,
        CASE WHEN event_id % 4 = 0 THEN (event_id % 50) / 100.0::DOUBLE END AS it_ratio, CASE WHEN event_id % 5 = 0 THEN ((event_id % 300) * 1000)::DOUBLE END AS platelets,
        CASE WHEN event_id % 7 = 0 THEN (event_id % 20) / 20.0::DOUBLE END AS pct, event_id % 97 = 0 AS culture
      FROM events""",
    "v_courses": "SELECT user_id AS encounter, event_id AS course, event_type AS drug, ts AS start, CAST(floor(value) AS BIGINT) AS hours FROM events",
    "v_edges": """
      SELECT 'region:' || n_regionkey AS from_id, 'RECOMMENDS' AS relationship, 'nation:' || n_nationkey AS to_id FROM nation
      UNION ALL SELECT 'nation:' || c_nationkey, 'HAS_RISK_FACTOR', 'customer:' || c_custkey FROM customer
      UNION ALL SELECT 'customer:' || o_custkey, 'REQUIRES', 'order:' || o_orderkey FROM orders
      UNION ALL SELECT 'order:' || l_orderkey, 'HAS_DOSE', 'part:' || l_partkey FROM lineitem
      UNION ALL SELECT 'supplier:' || s_suppkey, 'SUPPORTED_BY', 'nation:' || s_nationkey FROM supplier""",
    "v_text_pairs": """
      SELECT a.conv_id * 1000 + a.turn AS pair_id, a.text AS candidate, u.text AS reference
      FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user'""",
    "v_scores": "SELECT event_id AS id, CAST(event_type = 'error' AS INT) AS label, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 500.0::DOUBLE)) AS score FROM events",
    "v_ml": """
      SELECT doc_id, quality AS label, toxic, n_chars::DOUBLE AS n_chars, len(toks)::DOUBLE AS n_tokens,
        len(list_distinct(toks)) / greatest(len(toks), 1)::DOUBLE AS distinct_ratio, digits / greatest(n, 1)::DOUBLE AS digit_ratio, CAST(lang = 'en' AS DOUBLE) AS is_en
      FROM (SELECT l.doc_id, quality, toxic, n_chars, lang, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks,
              length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(text) AS n FROM labels l JOIN documents d USING (doc_id))""",
}


def duck(sql: str) -> str:
    """The query with the views that it names, and those that they name, before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in DUCK and name not in order:
                need(DUCK[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql
    head = ", ".join(f"{n} AS ({DUCK[n]})" for n in order)
    body = sql.strip()
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
