"""Queries: streaming jobs, drained over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidex.functions import risk as K
from evidex.plans.registry import query
from evidex.plans.risk_queries import RISK
from evidex.sources import views as V
from evidex.sources.tables import checkpoint_folder
from evidex.streaming import jobs


def stream_of(spark, sf, name="events"):
    """A table as a stream of its files."""
    given = spark.read.parquet(f"{sf}/{name}.parquet")
    folder = given.inputFiles()[0].rsplit("/", 1)[0]
    pattern = f"{name}.parquet" if folder.rstrip("/").endswith(sf.rstrip("/").rsplit("/", 1)[-1]) else "*.parquet"
    return spark.readStream.schema(given.schema).option("pathGlobFilter", pattern).parquet(folder)


def scratch(spark) -> str:
    base = checkpoint_folder(spark)
    return f"{base}/stream-{uuid.uuid4().hex}"


def assessed(spark, sf):
    rows = V.assessment_rows(stream_of(spark, sf)).withColumn("drivers", K.drivers())
    for i in (1, 2, 3):
        rows = rows.withColumn(f"l{i}", K.layer_sum(F.col("drivers"), i))
    rows = rows.withColumn("total", K.total_score(F.col("l1"), F.col("l2"), F.col("l3"), F.col("culture")))
    return rows.withColumn("category", K.category(F.col("total")))


@query("stream_alerts", f"WITH {RISK} SELECT event_id, encounter, unnest(list_filter([CASE WHEN category IN ('HIGH', 'CRITICAL') THEN 'risk' END, CASE WHEN ga < 37 THEN 'preterm' END, CASE WHEN culture THEN 'culture' END], lambda x: x IS NOT NULL)) AS alert FROM v_risk")
def stream_alerts(spark, sf):
    return jobs.drain(jobs.alerts(assessed(spark, sf)), spark, scratch(spark))


@query("stream_ingest_dedup", "SELECT DISTINCT md5(chunk_text) AS content_id FROM v_chunks")
def stream_ingest_dedup(spark, sf):
    """Content ids of the chunks that came in: equal chunks of all documents once."""
    docs = stream_of(spark, sf, "documents").select("doc_id", F.col("lang").alias("source"), F.col("source").alias("subsection"), "text")
    chunks = V.chunk_rows(docs).select(F.md5(F.col("chunk_text").cast("binary")).alias("content_id"), "chunk_id", "chunk_text")
    return jobs.ingest(chunks, "content_id", scratch(spark)).select("content_id")


@query("stream_trends", f"WITH {RISK}, v_lag AS (SELECT *, total - lag(total) OVER w AS score_delta, CASE WHEN crp > lag(crp) OVER w THEN 1 ELSE 0 END AS up FROM v_risk WINDOW w AS (PARTITION BY encounter ORDER BY ts, event_id)), v_is AS (SELECT *, sum(1 - up) OVER (PARTITION BY encounter ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM v_lag) SELECT encounter, event_id, score_delta::BIGINT AS score_delta, sum(up) OVER (PARTITION BY encounter, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS crp_streak FROM v_is")
def stream_trends(spark, sf):
    rows = assessed(spark, sf).select("encounter", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("total").cast("long").alias("total"), "crp")
    return jobs.settled(jobs.drain(jobs.trends(rows), spark, scratch(spark)))
