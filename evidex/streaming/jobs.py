"""Structured Streaming jobs that reuse the batch expressions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def drain(stream: DataFrame, spark: SparkSession, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, to Parquet under `folder`, and read the result."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def alerts(assessed: DataFrame) -> DataFrame:
    """Alert rows of arriving scored assessments (event_id, encounter, ga, culture, category)."""
    kinds = F.array_compact(F.array(F.when(F.col("category").isin("HIGH", "CRITICAL"), "risk"), F.when(F.col("ga") < 37, "preterm"), F.when(F.col("culture"), "culture")))
    return assessed.select("event_id", "encounter", F.explode(kinds).alias("alert"))


def registered(spark: SparkSession, folder: str, schema: StructType, before: int | None = None) -> DataFrame:
    """Rows of a registry with the batch that brought each; those before batch `before` if given."""
    try:
        rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(folder)
    except Exception as e:  # nothing has come in yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], StructType([*schema.fields, StructField("batch", LongType())]))
    return rows if before is None else rows.where(F.col("batch") < before)


def ingest(stream: DataFrame, id_col: str, folder: str) -> DataFrame:
    """Take in what is there of a stream, each id once and for good; gives the registry under `folder`.

    A batch adds rows whose id no earlier batch brought; of repeats within it
    one stays. Each batch has a folder of its own by its number, so a batch
    that is run again after a loss writes the same place and counts once.
    There is no watermark: a repeat never comes in, however late. Rows without
    id are left out.
    """
    spark, registry = stream.sparkSession, f"{folder}/registry"

    def add(batch: DataFrame, number: int) -> None:
        known = registered(spark, registry, stream.schema, number).select(id_col)
        new = batch.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).join(known, id_col, "left_anti").select(*stream.columns)
        new.write.mode("overwrite").parquet(f"{registry}/batch={number}")

    q = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return registered(spark, registry, stream.schema)


HELD = "ts array<bigint>, id array<bigint>, total array<bigint>, crp array<double>, base_total bigint, base_crp double, base_streak bigint, revision bigint"
TRENDS = "encounter bigint, event_id bigint, score_delta bigint, crp_streak bigint, revision bigint"


def _follow(rows: list[tuple], base: tuple | None) -> list[tuple]:
    """(event_id, score_delta, crp_streak, crp) along rows (ts, id, total, crp) in time order, after base (total, crp, streak)."""
    out, before = [], base
    for _, e, total, crp in rows:
        streak = before[2] + 1 if before is not None and crp > before[1] else 0  # a missing value (NaN) is no rise
        out.append((e, None if before is None else total - before[0], streak, crp))
        before = (total, crp, streak)
    return out


def trends(rows: DataFrame, delay: str = "30 days") -> DataFrame:
    """Score change and streak of rising CRP at each assessment, by event time, with corrections.

    rows (encounter, event_id, ts, total, crp). Assessments of an encounter are
    held in the order of their times until the watermark, `delay` behind the
    newest, has passed them; a row that arrives late among them is put in its
    place, and the rows whose results it changes come out again with a higher
    `revision` (`settled` keeps the last). Of what the watermark has passed one
    row is kept, and a timer lets the others go where nothing more arrives.
    Rows later than the delay, and rows without time, are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held, base, revision = [], None, 0
        if state.exists:
            ts, ids, totals, crps, *kept, revision = state.get
            held = list(zip(ts, ids, totals, crps))
            base = None if kept[0] is None else tuple(kept)
        old = {e: (d, n) for e, d, n, _ in _follow(held, base)}
        out = []
        if not state.hasTimedOut:
            for pdf in batches:
                stamps = pdf["ts"].astype("datetime64[us]").astype("int64")
                held += [(int(t), int(e), int(x), float(c)) for t, e, x, c in zip(stamps, pdf["event_id"], pdf["total"], pdf["crp"].astype("float64"))]
            held.sort(key=lambda r: r[:2])
            revision += 1
            out = [(key[0], e, d, n, revision) for e, d, n, _ in _follow(held, base) if old.get(e) != (d, n)]
        passed = sum(t <= state.getCurrentWatermarkMs() * 1000 for t, *_ in held)
        if passed:
            _, _, streak, crp = _follow(held[:passed], base)[-1]
            base, held = (held[passed - 1][2], crp, streak), held[passed:]
        columns = [list(c) for c in zip(*held)] or [[], [], [], []]
        state.update((*columns, *(base or (None, None, None)), revision))
        if held:
            state.setTimeoutTimestamp(max(held[-1][0] // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["encounter", "event_id", "score_delta", "crp_streak", "revision"]).astype({"score_delta": "Int64", "crp_streak": "Int64"})

    timed = rows.where("ts is not null").withWatermark("ts", delay)
    return timed.groupBy("encounter").applyInPandasWithState(step, TRENDS, HELD, "append", "EventTimeTimeout")


def settled(revised: DataFrame) -> DataFrame:
    """The last revision of each assessment."""
    last = F.max_by(F.struct("score_delta", "crp_streak"), "revision").alias("_r")
    return revised.groupBy("encounter", "event_id").agg(last).select("encounter", "event_id", "_r.*")
