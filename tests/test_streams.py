"""Streams over several small batches and a restart, against results over all rows at once."""

import random

import pytest

from evidex.streaming import jobs

ROWS = "encounter bigint, event_id bigint, ts timestamp, total bigint, crp double"


def arrivals(seed=6, n=120):
    rng = random.Random(seed)
    base = 1_700_000_000
    rows = [(rng.randrange(5), i, base + rng.randrange(40) * 3_600, rng.randrange(12), rng.choice([None, 1.0, 2.0, 3.0, 4.0, 5.0])) for i in range(n)]
    rng.shuffle(rows)  # late rows all over
    return rows


def in_order(rows):
    out = {}
    for key in {r[0] for r in rows}:
        before, streak = None, 0
        for _, e, _, total, crp in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            up = before is not None and crp is not None and before[1] is not None and crp > before[1]
            streak = streak + 1 if up else 0
            out[key, e] = (None if before is None else total - before[0], streak)
            before = (total, crp)
    return out


def put(spark, rows, folder, schema, nth):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{nth}")


@pytest.fixture
def stream(spark, tmp_path):
    def source(schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    return source


def timed(rows):
    from datetime import datetime

    return [(k, e, datetime.fromtimestamp(t), x, c) for k, e, t, x, c in rows]


def test_late_rows_correct_what_came_out(spark, tmp_path, stream):
    rows = arrivals()
    for i in range(4):
        put(spark, timed(rows[i * 20 : i * 20 + 20]), f"{tmp_path}/in", ROWS, i)
    first = jobs.settled(jobs.drain(jobs.trends(stream(ROWS)), spark, str(tmp_path / "run")))
    assert {(r.encounter, r.event_id): (r.score_delta, r.crp_streak) for r in first.collect()} == in_order(rows[:80])
    for i in range(4, 6):  # after a restart from the same state
        put(spark, timed(rows[i * 20 : i * 20 + 20]), f"{tmp_path}/in", ROWS, i)
    revised = jobs.drain(jobs.trends(stream(ROWS)), spark, str(tmp_path / "run"))
    got = jobs.settled(revised).collect()
    assert len(got) == len(rows) and {(r.encounter, r.event_id): (r.score_delta, r.crp_streak) for r in got} == in_order(rows)
    assert revised.count() > len(rows)  # some came out again


def test_rows_behind_the_watermark_leave_one_and_the_rest_follow(spark, tmp_path, stream):
    rows = sorted(arrivals(9, 60), key=lambda r: r[2])  # in order: nothing is late
    for i in range(6):
        put(spark, timed(rows[i * 10 : i * 10 + 10]), f"{tmp_path}/in", ROWS, i)
    put(spark, [(1, 900, None, 3, 1.0)], f"{tmp_path}/in", ROWS, 6)
    got = jobs.settled(jobs.drain(jobs.trends(stream(ROWS), "1 hour"), spark, str(tmp_path / "run"))).collect()
    assert {(r.encounter, r.event_id): (r.score_delta, r.crp_streak) for r in got} == in_order(rows)


def test_ids_come_in_once_over_batches_restarts_and_repeated_batches(spark, tmp_path, stream):
    schema = "id string, text string"
    for i, ids in enumerate([["a", "b", "a"], ["b", "c", None], ["a", "d"]]):
        put(spark, [(x, f"{x}{i}") for x in ids], f"{tmp_path}/in", schema, i)
    folder = str(tmp_path / "run")
    assert sorted(r.id for r in jobs.ingest(stream(schema), "id", folder).collect()) == ["a", "b", "c", "d"]
    put(spark, [("c", "late"), ("e", "e3")], f"{tmp_path}/in", schema, 3)
    got = jobs.ingest(stream(schema), "id", folder)
    assert sorted(r.id for r in got.collect()) == ["a", "b", "c", "d", "e"]
    assert {r.text for r in got.collect() if r.id == "c"} == {"c1"}
    (tmp_path / "run" / "state" / "commits" / "3").unlink()  # as if lost before the commit: the batch runs again
    (tmp_path / "run" / "state" / "commits" / ".3.crc").unlink(missing_ok=True)
    assert sorted(r.id for r in jobs.ingest(stream(schema), "id", folder).collect()) == ["a", "b", "c", "d", "e"]
