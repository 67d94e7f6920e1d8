"""Audit chains: against a fold in plain Python, and what removal, moving and cutting of segments shows."""

import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evidex.operators import audit


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def links(payloads, size):
    out = []
    for i, p in enumerate(payloads):
        out.append(sha("genesis" if i % size == 0 else out[-1], p))
    return out


def chain(payloads, size):
    link = links(payloads, size)
    if len(payloads) <= size:
        return [sha("genesis", x) for x in link]
    ends = [link[min(i + size, len(link)) - 1] for i in range(0, len(link), size)]
    heads = ["genesis", *chain(ends, size)]
    return [sha(heads[i // size], x) for i, x in enumerate(link)]


@pytest.fixture(scope="module")
def log(spark):
    rows = [(k, i, f"{k}-{i}") for k, n in (("a", 70), ("b", 3), ("c", 16), (None, 20)) for i in range(n)] + [("b", 3, None)]
    return spark.createDataFrame(rows, "who string, at int, what string").repartition(7)


@pytest.fixture(scope="module")
def made(log):
    return audit.audit_chain(log, "who", ["at"], "what", segment=4).cache()


def test_chain_is_the_fold_of_its_levels(made):
    got = {}
    for r in made.orderBy("who", "n").collect():
        got.setdefault(r.who, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {"a": 70, "b": 4, "c": 16, None: 20}
    for rows in got.values():  # 70 rows of four make three levels
        assert [r.n for r in rows] == [r.at for r in rows] == list(range(len(rows)))
        assert [r.chain_hash for r in rows] == chain([r.what or "" for r in rows], 4)


def again(rows):
    """As a forger would leave it: places without a gap."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("who").orderBy("n")) - 1)


def invalid(rows, **more):
    got = audit.audit_verify(rows, "who", "what", segment=4, **more).where("not valid").collect()
    return sorted((r.who or "", r.at) for r in got)


def test_untouched_log_is_valid(made):
    assert invalid(made, heads=audit.audit_heads(made, "who")) == []


def test_altered_payload_link_and_hash_show(made):
    assert invalid(made.withColumn("what", F.when(F.expr("who = 'a' and at = 9"), "x").otherwise(F.col("what")))) == [("a", 9)]
    assert invalid(made.withColumn("chain_hash", F.when(F.expr("who = 'a' and at = 9"), "x").otherwise(F.col("chain_hash")))) == [("a", 9)]
    assert invalid(made.withColumn("link", F.when(F.expr("who = 'a' and at = 9"), "x").otherwise(F.col("link")))) == [("a", 9), ("a", 10)]


@pytest.mark.parametrize("gone", ["at between 8 and 11", "at < 4", "at between 16 and 31", "at = 13"])
def test_missing_rows_show_in_all_later_segments(made, gone):
    left = again(made.where(f"who <> 'a' or who is null or not ({gone})"))
    shown = invalid(left)
    assert {w for w, _ in shown} == {"a"}
    last = {"at between 8 and 11": 11, "at < 4": 3, "at between 16 and 31": 31, "at = 13": 15}[gone]
    assert [i for _, i in shown if i > last] == [i for i in range(last + 1, 70)]


def test_moved_segments_show(made):
    moved = made.withColumn("n", F.expr("case when who = 'a' and at between 8 and 11 then n + 4 when who = 'a' and at between 12 and 15 then n - 4 else n end"))
    assert ("a", 12) in invalid(moved) and ("a", 69) in invalid(moved)


def test_cut_end_shows_by_the_kept_heads(made):
    heads = audit.audit_heads(made, "who")
    short = made.where("who <> 'a' or at < 64 or who is null")
    assert invalid(short) == [] and invalid(short, heads=heads) == [("a", 63)]


def test_places_equal_a_window(spark, log):
    got = {(r.who, r.at): r.n for r in audit.numbered(log, "who", ["at"]).collect()}
    assert got == {(r.who, r.at): r.at for r in log.collect()}
