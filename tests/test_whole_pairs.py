"""Queries that score pairs return every pair that their rule names."""

import pytest

import __spark_entry__ as entry
from evidex.operators import graph as G
from evidex.plans import retrieval_queries as RQ
from evidex.plans.graph_queries import BASELINE_KINDS
from tests.test_graph_index import made_up
from tests.test_whole_results import graph_points


def test_age_band_match_has_every_pair_of_texts(spark, sf):
    texts = {r.text for r in RQ.clinical(spark, sf).select("text").distinct().collect()}
    rows = entry.queries()["age_band_match"](spark, sf).collect()
    assert len(rows) == len(texts) ** 2 and {(r.query, r.chunk) for r in rows} == {(a, b) for a in texts for b in texts}
    of = {(r.query.split(" ")[0], r.chunk.split(" ")[0]): r.score for r in rows}
    # "day 14" contains "day 1", so that text names both bands
    assert of["newborn", "recommendation"] == 0.12 and of["newborn", "young"] == 0.0 and of["overview", "newborn"] == 0.0


@pytest.mark.parametrize("block", [4, 1024])
def test_graph_candidates_are_not_cut_at_ten_of_a_kind(spark, monkeypatch, block):
    monkeypatch.setattr(G, "BLOCK", block)
    asked, recs = made_up()
    got = G.all_candidates(spark.createDataFrame(asked, "qid int, text string"), spark.createDataFrame(recs, "rec_id string, section_type string, text_summary string"), BASELINE_KINDS)
    rows = [tuple(r) for r in got.collect()]
    want = {(q, rec, kind, kind in BASELINE_KINDS, float(p)) for q, t in asked for rec, kind, s in recs for m, p in [graph_points(t or "", kind, s or "")] if m}
    assert len(rows) == len(want) and set(rows) == want


def test_graph_candidates_has_every_pair(spark, sf):
    n = len(RQ.V.recommendations(spark, sf).where("guideline_id = 'EN'").where(RQ.F.col("section_type").isin(*BASELINE_KINDS)).collect())
    rows = entry.queries()["graph_candidates"](spark, sf)
    assert n > 40 and rows.where("baseline").count() == n * RQ.V.queries(spark, sf).count()
