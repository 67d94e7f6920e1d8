"""Results over all rows of small made-up tables, against plain Python."""

import re

import numpy as np
import pytest

import __spark_entry__ as entry
from evidex.operators import fusion as X
from evidex.operators import graph as G
from evidex.plans.graph_queries import BASELINE_KINDS
from evidex.sources import views as V


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """Few documents, most with ids past 200."""
    folder = str(tmp_path_factory.mktemp("late"))
    ids = (3, 40, 199, 200, 201, 5000, 5001, 70_002)
    text = "the the treatment of infants with gentamicin for seven days"
    docs = [(i, text, "en", "web", len(text)) for i in ids] + [(900, text, "fr", "web", len(text))]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "gentamicin treatment days"), (2, "none here")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def graph_points(query, kind, summary):
    """(any match, points) by the rule in words."""
    forms = lambda t: {v for k, v in G.SURFACE.items() if k in t.lower()}
    words = lambda t: set(re.findall("[a-z]{4,}", t.lower()))
    entity = bool(forms(query) & forms(summary))
    section = any(w in query.lower() for w in G.SECTION_WORDS.get(kind, ()))
    baseline = kind in BASELINE_KINDS
    tier = {}
    for name, t in (("q", query.lower()), ("r", summary.lower())):
        a, b = any(w in t for w in X.TIER_CRITICAL), any(w in t for w in X.TIER_SEVERE)
        tier[name] = None if a == b else a
    same = 0 if None in tier.values() else 1 if tier["q"] == tier["r"] else -1
    return entity or section or baseline, 100 * entity + 10 * section + 5 * (baseline and not entity and not section) + len(words(query) & words(summary)) + 20 * same


def test_graph_candidates_of_all_documents(spark, late):
    queries = {r.qid: r.text for r in V.queries(spark, late).collect()}
    want = set()
    for r in V.recommendations(spark, late).where("guideline_id = 'EN'").collect():
        for qid, text in queries.items():
            match, points = graph_points(text, r.section_type, r.text_summary)
            if match:
                want.add((qid, r.rec_id, r.section_type in BASELINE_KINDS, float(points)))
    assert {r[1] for r in want} == {"R3", "R40", "R199", "R200", "R201", "R5000", "R5001", "R70002"}
    got = [tuple(r) for r in entry.queries()["graph_candidates"](spark, late).select("qid", "rec_id", "baseline", "score").collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("k", [5, 1000])
def test_graph_points_of_every_kind(spark, k):
    texts = ["gentamicin dose", "monitor trough levels", "critical illness and gbs", "possible serious bacterial infection", "nothing", "", None, "Monitor GBS"]
    recs = [("R1", "Monitoring", "monitor gentamicin trough levels"), ("R2", "RiskFactors", "maternal gbs in critical illness"), ("R3", "Duration", "psbi for seven days"), ("R4", "RiskFactors", None), ("R5", None, "gentamicin")]
    got = G.candidates(spark.createDataFrame(list(enumerate(texts)), "qid int, text string"), spark.createDataFrame(recs, "rec_id string, section_type string, text_summary string"), BASELINE_KINDS, k).collect()
    want = {(q, rec, float(p)) for q, t in enumerate(texts) for rec, kind, s in recs for m, p in [graph_points(t or "", kind, s or "")] if m}
    assert len(got) == len(want) and {(r.qid, r.rec_id, r.score) for r in got} == want
    assert {p for _, _, p in want} > {5.0, 101.0} and any(p < 0 for _, _, p in want)
    assert {(r.rec_id, r.baseline) for r in got} == {("R1", True), ("R2", False), ("R3", True), ("R5", False)}


def test_page_window_counts_summary_and_query_words(spark):
    recs = spark.createDataFrame([(1, "R", "S", 20, "alpha bravo", "charlie delta"), (2, "R", "S", 20, "alpha bravo", None)], "qid int, rec_id string, guideline_id string, page int, text_summary string, text string")
    chunks = [("a", "S", 15, "alpha alpha charlie"), ("b", "S", 25, "bravo charlie delta"), ("c", "S", 26, "alpha bravo"), ("d", "T", 20, "alpha bravo"), ("e", "S", 21, None)]
    got = G.page_window(recs, spark.createDataFrame(chunks, "chunk_id string, source string, page int, chunk_text string")).collect()
    assert {(r.qid, r.chunk_id, r.score, r["rank"]) for r in got} == {(1, "b", 5, 1), (1, "a", 4, 2), (1, "e", 0, 3), (2, "a", 3, 1), (2, "b", 3, 2), (2, "e", 0, 3)}


def test_supporting_edges_follow_renamed_sections(spark):
    edges = spark.createDataFrame([("r1", "SUPPORTED_BY", "s"), ("r2", "SUPPORTED_BY", "s"), ("r3", "SUPPORTED_BY", "s"), ("r2", "TREATS", "s"), (None, "SUPPORTED_BY", "s"), ("x", None, "s")], "from_id string, relationship string, to_id string")
    sections = G.unique_section_ids(spark.createDataFrame([("g", "s", "dose"), ("g", "s", "risk")], "guideline string, section_id string, section_type string"))
    types = spark.createDataFrame([("r1", "dose"), ("r2", "risk")], "id string, section_type string")
    got = sorted((tuple(r) for r in G.remap_targets(edges, sections, types).collect()), key=str)
    want = [("r1", "SUPPORTED_BY", "s"), ("r2", "SUPPORTED_BY", "s_b"), ("r3", "SUPPORTED_BY", "s"), ("r2", "TREATS", "s"), (None, "SUPPORTED_BY", "s"), ("x", None, "s")]
    assert got == sorted(want, key=str)


def test_forced_candidates_of_all_documents(spark, late):
    got = entry.queries()["force_candidates"](spark, late).collect()
    pairs = [(r.qid, r.chunk_id) for r in got]
    own = {r.chunk_id for r in V.chunks(spark, late).where("source = 'EN' and chunk_index = 0").collect()}
    assert len(own) == 8 and len(pairs) == len(set(pairs))
    for q in V.queries(spark, late).collect():
        assert own <= {c for qid, c in pairs if qid == q.qid}


def test_dense_topk_over_several_blocks(spark):
    from evidex.operators import retrieval as R

    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6)).round(3)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    queries = vectors.where("id % 4 = 0").withColumnRenamed("id", "qid")
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    s = np.round(unit @ unit.T, 9)
    want = {(q, i, n) for q in range(0, 90, 4) for n, i in enumerate(sorted(range(90), key=lambda i: (-s[q, i], i))[:3], 1)}
    for limit in (1, 7, 23, 100):
        got = R.dense_topk(queries, vectors, 3, limit=limit).collect()
        assert len(got) == len(want) and {(r.qid, r.vec_id, r["rank"]) for r in got} == want


def test_auc_ranks_leave_no_task_with_all_rows(spark):
    from evidex.operators import models

    rng = np.random.default_rng(3)
    rows = [(g, int(y), float(s)) for g in ("a", None) for y, s in zip(rng.integers(0, 2, 400), rng.integers(0, 60, 400) / 60)]
    out = models.auc_brier(spark.createDataFrame(rows, "g string, label int, score double").repartition(5), ["g"])
    assert "rank(score" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.g: r for r in out.collect()}
    for g in ("a", None):
        one, zero = ([s for k, y, s in rows if k == g and y == label] for label in (1, 0))
        wins = sum((a > b) + (a == b) / 2 for a in one for b in zero)
        assert got[g].auc == pytest.approx(wins / len(one) / len(zero)) and got[g].n == 400
        assert got[g].brier == pytest.approx(np.mean([(s - y) ** 2 for k, y, s in rows if k == g]))
