"""Phrase hits by one pass over the texts, and metric queries that do no step twice."""

import random

import pytest

from evidex.operators import metrics, retrieval
from evidex.plans import metric_queries
from evidex.sources import views


@pytest.mark.parametrize("limit", [50_000, 7])
def test_phrase_hits_are_plain_containment(spark, limit):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("a b ab ba c".split()) for _ in range(n))
    chunks = [(f"c{i}", rng.choice(["EN", "FR", None]), text(40)) for i in range(60)] + [("none", "EN", None), ("empty", "EN", "")]
    phrases = [(q, n, text(4)) for q in range(6) for n in range(4)] + [(0, 9, "a b ab c"), (1, 9, "a b ab c")]
    found = metrics.phrase_hits(spark.createDataFrame(chunks, "chunk_id string, source string, chunk_text string"), spark.createDataFrame(phrases, "qid bigint, nth bigint, phrase string"), limit)
    got = sorted((r.qid, r.nth, r.chunk_id, r.source or "") for r in found.collect())
    assert got == sorted((q, n, c, s or "") for q, n, p in phrases for c, s, t in chunks if t is not None and p in t)


def test_no_phrases_have_no_hits(spark):
    chunks = spark.createDataFrame([("c", "EN", "a b c d")], "chunk_id string, source string, chunk_text string")
    assert metrics.phrase_hits(chunks, spark.createDataFrame([], "qid bigint, nth bigint, phrase string")).collect() == []


@pytest.mark.parametrize("query", ["slots", "mrr_anchor", "prf_anchor"])
def test_slots_of_one_arm_search_no_other(spark, sf, monkeypatch, query):
    def fail(*args, **kwargs):
        raise AssertionError("searched by keywords")

    monkeypatch.setattr(retrieval, "keyword_search", fail)
    assert getattr(metric_queries, query)(spark, sf).count() > 0


@pytest.mark.parametrize("query", ["gold_audit", "prf_anchor"])
def test_phrases_are_looked_up_once(spark, sf, monkeypatch, query):
    calls, real = [], metrics.phrase_hits
    monkeypatch.setattr(metrics, "phrase_hits", lambda *args: calls.append(1) or real(*args))
    assert getattr(metric_queries, query)(spark, sf).count() == views.queries(spark, sf).count()
    assert len(calls) == 1
