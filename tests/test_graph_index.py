"""Graph candidates by postings against every pair, and typed paths against walks in plain Python."""

import random

import pytest

from evidex.operators import graph as G
from evidex.operators.graph import Step
from evidex.plans.graph_queries import BASELINE_KINDS
from tests.test_whole_results import graph_points

EDGES, NODES = "from_id string, relationship string, to_id string", "node string, kind string"


def made_up(seed=2, queries=12, recs=150):
    rng = random.Random(seed)
    words = ["gentamicin", "monitor", "critical", "illness", "possible", "gbs", "infants", "seven", "days", "trough", "levels", "treatment", "fever", "apnea", "duration", "feed"]
    kinds = [*BASELINE_KINDS, "RiskFactors", "NutritionFluid", None]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    asked = [(i, text(rng.randint(1, 12))) for i in range(queries)] + [(90, ""), (91, None), (92, "unrelated words")]
    return asked, [(f"R{i:03d}", rng.choice(kinds), text(rng.randint(0, 8))) for i in range(recs)] + [("Z", None, None)]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_best_of_each_kind_equal_those_of_all_pairs(spark, k):
    asked, recs = made_up()
    got = G.candidates(spark.createDataFrame(asked, "qid int, text string"), spark.createDataFrame(recs, "rec_id string, section_type string, text_summary string"), BASELINE_KINDS, k)
    want = set()
    for qid, text in asked:
        by = {}
        for rec, kind, s in recs:
            match, p = graph_points(text or "", kind, s or "")
            if match:
                by.setdefault(kind, []).append((-p, rec))
        want |= {(qid, rec, kind, kind in BASELINE_KINDS, float(-p)) for kind, rows in by.items() for p, rec in sorted(rows)[:k]}
    rows = [tuple(r) for r in got.select("qid", "rec_id", "section_type", "baseline", "score").collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_no_nested_loop_and_empty_sides(spark):
    asked, recs = made_up()
    q, r = spark.createDataFrame(asked, "qid int, text string"), spark.createDataFrame(recs, "rec_id string, section_type string, text_summary string")
    assert "NestedLoop" not in G.candidates(q, r, BASELINE_KINDS)._jdf.queryExecution().executedPlan().toString()
    assert G.candidates(q.limit(0), r, BASELINE_KINDS).count() == 0 and G.candidates(q, r.limit(0), BASELINE_KINDS).count() == 0


def walk(edges, kinds, start, paths):
    out = set()
    for i in start:
        for path in paths:
            at = {i}
            for s in path:
                pairs = {(b, a) if s.back else (a, b) for a, r, b in edges if s.relationship in (None, r)}
                at = {b for a, b in pairs if a in at and s.kind in (None, kinds.get(b))}
            out |= {(i, x) for x in at}
    return out


GRAPH = [
    ("rec", "PRESCRIBES", "dose1"), ("rec", "RECOMMENDS", "cond"), ("drug", "HAS_DOSE", "dose1"), ("drug", "TREATS", "meningitis"), ("drug", "HAS_DOSE", "dose2"),
    ("other", "MONITOR_WITH", "dose1"), ("other", "TREATS", "x"), ("drug", "HAS_DOSE", "dose1"), ("rec2", "RECOMMENDS", "cond"), ("late", "HAS_DOSE", "cond"), ("rec3", None, "dose2"), (None, "TREATS", "dose1"),
]
KINDS = {"dose1": "Dose", "dose2": "Dose", "drug": "Medication", "cond": "Condition"}


@pytest.mark.parametrize("hub", [1, 2, 1 << 16])
def test_recommendation_entities(spark, monkeypatch, hub):
    monkeypatch.setattr(G, "HUB_EDGES", hub)
    e, n = spark.createDataFrame(GRAPH, EDGES), spark.createDataFrame([*KINDS.items(), (None, "Dose")], NODES)
    got = [tuple(r) for r in G.recommendation_entities(e, n, spark.createDataFrame([("rec",), ("rec2",), ("rec3",), ("rec",), ("none",)], "id string")).collect()]
    want = {("rec", x) for x in ("dose1", "cond", "drug", "meningitis", "dose2")} | {("rec2", "cond")} | {("rec3", x) for x in ("dose2", "drug", "dose1", "meningitis")}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("hub", [3, 1 << 16])
def test_paths_of_random_graphs(spark, monkeypatch, hub):
    monkeypatch.setattr(G, "HUB_EDGES", hub)
    rng = random.Random(4)
    edges = [(rng.choice("abcdefgh"), rng.choice(["R", "S", "T"]), rng.choice("aabcdefghij")) for _ in range(60)]
    kinds = {x: rng.choice(["k", "l"]) for x in "abcdefghij"}
    paths = [(Step("R"),), (Step("R"), Step("S", back=True)), (Step("R"), Step("S", back=True), Step(kind="k")), (Step(back=True, kind="l"), Step("T"))]
    got = [tuple(r) for r in G.follow(spark.createDataFrame(edges, EDGES), spark.createDataFrame(list(kinds.items()), NODES), spark.createDataFrame([(x,) for x in "abcz"], "id string"), paths).collect()]
    want = walk(edges, kinds, "abcz", paths)
    assert len(got) == len(want) and set(got) == want and want
