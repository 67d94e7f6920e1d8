"""Vector lists at rest against exact search, what a search reads, and batches filed later."""

import numpy as np
import pandas as pd
import pytest

from evidex.operators import lists as L
from evidex.operators.lists import VectorLists
from evidex.operators.retrieval import dense_topk
from evidex.plans.retrieval_queries import vector_tables

ROW, ASK = "id bigint, vec array<double>", "qid bigint, vec array<double>"


def clustered(n=3_000, groups=40, width=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width)) * 3
    return [(i, [float(v) for v in centres[i % groups] + rng.normal(size=width)]) for i in range(n)]


def cosines(rows, asked):
    x, q = np.array([v for _, v in rows]), np.array([v for _, v in asked])
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-10)
    return np.round(unit(q) @ unit(x).T, 9)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = clustered()
    return rows, VectorLists.build(spark.createDataFrame(rows, ROW), str(tmp_path_factory.mktemp("lists")))


def test_result_is_exact_within_the_probed_lists(spark, made):
    rows, lists = made
    asked = rows[::100]
    at = lists.index.distances(np.array([v for _, v in rows])).argmin(axis=1)
    probed = lists.index.probed(np.array([v for _, v in asked]))
    s = cosines(rows, asked)
    got = {}
    for r in lists.search(spark.createDataFrame(asked, ASK), 10, limit=7).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.vec_id, round(r.score, 6)))
    for j, (q, _) in enumerate(asked):
        seen = [(i, s[j, i]) for i in range(len(rows)) if probed[j, at[i]]]
        want = sorted(seen, key=lambda x: (-x[1], x[0]))[:10]
        assert got[q] == [(i, round(float(x), 6)) for i, x in want]


def test_clustered_vectors_are_found_in_few_lists(spark, made):
    rows, lists = made
    asked = rows[::50]
    s = cosines(rows, asked)
    exact = {(q, int(i)) for j, (q, _) in enumerate(asked) for i in np.lexsort((np.arange(len(rows)), -s[j]))[:10]}
    got = {(r.qid, r.vec_id) for r in lists.search(spark.createDataFrame(asked, ASK), 10).collect()}
    assert len(got & exact) / len(exact) >= 0.95
    sizes = np.bincount(lists.index.distances(np.array([v for _, v in rows])).argmin(axis=1), minlength=len(lists.index.centres))
    read = lists.index.probed(np.array([v for _, v in asked])) @ sizes
    assert read.mean() < 0.2 * len(rows)


def test_candidates_read_folders_of_probed_lists_and_codes_alone(spark, made):
    rows, lists = made
    plan = lists.probed_rows(lists.index.probed(np.array([rows[0][1]]))).select("id", "code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and "vec" not in plan
    found, _ = lists.candidates([0], np.array([rows[0][1]]), 10)
    assert 10 <= found.count() < 100  # vectors read in full


def test_given_vectors_reach_the_recall(spark):
    queries, vectors = vector_tables(spark, "/root/testdata/sf0.01")
    lists = L.opened(spark, spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), lambda: vectors)
    exact = {(r.qid, r.vec_id) for r in dense_topk(queries, vectors).collect()}
    got = {(r.qid, r.vec_id) for r in lists.search(queries).collect()}
    assert len(got & exact) / len(exact) >= 0.95


def test_batches_are_filed_without_repeats_and_seen_after_opening(spark, tmp_path):
    rows = clustered(600)
    first = VectorLists.build(spark.createDataFrame(rows[:400], ROW), str(tmp_path / "a"))
    second = first.add(spark.createDataFrame(rows[300:] + rows[590:], ROW))
    assert (first.n, second.n, second.fitted) == (400, 600, 400) and second.add(spark.createDataFrame(rows, ROW)).n == 600
    assert first.rows().count() == 400  # earlier readers keep what they had
    again = VectorLists.open(spark, str(tmp_path / "a"))
    asked = spark.createDataFrame(rows[550:], ASK)
    both = [sorted(map(tuple, x.search(asked, 3).collect())) for x in (second, again)]
    assert both[0] == both[1] and {(r[0], r[0]) for r in both[0]} <= {(r[0], r[1]) for r in both[0]}
    # files that no manifest names are not seen
    first.rows().write.parquet(str(tmp_path / "a" / "data" / "stray"))
    assert VectorLists.open(spark, str(tmp_path / "a")).n == 600
    fresh = second.rebuilt(str(tmp_path / "b"))
    assert fresh.fitted == 600 and fresh.rows().count() == 600 and len(fresh.parts) == 1


def test_worn_lists(spark, made):
    _, lists = made
    assert not lists.worn()
    lists = VectorLists(spark, lists.folder, lists.index, lists.parts, 10, 41)
    assert lists.worn()


def test_copies_zero_vectors_nulls_and_empty_tables(spark, tmp_path):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(5_000)] + [(6_000, [0.0, 0.0, 0.0]), (6_001, [3.0, 2.0, 1.0])]
    lists = VectorLists.build(spark.createDataFrame(rows + [(7_000, None), (None, [1.0, 1.0, 1.0])], ROW), str(tmp_path / "c"))
    assert lists.n == 5_002
    asked = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0]), (3, None)], ASK)
    got = [tuple(r) for r in lists.search(asked, 4).orderBy("qid", "rank").collect()]
    assert [(r[0], r[1]) for r in got if r[0] == 1] == [(1, 0), (1, 1), (1, 2), (1, 3)]
    probed = lists.probed_rows(lists.index.probed(np.zeros((1, 3)))).count()
    assert len([r for r in got if r[0] == 2]) == min(4, probed) and not [r for r in got if r[0] == 3]
    found, _ = lists.candidates([1], np.array([[1.0, 2.0, 3.0]]), 4)
    assert found.count() <= 4 * 8  # copies do not all leave their task
    none = VectorLists.build(spark.createDataFrame([], ROW), str(tmp_path / "d"))
    assert none.search(asked, 4).count() == 0 and none.add(spark.createDataFrame(rows[4_990:], ROW)).n == 12


def test_codes_bound_the_error():
    x = np.random.default_rng(1).normal(size=(200, 32))
    x[0] = 0
    code, step, slack = L.encode(x)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
    q = unit[1:50]
    assert (np.abs(unit @ q.T - (code * step[:, None]) @ q.T) <= slack[:, None] + 1e-12).all()


@pytest.mark.parametrize("pairs", [L.PAIRS, 2_000])
def test_few_pairs_are_laid_out_at_a_time(monkeypatch, pairs):
    """Before, the first rows that a task read were laid out with every query, copies too."""
    rng, k = np.random.default_rng(5), 5
    x = np.concatenate((rng.normal(size=(3_000, 8)), np.tile(rng.normal(size=(1, 8)), (3_000, 1))))
    asked = x[:200] / np.linalg.norm(x[:200], axis=1)[:, None]
    code, scale, slack = L.encode(x)
    rows = pd.DataFrame({"list": 0, "id": np.arange(len(x)), "code": [c.tobytes() for c in code], "scale": scale, "slack": slack, "digest": [v.tobytes().hex() for v in x]})
    sizes, real = [], L.prune
    monkeypatch.setattr(L, "PAIRS", pairs)
    monkeypatch.setattr(L, "prune", lambda found, k: sizes.append(len(found)) or real(found, k))
    found = pd.concat(L.near(iter([rows]), list(range(200)), asked, np.ones((200, 1), dtype=bool), k))
    assert max(sizes) < 30_000  # of 1,200,000 pairs
    cos = np.round(asked @ (x / np.linalg.norm(x, axis=1)[:, None]).T, 9)
    for q, mine in found.groupby("qid"):
        best = np.lexsort((np.arange(len(x)), -cos[q]))[:k]
        assert set(best) <= set(mine["id"])
    assert found["qid"].nunique() == 200
