"""The stored index against BM25 in plain Python, with and without bounds, and what a search reads."""

import math
import random
from collections import Counter

import pytest

from evidex.operators import postings
from evidex.operators.postings import InvertedIndex

K1, B = 1.5, 0.75


def corpus(seed=5, n=300):
    rng = random.Random(seed)
    common, rare = [f"w{i}" for i in range(6)], [f"r{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(0, 30))] + [rng.choice(rare) for _ in range(rng.randint(0, 6))]
        rng.shuffle(words)
        rows.append((f"c{i:03d}", rng.choice(["EN", "DE"]), " ".join(words)))
    rows += [("d1", "EN", rows[0][2]), ("d2", "DE", rows[0][2]), ("d3", None, None), ("d4", "EN", "")]
    return rows


def bm25(rows, queries, guideline=False):
    docs = [(i, s, (t or "").split()) for i, s, t in rows]
    avgdl = sum(len(t) for *_, t in docs) / len(docs)
    df = Counter(w for *_, t in docs for w in set(t))
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    out = {}
    for qid, text, own in queries:
        scored = []
        asked = Counter((text or "").lower().split())
        sources = {s for _, s, _ in docs}
        for i, s, t in docs:
            if guideline and own in sources and s != own:
                continue
            tf = Counter(t)
            if any(w in tf for w in asked):
                scored.append((i, sum(n * idf[w] * tf[w] * (K1 + 1) / (tf[w] + K1 * (1 - B + B * len(t) / avgdl)) for w, n in asked.items() if w in tf)))
        out[qid] = sorted(scored, key=lambda x: (-round(x[1], 9), x[0]))
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = corpus()
    folder = str(tmp_path_factory.mktemp("index"))
    return rows, InvertedIndex.build(spark.createDataFrame(rows, "chunk_id string, source string, chunk_text string"), folder)


QUERIES = [(1, "w0 w1 r5 r9", "EN"), (2, "r1 r2 r3", "DE"), (3, "w0", "EN"), (4, "unknown", "EN"), (5, None, "EN"), (6, "w1 w1 w2 r7 R8", "FR"), (7, "w0 w1 w2 w3 w4 w5 r11", "DE")]


@pytest.mark.parametrize("guideline", [False, True])
@pytest.mark.parametrize("direct", [1 << 25, 0])
@pytest.mark.parametrize("worth", [0.0, 0.75])
def test_search_equals_plain_bm25(spark, made, guideline, direct, worth, monkeypatch):
    monkeypatch.setattr(postings, "WORTH", worth)
    monkeypatch.setattr(postings, "SEED_POSTINGS", 20)
    rows, index = made
    asked = spark.createDataFrame(QUERIES, "qid bigint, text string, guideline string")
    want = bm25(rows, QUERIES, guideline)
    got = {}
    for r in index.search(asked, 5, own_guideline=guideline, direct=direct).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.chunk_id, r.score, r["rank"]))
    for qid, ranked in want.items():
        best = ranked[:5]
        assert [x[0] for x in got.get(qid, [])] == [x[0] for x in best]
        assert [x[1] for x in got.get(qid, [])] == pytest.approx([x[1] for x in best])
        assert [x[2] for x in got.get(qid, [])] == list(range(1, len(best) + 1))


def test_counts_equal_plain_bm25(spark, made):
    rows, index = made
    asked = spark.createDataFrame(QUERIES, "qid bigint, text string, guideline string")
    floors = {1: 8.0, 2: 4.0, 3: 1.0}
    got = {(r.qid, r.attempt): r.n for r in index.counts(asked, floors).collect()}
    want = {(q, a): sum(s > x for _, s in ranked) for q, ranked in bm25(rows, QUERIES).items() for a, x in floors.items()}
    assert got == {key: n for key, n in want.items() if n}


def test_bounds_leave_out_blocks_and_lists(spark, made, monkeypatch):
    monkeypatch.setattr(postings, "WORTH", 0.0)
    _, index = made
    asked, folders = index._asked(spark.createDataFrame([(1, "w0 w1 w2 w3 r5 r9 r11", "EN")], "qid bigint, text string, guideline string"), False)
    floors = index._bounds(asked, folders, 1)
    assert floors.first().floor > 0
    assert index._scored(asked, folders, floors).count() < index._scored(asked, folders, floors.selectExpr("qid", "double('-inf') as floor")).count()


def test_a_search_reads_the_folders_of_its_terms_and_no_text(spark, made, monkeypatch):
    _, index = made
    read = []
    join = postings.InvertedIndex.postings
    monkeypatch.setattr(postings.InvertedIndex, "postings", lambda self: read.append(join(self)) or read[-1])
    asked, folders = index._asked(spark.createDataFrame([(1, "r5 w0", "EN")], "qid bigint, text string, guideline string"), False)
    assert len(folders) <= 2 < index.folders
    plan = index._pairs(asked.selectExpr("qid", "bucket", "term", "source", "w", "explode(blocks.level) level"), folders)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "chunk_text" not in plan


def test_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([], "chunk_id string, source string, chunk_text string")
    index = InvertedIndex.build(rows, str(tmp_path / "none"))
    asked = spark.createDataFrame(QUERIES, "qid bigint, text string, guideline string")
    assert index.search(asked, 5).count() == 0 and index.terms().count() == 0
    assert index.search(asked.limit(0), 5).count() == 0


def test_term_counts_are_counted_inside_the_row(spark):
    got = spark.sql("select split('b a b c a b', ' ') t union all select array() union all select cast(null as array<string>)").select(postings.term_counts("t").alias("c")).collect()
    assert [sorted((x.term, x.tf) for x in r.c or []) for r in got] == [[("a", 2), ("b", 3), ("c", 1)], [], []]
