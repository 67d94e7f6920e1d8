"""The retrieval stack and its hooks against plain Python on a small corpus."""

import hashlib
import math
import random
from dataclasses import replace

import numpy as np
import pytest

from evidex.operators import hooks
from evidex.operators import stack as S
from evidex.operators.fusion import pool_size
from evidex.operators.postings import InvertedIndex
from tests.test_index import bm25

KINDS = ["recommendation", "table", "background", "remarks"]
SECTION = {"recommendation": 0.15, "table": 0.05, "background": -0.05, "remarks": -0.02}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"term{i}" for i in range(40)]
    rows = [(f"c{i:02d}", rng.choice(["EN", "EN", "DE"]), 100 + i, "", "", KINDS[i % 4], i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 25)))) for i in range(60)]
    queries = [(i, " ".join(rng.choice(words) for _ in range(5)), g) for i, g in enumerate(["EN", "EN", "DE", "FR"])]
    return rows, [*queries, (9, "nothing known here", "EN")]


@pytest.fixture(scope="module")
def made(spark, corpus, tmp_path_factory):
    rows, queries = corpus
    schema = "chunk_id string, source string, page bigint, subsection string, recommendation_id string, chunk_type string, chunk_index bigint, chunk_text string"
    index = InvertedIndex.build(spark.createDataFrame(rows, schema), str(tmp_path_factory.mktemp("stack")))
    return S.Stack(index), spark.createDataFrame(queries, "qid bigint, text string, guideline string")


def vector(text):
    out = np.zeros(64)
    for w in text.split():
        d = hashlib.md5(w.encode()).hexdigest()
        out[int(d[:4], 16) % 64] += 1 if int(d[4], 16) % 2 == 0 else -1
    return out


def dense(rows, queries, masked):
    out = {}
    for qid, text, own in queries:
        q, scored = vector(text), []
        for r in rows:
            if masked and own in {x[1] for x in rows} and r[1] != own:
                continue
            v = vector(r[7])
            n = np.linalg.norm(q) * np.linalg.norm(v)
            scored.append((r[0], float(q @ v / (n or 1e-10))))
        out[qid] = sorted(scored, key=lambda x: (-round(x[1], 9), x[0]))
    return out


def fused(lists, k=60):
    total = {}
    for ids in lists:
        for n, i in enumerate(ids, 1):
            total[i] = total.get(i, 0) + 1 / (k + n)
    return sorted(total, key=lambda i: (-round(total[i], 9), i))


def relevance(rows, text):
    docs = {r[0]: set(r[7].split()) for r in rows}
    df = {w: sum(w in d for d in docs.values()) for d in docs.values() for w in d}
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    asked = {w for w in text.split() if w in idf}
    return {i: sum(idf[w] for w in asked if w in d) / sum(idf[w] for w in asked) if asked else 0.0 for i, d in docs.items()}


def legs(rows, queries, s):
    sparse = bm25([(r[0], r[1], r[7]) for r in rows], queries, s.mask)
    near = dense(rows, queries, s.mask)
    return {q: [[i for i, _ in found[q][: s.pool]] for on, found in ((s.dense, near), (s.sparse, sparse)) if on] for q, *_ in queries}


def ranked(df):
    out = {}
    for r in df.where("rank is not null").orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.chunk_id)
    return out


def plain(rows, queries, s):
    by_id, out = {r[0]: r for r in rows}, {}
    for q, text, own in queries:
        rel = relevance(rows, text)
        score = lambda i: round(0.65 * rel[i] + 0.10 * SECTION[by_id[i][5]] + 0.05 * (0.15 if by_id[i][1] == own else 0), 9)  # noqa: B023, E731
        pool = sorted(fused(legs(rows, queries, s)[q]), key=lambda i: (-score(i), i))
        mine = [i for i in pool if by_id[i][1] == own]
        others = [i for i in pool if by_id[i][1] != own][: max(0, s.k - len(mine))]
        pool = sorted(mine + others, key=lambda i: (-score(i), i))[: pool_size(s.k)]
        picked = pool[: s.k]
        if s.diverse and len(pool) > s.k:
            words = {i: {w for w in by_id[i][7].split() if len(w) >= 4} for i in pool}
            lo, hi = min(map(score, pool)), max(map(score, pool))
            picked, left = [pool[0]], pool[1:]
            while len(picked) < s.k and left:
                gain = lambda i: 0.7 * (score(i) - lo) / ((hi - lo) or 1) - 0.3 * max(len(words[i] & words[j]) / len(words[i] | words[j]) for j in picked)  # noqa: B023, E731
                best = max(left, key=lambda i: (gain(i), -left.index(i)))  # noqa: B023
                picked.append(best)
                left.remove(best)
        if picked:
            out[q] = picked
    return out


@pytest.mark.parametrize("arm", [S.SPARSE_ONLY, S.DENSE_ONLY, S.VECTOR], ids=["sparse", "dense", "vector"])
@pytest.mark.parametrize("mask", [True, False])
def test_arms_equal_plain_python(made, corpus, arm, mask):
    st, queries = made
    s = replace(arm, adaptive=False, expanded=False, mask=mask, k=4)
    assert ranked(st.retrieve(queries, s)) == plain(*corpus, s)


def test_basic_equals_plain_python(made, corpus):
    st, queries = made
    rows, asked = corpus
    s = replace(S.Switches(), adaptive=False, expanded=False, mask=False)
    want = {}
    for q, text, _ in asked:
        rel = relevance(rows, text)
        want[q] = sorted(fused(legs(rows, asked, s)[q])[:10], key=lambda i: (-round(rel[i], 9), i))[:5]
    got = ranked(st.basic(queries))
    assert got == want and all(1 <= len(x) <= 5 for x in got.values())


def test_hybrid_fuses_the_vector_and_graph_pools(spark, made, corpus):
    st, queries = made
    graph = {0: ["c05", "c07", "c01"], 2: ["c11"]}
    rows = [(q, i, n) for q, ids in graph.items() for n, i in enumerate(ids, 1)]
    deep = ranked(st.retrieve(queries, replace(S.VECTOR, k=pool_size(3))))
    got = ranked(st.hybrid(queries, spark.createDataFrame(rows, "qid bigint, chunk_id string, rank int"), k=3))
    assert got == {q: fused([deep.get(q, []), graph.get(q, [])])[:3] for q in deep}


def test_forced_baseline_chunks_are_bounded_and_of_the_guideline(made, corpus):
    st, queries = made
    rows, asked = corpus
    forced = S.Stack(st.index, ("term7 ", "term8 ")).forced(queries, 3).collect()
    sources = {r[0]: r[1] for r in rows}
    own = {q: g for q, _, g in asked}
    assert forced and all(sources[r.chunk_id] == own[r.qid] for r in forced)
    assert max(sum(r.qid == q for r in forced) for q in own) <= 3


def test_reranker_hook_sets_the_order(made):
    class Longest:
        name = "longest"

        def __call__(self, pairs):
            return [len(t) for _, t in pairs]

    st, queries = made
    got = S.Stack(st.index, reranker=Longest()).basic(queries).orderBy("qid", "rank").collect()
    texts = {r.chunk_id: r.chunk_text for r in st.chunks().collect()}
    assert got and all(r.score == len(texts[r.chunk_id]) for r in got)
    shared = hooks.SharedWords()([("a b", "b c"), ("", "x")])
    assert shared.tolist() == [0.5, 0.0]


def test_vectors_are_stored_once_for_a_model(made):
    st, queries = made
    first = hooks.vectors(st.index, hooks.HashedWords(8))
    assert first.count() == 60 and f"{st.index.folder}/vectors-hashed-words-8" in st.index.beside
    assert hooks.vectors(st.index, hooks.HashedWords(8)).inputFiles() == first.inputFiles()


def test_full_plan_grows_groups_and_siblings(made):
    st, queries = made
    rows = st.retrieve(queries).collect()
    picked = {(r.qid, r.chunk_id) for r in rows if r["rank"] is not None}
    assert {r.qid for r in rows} == {0, 1, 2, 3, 9} and len(rows) == len({(r.qid, r.chunk_id) for r in rows})
    assert max(sum(q == x for x, _ in picked) for q, _ in picked) <= 5
