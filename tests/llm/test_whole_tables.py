"""Queries on whole tables against brute force in plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from evidex.llm import queries as q
from evidex.llm import rules

SYMBOLS = set("#*$%&|<>")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


def test_op4_base_counts(spark, sf, docs):
    got = q.op4_quality_rules(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, text in zip(docs["doc_id"], docs["text"]):
        words = text.encode().split()
        windows = Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
        marked = {j + k for j in range(len(words) - 4) if windows[tuple(words[j : j + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        row = got.loc[i]
        assert row.n_words == len(words)
        assert row.word_chars == sum(len(w.decode()) for w in words)
        assert row.n_symbols == sum(c in SYMBOLS for c in text)
        assert row.n_dup_lines == len(lines) - len(set(lines))
        assert row.n_repeat_words == len(marked)
        assert row.base_failed == (len(words) < 10 or 100 * len(marked) > 20 * len(words))
        assert not (row.base_failed and row.kept)


def test_op4_risk_is_limited_on_labels_that_certified_nothing(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = rules.quality_rules(docs, labels.where("crc32(cast(doc_id as string)) % 2 = 0")).toPandas()
    both = got.merge(labels.where("crc32(cast(doc_id as string)) % 2 = 1").toPandas(), on="doc_id")
    both = both[~both.base_failed]
    for _, band in both[both.quality == 1].groupby("band"):
        assert (~band.kept).mean() <= 0.02
    assert both.kept[both.quality == 0].mean() < 0.3


def test_op4_method_decides_at_small_scale(spark):
    got = q.op4_quality_rules(spark, "/root/testdata/sf0.01").toPandas()
    assert ((~got.kept) & ~got.base_failed).sum() > 10


def test_fixed_sequence_holds_a_stratum_s_rate():
    rng = np.random.default_rng(11)
    alpha, delta, true = 0.05, 0.1, np.array([0.001, 0.01, 0.03, 0.06, 0.1, 0.2])
    missed = 0
    for _ in range(2000):
        u = rng.random(400)
        level = rules.level_of(np.array([(u < p).sum() for p in true]), 400, alpha, delta)
        missed += level >= 0 and true[level] > alpha
    assert missed <= 2000 * delta
    assert rules.level_of(np.zeros(6, int), 40, alpha, delta) == -1 and rules.level_of(np.zeros(6, int), 400, alpha, delta) == 5


def test_binomial_tail_is_exact():
    assert rules.binomial_tail(0, 10, 0.1) == pytest.approx(0.9**10)
    assert rules.binomial_tail(2, 5, 0.5) == pytest.approx(0.5)
    assert rules.binomial_tail(5, 5, 0.3) == 1.0


def test_op5_shards(spark, sf, docs):
    got = q.op5_sharding(spark, sf).toPandas().sort_values(["text_crc32", "size", "doc_id"]).reset_index(drop=True)
    text = docs.set_index("doc_id")["text"]
    assert list(got["size"]) == [len(text[i].encode()) + 16 for i in got.doc_id]
    assert list(got.text_crc32) == [zlib.crc32(text[i].encode()) for i in got.doc_id]
    assert got.shard.is_monotonic_increasing and got.grown_shard.isna().all()
    target = got["size"].sum() / 40
    for _, part in got.groupby("shard"):
        assert list(part.slot) == list(range(len(part)))
        assert abs(part["size"].sum() - target) <= 2 * got["size"].max()
    start, total = (got["size"].cumsum() - got["size"]).tolist(), int(got["size"].sum())
    want = []
    for _, group in got.groupby(["text_crc32", "size"], sort=True):
        first, size = start[group.index[0]], int(group["size"].sum())
        if size * 40 * 10 <= total:
            want += [min(39, (2 * first + size) * 40 // (2 * total))] * len(group)
        else:
            want += [min(39, (2 * start[i] + z) * 40 // (2 * total)) for i, z in zip(group.index, group["size"])]
    assert list(got.shard) == want


def test_op5_parts_no_group_but_a_large_one(spark):
    from evidex.llm import sharding

    rows = [(i, f"text {i // 7} " * 20) for i in range(3000)] + [(5000 + i, "large " * 100) for i in range(900)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id bigint, text string"), 9).toPandas()
    parted = [len(g) for _, g in got.groupby(["text_crc32", "size"]) if g.shard.nunique() > 1]
    assert parted == [900]
    assert got.groupby("shard")["size"].sum().max() < 1.1 * got["size"].sum() / 9


def test_op5_many_equal_rows_spread_over_tasks(spark):
    from evidex.llm import sharding

    docs = spark.createDataFrame([(None, None)] * 4000 + [(1, "a")], "doc_id bigint, text string")
    got = sharding.shard_by_bytes(docs, 8).toPandas()
    assert len(got) == 4001 and got.groupby("shard")["size"].sum().max() <= 16 * 4001 / 8 + 32
    assert all(sorted(p.slot) == list(range(len(p))) for _, p in got.groupby("shard"))


def print_of(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps):
    """Component labels by comparing all pairs."""
    values = sorted(set(fps))
    array, parent = np.array(values, dtype=np.uint64), {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for v in values:
        for w in array[np.bitwise_count(array ^ np.uint64(v)) <= 3]:
            parent[find(int(w))] = find(v)
    return {v: find(v) for v in values}


def test_op9_against_all_pairs(spark, docs):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    fps = {i: print_of(t) for i, t in zip(docs.doc_id, docs.text)}
    root = roots(fps.values())
    least = defaultdict(lambda: 10**9)
    for i, v in fps.items():
        least[root[v]] = min(least[root[v]], i)
    got = q.op9_simhash(spark, sf).toPandas()
    assert {r.doc_id: r.fingerprint for r in got.itertuples()} == {i: f"{v:016x}" for i, v in fps.items()}
    assert {r.doc_id: r.component_id for r in got.itertuples()} == {i: least[root[v]] for i, v in fps.items()}


def test_op10_targets_and_reruns(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = q.op10_mixing(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    again = q.op10_mixing(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(again)
    frame = got.merge(docs[["doc_id", "source"]], on="doc_id")
    size = frame.groupby("source")["size"].sum()
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(size.index))}
    want = {s: 0.0 for s in size.index}
    left, open_ = float(size.sum()), set(size.index)
    while open_ and left > 1e-6:  # reshare until none is above
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if want[s] + unit * weight[s] > 3 * size[s]}
        for s in open_:
            want[s] += unit * weight[s]
        left = sum(want[s] - 3 * size[s] for s in full)
        for s in full:
            want[s] = 3.0 * size[s]
        open_ -= full
    for s, part in frame.groupby("source"):
        assert part.target.iloc[0] == pytest.approx(want[s])
        assert abs(part.taken.sum() - want[s]) <= part["size"].max()
        assert (part.taken <= 3 * part["size"]).all()
        ok = part["size"] > 0
        assert (part.taken[ok] % part["size"][ok] == 0).all()


def test_op10_draw_follows_a_portable_hash():
    key = hashlib.md5(b"mix:7").hexdigest()[:11]
    assert 0 < (int(key, 16) + 0.5) / 2**44 < 1
