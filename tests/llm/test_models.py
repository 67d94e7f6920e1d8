"""Trained operators: held-out accuracy, and the numbers that their methods rest on."""

import zlib

import numpy as np
import pytest

from evidex.llm import coder, langid, lm, mixer, quality, toxicity
from evidex.llm import queries as q

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").toPandas()


def auc(score, label):
    rank = score.rank()
    p = (label == 1).sum()
    return (rank[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1_held_out(spark, labels):
    got = q.op1_toxicity(spark, SF).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) for r in got.itertuples())
    assert (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert auc(held.score, held.toxic) > 0.95
    assert held.predicted[held.toxic == 1].mean() > 0.8
    assert held.predicted[held.toxic == 0].mean() < 0.02


def test_op2_held_out(spark, labels):
    got = q.op2_quality(spark, SF).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert auc(held.score, held.quality) > 0.98
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.97


def test_op3_held_out(spark):
    got = q.op3_language(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    held = got[got.held_out].merge(docs, on="doc_id")
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in got.itertuples())
    assert (held.lang_pred == held.lang).mean() > 0.98


@pytest.mark.parametrize("sign", [1, -1])
def test_pu_gradient_equals_finite_differences(sign):
    rng = np.random.default_rng(3)
    is_pos, prior = np.arange(30) < 10, 0.4
    z = rng.normal(size=30) + np.where(is_pos, 3.0, -3.0 if sign < 0 else 1.0)
    kept, rest, grad = toxicity.pu_risk(z, is_pos, prior)
    assert (rest > 0) == (sign > 0)

    def value(z):  # what is followed: the whole risk, or less of the rest where that is below zero
        a = prior * np.logaddexp(0, -z[is_pos]).mean()
        b = np.logaddexp(0, z[~is_pos]).mean() - prior * np.logaddexp(0, z[is_pos]).mean()
        return a + b if sign > 0 else -b

    assert kept == pytest.approx(prior * np.logaddexp(0, -z[is_pos]).mean())
    for i in range(30):
        h = np.zeros(30)
        h[i] = 1e-5
        assert grad[i] == pytest.approx((value(z + h) - value(z - h)) / 2e-5, abs=1e-6)


@pytest.mark.parametrize("prior", [0.1, 0.2, 0.3, 0.4, 0.5])
def test_marker_is_learnt_at_any_prior(prior):
    rng = np.random.default_rng(0)
    word = lambda: np.unique(rng.integers(100, 3000, 30).astype(np.uint32))
    pos = [np.append(word(), 7).astype(np.uint32) for _ in range(120)]
    unl = [np.append(word(), 7).astype(np.uint32) if i < 600 * prior else word() for i in range(600)]
    model = toxicity.train_nnpu(pos, unl, prior)
    assert max(model.weights, key=model.weights.get) == 7 and model.weights[7] > 1
    assert toxicity.train_nnpu([], unl, prior).weights == {}


def test_repeated_rows_do_not_fill_the_sample(spark):
    from evidex.llm._shared import row_sample

    rows = spark.createDataFrame([(1, "same")] * 500 + [(i, f"t{i}") for i in range(2, 40)] + [(None, "x"), (1, "other")], "doc_id bigint, _text string")
    got = row_sample(rows, 30, "s", "doc_id", "_text").collect()
    assert len(got) == 30 == len(set(got))
    assert len(row_sample(rows, 1000, "s", "doc_id", "_text").collect()) == 41


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    fm = quality.Machine(0.3, rng.normal(size=quality.WIDTH), rng.normal(size=(quality.WIDTH, 3)))
    col, val = np.array([3, 50, 700, 4000]), np.array([0.5, 1.0, -0.2, 2.0])
    z, _ = fm.raw_scores(np.zeros(4, int), col, val, 1)
    pairs = sum(fm.factors[col[i]] @ fm.factors[col[j]] * val[i] * val[j] for i in range(4) for j in range(i + 1, 4))
    assert z[0] == pytest.approx(0.3 + fm.linear[col] @ val + pairs)


def test_windows_cover_whole_texts():
    win, owner, weight = langid.windows_of(["a" * 300, None, "", "é" * 100])
    assert weight.sum() == 300 + 200
    assert [int((owner == i).sum()) for i in range(4)] == [3, 0, 0, 2]
    assert bytes(win[owner == 0].tobytes()).rstrip(b"\0") == b"a" * 300


def base_scores(docs):
    counts, vocab_n = {}, 0
    for i, t in docs:
        if fold(i, 7) != 2:
            for w in [*lm.words_of(t), b""]:
                counts[w] = counts.get(w, 0) + 1
    total, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in docs:
        words = [*lm.words_of(t), b""]
        out[i] = (len(words), sum(counts.get(w, 0) > 0 for w in words), sum(np.log10((counts.get(w, 0) + 1) / (total + v + 1)) for w in words), total)
    return out


def test_op6_base_is_exact_and_model_learns(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = base_scores(docs)
    got = q.op6_context_mixing(spark, sf).toPandas()
    assert len(got) == len(docs)
    for r in got.itertuples():
        n, known, base, total = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base)
        assert r.held_out == (fold(r.doc_id, 7) == 2)
    assert (got.score < 0).all()


def test_op6_beats_the_base_on_held_out_text(spark):
    got = q.op6_context_mixing(spark, SF).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (held.bits_per_byte > 0).all()


def test_byte_probabilities_sum_below_one():
    words = [b"the", b"then", b"cat", b""]
    model = mixer.Mixer.fresh(np.zeros((2, mixer.SLOTS), dtype=np.float32))
    for _ in range(200):
        model.learn(words, np.array([9.0, 5.0, 4.0, 6.0]))
        mixer.count_into(model.table, words, np.array([9.0, 5.0, 4.0, 6.0]))
    p = 10 ** model.settled().log10(words)
    assert 0.9 < p.sum() < 1 and p[0] > p[2] > 10 ** model.settled().log10([b"zebra"])[0]


def test_parts_of_tasks_add_up():
    rng = np.random.default_rng(2)
    a, b = (np.where(rng.random(100_000) < 0.9, 0, rng.integers(0, 50, 100_000)).astype(np.float32) for _ in range(2))
    a[: mixer.CHUNK] = b[: mixer.CHUNK] = 0
    x, y = dict(mixer.chunks(a)), dict(mixer.chunks(b))
    both = [(i, mixer.added([z[i] for z in (x, y) if i in z])) for i in x.keys() | y.keys()]
    assert 0 not in x and np.array_equal(mixer.from_chunks(both, len(a)), a + b)


@pytest.fixture(scope="module")
def running():
    rng = np.random.default_rng(4)
    vocab = [b"the", b"of", "\u00e9t\u00e9".encode(), b"cat", b"sat", b""]
    texts = [[vocab[j] for j in rng.choice(5, size=rng.integers(0, 40), p=[0.4, 0.2, 0.2, 0.1, 0.1])] for _ in range(60)]
    texts += [[b"odd", b"cat", b"odd", b"cat", b"odd", b"cat", b"odd"], [], [b"once"]]
    tree = coder.tree_of(vocab, [9, 5, 5, 3, 3, 8], 4)
    learnt = coder.Counts()
    for lo in range(0, len(texts), 10):
        s = coder.stream_of(texts[lo : lo + 10], tree)
        learnt.teach(s, tree)
        learnt.count(s, tree)
    sums, means = learnt.parts()
    return texts, tree, coder.Model.of(sums, means)


def told_one_by_one(text, tree, model, spelt):
    """The score of a text decision by decision, in plain Python."""
    words, total, run, mark, low = [*text, b""], 0.0, 0, 0, 0xFFFFFFFF
    mix = lambda x: ((lambda y: (y ^ y >> 15) * 0x85EBCA77 & low)(x * 0x9E3779B1 & low))
    for i, w in enumerate(words):
        back = [j for j in range(1, i) if i and words[j - 1] == words[i - 1]]
        if back:
            j = back[-1]
            deep = j > 1 and i > 1 and words[j - 2] == words[i - 2]
            p = model.repeat[min(run, 3) * 2 + deep]
            total += np.log10(p if words[j] == w else 1 - p)
        hit = bool(back) and words[back[-1]] == w
        if not hit:
            end = 1 if i == 0 else int.from_bytes((b"\0\0" + words[i - 1])[-2:], "big")
            leaf = tree.places.get(words[i - 1], len(tree.places)) if i else None
            before = low if i == 0 else (end + (1 << 24) if leaf == len(tree.places) else leaf)
            contexts = mix(end ^ (mark << 16) ^ 0x5BD1E995), mix(before)
            at = tree.places.get(w, len(tree.places))
            for k in range(tree.start[at], tree.start[at] + tree.length[at]):
                slot = [mix((c + int(tree.hashes[k])) & low) >> (32 - coder.SLOT_BITS) for c in contexts]
                gate = int(model.sure[0][slot[0]]) * coder.LEVELS_SURE + int(model.sure[1][slot[1]])
                x = [tree.base[k], model.logits[0][slot[0]], model.logits[1][slot[1]], 0.3]
                z = float(sum(a * b for a, b in zip(x, model.weights[:, gate])))
                spot = min(max(z, -8), 7.9995) * 2 + 16
                cell, part = int(spot), spot - int(spot)
                row = model.refine[tree.cells[k] // coder.CELLS]
                p = (1 / (1 + np.exp(-z)) + row[cell] * (1 - part) + row[cell + 1] * part) / 2
                total += np.log10(p if tree.bits[k] else 1 - p)
            total += spelt[w] if at == len(tree.places) else 0.0
        run = run + 1 if hit else 0
        high = [k for k, x in enumerate(w) if x >= 128]
        if high:
            mark = int.from_bytes((b"\0" + w)[high[-1] : high[-1] + 2], "big")
    return total


def test_running_score_equals_decisions_one_by_one(running):
    texts, tree, model = running
    s = coder.stream_of(texts, tree)
    spelt = {w: -1.5 - i / 7 for i, w in enumerate(sorted(s.distinct))}
    got = model.log10(s, tree, np.array([spelt[w] for w in s.distinct]), len(texts))
    for text, score in zip(texts, got):
        assert score == pytest.approx(told_one_by_one(text, tree, model, spelt), rel=1e-4)
