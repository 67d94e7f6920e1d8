"""op6: every training text and every rarer training word teaches the mixers."""

import numpy as np
import pytest

from evidex.llm import coder, lm, mixer

TEXTS = [f"the cat sat on the mat {w} of the day" for w in ("alpha", "beta", "gamma")]


@pytest.fixture(scope="module")
def tree(spark):
    words = [b"the", b"cat", b"sat", b"on", b"mat", b"of", b"day", b""]
    return spark.sparkContext.broadcast(coder.tree_of(words, [9, 3, 3, 3, 3, 3, 3, 3], 3))


@pytest.mark.parametrize("text", TEXTS)
def test_any_text_teaches(spark, tree, text):
    fitted = lm.fit_running(spark.createDataFrame([(text,)] * 20, "text string"), tree, 1)
    fresh = coder.Model.of(*coder.Counts().parts())
    assert not np.allclose(fitted.weights, fresh.weights)


@pytest.mark.parametrize("word", ["alpha", "beta", "gamma"])
def test_any_word_teaches(spark, tree, word):
    fitted = lm.fit_spelling(spark.createDataFrame([(bytearray(word.encode()), 4)], "word binary, c bigint"), tree)
    fresh = mixer.Mixer.fresh(np.zeros((2, mixer.SLOTS), dtype=np.float32))
    assert not np.allclose(fitted.refine, fresh.refine)


def test_reading_teaches_and_counts_every_decision(tree):
    s = coder.stream_of([t.encode().split() for t in TEXTS], tree.value)
    one, two = coder.Counts(), coder.Counts()
    for _ in range(3):
        one.read(s, tree.value)
        two.teach(s, tree.value)
        two.count(s, tree.value)
    n = sum(len(bit) for _, bit, _ in coder.decided(s, tree.value, coder.LESSON))
    assert one.taught.sum() == 3 * n and one.slots.sum() == 3 * n * coder.HASHED
    for a, b in zip(one.parts(), two.parts()):
        assert np.allclose(a, b)
