"""The byte model's lessons: decisions laid out once give what learning bit by bit and counting after gives."""

import numpy as np
import pytest

from evidex.llm import mixer


def words(n=600):
    rng = np.random.default_rng(4)
    some = [bytes(rng.choice(np.frombuffer(b"abcde\xc3\xa9.-", dtype=np.uint8), rng.integers(1, 12))) for _ in range(n)]
    return [*some, b"", b"z" * 900], rng.integers(1, 40, n + 2).astype(np.float64)


@pytest.mark.parametrize("laid", [mixer.LAID, 300, 1])
def test_reading_equals_lessons_and_a_count(monkeypatch, laid):
    text, n = words()
    want = mixer.Mixer.fresh(np.zeros((2, mixer.SLOTS), dtype=np.float32))
    for lo in range(0, len(text), 200):
        want.learn(text[lo : lo + 200], n[lo : lo + 200])
    plain = np.zeros((2, mixer.SLOTS))
    flat, context, _, owner = mixer.decisions(text)
    node = np.ones(len(flat), dtype=np.int64)
    for k in range(8):
        bit = (flat >> (7 - k)) & 1
        for at in mixer.slots(context, node):
            np.add.at(plain, (bit, at), n[owner])
        node = node * 2 + bit
    monkeypatch.setattr(mixer, "LAID", laid)
    got = mixer.Mixer.fresh(np.zeros((2, mixer.SLOTS), dtype=np.float32))
    got.read(text, n, 200)
    assert np.array_equal(got.table, plain.astype(np.float32))
    for part in ("weights", "refine", "steepness"):
        assert np.allclose(getattr(got, part), getattr(want, part), rtol=0, atol=1e-12)
