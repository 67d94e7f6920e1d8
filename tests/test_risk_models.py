"""Selection, members, vote and champion on small made-up tables."""

import numpy as np
import pytest

from evidex.operators import metrics, models


@pytest.fixture(scope="module")
def rows(spark):
    """240 rows whose label follows `signal`; two features are noise, one row has no label and one no feature."""
    rng = np.random.default_rng(11)
    signal, a, b = rng.normal(size=(3, 240))
    label = (signal + rng.normal(0, 0.3, 240) > 0).astype(int)
    data = [(i, int(y), float(s), float(x), float(z)) for i, (y, s, x, z) in enumerate(zip(label, signal, a, b))]
    data[5] = (5, None, *data[5][2:])
    data[6] = (6, data[6][1], None, *data[6][3:])
    return spark.createDataFrame(data, "doc_id bigint, label int, signal double, noise_a double, noise_b double")


FEATURES = ["noise_a", "signal", "noise_b"]


def test_selections_keep_the_signal(rows):
    whole = rows.dropna()
    lasso, boruta = models.lasso_select(whole, FEATURES), models.boruta_select(whole, FEATURES)
    assert max(lasso, key=lambda f: abs(lasso[f])) == "signal" and abs(lasso["signal"]) > 5 * max(abs(lasso["noise_a"]), abs(lasso["noise_b"]))
    assert boruta["signal"] == 3


def test_chosen_are_of_the_domain_and_of_a_selection():
    got = models.compare_selections(["a", "b", "c", "d", "e"], ["a", "b", "c"], {"a": 0.3, "b": 0.0, "c": 1e-9, "d": -2.0}, {"a": 0, "b": 2, "c": 1, "d": 3})
    assert got == [("a", True, True, False, True), ("b", True, False, True, True), ("c", True, False, False, False), ("d", False, True, True, False), ("e", False, False, False, False)]


def test_members_score_held_out_rows_and_the_vote_is_their_mean(rows):
    whole = rows.dropna()
    scored = models.member_scores(rows, FEATURES, 2)
    got = scored.collect()
    held = {(r.split, r.id) for r in models.strat_splits(whole, "doc_id", "label", 2).where("not is_train").collect()}
    assert len(got) == len(held) and {(r.split, r.doc_id) for r in got} == held
    for r in got:
        assert all(0 <= r[m] <= 1 for m in models.MEMBERS)
        assert r.vote == pytest.approx((r.gbt + r.boosted + r.forest) / 3)
    for i in (0, 1):
        for m in (*models.MEMBERS, "vote"):
            one, zero = ([r[m] for r in got if r.split == i and r.label == y] for y in (1, 0))
            assert np.mean([(p > q) + (p == q) / 2 for p in one for q in zero]) > 0.85


def test_champion_has_the_best_mean(spark):
    bench = [(0, "x", 0.7), (1, "x", 0.9), (0, "b", 0.8), (1, "b", 0.8), (0, "none", None), (1, "none", None), (0, "low", 0.5), (1, "low", 0.4)]
    got = {r.model: r for r in models.champion(spark.createDataFrame(bench, "split int, model string, auc double")).collect()}
    assert [m for m, r in got.items() if r.champion] == ["b"]  # a tie goes to the first name
    assert got["x"].mean_auc == pytest.approx(0.8) and got["x"].sd == pytest.approx(np.std([0.7, 0.9], ddof=1)) and got["none"].mean_auc is None


def test_bootstrap_interval_is_that_of_resampling(spark):
    x = np.random.default_rng(2).normal(0.3, 1, 60)
    got = metrics.bootstrap_ci(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id int, d double"), "d", "id").first()
    means = np.random.default_rng(4).choice(x, (4000, 60)).mean(axis=1)
    lo, hi = np.percentile(means, [2.5, 97.5])
    assert got.lo == pytest.approx(lo, abs=0.08) and got.hi == pytest.approx(hi, abs=0.08) and got["mean"] == pytest.approx(x.mean(), abs=0.03)


def test_saved_model_gives_the_same_probabilities(spark, sf):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    import __spark_entry__ as entry
    from evidex.plans.model_queries import FEATURES as columns
    from evidex.sources import views as V

    data = models.assembled(V.ml_rows(spark, sf), columns)
    want = {r.doc_id: r.p for r in LogisticRegression(maxIter=20).fit(data).transform(data).select("doc_id", vector_to_array("probability")[1].alias("p")).collect()}
    got = {r.doc_id: r.p for r in entry.queries()["model_io"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)
