"""Statistics whose one-task forms are dealt over ranges: same results, bounded tasks."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.operators import metrics, models

@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small tables stay in several ranges here, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

SCORES = "id bigint, label int, score double"

def scored(n=1_500, seed=8, levels=200):
    rng = np.random.default_rng(seed)
    s = np.round(rng.random(n), 3) if levels else rng.random(n)
    return [(i, int(rng.random() < x**2), float(x)) for i, x in enumerate(s)]

@pytest.mark.parametrize("merged", [2, 32])
def test_isotonic_equals_the_fit_in_one_task(spark, monkeypatch, merged):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    monkeypatch.setattr(models, "MERGED", merged)
    rows = spark.createDataFrame(scored(), SCORES)
    got = {r.id: r.calibrated for r in models.isotonic_cv(rows, 3).collect()}
    x = VectorAssembler(inputCols=["score"], outputCol="x").transform(rows.withColumn("y", F.col("label").cast("double"))).withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(3))).coalesce(1).cache()
    want = {}
    for f in range(3):
        model = IsotonicRegression(featuresCol="x", labelCol="y", predictionCol="c").fit(x.where(F.col("fold") != f))
        want |= {r.id: r.c for r in model.transform(x.where(F.col("fold") == f)).collect()}
    assert len(got) == len(want) == 1_500
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9

def test_isotonic_of_odd_rows(spark):
    rows = [(1, 1, None), (2, None, 0.5), (3, 0, float("nan")), (4, 0, 0.2), (5, 1, 0.7), (6, 1, 0.7), (7, 0, 0.7), (8, 1, 0.9), (None, 1, 0.1)]
    got = {r.id: r.calibrated for r in models.isotonic_cv(spark.createDataFrame(rows, SCORES)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, None} and got[1] is None and got[3] is None
    assert all(0 <= got[i] <= 1 for i in (2, 4, 5, 6, 7, 8, None))
    assert models.isotonic_cv(spark.createDataFrame([], SCORES)).count() == 0
    alone = models.isotonic_cv(spark.createDataFrame([(1, 1, 0.5)], SCORES)).first()
    assert alone.calibrated is None  # no other fold

def test_blocks_are_far_fewer_than_rows(spark):
    rows = spark.createDataFrame(scored(20_000, levels=None), SCORES)
    points = rows.groupBy("score").agg(F.array(F.count("*").cast("double")).alias("w"), F.array(F.sum("label").cast("double")).alias("s"))
    blocks = models.isotonic_blocks(points, 1).orderBy("lo").collect()
    means = [b.s / b.w for b in blocks]
    assert means == sorted(set(means)) and sum(b.w for b in blocks) == 20_000 and len(blocks) < 3 * 20_000 ** (1 / 3)

def test_splits_equal_places_in_order_of_the_hash(spark):
    rows = [(i, [0, 0, 0, 1, None][i % 5]) for i in range(500)]
    got = [tuple(r) for r in models.strat_splits(spark.createDataFrame(rows, "doc_id int, label int"), "doc_id", "label", 3).collect()]
    want = set()
    for split in range(3):
        for label in (0, 1, None):
            ids = sorted((hashlib.md5(f"{split}:{i}".encode()).hexdigest(), i) for i, y in rows if y == label)
            want |= {(split, i, n <= int(len(ids) * 0.8)) for n, (_, i) in enumerate(ids, 1)}
    assert len(got) == len(want) and set(got) == want

def test_places_over_ranges_of_one_hot_key(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.xxhash64("id").alias("h"), "id")
    placed = models.numbered(rows, ["k"], ["h", "id"]).withColumn("part", F.spark_partition_id())
    got = [r.id for r in placed.orderBy("rn").collect()]
    assert got == [r.id for r in rows.orderBy("h", "id").collect()]
    sizes = rows.repartitionByRange("k", "h", "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 12_000  # no task holds the key
    assert models.numbered(rows.limit(0), ["k"], ["h", "id"]).count() == 0

def test_poisson_weights_have_mean_and_variance_one(spark):
    w = spark.range(100_000).select(metrics.poisson_weight(F.col("id"), F.lit(7)).alias("w")).agg(F.avg("w").alias("m"), F.variance("w").alias("v"), F.avg((F.col("w") == 0).cast("int")).alias("zero")).first()
    assert w.m == pytest.approx(1, abs=0.02) and w.v == pytest.approx(1, abs=0.03) and w.zero == pytest.approx(np.exp(-1), abs=0.01)

def test_bootstrap_shuffles_a_row_a_replicate_and_skips_odd_rows(spark):
    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(2_000)] + [(5_000, None), (5_001, float("nan"))], "id int, d double")
    got = metrics.bootstrap_ci(rows, "d", "id", 200)
    r = got.first()
    x = np.array([i % 7 for i in range(2_000)])
    half = 1.96 * x.std() / np.sqrt(len(x))
    assert r["mean"] == pytest.approx(x.mean(), abs=0.02) and (r.hi - r.lo) / 2 == pytest.approx(half, rel=0.2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Window" not in plan and "partial_sum" in plan
    assert tuple(metrics.bootstrap_ci(rows.limit(0), "d", "id").first()) == (None, None, None)


def test_paired_statistics_of_three_arms(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.random((60, 3)), 1)  # many ties and zero differences
    rows = [(i, arm, float(v[i, j])) for i in range(60) for j, arm in enumerate("abc")] + [(90, "a", None), (91, "b", float("nan")), (92, "c", 1.0)]
    got = {(r.arm_a, r.arm_b): r for r in metrics.paired(spark.createDataFrame(rows, "q int, arm string, v double"), "q", "arm", "v").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (x, y), r in got.items():
        d = np.round(v[:, "abc".index(x)] - v[:, "abc".index(y)], 9)
        mag = np.abs(d[d != 0])
        rank = np.array([(mag < m).sum() + ((mag == m).sum() + 1) / 2 for m in mag])
        up, down = rank[d[d != 0] > 0].sum(), rank[d[d != 0] < 0].sum()
        m = len(mag)
        assert r.n == 60 and r.w == pytest.approx(min(up, down)) and r.r_rb == pytest.approx((up - down) / (up + down))
        assert r.z == pytest.approx((min(up, down) - m * (m + 1) / 4) / np.sqrt(m * (m + 1) * (2 * m + 1) / 24))
        assert r.t == pytest.approx(d.mean() / (d.std(ddof=1) / np.sqrt(60))) and r.d_z == pytest.approx(d.mean() / d.std(ddof=1))
    same = spark.createDataFrame([(i, a, 1.0) for i in range(3) for a in "ab"], "q int, arm string, v double")
    r = metrics.paired(same, "q", "arm", "v").first()
    assert (r.n, r.t, r.w, r.r_rb) == (3, None, None, None)
