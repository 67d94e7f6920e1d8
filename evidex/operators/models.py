"""Risk models: splits, selection, calibration, thresholds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.operators.retrieval import kept


def leakage(rows: DataFrame, label: str, flag: str) -> DataFrame:
    """Label by flag counts, and whether the flag separates the labels perfectly."""
    t = rows.groupBy(label).agg(F.count_if(F.col(flag) == 0).alias("n0"), F.count_if(F.col(flag) == 1).alias("n1"), F.min(flag).alias("lo"), F.max(flag).alias("hi"))
    mixed = F.sum((F.col("lo") != F.col("hi")).cast("int")).over(Window.partitionBy())
    distinct = F.size(F.collect_set("lo").over(Window.partitionBy())) == F.count("*").over(Window.partitionBy())
    return t.withColumn("separates", (mixed == 0) & distinct)


def numbered(rows: DataFrame, keys: list[str], order: list[str], nth: str = "rn", total: str = "n") -> DataFrame:
    """Add each row's place among those of its keys (in `order`, from 1) and their number.

    Rows are dealt by ranges of (keys, order); a place is a count of the ranges
    before and a number within the range, so no task has to hold a key's rows.
    Equal (keys, order) share a range: make `order` end with something that differs.
    """
    dealt = rows.repartitionByRange(*keys, *order).withColumn("_key", F.struct(F.spark_partition_id().alias("part"), *keys))
    dealt = kept(dealt)  # ranges are drawn anew at each reading
    counts = dealt.groupBy("_key").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*[f"_key.{k}" for k in keys])  # one row a range and key
    before = F.coalesce(F.sum("_n").over(by.orderBy("_key.part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_key", before.alias("_before"), F.sum("_n").over(by).alias(total))
    here = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    return dealt.withColumn("_here", here).join(counts, "_key").withColumn(nth, F.col("_before") + F.col("_here")).drop("_key", "_here", "_before")


def strat_splits(rows: DataFrame, id_col: str, label: str, splits: int = 5, train: float = 0.8) -> DataFrame:
    """(split, id, is_train): per split and label the first share, exactly, in order of a hash."""
    r = rows.select(F.col(id_col).alias("id"), F.col(label).alias("label")).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    key = F.md5(F.concat(F.col("split").cast("string"), F.lit(":"), F.col("id").cast("string")).cast("binary"))
    placed = numbered(r.withColumn("_by", key), ["split", "label"], ["_by", "id"])
    return placed.select("split", "id", (F.col("rn") <= F.floor(F.col("n") * train)).alias("is_train"))


def auc_brier(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Rank-sum AUC and Brier score of (label, score) per key; ranks are prefix sums of the counts of distinct scores over range partitions."""
    square = F.pow(F.col("score") - F.col("label"), 2)
    tied = scores.groupBy(*keys, "score").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("ones"), F.sum("label").alias("p"), F.sum(square).alias("sq"), F.count(square).alias("n_sq"))
    tied = kept(tied.repartitionByRange(*keys, "score").withColumn("_part", F.spark_partition_id()).withColumn("_key", F.struct("_part", *keys)))
    parts = tied.groupBy("_key", "_part", *keys).agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition and key
    parts = parts.select("_key", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"))
    here = Window.partitionBy("_key").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    ranked = tied.withColumn("_upto", F.sum("n").over(here)).join(parts, "_key")
    rank = F.col("_n0") + F.col("_upto") - (F.col("n") - 1) / 2.0  # ties share their mean
    a = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("ones") > 0, F.col("ones") * rank)).alias("rs"), F.sum("p").alias("p"), F.sum("n").alias("n"), (F.sum("sq") / F.sum("n_sq")).alias("brier"))
    pos, neg = F.col("p"), F.col("n") - F.col("p")
    ok = (pos > 0) & (neg > 0)
    return a.select(*keys, F.when(ok, (F.col("rs") - pos * (pos + 1) / 2.0) / F.when(ok, pos * neg)).alias("auc"), "brier", "n")


def prior_correct(p: Column, train: float, true: float) -> Column:
    """Probability moved from the training to the true prevalence, on the log-odds scale."""
    import math

    c = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    z = F.log(c / (1 - c)) + math.log(true / (1 - true)) - math.log(train / (1 - train))
    return 1 / (1 + F.exp(-z))


def threshold_counts(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion counts at every threshold from one pass: scores fall into buckets, counts run from above."""
    edges = F.array(*[F.lit(float(t)) for t in thresholds])
    b = scores.withColumn("b", F.size(F.filter(edges, lambda t: t <= F.col("score"))))
    n = b.groupBy("b").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    grid = scores.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(thresholds)], "b int, threshold double")
    full = n.join(grid, "b", "full")
    above = Window.orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, 0)  # one row per threshold
    every = Window.partitionBy()
    full = full.withColumn("tp", F.coalesce(F.sum("p").over(above), F.lit(0))).withColumn("fp", F.coalesce(F.sum(F.col("n") - F.col("p")).over(above), F.lit(0)))
    full = full.withColumn("all_p", F.sum("p").over(every)).withColumn("all_n", F.sum(F.col("n") - F.col("p")).over(every)).where("threshold is not null")
    return full.select("threshold", "tp", "fp", (F.col("all_p") - F.col("tp")).alias("fn"), (F.col("all_n") - F.col("fp")).alias("tn"))


def rates(counts: DataFrame) -> DataFrame:
    """Sensitivity, specificity, PPV and NPV; null where nothing is counted."""
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return counts.withColumn("sens", ratio("tp", "fn")).withColumn("spec", ratio("tn", "fp")).withColumn("ppv", ratio("tp", "fp")).withColumn("npv", ratio("tn", "fn"))


def best_threshold(rated: DataFrame, target: float = 0.85) -> DataFrame:
    """Highest threshold whose sensitivity reaches the target, else that of the best sensitivity."""
    ok = F.col("sens") >= target
    top = rated.agg(F.max(F.when(ok, F.col("threshold"))).alias("reaching"), F.max_by("threshold", F.struct("sens", "threshold")).alias("fallback"))
    return top.select(F.coalesce("reaching", "fallback").alias("threshold"), F.col("reaching").isNotNull().alias("reached"))


def bayes(sens: Column, spec: Column, prevalence: float) -> tuple[Column, Column]:
    """PPV and NPV at the true prevalence."""
    a, b = sens * prevalence, (1 - spec) * (1 - prevalence)
    c, d = spec * (1 - prevalence), (1 - sens) * prevalence
    return F.try_divide(a, a + b), F.try_divide(c, c + d)


def linear_contributions(rows: DataFrame, id_col: str, weights: dict[str, float]) -> DataFrame:
    """(id, feature, value): weight times distance from the mean, ranked by size."""
    means = rows.agg(*[F.avg(f).alias(f"_m_{f}") for f in weights])
    wide = rows.join(F.broadcast(means)).select(F.col(id_col).alias("id"), *[((F.col(f) - F.col(f"_m_{f}")) * w).alias(f) for f, w in weights.items()])
    long = wide.unpivot("id", list(weights), "feature", "value")
    w = Window.partitionBy("id").orderBy(F.abs(F.round("value", 9)).desc(), "feature")
    return long.withColumn("rank", F.row_number().over(w))


def driver_payload(contributions: DataFrame) -> DataFrame:
    """Add the share of each contribution in the row's absolute total, in percent."""
    total = F.sum(F.abs("value")).over(Window.partitionBy("id"))
    return contributions.withColumn("percent", F.coalesce(F.try_divide(F.abs("value") * 100, total), F.lit(0.0)))


def assembled(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(doc_id, features, label) with standardised features."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    v = VectorAssembler(inputCols=features, outputCol="raw").transform(rows)
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v).withColumn("label", F.col(label).cast("double"))


def lasso_select(rows: DataFrame, features: list[str], folds: int = 3) -> dict[str, float]:
    """Coefficients of a cross-validated L1 logistic model; kept features have one over 1e-6."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    lr = LogisticRegression(elasticNetParam=1.0, maxIter=30)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.01]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=7)
    model = cv.fit(assembled(rows, features)).bestModel
    return dict(zip(features, model.coefficients.toArray().tolist()))


def boruta_select(rows: DataFrame, features: list[str], trials: int = 3) -> dict[str, int]:
    """How often each feature's importance beats the best of shuffled copies, over `trials` forests.

    A shadow column takes another row's value: rows are ordered by two hashes
    and matched by place, within hash buckets so that no task sees all rows.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    wins = dict.fromkeys(features, 0)
    for t in range(trials):
        bucket = F.pmod(F.xxhash64("doc_id", F.lit(t)), F.lit(64))
        w = lambda s: Window.partitionBy("b").orderBy(F.xxhash64("doc_id", F.lit(s)), "doc_id")
        base = rows.withColumn("b", bucket).withColumn("i", F.row_number().over(w(t + 100)))
        shade = base.select("b", F.row_number().over(w(t + 200)).alias("i"), *[F.col(f).alias(f"s_{f}") for f in features])
        both = base.join(shade, ["b", "i"])
        cols = features + [f"s_{f}" for f in features]
        v = VectorAssembler(inputCols=cols, outputCol="features").transform(both).withColumn("label", F.col("label").cast("double"))
        imp = RandomForestClassifier(numTrees=15, maxDepth=5, seed=t).fit(v).featureImportances.toArray()
        best = imp[len(features) :].max()
        for f, x in zip(features, imp):
            wins[f] += int(x > best)
    return wins


MEMBERS = ("gbt", "boosted", "forest", "svm_rbf")
#: Members whose mean is the vote.
VOTERS = ("gbt", "boosted", "forest")


def member_scores(rows: DataFrame, features: list[str], splits: int = 5) -> DataFrame:
    """(split, doc_id, label, one probability for each of `MEMBERS`, vote) of the held-out rows of each split.

    Members learn on the split's training rows: two kinds of boosted trees, a
    forest, and a linear SVM on random Fourier features of a Gaussian kernel.
    `vote` is the mean of `VOTERS`. Rows with a null label or feature are left out.
    """
    import numpy as np
    from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    whole = rows.dropna(subset=["label", *features])
    split = strat_splits(whole, "doc_id", "label", splits).withColumnRenamed("id", "doc_id")
    data = assembled(whole, features).select("doc_id", "label", "features")
    rng = np.random.default_rng(3)
    omega, phase = rng.normal(0, 0.5, (32, len(features))), rng.uniform(0, 2 * np.pi, 32)
    arr = vector_to_array("features")
    fourier = [F.cos(sum((arr[j] * float(omega[i, j]) for j in range(len(features))), F.lit(float(phase[i])))).alias(f"z{i}") for i in range(32)]
    wide = VectorAssembler(inputCols=[f"z{i}" for i in range(32)], outputCol="fourier").transform(data.select("*", *fourier))
    wide = kept(wide.select("doc_id", "label", "features", "fourier").join(split, "doc_id"))
    trees = {
        "gbt": GBTClassifier(maxIter=10, maxDepth=3, seed=1),
        "boosted": GBTClassifier(maxIter=10, maxDepth=5, stepSize=0.2, subsamplingRate=0.8, seed=2),
        "forest": RandomForestClassifier(numTrees=20, seed=1),
    }

    def scored(i: int) -> DataFrame:
        fit, held = wide.where((F.col("split") == i) & F.col("is_train")), wide.where((F.col("split") == i) & ~F.col("is_train"))
        for name, est in trees.items():
            est = est.copy().setProbabilityCol("_prob").setPredictionCol("_pred").setRawPredictionCol("_raw")
            held = est.fit(fit).transform(held).withColumn(name, vector_to_array("_prob")[1]).drop("_prob", "_pred", "_raw")
        margin = vector_to_array("rawPrediction")[1]
        held = LinearSVC(featuresCol="fourier", maxIter=20).fit(fit).transform(held).withColumn("svm_rbf", 1 / (1 + F.exp(-margin)))
        return held.select("split", "doc_id", "label", *MEMBERS)

    with ThreadPool(splits) as pool:  # the splits' jobs run side by side
        out = reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(rows.sparkSession)(scored), range(splits)))
    return out.withColumn("vote", sum((F.col(m) for m in VOTERS), F.lit(0.0)) / len(VOTERS))


def bench_models(rows: DataFrame, features: list[str], splits: int = 5) -> DataFrame:
    """(split, model, auc, brier, n) of every member and of the vote."""
    names = [*MEMBERS, "vote"]
    return auc_brier(member_scores(rows, features, splits).unpivot(["split", "doc_id", "label"], names, "model", "score"), ["split", "model"])


def champion(benched: DataFrame) -> DataFrame:
    """Mean and standard deviation of each model's AUC over the splits; the best mean, the first name on a tie, is champion."""
    a = benched.groupBy("model").agg(F.avg("auc").alias("mean_auc"), F.stddev_samp("auc").alias("sd"))
    best = F.row_number().over(Window.orderBy(F.desc_nulls_last("mean_auc"), "model"))  # one row per model
    return a.withColumn("champion", (best == 1) & F.col("mean_auc").isNotNull())


def compare_selections(features: list[str], domain: list[str], lasso: dict[str, float], boruta: dict[str, int], wins: int = 2) -> list[tuple]:
    """(feature, domain, lasso, boruta, chosen): chosen are the domain's features that one of the two selections keeps."""
    out = []
    for f in features:
        d, l, b = f in domain, abs(lasso.get(f, 0.0)) > 1e-6, boruta.get(f, 0) >= wins
        out.append((f, d, l, b, d and (l or b)))
    return out


#: Neighbouring ranges whose blocks are merged at a time.
MERGED = 32
BLOCKS = "fit int, part bigint, lo double, hi double, w double, s double"


class Pool:
    """Pool adjacent violators, fed in order of score: blocks (lo, hi, weight, sum) of rising means."""

    def __init__(self):
        self.blocks: list[tuple[float, float, float, float]] = []

    def add(self, lo: float, hi: float, w: float, s: float) -> None:
        held = self.blocks
        while held and held[-1][3] * w >= s * held[-1][2]:  # the mean before is not below this one
            before = held.pop()
            lo, w, s = before[0], before[2] + w, before[3] + s
        held.append((lo, hi, w, s))

    def frame(self, fit: int, part: int) -> pd.DataFrame:
        rows = pd.DataFrame(self.blocks, columns=["lo", "hi", "w", "s"], dtype="float64")
        return rows.assign(fit=np.int32(fit), part=np.int64(part))[["fit", "part", "lo", "hi", "w", "s"]]


def isotonic_blocks(points: DataFrame, fits: int) -> DataFrame:
    """(fit, lo, hi, w, s): the blocks of `fits` isotonic fits of points (score, w array, s array), score distinct.

    Points are pooled within ranges of the score, and the blocks of neighbouring
    ranges `MERGED` at a time until one is left; pooling pooled blocks gives what
    pooling the points gives. For labels 0 and 1 the means of the blocks are
    rising fractions whose denominators add up to n at most, so that there are
    fewer than 3 n^(2/3) blocks, and about n^(1/3) in noise.
    """

    def pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pools, part = [Pool() for _ in range(fits)], 0
        for pdf in batches:
            for score, ws, ss, part in zip(pdf["score"], pdf["w"], pdf["s"], pdf["part"]):
                for pool, w, s in zip(pools, ws, ss):
                    if w:
                        pool.add(score, score, w, s)
        for fit, pool in enumerate(pools):
            yield pool.frame(fit, part)

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pool = Pool()
        for r in pdf.sort_values("lo").itertuples(index=False):
            pool.add(r.lo, r.hi, r.w, r.s)
        return pool.frame(key[0], key[1])

    ranged = points.repartitionByRange("score").sortWithinPartitions("score").withColumn("part", F.spark_partition_id().cast("bigint"))
    blocks = kept(ranged.select("score", "w", "s", "part").mapInPandas(pooled, BLOCKS))
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // MERGED)
        blocks = kept(blocks.withColumn("part", F.floor(F.col("part") / MERGED)).groupBy("fit", "part").applyInPandas(merged, BLOCKS))
    return blocks.drop("part")


def isotonic_cv(scores: DataFrame, folds: int = 5) -> DataFrame:
    """(id, label, score, calibrated): each fold's rows by an isotonic fit on the other folds.

    Linear between blocks, level outside. Rows without score or label teach
    nothing; without a score, or other folds to learn from, `calibrated` is null.
    All fits come from one pass over the distinct scores.
    """
    fold = F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int")
    usable = scores.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("label").isNotNull()).withColumn("fold", fold)
    others = [F.col("fold") != f for f in range(folds)]
    y = F.col("label").cast("double")
    points = usable.groupBy((F.col("score").cast("double") + F.lit(0.0)).alias("score")).agg(
        F.array(*(F.count_if(o).cast("double") for o in others)).alias("w"), F.array(*(F.coalesce(F.sum(F.when(o, y)), F.lit(0.0)) for o in others)).alias("s")
    )
    fitted = isotonic_blocks(points, folds).orderBy("fit", "lo").toPandas()  # see the bound on blocks there
    lines = {int(f): (np.ravel(g[["lo", "hi"]]), np.repeat((g["s"] / g["w"]).to_numpy(), 2)) for f, g in fitted.groupby("fit")}
    sent = scores.sparkSession.sparkContext.broadcast(lines)  # as many blocks

    @F.pandas_udf("double")
    def calibrated(fold: pd.Series, score: pd.Series) -> pd.Series:
        out = np.full(len(score), np.nan)
        for f, (x, v) in sent.value.items():
            rows = (fold == f).to_numpy() & score.notna().to_numpy()
            out[rows] = np.interp(score[rows], x, v)
        return pd.Series(out).where(~np.isnan(out), None).astype("Float64")

    return scores.select("id", "label", "score", calibrated(fold, F.col("score").cast("double")).alias("calibrated"))
