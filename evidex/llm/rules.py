"""Quality rules whose cut-offs carry a risk guarantee.

The rules are tightened together in fixed levels: each level has one cut-off
for every statistic, none looser than those of the level before. On labelled
holdout documents of good quality the false rejections of the whole rule set
are counted per stratum and level. Within a stratum the levels are tested in
order, from the loosest, with the exact binomial p-value for "the rate of false
rejections exceeds alpha", until one fails (fixed-sequence testing, which
needs no correction); the strata share delta equally (Bonferroni). With
confidence 1 - delta, no stratum loses more than alpha of its good documents.
A stratum with too few labels for any guarantee keeps the base rule alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidex.llm._shared import cut, slices, wrapped

#: Bands of length, by words: the strata within which false rejections are limited.
BANDS = (50, 200)
#: Cut-offs of each statistic (in thousandths of words or characters) at the levels, loosest first: a text is rejected above one.
LEVELS = {
    "symbol_permille": [300, 200, 120, 80, 50, 30, 20, 10, 5],
    "dup_line_permille": [900, 800, 700, 650, 600, 550, 500, 450, 400],
    "repeat_word_permille": [200, 200, 200, 200, 200, 200, 200, 195, 190],
    "long_word_permille": [24000, 20000, 16000, 14000, 12000, 11000, 10000, 9500, 9300],
    "upper_permille": [900, 800, 700, 600, 500, 400, 300, 250, 200],
}
N_LEVELS = 9
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars_all", "n_upper")
SPACES, SYMBOLS, CAPITALS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact codes for pairs of codes: equal pairs, equal codes."""
    return pd.factorize(left.astype(np.int64) * (int(right.max(initial=0)) + 1) + right)[0].astype(np.int64)


def repeated_words(words: list, owner: np.ndarray, rows: int, k: int = 5) -> np.ndarray:
    """Per row, the words that lie in a k-word window (k = 5) found twice or more in that row."""
    n = len(words) - k + 1
    if n < 2:
        return np.zeros(rows, dtype=np.int64)
    one = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    two = _pair(one[:-1], one[1:])
    four = _pair(two[:-2], two[2:])
    five = _pair(four[:-1], one[4:])
    place = np.flatnonzero(owner[:n] == owner[k - 1 :])
    key = _pair(five[place], owner[place])
    again = place[np.bincount(key, minlength=1)[key] > 1]
    size = len(words) + 1
    marks = np.bincount(again, minlength=size) - np.bincount(again + k, minlength=size)
    return np.bincount(owner[np.cumsum(marks)[:-1] > 0], minlength=rows)


def base_statistics(texts: list) -> pd.DataFrame:
    """Counts of whole texts, one row each; null counts as empty. Columns as in BASE."""
    rows = {c: np.zeros(len(texts), dtype=np.int64) for c in BASE}
    words: list = []
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        found = raw.split()
        words += found
        rows["n_words"][i] = len(found)
        rows["word_chars"][i] = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
        rows["n_chars_all"][i] = len(text)
        rows["n_symbols"][i] = len(raw) - len(raw.translate(None, SYMBOLS))
        rows["n_upper"][i] = len(raw) - len(raw.translate(None, CAPITALS))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        rows["n_lines"][i] = len(lines)
        rows["n_dup_lines"][i] = len(lines) - len(set(lines))
    rows["n_repeat_words"] = repeated_words(words, np.repeat(np.arange(len(texts)), rows["n_words"]), len(texts))
    return pd.DataFrame(rows)


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in BASE]))
def _measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch.tolist()
        parts = [base_statistics(texts[lo:hi]) for lo, hi in slices(texts)]
        yield pd.concat(parts, ignore_index=True) if parts else base_statistics([])


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the base counts, the rule statistics and base_failed in one struct column `_m`."""
    docs = docs.withColumn("_m", _measure.asNondeterministic()(F.col(text_col).cast("string")))

    def share(part: str, whole: str):
        return F.coalesce(F.expr(f"cast(1000 * _m.{part} div nullif(_m.{whole}, 0) as bigint)"), F.lit(0))

    return docs.withColumn(
        "_m",
        F.struct(
            *[F.col(f"_m.{c}").alias(c) for c in BASE],
            share("n_symbols", "n_chars_all").alias("symbol_permille"),
            share("n_dup_lines", "n_lines").alias("dup_line_permille"),
            share("n_repeat_words", "n_words").alias("repeat_word_permille"),
            share("word_chars", "n_words").alias("long_word_permille"),
            share("n_upper", "word_chars").alias("upper_permille"),
            F.expr("_m.n_words < 10 or 100 * _m.n_repeat_words > 20 * _m.n_words").alias("base_failed"),
            sum((F.expr(f"cast(_m.n_words >= {b} as int)") for b in BANDS), F.lit(0)).alias("band"),
        ),
    )


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), summed exactly from log terms."""
    if k >= n:
        return 1.0
    logs = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)])
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def level_of(k: np.ndarray, n: int, alpha: float, delta: float) -> int:
    """The last level that fixed-sequence testing certifies, from rejections `k` at each level among n; -1 for none."""
    for j, x in enumerate(k):
        if x > alpha * n or binomial_tail(int(x), n, alpha) > delta:
            return j - 1
    return len(k) - 1


def survives() -> Column:
    """How many levels, from the loosest, a measured text passes by all statistics."""
    passed = []
    for s, cuts in LEVELS.items():
        value = F.col(f"_m.{s}")
        passed.append(F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c >= value)))  # noqa: B023
    return F.least(*passed)


def thresholds(holdout: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(band, level) certified on measured good documents that pass the base rule.

    Counting is a Spark aggregate; the tests see one small row a band, and so
    does the result: the last certified level from 0, or -1.
    """
    s = survives()
    counted = holdout.where("not _m.base_failed").groupBy(F.col("_m.band").alias("band")).agg(
        F.count("*").alias("n"), F.array(*[F.sum((s <= j).cast("long")) for j in range(N_LEVELS)]).alias("k")
    )

    @F.pandas_udf("int")
    def tested(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([level_of(a, int(b), alpha, delta / (len(BANDS) + 1)) for a, b in zip(k, n)], dtype="int32")

    return counted.select("band", tested("k", "n").alias("level"))


def verdict(measured: DataFrame, certified: DataFrame) -> DataFrame:
    """Add `kept`: not base_failed, and passing the certified level of its band.

    The levels are one row with a map of at most one entry a band, and so
    broadcast at a fixed size.
    """
    one = certified.agg(F.map_from_entries(F.collect_list(F.struct("band", "level"))).alias("_levels"))
    level = F.coalesce(F.try_element_at("_levels", F.col("_m.band")), F.lit(-1))
    return measured.join(F.broadcast(one)).withColumn("kept", ~F.col("_m.base_failed") & (survives() > level)).drop("_levels")


def certify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.02, delta: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(measured ids, certified levels): every document is measured once and cut with a checkpoint without its text."""
    measured = cut(measure(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text").drop("_text"))
    good = labels.where(F.col("quality") == 1).select("doc_id").distinct()
    return measured, cut(thresholds(measured.join(good, "doc_id", "left_semi"), alpha, delta))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Counts and verdict of every document.

    `labels` has doc_id and quality; its documents with quality 1 are the
    holdout on which levels are certified. Strata are bands of length in
    words. Null and empty texts have zero counts and fail the base rule; null
    ids are judged but never labelled; repeated rows are judged alike; an empty
    table gives no rows and no labels give base verdicts only. Other columns
    are not read. Returns doc_id, the counts in BASE, the statistics, band,
    base_failed and kept.
    """
    measured, cuts = certify(docs, labels, id_col, text_col, alpha, delta)
    return verdict(measured, cuts).select("doc_id", "_m.*", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose verdict is to keep. Texts are measured again rather than shuffled."""
    _, cuts = certify(docs, labels, id_col, text_col)
    return verdict(measure(wrapped(docs, _text=text_col), "_text"), cuts).where("kept").select("_row.*")
