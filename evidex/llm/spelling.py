"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

A sorted list is scanned for each of its words with a banded edit matrix. The
rows of a list word serve the next one as far as their common prefix (LCP)
reaches, and once all of a row exceeds one edit, the range of words that share
that prefix is skipped.

The vocabulary is dealt into lists by equi-keys. Let m be the shorter length
of a pair and i its common prefix. An edit at i in [lo, hi] leaves the first
lo and the last m - 1 - hi code points alike, so (m, lo, hi, these) names the
list that the pair meets in, and no other: a list keeps only pairs with i in
its interval. Lists start from two halves of m; one of more than `block`
words has its interval halved, on all words, until it is small or its interval
is one place. So no list grows with the corpus, and no pair is lost.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm._shared import written

#: Longest list that is scanned before its interval is halved.
BLOCK = 2_000
FAR = 9


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, damage: int | None = 31) -> DataFrame:
    """Words (maximal runs of Latin letters, A-Z lower-cased) of all texts with their number n.

    With `damage`, a run loses the code point at h % length if `damage` divides
    h, the crc32 of `<id>:<run>`: made misspellings to be found again. A null
    text has no words, a null id counts as empty text.
    """
    lowered = F.translate(F.col(text_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(rf"([a-zÀ-ÿ]{{{least_length},}})"), 1)).alias("word"),
    )
    if damage:
        h = F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary"))
        runs = runs.withColumn("_h", h)
        at = (F.col("_h") % F.char_length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        runs = runs.select(F.when(F.col("_h") % damage == 0, less).otherwise(F.col("word")).alias("word"))
    words = runs.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return words.filter(F.col("n") >= least_count)


def near_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Index pairs (i, j), i < j, of a sorted list of distinct words that are one edit apart."""
    n = len(words)
    lcp = [0] * n + [-1]  # of a word and the one before
    for j in range(1, n):
        a, b = words[j - 1], words[j]
        k, stop = 0, min(len(a), len(b))
        while k < stop and a[k] == b[k]:
            k += 1
        lcp[j] = k
    lower = [n] * n  # the next place with a smaller LCP
    stack: list[int] = []
    for j in range(1, n + 1):
        while stack and lcp[stack[-1]] > lcp[j]:
            lower[stack.pop()] = j
        stack.append(j)
    deepest = max(map(len, words)) + 1
    below, same, above = [FAR] * (deepest + 1), [FAR] * (deepest + 1), [FAR] * (deepest + 1)
    for i in range(n - 1):
        query = words[i]
        size = len(query)
        # rows of the query's own prefixes: a cell is edits between d code points of the list word and d - 1, d or d + 1 of the query
        for d in range(lcp[i + 1] + 1):
            below[d], same[d], above[d] = (1 if d else FAR), 0, (1 if d < size else FAR)
        j = i + 1
        depth = lcp[j]
        while j < n:
            word = words[j]
            dead = False
            for d in range(depth, len(word)):
                c = word[d]
                was, now, next_ = below[d], same[d], above[d]
                lo = min(was + (query[d - 1] != c), now + 1) if 0 < d <= size else (now + 1 if d == 0 else FAR)
                mid = min(now + (query[d] != c), next_ + 1, lo + 1) if d < size else FAR
                hi = min(next_ + (query[d + 1] != c), mid + 1) if d + 1 < size else FAR
                below[d + 1], same[d + 1], above[d + 1] = lo, mid, hi
                if lo > 1 and mid > 1 and hi > 1:
                    dead = True
                    j += 1
                    while lcp[j] > d:  # these share the d + 1 code points that are too far already
                        j = lower[j]
                    break
            if not dead:
                end = len(word)
                edits = same[end] if end == size else above[end] if end + 1 == size else below[end] if end - 1 == size else FAR
                if edits == 1:
                    yield i, j
                j += 1
            if j < n:
                depth = lcp[j]


def _common(a: str, b: str) -> int:
    k, stop = 0, min(len(a), len(b))
    while k < stop and a[k] == b[k]:
        k += 1
    return k


def _scanned(words: list[str], counts: list[int], m: int, lo: int, hi: int, turned: bool) -> Iterator[tuple[str, int, int, str]]:
    """For each word of a list its near words of this list: their number, and the commonest with its count."""
    found: dict[int, list[int]] = {}
    for i, j in near_pairs(words):
        a, b = words[i], words[j]
        if min(len(a), len(b)) != m:
            continue
        at = _common(a[::-1], b[::-1]) if turned else _common(a, b)
        if lo <= at <= hi:
            found.setdefault(i, []).append(j)
            found.setdefault(j, []).append(i)
    for i, others in found.items():
        plain = [(-counts[j], words[j][::-1] if turned else words[j]) for j in others]
        best = min(plain)
        yield words[i][::-1] if turned else words[i], len(plain), -best[0], best[1]


def _key(word: Column, m: Column, lo: Column, hi: Column) -> Column:
    left = F.substring(word, F.lit(1), lo)
    tail = F.greatest(F.lit(0), m - 1 - hi)
    right = F.when(tail > 0, F.substring(word, -tail, tail)).otherwise(F.lit(""))
    return F.xxhash64(m, lo, hi, left, right)


def _lists(words: DataFrame, block: int) -> DataFrame:
    """Each word once for each list that it belongs to."""
    size = F.char_length("word")
    m = F.explode(F.array(size, size - 1)).alias("m")
    halves = F.explode(F.array(F.struct(F.lit(0).alias("lo"), (F.floor(F.col("m") / 2) - 1).cast("int").alias("hi")), F.struct(F.floor(F.col("m") / 2).cast("int").alias("lo"), F.col("m").alias("hi"))))
    rows = words.select("word", "n", m).select("word", "n", "m", halves.alias("_i")).select("word", "n", "m", "_i.lo", "_i.hi")
    rows = rows.withColumn("key", _key(F.col("word"), F.col("m"), F.col("lo"), F.col("hi")))
    done = None
    while True:
        large = rows.groupBy("m", "lo", "hi", "key").count().filter((F.col("count") > block) & (F.col("hi") > F.col("lo"))).drop("count")
        large = written(large)
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        on = ["m", "lo", "hi", "key"]
        small = rows.join(large, on, "left_anti").select("word", "n", *on)
        done = small if done is None else done.unionByName(small)
        half = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        parts = F.explode(F.array(F.struct(F.col("lo").alias("a"), half.alias("b")), F.struct((half + 1).alias("a"), F.col("hi").alias("b"))))
        rows = rows.join(large, on, "left_semi").select("word", "n", "m", parts.alias("_i")).select("word", "n", "m", F.col("_i.a").alias("lo"), F.col("_i.b").alias("hi"))
        rows = written(rows.withColumn("key", _key(F.col("word"), F.col("m"), F.col("lo"), F.col("hi"))))


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each word (distinct, with n) that has words one edit away: word, n_near, and best_n, best (largest n, then code-point order)."""
    lists = _lists(words, block)
    # the longer shared end leads, so that a sorted list has long common prefixes
    turned = F.col("lo") < F.col("m") - 1 - F.col("hi")
    lists = lists.select("m", "lo", "hi", "key", F.when(turned, F.reverse("word")).otherwise(F.col("word")).alias("word"), "n")
    laid = lists.repartition("m", "lo", "hi", "key").sortWithinPartitions("m", "lo", "hi", "key", "word")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            ends = np.flatnonzero(_starts(pdf))
            if len(held) and len(pdf) and _same(held[-1], pdf):
                ends = ends[1:]
            if not len(ends):
                held.append(pdf)
                continue
            last = int(ends[-1])
            yield _solve(pd.concat([*held, pdf.iloc[:last]]))
            held = [pdf.iloc[last:]]
        if held:
            yield _solve(pd.concat(held))

    found = laid.mapInPandas(run, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
    return merged.select("word", "n_near", (-F.col("_best.less")).alias("best_n"), F.col("_best.word").alias("best"))


_NAMES = ["m", "lo", "hi", "key"]


def _starts(pdf: pd.DataFrame) -> np.ndarray:
    """Whether a list begins at each row."""
    names = pdf[_NAMES].to_numpy(dtype=np.int64)
    first = np.ones(len(names), dtype=bool)
    first[1:] = (names[1:] != names[:-1]).any(axis=1)
    return first


def _same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    return (a[_NAMES].iloc[-1] == b[_NAMES].iloc[0]).all()


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Near words of all lists of a run of rows."""
    out: list[tuple] = []
    if len(pdf) > 1:
        starts = np.flatnonzero(_starts(pdf))
        stops = np.append(starts[1:], len(pdf))
        words, counts = pdf["word"].tolist(), pdf["n"].tolist()
        m, lo, hi = (pdf[c].to_numpy() for c in ("m", "lo", "hi"))
        for a, b in zip(starts[stops - starts > 1].tolist(), stops[stops - starts > 1].tolist()):
            k, i, j = int(m[a]), int(lo[a]), int(hi[a])
            out.extend(_scanned(words[a:b], counts[a:b], k, i, j, i < k - 1 - j))
    return pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])


def variants(words: DataFrame, ratio: int = 10, block: int = BLOCK) -> DataFrame:
    """The form and root of each distinct word, given with its number n.

    A word's form is its near word of largest n (ties: the smallest in
    code-point order) if that is at least `ratio` times its own; its root is
    reached by following forms. n grows with each form, so there are no rings,
    and doubling the steps ends after a few rounds. Returns word, form, root,
    n, n_near, form_n.
    """
    near = near_words(words, block)
    joined = words.select("word", "n").join(near, "word", "left")
    taken = F.col("best_n") >= ratio * F.col("n")
    formed = written(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n"))
    )
    links = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        stepped = written(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        links = stepped.drop("_moved")
        if stepped.filter("_moved").isEmpty():
            break
    found = formed.join(links, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, **options) -> DataFrame:
    """Vocabulary of all texts with each word's commonest near spelling.

    A null text has no words; a null id counts as empty text; texts of any
    length are read whole; repeated rows count each; ties go to the smallest
    word in code-point order; an empty table gives no rows. Other columns are
    not read. Options are those of `vocabulary`.
    """
    return variants(written(vocabulary(docs, id_col, text_col, **options)), block=block)
