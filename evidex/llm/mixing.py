"""Mix sources to target weights with Pareto order sampling.

Native: DataFrame operations only. Each source gets a word target by water
filling, every document gets the certain whole copies that target allows, and
the fraction left over is a sample: documents are ranked by random odds over
inclusion odds and taken until the words wanted are reached. Ranks run through
buckets of the rank value, so the largest source is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.llm._shared import WORD, cut, wrapped

#: Buckets of the rank value in each source.
BUCKETS = 1024
#: The whole order of ranks; rows equal in all of it have one id and one text.
TIE = ("_z", "doc_id", "text_md5")
#: Sources are broadcast up to this count, which is checked; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Add `target` (words) to (source, source_size, ...), one row per source.

    Sources by code point, null last, weigh `weights` in turn and share the
    total; a target stops at `cap` times its source's size and the excess is
    reshared by weight. The fixed point is a water level: with sources by
    capacity per weight, the first ones are full until the level reached by
    what remains no longer fills the next.
    """
    by_code = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row per source
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sizes = (
        sizes.withColumn("_nth", F.row_number().over(by_code))
        .withColumn("_w", F.element_at(cycle, ((F.col("_nth") - 1) % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    )
    by_fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_nth")
    full = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    sizes = (
        sizes.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(full), F.lit(0.0))) / F.sum("_w").over(rest))
        .withColumn("_open", F.col("_cap") > F.col("_w") * F.col("_level"))
        .withColumn("_fill", F.row_number().over(by_fill))
        .withColumn("_lambda", F.min(F.when(F.col("_open"), F.struct("_fill", "_level"))).over(everything)["_level"])
    )
    target = F.least(F.col("_cap"), F.coalesce(F.col("_w") * F.col("_lambda"), F.col("_cap")))
    return sizes.withColumn("target", target).drop("_w", "_cap", "_total", "_level", "_open", "_fill", "_lambda")


def random_unit(seed: str) -> Column:
    """44 bits of a portable hash of id and text, strictly inside (0, 1): many rows of one id spread out."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text_md5")).cast("binary"))
    return (F.conv(F.substring(key, 1, 11), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**44))


def ranked(rows: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """Join (doc_id, source, size, text_md5, ...) to its source's target and add whole copies and the Pareto rank `_z`."""
    rows = rows.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0))
    rows = (
        rows.withColumn("_whole", whole)
        .withColumn("_wanted", F.col("target") - F.col("_whole") * F.col("source_size"))
        .withColumn("_p", F.least(F.col("_wanted") / F.greatest("source_size", F.lit(1)), F.lit(1 - 1e-12)))
        .withColumn("_mean", F.greatest("source_size", F.lit(1)) / F.col("_n"))
        .withColumn("_u", random_unit(seed))
        .withColumn("_source_odds", F.col("_p") / (F.lit(1.0) - F.col("_p")))
        .withColumn("_odds", F.col("_source_odds") * F.sqrt(F.col("size") / F.col("_mean")))
    )
    z = F.col("_u") / (F.lit(1.0) - F.col("_u")) / F.greatest("_odds", F.lit(1e-300))
    return rows.withColumn("_z", F.when(F.col("_odds") > 0, z).otherwise(F.lit(1e300)))


def draw(slim: DataFrame, weights: tuple[int, ...], cap: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """(rows with copies, source targets) of (doc_id, source, size, text_md5) rows."""
    slim = cut(slim)  # read twice below; texts are read once
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    targets = source_targets(sizes, weights, cap)
    if sizes.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    # the rank without the source's own odds is spread evenly; rows that cannot be drawn are spread by u
    even = F.when(F.col("_odds") > 0, F.col("_z") * F.col("_source_odds")).otherwise(F.col("_u") / (F.lit(1.0) - F.col("_u")))
    rows = ranked(slim, targets, seed).withColumn("_bucket", F.floor(even / (F.lit(1.0) + even) * BUCKETS).cast("int"))
    before = Window.partitionBy("_nth").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("_nth", "_bucket").agg(F.sum("size").alias("_words"))
        .withColumn("_base", F.coalesce(F.sum("_words").over(before), F.lit(0)))
        .drop("_words")
    )
    inside = Window.partitionBy("_nth", "_bucket").orderBy(*TIE).rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        rows.withColumn("_upto", F.sum("size").over(inside))
        .join(starts, ["_nth", "_bucket"])
        .withColumn("_middle", F.col("_base") + F.col("_upto") - F.col("size") / F.lit(2.0))
        .withColumn("_drawn", (F.col("size") > 0) & (F.col("_middle") <= F.col("_wanted")))
        .withColumn("copies", (F.col("_whole") + F.col("_drawn").cast("int")).cast("long"))
    )
    return rows, targets


def slim_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, text_md5) of documents."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(text.cast("binary")).alias("text_md5"),
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    cap: float = 3.0,
    seed: str = "mix",
) -> DataFrame:
    """Copies of each document so that its source's words come near the target.

    A document's size is its number of words (null text: 0). Expected copies
    of a source's documents are target / size; the whole part is given to all,
    the rest goes by Pareto order: u / (1 - u), with u from a hash of id and text,
    over inclusion odds p / (1 - p), which grow with the square root of the
    size. Documents are taken in this order while the middle of their words
    lies under the words still wanted, so a source misses its target by one
    document at most, and reruns agree.

    Returns doc_id, size, source_size, target, taken (words with repeats) and
    copies. Null or repeated ids, empty texts and ties have a place each:
    a null id hashes as empty text, ties go by id and text hash; an empty table
    gives no rows. Other columns are not read.
    """
    rows, _ = draw(slim_rows(docs, id_col, text_col, source_col), weights, cap, seed)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    cap: float = 3.0,
    seed: str = "mix",
) -> DataFrame:
    """The rows of `docs`, all columns, each as often as mix_sources takes it.

    What was drawn is a prefix of each source's ranks, so the last rank drawn
    of each source, ties included, says it all and texts are not shuffled. Of
    rows equal to the last rank in id and text, as many stay as were drawn,
    first in order of a hash of the whole row; only these rows are shuffled,
    and only where there are any to tell apart.
    """
    rows, targets = draw(slim_rows(docs, id_col, text_col, source_col), weights, cap, seed)
    key = F.struct(*TIE)
    last = rows.where("_drawn").groupBy("_nth").agg(F.max(key).alias("_last"))
    ends = rows.join(last, "_nth").where(key.eqNullSafe(F.col("_last"))).groupBy("_nth").agg(F.count_if("_drawn").alias("_take"), F.count("*").alias("_tied"))
    limits = cut(targets.join(last, "_nth", "left").join(ends, "_nth", "left"))  # one row per source
    parted = bool(limits.where("_take < _tied").take(1))
    if limits.count() <= BROADCAST_SOURCES:
        limits = F.broadcast(limits)
    whole = wrapped(docs, doc_id=id_col, source=source_col, _text=text_col).withColumn("source", F.col("source").cast("string"))
    text = F.coalesce(F.col("_text").cast("string"), F.lit(""))
    whole = whole.withColumns({"size": F.regexp_count(text, F.lit(WORD)).cast("long"), "text_md5": F.md5(text.cast("binary"))}).drop("_text")
    placed = ranked(whole, limits, seed)
    at_end = (F.col("_take") < F.col("_tied")) & key.eqNullSafe(F.col("_last"))
    drawn = (F.col("size") > 0) & F.coalesce(key <= F.col("_last"), F.lit(False))

    def repeated(rows: DataFrame, drawn: Column) -> DataFrame:
        copies = (F.col("_whole") + drawn.cast("int")).cast("int")
        return rows.select("_row", F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy")).select("_row.*")

    if not parted:
        return repeated(placed, drawn)
    fields = [F.col("_row")[c] for c, kind in docs.dtypes if "map<" not in kind]
    nth = F.row_number().over(Window.partitionBy("_nth").orderBy(F.xxhash64(*fields)))
    ties = placed.where(F.coalesce(at_end, F.lit(False))).withColumn("_place", nth)
    return repeated(placed.where(~F.coalesce(at_end, F.lit(False))), drawn).unionByName(repeated(ties, F.col("_place") <= F.col("_take")))
