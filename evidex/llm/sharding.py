"""Contiguous shards of near-equal byte size from global prefix sums.

Native: DataFrame operations only. Texts are read once and reduced to (id,
size, crc), which is cut with a checkpoint, so that laying the rows out in
range partitions does not read them again; equal texts lie side by side. A
place in the checkpoint breaks ties, so that equal rows spread over partitions
too, however many they are. Per-partition totals
give each partition's global start, and a window inside the partition adds
the local prefix, so no task ever sees all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.llm._shared import cut


def with_prefix(slim: DataFrame, order: list[str], size: str) -> DataFrame:
    """Add `start` (bytes before the row), `row` (rows before it) and `total` (all bytes) in the order given.

    Nulls sort first; the last column of `order` tells equal rows apart.
    """
    laid = cut(slim.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = laid.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    totals = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"),
        F.sum("_bytes").over(Window.partitionBy()).alias("total"),
    )
    here = Window.partitionBy("_part").orderBy(*order)
    return (
        laid.withColumn("_upto", F.sum(size).over(here.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_nth", F.row_number().over(here))
        .join(F.broadcast(totals), "_part")  # as many rows as there are partitions
        .withColumn("start", F.col("_bytes0") + F.col("_upto") - F.col(size))
        .withColumn("row", F.col("_rows0") + F.col("_nth") - 1)
        .drop("_part", "_bytes0", "_rows0", "_upto", "_nth")
    )


#: Groups of equal texts of up to this part of a shard's bytes, one in so many, are not parted.
GROUP_PART = 10


def shard_by_bytes(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, group_part: int = GROUP_PART
) -> DataFrame:
    """Cut the documents, in order of text hash, size and id, into `shards` contiguous runs of near-equal bytes.

    Equal texts are neighbours in this order. A cut that falls into a group of
    them (same crc32 and size) moves to the group's nearer end, so the group
    lies in one shard; only a group of more than 1 / `group_part` of a shard's
    bytes is parted at the cut.

    A document's size is its UTF-8 length (null: none) plus `overhead`; it goes
    to the shard that holds the middle of its bytes, or of its group's, so a
    shard misses its target by one document or half such a group at each end.
    A null id comes first; repeated rows each
    get a place; an empty table gives no rows. Returns doc_id, size,
    text_crc32, law, shard, slot (gapless from 0 in each shard) and
    grown_shard (null: the law is `bytes`). Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = with_prefix(cut(slim).withColumn("_place", F.monotonically_increasing_id()), ["text_crc32", "size", "doc_id", "_place"], "size").withColumn(
        "shard",
        F.least(
            F.lit(shards - 1),
            F.expr(f"((2 * start + size) * {shards}L) div (2 * greatest(total, 1L))"),
        ).cast("int"),
    )
    groups = placed.groupBy("text_crc32", "size").agg(F.min("start").alias("_from"), F.sum("size").alias("_bytes"), F.min("shard").alias("_low"), F.max("shard").alias("_high"), F.max("total").alias("_all"))
    parted = groups.filter((F.col("_low") < F.col("_high")) & (F.col("_bytes") * shards * group_part <= F.col("_all")))
    whole = F.least(F.lit(shards - 1), F.expr(f"((2 * _from + _bytes) * {shards}L) div (2 * greatest(_all, 1L))")).cast("int")
    parted = parted.select("text_crc32", "size", whole.alias("_whole"))
    placed = placed.join(F.broadcast(parted), ["text_crc32", "size"], "left").withColumn("shard", F.coalesce("_whole", "shard"))  # one group a cut
    first = placed.groupBy("shard").agg(F.min("row").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
