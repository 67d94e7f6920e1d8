"""Hash-chained logs: each row's hash covers the row and everything before it.

A key's rows fall into segments. Inside a segment each row has a link: the hash
of the link before it and its payload. The last links of the segments are
chained in the same way, in segments of their own, and so on as a tree; a row's
chain hash joins its link with the chain hash of the segment before. So the
log is built in parallel over bounded arrays, a row's hash still depends on all
earlier rows of its key, and no segment can be taken out, moved or cut short
without the rows after it showing it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.sources.tables import checkpoint_folder

#: Rows of a segment, and what the first row of a key follows.
SEGMENT = 512
GENESIS = "genesis"


def chained(before: Column, payload: Column) -> Column:
    """Hash of what follows the hash `before`."""
    return F.sha2(F.concat(before, payload), 256)


def numbered(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add `n`, the place within the key from 0, without gathering a key in one task.

    Rows lie in range partitions of key and order; places are counted inside a
    partition, and a key that goes on in the next partitions brings its count
    along: one row a partition at most.
    """
    checkpoint_folder(log.sparkSession)
    laid = log.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    here = Window.partitionBy("_part", key).orderBy(*order)
    counts = laid.groupBy(F.col(key).alias("_key"), "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn("_before", F.sum("_rows").over(before)).where("_before > 0").select("_key", F.col("_part").alias("_p"), "_before")
    joined = laid.withColumn("n", (F.row_number().over(here) - 1).cast("long")).join(F.broadcast(carried), F.col("_key").eqNullSafe(F.col(key)) & (F.col("_p") == F.col("_part")), "left")
    return joined.withColumn("n", F.col("n") + F.coalesce("_before", F.lit(0))).drop("_part", "_p", "_key", "_before")


def _links(rows: DataFrame, key: str, segment: int) -> DataFrame:
    """(key, n, link, last) of rows (key, n, payload)."""
    held = F.array_sort(F.collect_list(F.struct("n", "payload")))
    groups = rows.groupBy(key, F.floor(F.col("n") / segment).alias("seg")).agg(held.alias("rows"))  # `segment` rows at most
    hashes = F.aggregate("rows", F.array(F.lit(GENESIS)), lambda done, x: F.concat(done, F.array(chained(F.element_at(done, -1), x["payload"]))))
    each = groups.select(key, F.size("rows").alias("size"), F.posexplode(F.arrays_zip(F.col("rows.n").alias("n"), F.slice(hashes, F.lit(2), F.size("rows")).alias("link"))))
    return each.select(key, "col.n", "col.link", (F.col("pos") + 1 == F.col("size")).alias("last"))


def _heads(links: DataFrame, key: str, segment: int) -> DataFrame:
    """(key, seg, head): the chain hash of the segment before `seg`; segments without one before them are left out."""
    digests = links.where("last").select(key, F.floor(F.col("n") / segment).alias("n"), F.col("link").alias("payload")).checkpoint()
    most = digests.agg(F.max("n")).first()[0] or 0
    above = _links(digests, key, segment)
    whole = _joined(above, key, segment) if most >= segment else above.withColumn("chain_hash", chained(F.lit(GENESIS), F.col("link")))
    return whole.select(key, (F.col("n") + 1).alias("seg"), F.col("chain_hash").alias("head"))


def _joined(links: DataFrame, key: str, segment: int) -> DataFrame:
    """`links` with their chain hashes."""
    heads = _heads(links, key, segment).withColumnsRenamed({key: "_key", "seg": "_seg"})
    met = links.join(heads, F.col("_key").eqNullSafe(F.col(key)) & (F.col("_seg") == F.floor(F.col("n") / segment)), "left")
    return met.withColumn("chain_hash", chained(F.coalesce("head", F.lit(GENESIS)), F.col("link"))).drop("_key", "_seg", "head")


def audit_chain(log: DataFrame, key: str, order: list[str], payload: str, segment: int = SEGMENT) -> DataFrame:
    """Add `n` (place within the key, from 0), `link` and `chain_hash`.

    Null payloads count as empty, and a null key is a key; `order` must tell the
    rows of a key apart. The log's own columns stay as they are.
    """
    rows = numbered(log, key, order).checkpoint()
    links = _links(rows.select(key, "n", F.coalesce(payload, F.lit("")).alias("payload")), key, segment).checkpoint()
    hashed = _joined(links, key, segment).drop("last").withColumnsRenamed({key: "_key", "n": "_n"})
    return rows.join(hashed, F.col("_key").eqNullSafe(F.col(key)) & (F.col("_n") == F.col("n"))).drop("_key", "_n")


def audit_heads(chain: DataFrame, key: str) -> DataFrame:
    """(key, rows, head): length and last chain hash of each key, to be kept elsewhere: without it the end of a log can be cut off unseen."""
    return chain.groupBy(key).agg(F.count("*").alias("rows"), F.max_by("chain_hash", "n").alias("head"))


def audit_verify(log: DataFrame, key: str, payload: str, link: str = "link", stored: str = "chain_hash", heads: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """Add `valid`: whether a row's link follows from its payload and the link before, and its hash from its link and the segment before.

    All rows are checked at once, by what is stored. An altered payload makes
    its own row invalid, an altered link the next row as well and, if it ends a
    segment, all later ones; so does a segment that is missing, moved or short.
    With `heads` (from `audit_heads`) the last row of a key of another length
    or end is invalid too.
    """
    seg = F.floor(F.col("n") / segment)
    last = F.lead("n").over(Window.partitionBy(key, seg).orderBy("n")).isNull()  # a segment's rows
    before = F.when(F.col("n") % segment == 0, F.lit(GENESIS)).otherwise(F.lag(link).over(Window.partitionBy(key, seg).orderBy("n")))
    follows = F.col(link) == chained(before, F.coalesce(payload, F.lit("")))
    checkpoint_folder(log.sparkSession)
    held = log.withColumns({"_follows": F.coalesce(follows, F.lit(False)), "_last": last}).checkpoint()
    links = held.select(key, "n", F.coalesce(link, F.lit("")).alias("link"), F.col("_last").alias("last"))
    own = _joined(links, key, segment).select(F.col(key).alias("_key"), F.col("n").alias("_n"), F.col("chain_hash").alias("_hash"))
    met = held.join(own, F.col("_key").eqNullSafe(F.col(key)) & (F.col("_n") == F.col("n")))
    valid = F.col("_follows") & F.coalesce(F.col(stored) == F.col("_hash"), F.lit(False))
    out = met.withColumn("valid", valid).drop("_follows", "_last", "_key", "_n", "_hash")
    if heads is None:
        return out
    told = heads.select(F.col(key).alias("_key"), (F.col("rows") - 1).alias("_end"), F.col("head").alias("_head"))
    ends = out.groupBy(F.col(key).alias("_of")).agg(F.max("n").alias("_most"))
    out = out.join(told, F.col("_key").eqNullSafe(F.col(key)), "left").join(ends, F.col("_of").eqNullSafe(F.col(key)), "left")
    ended = (F.col("n") != F.col("_most")) | ((F.col("n") == F.col("_end")) & (F.col(stored) == F.col("_head")))
    return out.withColumn("valid", F.col("valid") & F.coalesce(ended, F.lit(False))).drop("_key", "_end", "_head", "_of", "_most")
