"""Small helpers used by several operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.sources.tables import checkpoint_folder

#: A word is a run of characters other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Spark alone touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str | Column, n: int) -> Column:
    """crc32 of the id's text modulo n; a null id counts as empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: what spark.checkpoint.dir names, or a temporary one on a local master."""
    return checkpoint_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(texts: list, budget: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of rows with about `budget` characters each, one row at least."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > lo and size + n > budget:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def row_sample(rows: DataFrame, limit: int, seed: str, *by: str, among: DataFrame | None = None) -> DataFrame:
    """At most `limit` rows in order of a hash of the columns `by`, the same on each run; rows equal in them count once.

    With `among` (first column of `by`, and what else it has) only rows that it
    names count, and its other columns are added. Hashes alone are sorted and
    joined with `among`; `limit` of them then find their rows, so texts are
    shuffled only for the sample.
    """
    key = F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in by])
    narrow = rows.select(key.alias("_key"), F.col(by[0]))
    narrow = narrow.select("_key") if among is None else narrow.join(among, by[0]).drop(by[0])
    more = [F.max(c).alias(c) for c in narrow.columns[1:]]
    chosen = (narrow.groupBy("_key").agg(*more) if more else narrow.distinct()).orderBy("_key").limit(limit)
    found = rows.withColumn("_key", key).join(F.broadcast(chosen), "_key")  # `limit` hashes
    return found.groupBy("_key").agg(*[F.first(c).alias(c) for c in found.columns if c != "_key"]).drop("_key")


def written(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the shared checkpoint folder: smaller there than a checkpoint."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wrapped(docs: DataFrame, **names: str) -> DataFrame:
    """Whole rows as one struct `_row`, and the named columns beside it, so that no column of the table clashes."""
    return docs.select(F.struct("*").alias("_row"), *[F.col(f"`{c}`").alias(n) for n, c in names.items()])
