"""An evidence store that only grows: staged files, and a manifest that makes each of them visible at once.

A commit writes its rows to a folder of its own and then one small manifest
file that names it. Until that file is there nobody sees the rows, so a run
that dies half way leaves nothing behind but files that no manifest names.
Nothing that a manifest names is ever replaced: whoever reads a version goes on
reading it, whatever is committed later.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.sources.corpus import sentence_chunks

MANIFEST = "version bigint, kind string, path string, run string"
REGISTRY = "document_id string, name string, active boolean"
CHUNKS = "document_id string, source string, chunk_index bigint, chunk_text string, section string, content_id string"
CELLS = "backbone string, arm string, status string"
SCHEMAS = {"registry": REGISTRY, "chunks": CHUNKS, "cells": CELLS}


@dataclass
class EvidenceStore:
    """Registry of documents, their chunks, and the cells of experiments, in one folder; commits come from one writer at a time."""

    spark: SparkSession
    folder: str

    def manifest(self) -> DataFrame:
        """(version, kind, path, run): what is visible, one row a commit and kind."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
        except Exception as e:  # no commit yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def version(self) -> int:
        return self.manifest().agg(F.max("version")).first()[0] or 0

    def stage(self, kind: str, rows: DataFrame) -> str:
        """Write rows where no reader sees them yet; gives their path."""
        path = f"{self.folder}/data/{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def commit(self, staged: dict[str, str], run: str = "") -> int:
        """Make staged rows (kind: path) visible together; gives the new version."""
        version = self.version() + 1
        entries = self.spark.createDataFrame([(version, kind, path, run) for kind, path in staged.items()], MANIFEST)
        entries.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")  # one file: all or nothing
        return version

    def clear(self) -> int:
        """Hide everything from later versions; files and earlier versions stay."""
        return self.commit({"clear": ""})

    def read(self, kind: str, version: int | None = None) -> DataFrame:
        """Rows of a kind with the version that brought them, up to `version` and after the last clear before it."""
        seen = self.manifest()
        if version is not None:
            seen = seen.where(F.col("version") <= version)
        cleared = seen.where("kind = 'clear'").agg(F.max("version")).first()[0] or 0
        entries = seen.where((F.col("version") > cleared) & (F.col("kind") == kind)).select("version", "path").collect()  # one row a commit
        out = self.spark.createDataFrame([], f"{SCHEMAS[kind]}, version bigint")
        for e in entries:
            out = out.unionByName(self.spark.read.schema(SCHEMAS[kind]).parquet(e["path"]).withColumn("version", F.lit(e["version"]).cast("bigint")))
        return out

    def registry(self, version: int | None = None) -> DataFrame:
        """One row a document id (a null id is one): the latest."""
        latest = F.max(F.struct("version", "name", "active")).alias("_row")
        return self.read("registry", version).groupBy("document_id").agg(latest).select("document_id", "_row.name", "_row.active", "_row.version")

    def chunks(self, version: int | None = None) -> DataFrame:
        """One row a content id: the first that came, so a repeat changes nothing."""
        return _first(self.read("chunks", version))

    # ingest -----------------------------------------------------------------------------------

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str = "source", batches: int = 1, run: str = "") -> int:
        """Documents and their sentence chunks, in batches that are committed one by one; gives the last version.

        A chunk whose content is in the store already is not written again, and
        a document that comes again takes the newer registry row, so a run can
        be repeated after a failure. Null and repeated ids keep their chunks;
        a null text has a registry row and no chunk.
        """
        named = docs.select(F.col(id_col).cast("string").alias("document_id"), F.col(name_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text"))
        part = F.pmod(F.xxhash64("document_id", "text"), F.lit(batches))
        version = self.version()
        for b in range(batches):
            rows = named.where(part == b) if batches > 1 else named
            registry = rows.groupBy("document_id").agg(F.min("name").alias("name")).withColumn("active", F.lit(True))
            about = rows.select(F.to_json(F.struct("document_id", F.col("name").alias("source"))).alias("about"), "text")
            cut = sentence_chunks(about, "about", "text").withColumn("_about", F.from_json("doc_id", "document_id string, source string"))
            cut = cut.select("_about.*", "chunk_index", "chunk_text", "section", "content_id")
            fresh = _first(cut.withColumn("version", F.lit(0).cast("bigint"))).drop("version")
            known = self.read("chunks").select("content_id")
            staged = {"registry": self.stage("registry", registry), "chunks": self.stage("chunks", fresh.join(known, "content_id", "left_anti").select(*fresh.columns))}
            version = self.commit(staged, run)
        return version

    # grids ------------------------------------------------------------------------------------

    def finish(self, cells: DataFrame, run: str = "") -> int:
        """Record cells (backbone, arm, status `done` or `failed`) of a grid."""
        return self.commit({"cells": self.stage("cells", cells.select("backbone", "arm", "status"))}, run)

    def cells(self, grid: DataFrame) -> DataFrame:
        """`grid` (backbone, arm) with the latest status of each cell: done, failed or open."""
        latest = self.read("cells").groupBy("backbone", "arm").agg(F.max(F.struct("version", "status"))["status"].alias("status"))
        told = latest.withColumnsRenamed({"backbone": "_b", "arm": "_a"})
        met = grid.join(told, F.col("_b").eqNullSafe(F.col("backbone")) & F.col("_a").eqNullSafe(F.col("arm")), "left")
        return met.withColumn("status", F.coalesce("status", F.lit("open"))).drop("_b", "_a")


def _first(rows: DataFrame) -> DataFrame:
    """One row a content id: of the least version, then document id (nulls last) and place; copies are folded before the shuffle."""
    order = F.struct("version", F.col("document_id").isNull().alias("none"), "document_id", "chunk_index", "source", "section", "chunk_text")
    kept = rows.groupBy("content_id").agg(F.min(order).alias("_row"))
    return kept.select(*[F.col("content_id") if c == "content_id" else F.col(f"_row.{c}") for c in rows.columns])
