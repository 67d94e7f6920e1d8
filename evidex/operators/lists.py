"""Vector lists at rest: vectors filed by their nearest centre, with one-byte codes that bound every score.

Each list is a partition folder, so a search reads the folders that its queries
probe. There it compares codes first: a vector's code has a byte for each
number, and the length of what the code leaves out bounds the error of a
cosine. Only vectors whose upper bound reaches the k-th best lower bound are
read in full, so within the probed lists the result is exact.

New vectors are filed in the lists as they are; a manifest file makes each batch
visible at once, and what it names is never replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.operators.retrieval import BLOCK_QUERIES, SMALL_MATRIX, Index, ann_index, cosine, dense_topk, in_blocks, top_k, vector_blocks
from evidex.sources.tables import checkpoint_folder, stored

#: Vectors of one file of a list.
FILE_ROWS = 1 << 20
#: Scores are compared after rounding to nine decimals.
SLACK = 1e-8
#: Pairs of query and vector laid out at a time, about.
PAIRS = 1 << 17
#: Lists are worn once the table has grown this much since their centres were fitted.
WORN = 4
ROWS = "id bigint, vec array<double>, code binary, scale double, slack double, digest string, list int"
MANIFEST = "part string, rows bigint"
FOUND = "qid bigint, list int, id bigint, digest string, low double, high double"


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the unit vectors of x (a signed byte a number), the worth of one step, and the length of what is left out."""
    unit = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-10)
    step = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / np.where(step == 0, 1, step)[:, None]).astype(np.int8)
    return code, step, np.sqrt(((unit - code * step[:, None]) ** 2).sum(axis=1))


def prune(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Rows (q, id, digest, low, high) that may be among the k best of q; of equal vectors the k smallest ids."""
    rows = rows.sort_values(["q", "low"], ascending=[True, False], kind="stable")
    floor = rows[rows.groupby("q").cumcount() == k - 1].set_index("q")["low"]
    rows = rows[rows["high"] >= rows["q"].map(floor).fillna(-np.inf)]
    rows = rows.sort_values(["q", "digest", "id"], kind="stable")
    return rows[rows.groupby(["q", "digest"]).cumcount() < k]


def near(batches: Iterator[pd.DataFrame], ids: list, unit: np.ndarray, probed: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """FOUND rows of a task's coded vectors that may be among the k best of a query; about PAIRS pairs are laid out at a time."""
    held, floor = None, np.full(len(ids), -np.inf)
    step = max(1, SMALL_MATRIX // len(ids))

    def pruned(found: list[pd.DataFrame]) -> pd.DataFrame:
        kept = prune(pd.concat([*found, *([] if held is None else [held])], ignore_index=True), k)
        kth = kept.sort_values(["q", "low"], ascending=[True, False], kind="stable")
        kth = kth[kth.groupby("q").cumcount() == k - 1]
        floor[kth["q"]] = np.maximum(floor[kth["q"]], kth["low"])
        return kept

    for whole in batches:
        whole = whole[whole["scale"].notna()].sort_values(["digest", "id"], kind="stable")
        whole = whole[whole.groupby("digest").cumcount() < k].sort_index()  # of equal vectors the k smallest ids can be among the best
        for lo in range(0, len(whole), step):
            pdf, found, n = whole.iloc[lo : lo + step], [], 0
            at, name, digest = pdf["list"].to_numpy(), pdf["id"].to_numpy(), pdf["digest"].to_numpy()
            code = np.frombuffer(b"".join(pdf["code"]), dtype=np.int8).reshape(len(pdf), -1)
            scale, slack = pdf["scale"].to_numpy(), pdf["slack"].to_numpy() + SLACK
            for c in np.unique(at):
                probing, rows = np.flatnonzero(probed[:, c]), np.flatnonzero(at == c)
                vectors, width = code[rows].astype(np.float64), max(1, PAIRS // len(rows))
                for a in range(0, len(probing), width):
                    asks = probing[a : a + width]
                    s = (vectors @ unit[asks].T) * scale[rows, None]
                    if len(rows) >= k:  # k rows reach their k-th best lower bound, so pairs below it are not laid out
                        nth = np.partition(s - slack[rows, None], len(rows) - k, axis=0)[len(rows) - k]
                        floor[asks] = np.maximum(floor[asks], nth)
                    i, j = np.nonzero(s + slack[rows, None] >= floor[asks])
                    r = rows[i]
                    found.append(pd.DataFrame({"q": asks[j], "list": c, "id": name[r], "digest": digest[r], "low": s[i, j] - slack[r], "high": s[i, j] + slack[r]}))
                    n += len(i)
                    if n > PAIRS:
                        held, found, n = pruned(found), [], 0
            if n:
                held = pruned(found)
    if held is not None:
        yield held.assign(qid=[ids[q] for q in held["q"]])[["qid", "list", "id", "digest", "low", "high"]]


@dataclass
class VectorLists:
    """Lists in a folder: centres and probes, the batches that are visible, and how many vectors the first had."""

    spark: SparkSession
    folder: str
    index: Index | None  # none before the first vector
    parts: tuple[str, ...]
    fitted: int
    n: int

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, k: int = 10, recall: float = 0.97) -> VectorLists:
        """File `vectors` (id bigint, vec) in a new folder. Rows without id or vector are left out; of repeated ids one stays."""
        return cls(vectors.sparkSession, folder, None, (), 0, 0).add(vectors, k, recall)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorLists:
        """The lists of a folder with all batches committed by now; there must be one."""
        rows = spark.read.parquet(f"{folder}/centres").orderBy("list").collect()  # 1,024 lists at most
        index = Index(np.array([r["centre"] for r in rows]), rows[0]["probes"])
        batches = spark.read.schema(MANIFEST + ", nth bigint").parquet(f"{folder}/manifest").orderBy("nth").collect()  # one a batch
        return cls(spark, folder, index, tuple(r["part"] for r in batches), batches[0]["rows"], sum(r["rows"] for r in batches))

    def rows(self) -> DataFrame:
        """All filed vectors with their codes."""
        read = self.spark.read.schema(ROWS)
        parts = [read.parquet(f"{self.folder}/data/{p}") for p in self.parts]
        out = self.spark.createDataFrame([], ROWS) if not parts else parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _fit(self, vectors: DataFrame, k: int, recall: float) -> Index:
        index = ann_index(vectors, k, recall)
        centres = [(i, index.probes, [float(v) for v in c]) for i, c in enumerate(index.centres)]
        self.spark.createDataFrame(centres, "list int, probes int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/centres")
        return index

    def add(self, vectors: DataFrame, k: int = 10, recall: float = 0.97) -> VectorLists:
        """The lists with a batch of vectors filed in them; ids that are there already change nothing.

        The first batch fits the centres, and the probes that `recall` of the k nearest take.
        """
        spark = self.spark
        new = vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).where("id is not null and vec is not null").dropDuplicates(["id"])
        if self.parts:
            new = new.join(self.rows().select("id"), "id", "left_anti")
        elif not new.take(1):
            return self
        index = self.index or self._fit(new, k, recall)
        sent = spark.sparkContext.broadcast(index)  # 1,024 centres at most

        @F.pandas_udf("list int, code binary, scale double, slack double")
        def filed(v: pd.Series) -> pd.DataFrame:
            x = np.array(v.tolist(), dtype=np.float64) if len(v) else np.zeros((0, 1))
            if not len(x):
                return pd.DataFrame({"list": np.zeros(0, np.int32), "code": [], "scale": [], "slack": []})
            code, step, slack = encode(x)
            return pd.DataFrame({"list": sent.value.nearest(x), "code": [c.tobytes() for c in code], "scale": step, "slack": slack})

        sizes = new.select(Index.nearest_list(sent)("vec").alias("list")).groupBy("list").agg(F.count("*").alias("n"))
        sizes = [(r["list"], r["n"], -(-r["n"] // FILE_ROWS)) for r in sizes.collect()]  # a row a list
        files = spark.createDataFrame(sizes, "list int, n bigint, files bigint").select("list", "files")
        coded = new.withColumn("_c", filed("vec")).select("id", "vec", "_c.*", F.md5(F.to_json(F.struct("vec"))).alias("digest"))
        # a list of many vectors is dealt to several tasks
        dealt = coded.join(F.broadcast(files), "list").repartition("list", F.pmod(F.xxhash64("id"), F.col("files"))).drop("files")
        part, total = uuid.uuid4().hex, sum(n for _, n, _ in sizes)
        if total:
            dealt.sortWithinPartitions("list", "id").select("id", "vec", "code", "scale", "slack", "digest", "list").write.partitionBy("list").parquet(f"{self.folder}/data/{part}")
            spark.createDataFrame([(part, total, len(self.parts))], MANIFEST + ", nth bigint").coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return VectorLists(spark, self.folder, index, self.parts + ((part,) if total else ()), self.fitted or total, self.n + total)

    def worn(self) -> bool:
        """Whether the table has outgrown its centres, so that `rebuilt` would search less."""
        return self.n > WORN * max(1, self.fitted)

    def rebuilt(self, folder: str, k: int = 10, recall: float = 0.97) -> VectorLists:
        """The same vectors in new lists and one batch, in a folder of their own."""
        return VectorLists.build(self.rows().select("id", "vec"), folder, k, recall)

    # search -----------------------------------------------------------------------------------

    def probed_rows(self, probed: np.ndarray) -> DataFrame:
        """Rows of the lists that any query of `probed` (queries, lists) looks into: other folders are not read."""
        return self.rows().where(F.col("list").isin([int(c) for c in np.flatnonzero(probed.any(axis=0))]))

    def candidates(self, ids: list, mat: np.ndarray, k: int) -> tuple[DataFrame, object]:
        """(qid, list, id, ...) that may be among the k best of their query by the bounds of their codes; vectors are not read."""
        probed = self.index.probed(mat)
        unit = mat / np.maximum(np.sqrt((mat * mat).sum(axis=1, keepdims=True)), 1e-10)
        sent = self.spark.sparkContext.broadcast((ids, unit, probed))  # a block of queries

        slim = self.probed_rows(probed).select("list", "id", "code", "scale", "slack", "digest")
        found = stored(slim.mapInPandas(lambda batches: near(batches, *sent.value, k), FOUND))
        floors = top_k(found, k, score="low", tie="id").groupBy("qid").agg(F.min("low").alias("_low"), F.count("*").alias("_n"))
        floors = floors.select("qid", F.when(F.col("_n") == k, F.col("_low") - SLACK).otherwise(F.lit(float("-inf"))).alias("_floor"))
        return found.join(floors, "qid").where("high >= _floor").select("qid", "list", "id"), sent

    def search(self, queries: DataFrame, k: int = 10, limit: int = BLOCK_QUERIES) -> DataFrame:
        """(qid, vec_id, score, rank): the k nearest vectors by cosine among the lists that a query probes, ties by id.

        queries (qid unique, vec). Queries go in blocks of `limit`. A query
        without a vector is left out. Exact where the k nearest lie in the
        probed lists; fewer than k rows where those hold fewer vectors.
        """
        asked = queries.where("vec is not null").select(F.col("qid").cast("bigint").alias("qid"), F.col("vec").cast("array<double>").alias("vec"))

        def run(part):
            found, sent = self.candidates(*part, k)
            found = stored(found)
            lists = [r[0] for r in found.select("list").distinct().collect()]  # of the block's lists
            full = self.rows().where(F.col("list").isin(lists)).select("list", "id", "vec").join(found, ["list", "id"])
            scored = full.join(asked.select("qid", F.col("vec").alias("_q")), "qid").select("qid", F.col("id").alias("vec_id"), F.round(cosine(F.col("_q"), F.col("vec")), 9).alias("score"))
            return top_k(scored, k, tie="vec_id").select("qid", "vec_id", "score", "rank"), sent

        if not self.parts:
            return dense_topk(asked, self.rows(), k)
        return in_blocks(vector_blocks(asked, limit), run, asked.select("qid", F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0))


_OPENED: dict[tuple, VectorLists] = {}


def opened(spark: SparkSession, source: DataFrame, make) -> VectorLists:
    """The lists of make() over the files of `source`; built once in an application, and anew when a file changes."""
    about = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    files = about.agg(F.count("*"), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first()
    key = (spark.sparkContext.applicationId, checkpoint_folder(spark), *files)
    if key not in _OPENED:
        _OPENED[key] = VectorLists.build(make(), f"{checkpoint_folder(spark)}/lists-{uuid.uuid4().hex}")
    return _OPENED[key]
