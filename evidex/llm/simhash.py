"""SimHash near-duplicates by multi-index hashing.

Fingerprints are made next to the data. Distinct fingerprints are indexed by
each 32-bit half; two that differ in at most three bits differ in at most one
bit of some half, so each looks its half up together with the values one bit
above it (the other direction is the partner's own look-up), and the whole
distance is verified before a link comes out. Components follow by rounds of
neighbour-minimum contraction, each cut with a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.llm._shared import cut, wrapped

MAX_BITS = 3
SHINGLE = 3


def fingerprints_of(texts: list, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit majority fingerprints of the texts' word shingles, as uint64."""
    out = np.zeros(len(texts), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text is not None else []
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        k = min(shingle, len(words))
        spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
        h = np.fromiter((digest(joined[a:b], 42) for a, b in spans), dtype=np.uint64, count=len(words) - k + 1)
        ones = np.zeros(64, dtype=np.int64)
        for lo in range(0, len(h), 65536):  # bounded memory for very long texts
            part = h[lo : lo + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        out[i] = weights[2 * ones > len(h)].sum(dtype=np.uint64)
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every document; null and wordless texts get fingerprint zero."""

    @F.pandas_udf("bigint")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(fingerprints_of(batch.tolist(), shingle).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), fp.asNondeterministic()(F.col(text_col).cast("string")).alias("fp"))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at most `max_bits` (0 to 3) apart, each pair once or twice.

    `fps` has one row per distinct `fp`. A half's bucket holds distinct values
    only, so copies never meet here, and unverified pairs leave no join.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves with balls of radius one cover distances 0 to 3")
    mask = F.lit(0xFFFFFFFF).cast("long")
    halves = F.array(
        F.struct(F.lit(0).alias("side"), F.shiftrightunsigned("fp", 32).alias("half")),
        F.struct(F.lit(1).alias("side"), F.col("fp").bitwiseAND(mask).alias("half")),
    )
    table = fps.select("fp", F.explode(halves).alias("h")).select("fp", "h.side", "h.half")
    flips = F.array(*[F.lit(1 << i).cast("long") for i in range(32)])
    ball = F.concat(
        F.array(F.col("half")),
        F.transform(
            F.filter(flips, lambda bit: F.col("half").bitwiseAND(bit) == 0),
            lambda bit: F.col("half").bitwiseOR(bit),
        ),
    )
    probes = table.select(F.col("fp").alias("a"), "side", F.explode(ball).alias("half"))
    found = probes.join(table.withColumnRenamed("fp", "b"), ["side", "half"])
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return found.where((F.col("a") != F.col("b")) & near).select("a", "b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of `edges` (a, b) can reach.

    Alternates large-star and small-star steps: every edge is turned towards
    the smallest neighbour until all nodes hang on their root. A node's
    neighbour list is never built: the minimum comes from an aggregate and is
    joined back. Isolated nodes are not returned. Each round is checkpointed.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = None
    for _ in range(rounds):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi <> lo").distinct()
        parent = large.groupBy("hi").agg(F.min("lo").alias("m"))
        ends = F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        small = large.join(parent, "hi").select(F.explode(ends).alias("e")).select("e.hi", "e.lo")
        edges = cut(small.where("hi <> lo").distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def grouped(prints: DataFrame, max_bits: int, **picks: Column) -> DataFrame:
    """(fp, root, picks) of every distinct fingerprint of `prints`: its component and an aggregate of its rows for each pick."""
    groups = cut(prints.groupBy("fp").agg(*[c.alias(n) for n, c in picks.items()]))
    roots = components(links(groups.select("fp"), max_bits))
    return groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, shingle: int = SHINGLE
) -> DataFrame:
    """Fingerprint and component of every document.

    Words are lower-cased (A-Z) runs of non-space; shingles are three words,
    repeats included, or the whole sequence where there are fewer. Null, empty
    and wordless texts have fingerprint zero and are linked like any other.
    Returns one row per document row: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest doc_id reachable through links; repeated doc_ids
    keep their rows, a null doc_id is returned and is a component_id only where
    no other id is reachable. An empty table gives no rows; other columns are
    not read. Copies are folded into their fingerprint before any join, so a
    large group of copies costs one row in the index.
    """
    prints = cut(fingerprint(docs, id_col, text_col, shingle))
    named = grouped(prints, max_bits, least=F.min("doc_id"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row of `docs`, all columns, of each component: that of its smallest id.

    A null id comes after all others. Rows are told apart by id and a 128-bit
    hash of the text, so that texts under null or repeated ids each stand for
    their own component; of equal texts under one id the row of the smallest
    hash stays.
    """
    text = F.col("_text").cast("string")
    told = {"_id": F.coalesce(F.concat(F.lit("="), F.col("_key").cast("string")), F.lit("")), "_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(1), text)}
    rows = wrapped(docs, _key=id_col, _text=text_col).withColumns(told)
    prints = fingerprint(rows.withColumn("_doc", F.struct("_key", *told)), "_doc", "_text")
    prints = cut(prints.select("fp", F.struct(F.col("doc_id._key").isNull().alias("none"), "doc_id._key", "fp", *[f"doc_id.{n}" for n in told]).alias("doc")))
    first = grouped(prints, max_bits, least=F.min("doc")).groupBy("root").agg(F.min("least").alias("least"))
    rows = rows.join(first.select(*[f"least.{n}" for n in told]), list(told), "left_semi")
    whole = [F.col("_row")[c] for c, kind in docs.dtypes if "map<" not in kind]
    once = Window.partitionBy(*told).orderBy(F.xxhash64(*whole))
    return rows.withColumn("_nth", F.row_number().over(once)).where("_nth = 1").select("_row.*")
