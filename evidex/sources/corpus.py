"""Sources, sinks and upkeep of evidence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidex.functions.text import content_id, section_title, tokens

#: First match wins: (all of, any of, source, name, version, region). Fixed values.
SOURCE_RULES = (
    (("nice",), "NICE", "NICE NG195", "2023", "UK"),
    (("ng195",), "NICE", "NICE NG195", "2023", "UK"),
    (("aap",), "AAP", "AAP EOS Guidelines 2023", "2023", "USA"),
    (("puopolo", "2018"), "AAP", "AAP EOS Guidelines 2023", "2023", "USA"),
    (("who",), "WHO", "WHO Newborn Sepsis Guidelines", "2024", "GLOBAL"),
    (("kuzniewicz",), "EOSCAL", "Kuzniewicz et al. 2024 EOSCAL Recalibration", "2024", "GLOBAL"),
    (("2024",), "EOSCAL", "Kuzniewicz et al. 2024 EOSCAL Recalibration", "2024", "GLOBAL"),
    (("2023065267",), "EOSCAL", "Kuzniewicz et al. 2024 EOSCAL Recalibration", "2024", "GLOBAL"),
    (("2011",), "EOSCAL", "Puopolo et al. 2011 Original EOSCAL", "2011", "GLOBAL"),
    (("e1155",), "EOSCAL", "Puopolo et al. 2011 Original EOSCAL", "2011", "GLOBAL"),
    (("2019",), "EOSCAL", "Puopolo et al. 2019 EOSCAL Update", "2019", "GLOBAL"),
    (("qatar",), "EOSCAL", "Paraparambil Vellamgot et al. 2023 Qatar Validation", "2023", "GLOBAL"),
    (("bmj",), "EOSCAL", "Paraparambil Vellamgot et al. 2023 Qatar Validation", "2023", "GLOBAL"),
    (("vellamgot",), "EOSCAL", "Paraparambil Vellamgot et al. 2023 Qatar Validation", "2023", "GLOBAL"),
)


def read_chunks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a CSV file: section is the first non-empty of subsection, section and chunk_type; no page is -1."""
    schema = "chunk_id string, source string, page string, section string, subsection string, recommendation_id string, chunk_type string, chars string, chunk_text string"
    raw = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')
    return raw.select("chunk_id", "source", first_section().alias("section"), page_or_none("page").alias("page"), "subsection", "recommendation_id", "chunk_type", "chunk_text")


def first_section() -> Column:
    """First non-empty of subsection, section and chunk_type."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("subsection", "section", "chunk_type")], F.lit(""))


def page_or_none(col: str) -> Column:
    """A page number, or -1 where there is none."""
    return F.coalesce(F.expr(f"cast(try_cast(`{col}` as double) as bigint)"), F.lit(-1))


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evaluation cases of a JSON array; fields outside the schema are dropped."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_graph(spark: SparkSession, folder: str, guidelines: list[str]) -> dict[str, DataFrame]:
    """Recommendations, doses and relationships of several guidelines, each row with its guideline."""
    out: dict[str, DataFrame] = {}
    for kind in ("nodes_recommendations", "nodes_doses", "relationships"):
        parts = [spark.read.csv(f"{folder}/{g}_{kind}.csv", header=True, multiLine=True, escape='"').withColumn("guideline", F.lit(g)) for g in guidelines]
        for p in parts:
            out[kind] = out[kind].unionByName(p, allowMissingColumns=True) if kind in out else p
    return out


def filter_sources(rows: DataFrame, filters: list[str], name_col: str, meta_col: str) -> DataFrame:
    """Rows whose name or metadata source contains a filter (any case), all for `ALL`; all rows where none match."""
    wanted = [f.upper() for f in filters]
    hit = F.lit("ALL" in wanted)
    for f in wanted:
        hit = hit | F.upper(F.coalesce(name_col, F.lit(""))).contains(f) | F.upper(F.coalesce(meta_col, F.lit(""))).contains(f)
    flagged = rows.withColumn("_hit", hit)
    any_hit = flagged.agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("_any"))
    return flagged.join(F.broadcast(any_hit)).where(F.col("_hit") | ~F.col("_any")).drop("_hit", "_any")


def parse_vector(col: Column, width: int) -> Column:
    """`[0.1,...]` as an array of floats; null is zeros."""
    return F.coalesce(F.from_json(col, "array<double>"), F.array_repeat(F.lit(0.0), width))


def infer_source(filename: Column) -> Column:
    """Source, name, version and region by the first rule whose words the file name contains.

    Without a rule the file is a local document, named as the file without
    folder and last suffix. Null is null's name.
    """
    low = F.lower(filename)
    out = None
    for words, *values in SOURCE_RULES:
        test = F.lit(True)
        for w in words:
            test = test & low.contains(w)
        row = F.struct(*[F.lit(v).alias(n) for v, n in zip(values, ("source", "source_name", "version", "region_tag"))])
        out = F.when(test, row) if out is None else out.when(test, row)
    base = F.regexp_extract(filename, "([^/]*)/*$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")
    other = F.struct(F.lit("LOCAL").alias("source"), stem.alias("source_name"), F.lit("1.0").alias("version"), F.lit("LOCAL").alias("region_tag"))
    return out.otherwise(other)


def sentence_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 50, least: int = 20) -> DataFrame:
    """Chunks of whole sentences: up to `size` tokens, the last sentences within `overlap` tokens repeated.

    Works document by document in Arrow batches; a sentence longer than `size`
    is a chunk by itself; chunks shorter than `least` characters are dropped
    before they are numbered. Null texts have none.
    """
    import re

    import pandas as pd

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def pack(text: str) -> list[str]:
        parts = [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
        out, held, sizes = [], [], []
        for s in parts:
            k = len(s.split())
            if held and sum(sizes) + k > size:
                out.append(" ".join(held))
                keep, m = len(held), 0
                while keep and m + sizes[keep - 1] <= overlap:
                    keep -= 1
                    m += sizes[keep]
                held, sizes = held[keep:], sizes[keep:]
            held.append(s)
            sizes.append(k)
        return out + ([" ".join(held)] if held else [])

    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                kept = [c for c in pack(text) if len(c.strip()) >= least] if text else []
                rows += [(doc_id, i, c) for i, c in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "chunk_text"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    out = slim.mapInPandas(run, f"doc_id {kind}, chunk_index bigint, chunk_text string")
    return out.withColumn("section", section_title(F.col("chunk_text"), F.col("chunk_index"))).withColumn("content_id", content_id(F.col("chunk_text")))


def fixed_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 128, overlap: int = 16) -> DataFrame:
    """Windows of `size` tokens that share `overlap` with the next."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.size("toks") - overlap) / F.lit(float(step)))).cast("int")
    return (
        docs.select(F.col(id_col).alias("doc_id"), tokens(text_col).alias("toks"))
        .where(F.size("toks") > 0)
        .withColumn("chunk_index", F.explode(F.sequence(F.lit(0), n - 1)))
        .select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.array_join(F.slice("toks", F.col("chunk_index") * step + 1, size), " ").alias("chunk_text"))
    )


def flat_export(rows: DataFrame) -> DataFrame:
    """Arrays of strings as joined text, for CSV."""
    return rows.select(*[F.array_join(f.name, ", ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in rows.schema.fields])


def first_per_id(gold: DataFrame, distractors: DataFrame, id_col: str) -> DataFrame:
    """Union in which gold rows come before distractors; one row per id."""
    both = gold.withColumn("_rank", F.lit(0)).unionByName(distractors.withColumn("_rank", F.lit(1)))
    w = Window.partitionBy(id_col).orderBy("_rank")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def index_health(chunks: DataFrame, stamp_col: str) -> DataFrame:
    """Row count, latest ingest, and what they say of the index."""
    return chunks.agg(F.count("*").alias("total_chunks"), F.max(stamp_col).alias("last_ingestion")).select(
        F.when(F.col("total_chunks") > 0, "healthy").otherwise("empty").alias("status"),
        "total_chunks",
        "last_ingestion",
        F.when(F.col("total_chunks") >= 100, "ivfflat").otherwise("pending").alias("vector_index"),
    )


def shared_rows(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """Number of distinct rows that two tables share in content, the id apart."""
    return left.drop(id_col).intersect(right.drop(id_col)).agg(F.count("*").alias("shared"))
