"""Queries: sources, sinks and text preparation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.plans.registry import query, sql_list
from evidex.sources import corpus
from evidex.sources import views as V
from evidex.sources.store import EvidenceStore
from evidex.sources.tables import checkpoint_folder, table


@query("chunk_scan", "SELECT chunk_id, source, coalesce(nullif(trim(subsection), ''), nullif(trim(chunk_type), ''), '') AS section, coalesce(CASE WHEN chunk_index = 0 THEN page END, -1) AS page FROM v_chunks")
def chunk_scan(spark, sf):
    c = V.chunks(spark, sf).withColumn("section", F.lit("")).withColumn("page_text", F.when(F.col("chunk_index") == 0, F.col("page").cast("string")).otherwise(""))
    return c.select("chunk_id", "source", corpus.first_section().alias("section"), corpus.page_or_none("page_text").alias("page"))


@query("case_scan", "SELECT doc_id AS case_id, lang AS guideline, source AS unit FROM documents")
def case_scan(spark, sf):
    raw = table(spark, sf, "documents").select(F.to_json(F.struct(F.col("doc_id").alias("case_id"), F.col("lang").alias("guideline"), F.col("source").alias("unit"), F.lit(1).alias("unknown"))).alias("j"))
    return raw.select(F.from_json("j", "case_id bigint, guideline string, unit string").alias("c")).select("c.*")


@query("graph_scan", "SELECT relationship, count(*) AS n, count(DISTINCT from_id) AS n_from, count(DISTINCT to_id) AS n_to FROM v_edges GROUP BY relationship")
def graph_scan(spark, sf):
    return V.edges(spark, sf).groupBy("relationship").agg(F.count("*").alias("n"), F.countDistinct("from_id").alias("n_from"), F.countDistinct("to_id").alias("n_to"))


@query("source_filter", "WITH f AS (SELECT doc_id, source, contains(upper(source), 'SRC1') OR contains(upper(lang), 'ES') AS hit FROM documents) SELECT doc_id, source FROM f WHERE hit OR NOT (SELECT bool_or(hit) FROM f)")
def source_filter(spark, sf):
    return corpus.filter_sources(table(spark, sf, "documents").select("doc_id", "source", "lang"), ["src1", "es"], "source", "lang").select("doc_id", "source")


@query("vector_parse", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 0.0::DOUBLE ELSE round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) END AS total, 64 AS width FROM embeddings")
def vector_parse(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("s", F.when(F.col("vec_id") % 10 != 0, F.to_json(F.col("embedding").cast("array<double>"))))
    v = e.select("vec_id", corpus.parse_vector(F.col("s"), 64).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size("v").alias("width"))


def new_store(spark):
    """A store in a folder that no other call uses."""
    return EvidenceStore(spark, f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}")


@query("ingest_documents")
def ingest_documents(spark, sf):
    """Documents ingested in two batches, the second half of them twice, and read again from the store."""
    store, docs = new_store(spark), table(spark, sf, "documents").select("doc_id", "text", "source")
    store.ingest(docs, batches=2)
    store.ingest(docs.where("doc_id % 2 = 1"))
    return store.chunks().select("document_id", "chunk_index", "section", "content_id", "source")


@query("results_export", "SELECT qid, array_to_string(list(phrase ORDER BY nth), ', ') AS phrases FROM v_phrases GROUP BY qid")
def results_export(spark, sf):
    p = V.phrases(spark, sf).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "phrase"))), lambda x: x["phrase"]).alias("phrases"))
    return corpus.flat_export(p)


@query("joined_ids_parse", "SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> ''))) AS ids FROM (SELECT doc_id, lang || ', ' || source || ',, ' || lang AS s FROM documents)")
def joined_ids_parse(spark, sf):
    d = table(spark, sf, "documents").withColumn("s", F.concat("lang", F.lit(", "), "source", F.lit(",, "), "lang"))
    return d.select("doc_id", T.joined_ids(F.col("s")).alias("ids"))


@query(
    "resume_grid",
    """WITH v_c AS (SELECT DISTINCT source, lang FROM documents), v_n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang)
      SELECT b.source AS backbone, a.lang AS arm, CASE WHEN n IS NULL THEN 'open' WHEN n % 3 = 0 THEN 'failed' WHEN n % 3 = 1 THEN 'done' ELSE 'open' END AS status
      FROM (SELECT DISTINCT source FROM v_c) b CROSS JOIN (SELECT DISTINCT lang FROM v_c) a LEFT JOIN v_n n ON n.source IS NOT DISTINCT FROM b.source AND n.lang IS NOT DISTINCT FROM a.lang""",
)
def resume_grid(spark, sf):
    """A grid of sources and languages after two runs: cells whose number of documents leaves 1 of 3 were done, in the first run or after failing in it; those that leave 0 failed."""
    d, store = table(spark, sf, "documents"), new_store(spark)
    n = d.groupBy(F.col("source").alias("backbone"), F.col("lang").alias("arm")).agg(F.count("*").alias("n"))
    store.finish(n.where("n % 3 < 2").withColumn("status", F.when(F.col("n") % 2 == 0, "failed").when(F.col("n") % 3 == 1, "done").otherwise("failed")), "first")
    store.finish(n.where("n % 3 = 1 and n % 2 = 0").withColumn("status", F.lit("done")), "second")
    grid = d.select(F.col("source").alias("backbone")).distinct().crossJoin(F.broadcast(d.select(F.col("lang").alias("arm")).distinct()))
    return store.cells(grid).select("backbone", "arm", "status")


@query("union_corpus", "SELECT chunk_id, CASE WHEN chunk_index = 0 THEN 'gold' ELSE 'distractor' END AS role FROM v_chunks")
def union_corpus(spark, sf):
    c = V.chunks(spark, sf)
    gold = c.where("chunk_index = 0").select("chunk_id", F.lit("gold").alias("role"))
    rest = c.select("chunk_id", F.lit("distractor").alias("role"))
    return corpus.first_per_id(gold, rest, "chunk_id")


_NAMES = ("NICE_ng195", "puopolo_2018", "puopolo_2019", "who_psbi", "kuzniewicz", "e1155", "aap_preterm", "notes", "qatar", "2023065267")
_FILE = f"({sql_list(_NAMES)}[doc_id % {len(_NAMES)} + 1] || '_' || doc_id || '.pdf')"


def _rule_sql(place: int, default: str) -> str:
    cases = (f"WHEN {' AND '.join(f'contains(l, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{values[place]}'" for words, *values in corpus.SOURCE_RULES)
    return f"CASE {' '.join(cases)} ELSE {default} END"


@query(
    "infer_source",
    f"""SELECT doc_id, {_rule_sql(0, "'LOCAL'")} AS source, {_rule_sql(1, "replace(f, '.pdf', '')")} AS source_name, {_rule_sql(2, "'1.0'")} AS version, {_rule_sql(3, "'LOCAL'")} AS region_tag
      FROM (SELECT doc_id, {_FILE} AS f, lower({_FILE}) AS l FROM documents)""",
)
def infer_source(spark, sf):
    names = F.array(*[F.lit(x) for x in _NAMES])
    f = F.concat(F.element_at(names, (F.col("doc_id") % len(_NAMES) + 1).cast("int")), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return table(spark, sf, "documents").select("doc_id", corpus.infer_source(f).alias("m")).select("doc_id", "m.*")


@query("index_health", "SELECT CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'empty' END AS status, count(*) AS total_chunks, max(ts) AS last_ingestion, CASE WHEN count(*) >= 100 THEN 'ivfflat' ELSE 'pending' END AS vector_index FROM events")
def index_health(spark, sf):
    return corpus.index_health(table(spark, sf, "events"), "ts")


@query("row_overlap_check", "SELECT count(*) AS shared FROM (SELECT text, lang FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text, lang FROM documents WHERE doc_id % 2 = 1)")
def row_overlap_check(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return corpus.shared_rows(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "doc_id")


@query("chunk_documents")
def chunk_documents(spark, sf):
    return corpus.sentence_chunks(table(spark, sf, "documents"), "doc_id", "text")


@query("chunk_fixed", "SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, array_to_string(t[i * 112 + 1 : i * 112 + 128], ' ') AS chunk_text FROM (SELECT *, unnest(range(greatest(1, CAST(ceil((len(t) - 16) / 112.0) AS BIGINT)))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents) WHERE len(t) > 0)")
def chunk_fixed(spark, sf):
    return corpus.fixed_chunks(table(spark, sf, "documents"), "doc_id", "text")


@query("section_title", "SELECT doc_id, CASE WHEN length(l) > 10 THEN l ELSE 'Section ' || (doc_id + 1) END AS title FROM (SELECT doc_id, string_split(trim(text), chr(10))[1][1:120] AS l FROM documents)")
def section_title(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.section_title(F.col("text"), F.col("doc_id")).alias("title"))


@query("content_id", "SELECT doc_id, md5(text[1:200])[1:12] AS content_id FROM documents")
def content_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_id(F.col("text")).alias("content_id"))


@query("tokenize", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{4,}'))) AS n4, len(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) AS n5 FROM documents")
def tokenize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.tokens("text")).alias("n_tokens"), F.size(T.words_at_least("text", 4)).alias("n4"), F.size(T.words_at_least("text", 5, True)).alias("n5"))


@query("normalize_ws", "SELECT doc_id, md5(lower(trim(regexp_replace(replace(text, chr(160), ' '), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) AS digest FROM documents")
def normalize_ws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.one_space("text").cast("binary")).alias("digest"))


@query("page_key", "SELECT chunk_id, CASE WHEN regexp_extract(chunk_id, '^(.*?_pg[0-9]+)_', 1) <> '' THEN regexp_extract(chunk_id, '^(.*?_pg[0-9]+)_', 1) ELSE chunk_id END AS page_key, CAST(nullif(regexp_extract(chunk_id, '_pg([0-9]+)', 1), '') AS BIGINT) AS page FROM v_chunks")
def page_key(spark, sf):
    return V.chunks(spark, sf).select("chunk_id", T.page_key(F.col("chunk_id")).alias("page_key"), T.page_number(F.col("chunk_id")).alias("page"))


_RAW = "CASE doc_id % 3 WHEN 0 THEN '```json' || chr(10) || '{\"id\": ' || doc_id || ', \"lang\": \"' || lang || '\"}' || chr(10) || '```' WHEN 1 THEN '{\"id\": ' || doc_id || '}' ELSE 'no json ' || doc_id END"


@query("llm_json_parse", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN doc_id END AS id, CASE WHEN doc_id % 3 = 0 THEN lang END AS lang, doc_id % 3 < 2 AS parsed FROM documents")
def llm_json_parse(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr(_RAW.replace("chr(10)", "'\\n'")).alias("raw"))
    d = d.withColumn("body", T.without_fences(F.col("raw")))
    d = d.withColumn("ok", F.col("body").startswith("{") & F.from_json("body", "map<string,string>").isNotNull())
    got = F.from_json("body", "id bigint, lang string")
    return d.select("doc_id", F.when(F.col("ok"), got["id"]).alias("id"), F.when(F.col("ok"), got["lang"]).alias("lang"), F.col("ok").alias("parsed"))


@query("registry_search", "SELECT doc_id FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(text), 'thnt')")
def registry_search(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(F.lower("source").contains("src1") | F.lower("text").contains("thnt")).select("doc_id")


@query(
    "prompt_build",
    """SELECT qid, md5('QUESTION: ' || text || chr(10) || 'EVIDENCE:' || chr(10) || coalesce(evidence, '')) AS prompt FROM v_queries LEFT JOIN (
      SELECT qid, array_to_string(list('[' || chunk_id || '] ' || source || ' — ' || chunk_type || ':' || chr(10) || chunk_text ORDER BY hits DESC, chunk_id), chr(10) || chr(10)) AS evidence
      FROM v_gold JOIN v_chunks USING (chunk_id) GROUP BY qid) USING (qid)""",
)
def prompt_build(spark, sf):
    from evidex.operators.metrics import evidence_block
    from evidex.plans.metric_queries import gold

    g = gold(spark, sf).join(V.chunks(spark, sf), "chunk_id").withColumn("rank", -F.col("hits"))
    block = evidence_block(g)
    q = V.queries(spark, sf).join(block, "qid", "left")
    return q.select("qid", F.md5(F.concat(F.lit("QUESTION: "), "text", F.lit("\nEVIDENCE:\n"), F.coalesce("evidence", F.lit(""))).cast("binary")).alias("prompt"))
