"""Queries: whole retrieval plans and the arms of the ablation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from evidex.operators import stack as S
from evidex.plans import graph_queries as GQ
from evidex.plans import retrieval_queries as RQ
from evidex.plans.registry import query
from evidex.sources import views as V


def stack(spark, sf):
    return S.Stack(V.index(spark, sf), RQ.BASELINE)


#: Vectors of hashed words, and the dense list of each query; zero norms count as 1e-10, as in `cosines`.
DENSE = """v_tok AS (SELECT 'c' AS kind, chunk_id AS id, unnest(regexp_extract_all(lower(chunk_text), '[a-z0-9]+')) AS term FROM v_chunks UNION ALL SELECT 'q', qid::VARCHAR, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) FROM v_queries),
  v_vec AS (SELECT kind, id, ('0x' || md5(term)[1:4])::INT % 64 AS dim, sum(1 - 2 * (('0x' || md5(term)[5:5])::INT % 2))::DOUBLE AS v FROM v_tok GROUP BY kind, id, dim),
  v_len AS (SELECT kind, id, sqrt(sum(v * v)) AS len FROM v_vec GROUP BY kind, id),
  v_dot AS (SELECT q.id AS qid, c.id AS chunk_id, sum(q.v * c.v) AS dot FROM v_vec q JOIN v_vec c ON q.kind = 'q' AND c.kind = 'c' AND q.dim = c.dim GROUP BY q.id, c.id),
  v_den AS (SELECT qid::BIGINT AS qid, chunk_id, dot / greatest(1e-10, q.len * c.len) AS score FROM v_dot JOIN v_len q ON q.kind = 'q' AND q.id = qid JOIN v_len c ON c.kind = 'c' AND c.id = chunk_id)"""
FUSED = f"""{RQ.BM25}, {DENSE}, v_l1 AS ({RQ.ranked_sql('SELECT * FROM v_bm', 10)}), v_l2 AS ({RQ.ranked_sql('SELECT * FROM v_den', 10)}),
  v_lists AS (SELECT qid, chunk_id, rank FROM v_l1 UNION ALL SELECT qid, chunk_id, rank FROM v_l2),
  v_rrf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM v_lists GROUP BY qid, chunk_id)),
  v_rel AS (SELECT r.qid, r.chunk_id, coalesce(sum(i.idf) FILTER (WHERE p.chunk_id IS NOT NULL), 0) / sum(i.idf) AS score
    FROM v_rrf r JOIN v_qt t USING (qid) JOIN v_idf i USING (term) LEFT JOIN v_post p ON p.chunk_id = r.chunk_id AND p.term = t.term WHERE r.rank <= 10 GROUP BY r.qid, r.chunk_id)"""


@query("retrieve_basic", f"WITH {FUSED} {RQ.ranked_sql('SELECT * FROM v_rel', 5, cols='qid, chunk_id, rank, round(score, 4) AS score')}")
def retrieve_basic(spark, sf):
    found = stack(spark, sf).basic(V.queries(spark, sf))
    return found.select("qid", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query("retrieve_full")
def retrieve_full(spark, sf):
    return stack(spark, sf).retrieve(V.queries(spark, sf)).select("qid", "chunk_id", "score", "group_rank")


@query("hybrid_arm")
def hybrid_arm(spark, sf):
    return stack(spark, sf).hybrid(V.queries(spark, sf), GQ.graph_select(spark, sf)).select("qid", "chunk_id", "rank")


@query("ablation_arms")
def ablation_arms(spark, sf):
    """Sparse, dense, vector, graph and hybrid: five chunks a query at most from each."""
    st, q, graph = stack(spark, sf), V.queries(spark, sf), GQ.graph_select(spark, sf)
    found = {"sparse_only": st.retrieve(q, S.SPARSE_ONLY), "dense_only": st.retrieve(q, S.DENSE_ONLY), "vector": st.retrieve(q, replace(S.VECTOR, k=5)), "graph": graph.where("rank <= 5"), "hybrid": st.hybrid(q, graph)}
    out = None
    for name, rows in found.items():
        part = rows.select(F.lit(name).alias("arm"), "qid", "chunk_id", "rank")
        out = part if out is None else out.unionByName(part)
    return out
