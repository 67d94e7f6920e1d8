"""Page windows take words of chunks near a recommendation alone; recommendations at rest equal those made from texts."""

from evidex.operators.graph import page_window
from evidex.sources import views as V


def test_chunks_far_from_any_recommendation_are_left_out_first(spark):
    recs = spark.createDataFrame([(1, "R1", "EN", 20, "alpha beta", "beta gamma")], "qid bigint, rec_id string, guideline_id string, page bigint, text_summary string, text string")
    rows = [(f"c{p}", "EN", p, "alpha beta gamma") for p in range(0, 400, 5)] + [("x", "FR", 20, "alpha"), ("n", None, 20, "alpha"), ("m", "EN", None, "alpha")]
    got = page_window(recs, spark.createDataFrame(rows, "chunk_id string, source string, page bigint, chunk_text string"))
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.chunk_id, r.score, r["rank"]) for r in got.orderBy("rank").collect()] == [("c15", 8, 1), ("c20", 8, 2), ("c25", 8, 3)]


def test_recommendations_at_rest(spark):
    sf = "/root/testdata/sf0.001"
    one, two = V.stored_recommendations(spark, sf), V.recommendations(spark, sf)
    assert one.schema == two.schema and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
