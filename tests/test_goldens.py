"""Hand-computed results and invariants of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from evidex.functions import query as Q
from evidex.functions import risk as K
from evidex.functions import text as T
from evidex.operators import fusion, graph, metrics, models, retrieval
from evidex.sources import corpus

PATIENT = (
    "ga double, maternal_temperature double, rom_hours int, gbs boolean, iap boolean, chorio boolean, respiratory string, oxygen string, apgar int, poor_perfusion boolean, "
    "neonatal_temperature double, neuro string, wbc double, it_ratio double, platelets double, crp double, pct double, culture boolean"
)
WELL = dict(ga=39.0, maternal_temperature=37.0, rom_hours=6, gbs=False, iap=False, chorio=False, respiratory="None", oxygen="None", apgar=9, poor_perfusion=False, neonatal_temperature=37.0, neuro="Normal", wbc=None, it_ratio=None, platelets=None, crp=None, pct=None, culture=None)
CASES = [
    ({}, 0, "LOW"),
    (dict(maternal_temperature=38.2, rom_hours=20, gbs=True, respiratory="Mild"), 4, "INTERMEDIATE"),
    (dict(maternal_temperature=39.1, chorio=True, respiratory="Severe", oxygen="CPAP/Ventilation", apgar=3, poor_perfusion=True, crp=35.0, wbc=4000.0), 14, "CRITICAL"),
    (dict(culture=True), 10, "CRITICAL"),
]


@pytest.mark.parametrize("change,total,category", CASES)
def test_layer_score_totals(spark, change, total, category):
    names = [p.split()[0] for p in PATIENT.split(", ")]
    row = spark.createDataFrame([tuple({**WELL, **change}[n] for n in names)], PATIENT).withColumn("d", K.drivers())
    l1, l2, l3 = (K.layer_sum(F.col("d"), i) for i in (1, 2, 3))
    t = K.total_score(l1, l2, l3, F.col("culture"))
    got = row.select(t.alias("t"), K.category(t).alias("c"), K.probability(l2, l3).alias("p")).first()
    assert (got.t, got.c) == (total, category) and got.p > 0


def test_absent_measurements_score_nothing(spark):
    names = [p.split()[0] for p in PATIENT.split(", ")]
    row = spark.createDataFrame([tuple(WELL[n] for n in names)], PATIENT)
    assert row.select(K.drivers().alias("d")).first().d == []


def test_rrf_of_two_lists(spark):
    rows = [(1, "x", "a", 1), (1, "x", "b", 2), (1, "x", "c", 3), (1, "y", "b", 1), (1, "y", "d", 2), (1, "y", "a", 3)]
    got = {r.chunk_id: r for r in fusion.rrf(spark.createDataFrame(rows, "qid int, list string, chunk_id string, rank int")).collect()}
    assert got["b"].score == pytest.approx(1 / 62 + 1 / 61) and got["b"].rank == 1
    assert got["a"].score == pytest.approx(1 / 61 + 1 / 63) and len(got) == 4


def test_bleu_of_a_text_with_itself(spark):
    rows = [(1, "a b c d e", "a b c d e"), (2, "", "a"), (3, "a b", "c d"), (4, "a b c d", "a b c d e f")]
    got = {r.pair_id: r for r in metrics.bleu(spark.createDataFrame(rows, "pair_id int, candidate string, reference string")).collect()}
    assert got[1].bleu == got[1].bleu_no_smoothing == pytest.approx(1)
    assert got[2].bleu == 0 and got[3].bleu_no_smoothing == 0 and got[3].bleu_1 == pytest.approx(0.25)
    assert got[4].bleu == pytest.approx(math.exp(1 - 6 / 4))
    assert metrics.corpus_bleu(spark.createDataFrame(rows[:1], "pair_id int, candidate string, reference string")).first().corpus_bleu == pytest.approx(1)


def test_meteor_of_a_text_with_itself(spark):
    got = metrics.meteor_lite(spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "x", "y")], "pair_id int, candidate string, reference string")).collect()
    assert {r.pair_id: r.meteor for r in got} == {1: pytest.approx(1 - 0.5 / 64), 2: 0.0}


def test_holm_by_hand(spark):
    got = metrics.holm(spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03)], "f string, p double"), ["f"]).collect()
    assert {r.p: r.p_holm for r in got} == {0.01: pytest.approx(0.03), 0.03: pytest.approx(0.06), 0.04: pytest.approx(0.06)}


def test_paired_statistics(spark):
    rows = [(i, "a", float(i)) for i in range(6)] + [(i, "b", float(i) - d) for i, d in enumerate((1, 2, -0.5, 1, 3, 0))]
    r = metrics.paired(spark.createDataFrame(rows, "c int, arm string, v double"), "c", "arm", "v").first()
    assert r.n == 6 and r.mean_diff == pytest.approx(6.5 / 6) and r.w == 1.0
    same = metrics.paired(spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0)], "c int, arm string, v double"), "c", "arm", "v").first()
    assert same.t is None and same.r_rb is None


def test_prf_without_gold(spark):
    counts = spark.createDataFrame([(0, 0, 0), (3, 0, 0), (0, 2, 0), (4, 2, 1)], "n_ret int, n_gold int, n_both int")
    got = [(r.precision, r.recall) for r in metrics.prf(counts).collect()]
    assert got == [(1, 1), (0, 0), (0, 0), (0.25, 0.5)]


def test_mmr_by_score_alone_and_bound(spark):
    pool = spark.createDataFrame([(1, f"c{i}", 1.0 - i / 10, f"word{i} same text") for i in range(8)], "qid int, chunk_id string, score double, chunk_text string")
    got = sorted((r["rank"], r.chunk_id) for r in fusion.mmr(pool, 5, weight=1.0).collect())
    assert [c for _, c in got] == [f"c{i}" for i in range(5)]
    with pytest.raises(Exception, match="at most"):
        fusion.mmr(pool, 1).collect()


def test_coverage_swap(spark):
    chosen = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.2, 2)], "qid int, chunk_id string, score double, rank int")
    pool = spark.createDataFrame([(1, "a", 0.9, "x", False), (1, "b", 0.2, "y", False), (1, "c", 0.1, "z", True)], "qid int, chunk_id string, score double, section string, baseline boolean")
    assert {r.chunk_id for r in fusion.coverage_swap(chosen, pool).collect()} == {"a", "c"}


def test_groups_of_a_page_with_two_recommendations(spark):
    rows = [("r1", "S", 1, "s1", "R1", "recommendation"), ("r2", "S", 1, "s2", "R2", "recommendation"), ("x", "S", 1, "s1", "", "remarks"), ("y", "S", 1, "s9", "", "remarks"), ("t", "S", 1, "s1", "", "table"), ("n", "S", -1, "s1", "", "remarks")]
    df = spark.createDataFrame(rows, "chunk_id string, source string, page int, subsection string, recommendation_id string, chunk_type string")
    got = {r.chunk_id: r.group_key for r in fusion.retrieval_groups(df).collect()}
    assert got == {"r1": "S_pg1_R1", "r2": "S_pg1_R2", "x": "S_pg1_R1", "y": "y", "t": "t", "n": "n"}


def test_page_shift_is_recovered(spark):
    words = ["alpha%d bravo%d charlie%d delta%d" % ((i,) * 4) for i in range(20)]
    letters = [w.translate(str.maketrans("0123456789", "qwertyuiop")) for w in words]
    recs = spark.createDataFrame([(f"R{i}", "S", t, i + 7) for i, t in enumerate(letters)], "rec_id string, guideline_id string, text_summary string, page int")
    chunks = spark.createDataFrame([("S", i, t + " more words here") for i, t in enumerate(letters)], "source string, page int, chunk_text string")
    assert graph.calibrate(recs, chunks).first()["shift"] == 7


def test_broken_graph_is_repaired(spark):
    e = spark.createDataFrame([("G", "RECOMMENDS", "R1"), ("R1", "RECOMMENDS", "D1")], "from_id string, relationship string, to_id string")
    d = spark.createDataFrame([("D1",)], "id string")
    roots = spark.createDataFrame([("G", "R1"), ("G", "R2")], "from_id string, to_id string")
    assert sorted(tuple(r) for r in graph.repair_edges(e, d, roots).collect()) == [("G", "RECOMMENDS", "R1"), ("G", "RECOMMENDS", "R2"), ("R1", "PRESCRIBES", "D1")]
    s = spark.createDataFrame([("g", "s1", "b"), ("g", "s1", "a"), ("g", "s2", "c")], "guideline string, section_id string, section_type string")
    assert sorted((r.section_type, r.section_id) for r in graph.unique_section_ids(s).collect()) == [("a", "s1"), ("b", "s1_b"), ("c", "s2")]


def test_anchor_phrases_found_as_substrings(spark):
    chunks = spark.createDataFrame([("c1", "S", "xa b c dy z"), ("c2", "S", "a b d c")], "chunk_id string, source string, chunk_text string")
    phrases = spark.createDataFrame([(1, 0, "a b c d")], "qid int, nth int, phrase string")
    assert [r.chunk_id for r in metrics.phrase_hits(chunks, phrases).collect()] == ["c1"]


def test_dense_matches_cosine(spark, sf):
    from evidex.plans.retrieval_queries import vector_tables

    q, v = vector_tables(spark, sf)
    exact = {(r.qid, r.vec_id) for r in retrieval.dense_topk(q, v).collect()}
    plain = retrieval.top_k(q.withColumnRenamed("vec", "qv").crossJoin(v).select("qid", F.col("id").alias("vec_id"), retrieval.cosine(F.col("qv"), F.col("vec")).alias("score")), 10, tie="vec_id")
    assert exact == {(r.qid, r.vec_id) for r in plain.collect()}


def test_source_rules(spark):
    names = ["NICE_x.pdf", "puopolo_2018.pdf", "puopolo_2019.pdf", "WHO.pdf", "e1155.pdf", "2023065267.pdf", "BMJ.pdf", "vellamgot.pdf", "docs/local memo.v2.pdf", "memo", ".hidden"]
    df = spark.createDataFrame([(n,) for n in names], "f string").select(corpus.infer_source(F.col("f")).alias("m"))
    got = [r.m for r in df.collect()]
    assert [m.source for m in got] == ["NICE", "AAP", "EOSCAL", "WHO", "EOSCAL", "EOSCAL", "EOSCAL", "EOSCAL", "LOCAL", "LOCAL", "LOCAL"]
    assert [m.version for m in got[5:8]] == ["2024", "2023", "2023"]
    assert [(m.source_name, m.version, m.region_tag) for m in got[8:]] == [("local memo.v2", "1.0", "LOCAL"), ("memo", "1.0", "LOCAL"), (".hidden", "1.0", "LOCAL")]


def test_filter_without_match_keeps_all(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "n string, m string")
    assert corpus.filter_sources(df, ["zzz"], "n", "m").count() == 2
    assert corpus.filter_sources(df, ["X"], "n", "m").count() == 1


def test_query_functions(spark):
    df = spark.createDataFrame([("GBS and rom",), ("hello",), ("",)], "t string")
    got = df.select(Q.expand(F.col("t")).alias("e"), Q.intent(F.col("t")).alias("i")).collect()
    assert got[0].e.startswith("GBS and rom group b strep") and got[0].i == "risk_assessment"
    assert got[1].e == "hello" and got[1].i == "other" and got[2].e == ""


def test_text_functions(spark):
    df = spark.createDataFrame([("WHO_pg12_x_c1", " a, b ,,a", "```json\n{}\n```")], "c string, j string, f string")
    r = df.select(T.page_key(F.col("c")).alias("k"), T.page_number(F.col("c")).alias("p"), T.joined_ids(F.col("j")).alias("j"), T.without_fences(F.col("f")).alias("f")).first()
    assert (r.k, r.p, r.j, r.f) == ("WHO_pg12", 12, ["a", "b"], "{}")


def test_sentence_chunks_overlap(spark):
    text = " ".join(f"w{i} two three four." for i in range(40))
    got = corpus.sentence_chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"), "doc_id", "text", size=20, overlap=4).orderBy("chunk_index").collect()
    assert all(len(r.chunk_text.split()) <= 20 for r in got) and got[1].chunk_text.startswith(got[0].chunk_text.split(". ")[-1])


def test_threshold_and_auc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, score double").withColumn("g", F.lit(1))
    assert models.auc_brier(df, ["g"]).first().auc == pytest.approx(0.75)
    t = models.best_threshold(models.rates(models.threshold_counts(df, [0.2, 0.3, 0.5]))).first()
    assert (t.threshold, t.reached) == (0.3, True)
