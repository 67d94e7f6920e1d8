"""Every operator and stage on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest

import corpus_pipeline
from evidex.llm import langid, lm, media, mixing, packing, quality, rules, sharding, simhash, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, size int, shard string, _key int, _row string, band int"
EXTRA = (True, 5, "x", 1, "r", 2)
ROWS = [
    (None, None, None, None, None, *EXTRA),
    (1, None, "en", None, None, *EXTRA),
    (2, "", "en", "a", 0, *EXTRA),
    (3, "   \n\t ", "en", "a", 6, *EXTRA),
    (4, "the cat sat on the mat and then it left again", "en", "a", 45, *EXTRA),
    (5, "the cat sat on the mat and then it left again", "en", "b", 45, *EXTRA),
    (5, "the cat sat on the mat and then it left again", "en", "b", 45, *EXTRA),
    (6, "der hund lief. " * 20_000, "de", "b", 300_000, *EXTRA),
    (7, "123 456 ### $$$", "de", "c", 15, *EXTRA),
    (8, "one", None, "c", 3, *EXTRA),
]
LABELS = [(4, 1, 0), (6, 1, 1), (7, 0, 0), (8, None, None), (None, 1, 1)]


@pytest.fixture(scope="module", params=["rows", "none"])
def tables(spark, request):
    rows, labels = (ROWS, LABELS) if request.param == "rows" else ([], [])
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), len(rows)


OPERATORS = {
    "toxicity": lambda d, lab: toxicity.toxicity(d, lab),
    "quality": lambda d, lab: quality.quality(d, lab),
    "language": lambda d, lab: langid.languages(d),
    "rules": lambda d, lab: rules.quality_rules(d, lab),
    "sharding": lambda d, lab: sharding.shard_by_bytes(d),
    "lm": lambda d, lab: lm.score_texts(d),
    "media": lambda d, lab: media.media_digests(d),
    "simhash": lambda d, lab: simhash.near_duplicates(d),
    "mixing": lambda d, lab: mixing.mix_sources(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_gives_each_row_once(tables, name):
    docs, labels, n = tables
    got = OPERATORS[name](docs, labels).collect()
    assert len(got) == n
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())


def test_packing_covers_each_row(tables):
    docs, _, n = tables
    got = packing.pack(docs, packing.word_vocabulary).collect()
    assert sum(r.start == 0 for r in got) == n
    assert sum(r.length for r in got if r.doc_id is None) == (1 if n else 0)


def test_results_of_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    lang = {r.doc_id: r for r in langid.languages(docs).collect()}
    assert all(lang[i].lang_pred == "und" and lang[i].score == 0 for i in (None, 1, 2, 3, 7))
    near = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert near[2].fingerprint == near[1].fingerprint == "0" * 16 and near[3].component_id == 1 and near[None].component_id == 1
    assert near[5].component_id == 4
    mixed = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    assert mixed[1].taken == 0 and mixed[1].target == 0 and mixed[6].size == 60_000
    assert sum(r.size for r in sharding.shard_by_bytes(docs, 3).collect()) == 16 * len(ROWS) + sum(len((r[1] or "").encode()) for r in ROWS)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_keeps_columns_and_values(tables, stage, tmp_path_factory):
    docs, labels, n = tables
    folder = str(tmp_path_factory.mktemp("sf"))
    labels.write.parquet(f"{folder}/labels.parquet")
    out = stage(docs.sparkSession, docs, folder)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) <= 3 * n and set(rows) <= set(docs.collect())


def test_certified_rules_need_enough_labels(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = rules.quality_rules(docs, none).collect()
    assert all(r.kept == (not r.base_failed) for r in got)


def test_null_and_repeated_ids_lose_no_text(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(None, a, 1), (None, b, 1), (None, b, 2), (None, c, 1), (1, c, 1), (2, d, 1), (2, e, 1), (2, e, 2), (1, e, 1)]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string, part int")).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("None", a), ("None", b), ("1", c), ("2", d), ("1", e)])


def test_mixing_takes_exactly_what_was_drawn_on_ties(spark):
    rows = [(None, "a b c " * 5, "s", i) for i in range(30)] + [(1, "x y z w", "s", 2), (2, "q r", "s", 1), (3, "lone word here", "t", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, k int")
    for weights in ((1, 2, 3), (3, 1), (1, 9)):
        want = {}
        for r in mixing.mix_sources(docs, weights=weights).collect():
            want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
        got = {}
        for r in mixing.mixed_rows(docs, weights=weights).collect():
            got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert got == {i: n for i, n in want.items() if n}


def test_recorded_length_may_be_any_text(spark):
    docs = spark.createDataFrame([(1, "some words", "12"), (2, "more words", "twelve"), (3, None, None)], "doc_id bigint, text string, n_chars string")
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    assert quality.quality(docs, labels).count() == 3
