"""The pipeline's rows against its stages worked out one by one in plain Python."""

import corpus_pipeline
from evidex.llm import langid, rules
from evidex.llm._shared import table
from tests.llm.test_whole_tables import print_of, roots


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality_rules"](spark, docs, sf).cache()
    verdicts = {r.doc_id: r.kept for r in rules.quality_rules(docs, table(spark, sf, "labels")).collect()}
    assert {r.doc_id for r in one.collect()} == {i for i, k in verdicts.items() if k}
    good = {r.doc_id for r in table(spark, sf, "labels").where("quality = 1").collect()}
    base_ok = {r.doc_id for r in rules.quality_rules(docs, table(spark, sf, "labels")).where("not base_failed").collect()}
    assert len(good & base_ok & {r.doc_id for r in one.collect()}) >= 0.97 * len(good & base_ok)
    two = stages["language"](spark, one, sf).cache()
    sure = {r.doc_id for r in langid.languages(one).where("lang_pred <> 'und' and score >= 0.5").collect()}
    assert {r.doc_id for r in two.collect()} == sure
    three = stages["near_duplicates"](spark, two, sf).cache()
    fps = {r.doc_id: print_of(r.text) for r in two.collect()}
    root, least = roots(fps.values()), {}
    for i in sorted(fps):
        least.setdefault(root[fps[i]], i)
    assert sorted(r.doc_id for r in three.collect()) == sorted(least.values())
    four = stages["mix"](spark, three, sf).cache()
    from evidex.llm.mixing import mix_sources

    copies = {r.doc_id: r.copies for r in mix_sources(three).collect()}
    seen = {}
    for r in four.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {i: c for i, c in copies.items() if c}
    five = stages["pack"](spark, four, sf).collect()
    assert sum(r.start == 0 for r in five) == sum(seen.values())
