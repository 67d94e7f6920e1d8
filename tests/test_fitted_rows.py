"""Fits read rows at rest, so that texts are tokenised once."""

import __spark_entry__ as entry
from evidex.operators import models as M


def test_selections_do_not_read_texts_again(spark, sf, monkeypatch):
    given = []
    monkeypatch.setattr(M, "boruta_select", lambda rows, features: given.append(rows) or dict.fromkeys(features, 0))
    assert entry.queries()["boruta_select"](spark, sf).count() == 5
    assert "documents.parquet" not in " ".join(given[0].inputFiles()) and given[0].count() > 0
