"""The evidence store: commits, snapshots, failures half way, repeats, and grids."""

import pytest

from evidex.sources.store import EvidenceStore

SENTENCES = "The first sentence is long enough to stay. The second sentence is long enough too."


@pytest.fixture
def store(spark, tmp_path):
    return EvidenceStore(spark, str(tmp_path / "store"))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def shown(store, version=None):
    return sorted((r.document_id or "", r.chunk_text, r.source or "") for r in store.chunks(version).collect())


def test_two_ingests_leave_the_earlier_result_readable(spark, store):
    one = store.ingest(docs(spark, [(1, SENTENCES, "a")]))
    before = store.chunks()
    two = store.ingest(docs(spark, [(2, "Quite another text of the second document, a longer one.", "b")]))
    assert (one, two) == (1, 2)
    assert before.count() == 1 and shown(store, one) == [("1", SENTENCES, "a")]
    assert [d for d, *_ in shown(store)] == ["1", "2"]
    store.clear()
    assert shown(store) == [] and len(shown(store, two)) == 2 and before.count() == 1


def test_repeats_change_nothing_and_the_registry_takes_the_latest(spark, store):
    rows = [(1, SENTENCES, "a"), (2, SENTENCES, "b"), (3, None, "c"), (None, "A text without an id that is long enough.", None), (1, "Text of a repeated id that is long enough to stay.", "a")]
    store.ingest(docs(spark, rows), batches=3)
    first = shown(store)
    assert first == [("", "A text without an id that is long enough.", ""), ("1", "Text of a repeated id that is long enough to stay.", "a"), first[2]]
    assert first[2][1] == SENTENCES and len(first) == 3
    written = store.read("chunks").count()
    store.ingest(docs(spark, [*rows[1:], (1, SENTENCES, "renamed")]), batches=2)
    assert shown(store) == first and store.read("chunks").count() == written
    registry = {r.document_id: r.name for r in store.registry().collect()}
    assert registry == {"1": "a", "2": "b", "3": "c", None: None} | ({"1": registry["1"]} if registry["1"] in ("a", "renamed") else {})


def test_a_crash_between_batches_leaves_whole_commits(spark, store, monkeypatch):
    rows = docs(spark, [(i, f"Document number {i} has a sentence that is long enough.", "s") for i in range(40)])
    commit, done = EvidenceStore.commit, []

    def fails(self, staged, run=""):
        if len(done) == 2:
            raise OSError("lost")
        done.append(1)
        return commit(self, staged, run)

    monkeypatch.setattr(EvidenceStore, "commit", fails)
    with pytest.raises(OSError):
        store.ingest(rows, batches=4)
    monkeypatch.setattr(EvidenceStore, "commit", commit)
    half = shown(store)
    assert 0 < len(half) < 40 and store.version() == 2
    assert {d for d, *_ in half} == {r.document_id for r in store.registry().collect()}
    store.ingest(rows, batches=4)
    assert len(shown(store)) == 40 and shown(store, 2) == half and store.read("chunks").count() == 40


def test_empty_store_and_empty_documents(spark, store):
    assert store.version() == 0 and shown(store) == [] and store.registry().count() == 0
    store.ingest(docs(spark, []))
    assert store.version() == 1 and shown(store) == []


def test_cells_take_their_latest_status(spark, store):
    cell = lambda *rows: spark.createDataFrame(rows, "backbone string, arm string, status string")
    grid = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), (None, "p")], "backbone string, arm string")
    store.finish(cell(("x", "p", "failed"), ("x", "q", "failed"), (None, "p", "done")))
    store.finish(cell(("x", "p", "done")))
    got = {(r.backbone, r.arm): r.status for r in store.cells(grid).collect()}
    assert got == {("x", "p"): "done", ("x", "q"): "failed", ("y", "p"): "open", (None, "p"): "done"}
