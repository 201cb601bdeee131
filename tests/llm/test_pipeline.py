import corpus_pipeline
from hydrolens.llm import piece_codec
from hydrolens.llm.queries import PIECES
from hydrolens.llm.tables import table, written
from tests.helpers import rows
from tests.llm.samples import CLASHING, nothing, odd
from tests.llm.test_decision_list import counts
from tests.llm.test_decontaminate import holds
from tests.llm.test_simhash_ball import connected, fingerprint


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages(spark, sf_dir):
    """Each stage over what the one before kept, against plain versions."""
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    before = {d.doc_id: d.text for d in docs.collect()}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(name)(spark, docs, sf_dir), "test-stage")
        assert docs.columns == columns
        after = {d.doc_id: d.text for d in docs.collect()}
        assert after.items() <= before.items() and len(after) == docs.count()
        if name == "language":
            assert len(after) >= 0.99 * len(before)
        elif name == "quality":
            own = {i: counts(text) for i, text in before.items()}
            failed = {i for i, c in own.items() if c[0] < 50 or 100 * c[4] > 50 * c[0]}
            assert not failed & after.keys()
        elif name == "near_duplicates":
            ids = sorted(before)
            roots = connected([fingerprint(before[i]) for i in ids])
            assert set(after) == {ids[root] for root in roots}
        else:
            tests = table(spark, sf_dir, "benchmark").collect()
            assert set(after) == {i for i, text in before.items() if not any(holds(text, t.text) for t in tests)}
        before = after
    encoded = stage("pieces")(spark, docs, sf_dir)
    assert rows(encoded.select("doc_id", "ids")) == rows(piece_codec.encode(docs, PIECES))


def test_odd_rows(spark, sf_dir):
    docs = odd(spark, sf_dir)
    for name, run in corpus_pipeline.STAGES:
        found = run(spark, docs, sf_dir)
        if name != "pieces":
            assert found.columns == docs.columns
            assert found.select(*CLASHING).distinct().collect() == [("x",) * len(CLASHING)]  # all values as they were
        assert found.count() <= docs.count()


def test_empty_tables(spark, sf_dir):
    docs = nothing(spark)
    for _, run in corpus_pipeline.STAGES:
        assert run(spark, docs, sf_dir).count() == 0
