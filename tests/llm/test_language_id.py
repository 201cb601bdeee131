import zlib

import pytest

from hydrolens.llm import language_id
from hydrolens.llm.queries import op5_language
from hydrolens.llm.tables import table
from tests.llm.samples import documents, nothing, odd


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return language_id.train(language_id.learning_rows(table(spark, sf_dir, "documents")))


def test_held_out_accuracy(spark, sf_dir):
    langs = {d.doc_id: d.lang for d in table(spark, sf_dir, "documents").collect()}
    found = op5_language(spark, sf_dir).collect()
    assert sorted(row.doc_id for row in found) == sorted(langs)
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1) for row in found)
    held = [row for row in found if row.held_out]
    assert sum(row.lang_pred == langs[row.doc_id] for row in held) >= 0.95 * len(held)
    assert all(0 <= row.score <= 1 and row.lang_pred in set(langs.values()) for row in found)


def test_prediction_reads_the_text_only(spark, model):
    text = "The ting of and with that for this was are from by."
    docs = documents(spark, [(1, text, "de", "a", 1), (2, text, None, "b", 2)])
    found = language_id.identify(docs, model).collect()
    assert len({(row.lang_pred, row.score) for row in found}) == 1


def test_distance_rejects(spark, model):
    docs = documents(spark, [(1, "Это совсем другой язык, которого никто не учил. " * 9), (2, "the and of with that")])
    assert [row.rejected for row in language_id.identify(docs, model).orderBy("doc_id").collect()] == [True, False]


def test_learning_ignores_the_held_out(spark, sf_dir):
    assert language_id.learning_rows(table(spark, sf_dir, "documents")).filter(language_id.held_out()).count() == 0


def test_odd_rows(spark, sf_dir, model):
    docs = odd(spark, sf_dir)
    found = language_id.identify(docs, model)
    assert set(found.columns) == set(docs.columns) | {"lang_pred", "score", "rejected"}
    rows = found.collect()
    assert len(rows) == docs.count()
    assert all((row.lang_pred, row.score, row.rejected) == ("und", 0.0, True) for row in rows if row.doc_id in (1, 2, 4))
    assert all(row.lang_pred == "und" for row in rows if row.text is None)


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "some text", None)])
    model = language_id.train(docs)
    assert language_id.identify(docs, model).first().lang_pred == "und"
    assert language_id.identify(nothing(spark), model).count() == 0
    model = language_id.train(documents(spark, [(1, "", "x"), (2, "only text here", "y")]))
    assert language_id.identify(documents(spark, [(3, "only text")]), model).first().lang_pred == "y"
