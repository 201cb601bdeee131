import hashlib
import random

import pytest
import sentencepiece

from hydrolens.llm import piece_codec
from hydrolens.llm.piece_codec import Codec, Vocabulary
from hydrolens.llm.queries import PIECES, op10_pieces
from hydrolens.llm.tables import table
from tests.helpers import rows
from tests.llm.samples import nothing, odd


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def codec():
    return Codec(Vocabulary.load(PIECES))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, doc_id, text):
    ids = library.encode(text or "")
    return doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


def test_equals_the_library_on_random_texts(library, codec):
    draw = random.Random(11)
    letters = list("  \n\tabcdefghijklmnopqrstuvwxyzàéñß日本語中国🎉▁　.,!?'\"0123456789<>ABC\x00") + ["   ", "”.", "é́"]
    pieces = [piece.replace("▁", " ") for piece in codec.vocabulary.pieces]
    for _ in range(6000):
        source = draw.choice((letters, pieces, "aeinrst "))
        text = "".join(draw.choices(source, k=draw.randint(0, 30)))
        ids = library.encode(text)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids) == codec.both(text)[1]


def test_runs_of_spaces(library, codec):
    for n in [*range(1, 70), 500]:
        for text in (" " * n, " " * n + "a", " " * n + "日", "x" + " " * n + "\n" + " " * n):
            assert codec.encode(text) == library.encode(text)


def test_text_without_spaces(library, codec):
    text = "".join(random.Random(2).choices("abcdefghijklmnoprst", k=30_000))
    assert codec.encode(text) == library.encode(text)


def test_decoding_any_ids(library, codec):
    draw = random.Random(3)
    for top in (32_000, 262):
        for _ in range(2000):
            ids = draw.choices(range(top), k=draw.randint(0, 12))
            assert codec.decode(ids) == library.decode(ids)


def test_full_dictionaries(monkeypatch, library, codec):
    monkeypatch.setattr(piece_codec, "REMEMBERED", 3)
    text = "One two three, four five six seven. Eight nine ten eleven twelve."
    assert [Codec(codec.vocabulary).encode(text) for _ in range(2)] == [library.encode(text)] * 2


def test_query_equals_the_library(spark, sf_dir, library):
    docs = table(spark, sf_dir, "documents").collect()
    assert rows(op10_pieces(spark, sf_dir)) == sorted((expected(library, d.doc_id, d.text) for d in docs), key=repr)


def test_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    again = piece_codec.decode(piece_codec.encode(docs, PIECES), PIECES)
    assert rows(again) == rows(docs)


def test_odd_rows(spark, sf_dir, library):
    docs = odd(spark, sf_dir)
    found = rows(piece_codec.digests(docs, PIECES))
    assert found == sorted((expected(library, d.doc_id, d.text) for d in docs.collect()), key=repr)
    assert piece_codec.encode(docs, PIECES).count() == docs.count()
    assert piece_codec.digests(nothing(spark), PIECES, with_ids=True).count() == 0
