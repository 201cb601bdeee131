import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from hydrolens.llm import config_packing
from hydrolens.llm.config_packing import Words, best_fit, pack, plan, sequences, slots, solve
from hydrolens.llm.queries import WORDS, op13_packing
from hydrolens.llm.tables import table
from tests.helpers import rows
from tests.llm.samples import documents, nothing, odd


def expected_pieces(docs, capacity=4096):
    tokenizer = Tokenizer.from_file(WORDS)
    out = []
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), capacity):
            part = np.array(ids[at : at + capacity], "<u4")
            out.append((i, at // capacity, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check_places(found, capacity=4096):
    """Every sequence is filled from 0 without gaps, up to its capacity."""
    by_sequence = {}
    for length, sequence, offset in found:
        by_sequence.setdefault(sequence, []).append((offset, length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_query_equals_the_tokenizer_and_fills_sequences(spark, sf_dir):
    found = op13_packing(spark, sf_dir)
    docs = [(d.doc_id, d.text) for d in table(spark, sf_dir, "documents").collect()]
    assert rows(found, "doc_id", "piece", "start", "length", "ids_crc32") == expected_pieces(docs)
    places = rows(found, "length", "sequence_id", "offset")
    # No packing has fewer sequences than the tokens fill; this one has no more.
    assert check_places(places) == -(-sum(length for length, _, _ in places) // 4096)


WORDS_OF_ALL_KINDS = [
    "Plain words, marks... and (more)!", "it's we'll I'D o'clock '' 'tis", "<|startoftext|>a<|endoftext|> <|endoftext|>", "x<|endoftext|>y z<|end",
    "ÀÉÎ straße ŒUVRE İstanbul ΣΑΣ ςσ", "é ạ̈ ́lone a ́", "日本語 テスト 🎉👩‍👩‍👧 ١٢٣", "a\tb\r\nc\x0bd\x1ce\xa0f g​h",
    "12345 3.14 x2y", "\x00 \x01a\x7f", "  spaced   out \n\n lines ", "a" * 5000, "µ º ª × ÷ ﬁ Ａ", "don't-stop_now|go", "", " ", "\n",
]


def test_words_equal_the_tokenizer(monkeypatch):
    tokenizer = Tokenizer.from_file(WORDS)
    texts = [*WORDS_OF_ALL_KINDS, " ".join(WORDS_OF_ALL_KINDS), "\n".join(reversed(WORDS_OF_ALL_KINDS))]
    for remembered in (1_000_000, 3):
        monkeypatch.setattr(config_packing, "REMEMBERED", remembered)
        words = Words(WORDS)
        for text in texts * 2:
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(words.encode(text), "<u4").tolist() == ids, text


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_piece_once(seed):
    draw = np.random.default_rng(seed)
    shapes = [draw.integers(1, 101, 400), draw.integers(26, 60, 300), np.full(200, 34), np.concatenate([np.full(50, 100), draw.integers(1, 4, 500)])]
    lengths = Counter(shapes[seed].tolist())
    planned = plan(dict(lengths), 100)
    held = Counter()
    for taken, number in planned.items():
        assert sum(taken) <= 100 and number > 0
        for length in taken:
            held[length] += number
    assert held == lengths
    plain = best_fit(Counter(lengths), 100)
    assert sum(planned.values()) <= sum(plain.values()) + 1
    for length, known in slots(planned).items():
        assert known[0, 0] == 0 and (np.diff(known[:, 0]) > 0).all()


def test_the_program_beats_best_fit():
    """Thirds and halves that a greedy packing pairs badly: 6 + 3 + 1, 5 + 5, 4 + 4 + 2."""
    counts = {60: 300, 50: 200, 44: 200, 36: 300, 20: 100, 12: 100, 4: 300}
    planned = plan(counts, 100)
    assert sum(planned.values()) <= sum(best_fit(Counter(counts), 100).values())


def test_solutions_cover_all_pieces():
    counts = {70: 30, 45: 50, 30: 80, 25: 10}
    fractions = solve(counts, 100)
    for length, count in counts.items():
        assert sum(x * taken.count(length) for taken, x in fractions.items()) >= count - 1e-6


def test_best_fit_by_number_equals_piece_by_piece():
    draw = np.random.default_rng(9)
    lengths = Counter(draw.integers(1, 101, 500).tolist())
    rooms = []
    for length in sorted(lengths.elements(), reverse=True):
        fitting = [(room, i) for i, room in enumerate(rooms) if room >= length]
        if fitting:
            rooms[min(fitting)[1]] -= length
        else:
            rooms.append(100 - length)
    assert abs(sum(best_fit(lengths, 100).values()) - len(rooms)) <= 1


def test_odd_rows_and_sequences(spark, sf_dir):
    docs = odd(spark, sf_dir)
    expected = expected_pieces([(d.doc_id, d.text) for d in docs.collect()], 64)
    packed = pack(docs, WORDS, capacity=64, with_ids=True)
    assert rows(packed, "doc_id", "piece", "start", "length", "ids_crc32") == expected
    found = sequences(packed).collect()
    assert sum(len(row.ids) for row in found) == sum(row[3] for row in expected)
    assert max(len(row.ids) for row in found) <= 64
    whole = packed.filter("doc_id = 6").first()
    assert any(row.ids[whole.offset : whole.offset + whole.length] == whole.ids for row in found)
    assert pack(nothing(spark), WORDS).count() == 0


def test_equal_lengths_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(config_packing, "NUMBERED", 7)
    docs = documents(spark, [(i, None if i % 3 else "some words") for i in range(200)])
    assert check_places(rows(pack(docs, WORDS, capacity=16), "length", "sequence_id", "offset"), 16) == -(-(133 + 67 * 3) // 16)
