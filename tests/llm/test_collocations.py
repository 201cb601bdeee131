import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from hydrolens.llm import collocations
from hydrolens.llm.queries import op12_collocations
from hydrolens.llm.tables import table, written
from tests.helpers import rows
from tests.llm.samples import LONG, documents, nothing, odd


def counts_of(docs):
    """Occurrences of all phrases of 1 to 4 words, per language, by the definition."""
    found = {}
    for text, lang in docs:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            counter = found.setdefault("und" if lang is None else lang, Counter())
            for n in (1, 2, 3, 4):
                counter.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return found


def plain(docs, support=30, top=2000):
    out = []
    for lang, f in counts_of(docs).items():
        total = sum(c for p, c in f.items() if " " not in p)
        candidates = {p: a for p, a in f.items() if " " in p and a >= support}
        scored = []
        for phrase, a in candidates.items():
            words = phrase.split(" ")
            cuts = [(f[" ".join(words[:k])], f[" ".join(words[k:])]) for k in range(1, len(words))]
            score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
            inside = (c for p, c in candidates.items() if p != phrase and f" {phrase} " in f" {p} ")
            if not any(100 * c >= 80 * a for c in inside):
                scored.append((-score, -a, phrase.encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top]):
            out.append((lang, rank + 1, phrase.decode(), -a, left, right, total, -score))
    return sorted(out, key=repr)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def pairs(docs):
    return [(d.text, d.lang) for d in docs.select("text", "lang").collect()]


def test_query_equals_brute_force(spark, sf_dir):
    found = rows(op12_collocations(spark, sf_dir), *COLUMNS)
    assert found and found == plain(pairs(table(spark, sf_dir, "documents")))


@pytest.mark.parametrize(
    ("sample", "chunk", "part", "bits"), [(0.02, 1 << 21, 1 << 20, 1 << 15), (0.3, 200, 25, 1 << 8), (0.0, 5000, 1 << 20, 1 << 12)]
)
def test_any_sample_chunks_and_bit_maps(spark, sf_dir, sample, chunk, part, bits):
    """A poor sample needs passes, short chunks need context, a small map has collisions."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0")
    passes = []
    found, _ = collocations.frequent_phrases(docs, support=6, sample=sample, passes=passes, sizes=collocations.Sizes(bits, chunk, part))
    expected = [(lang, p, c) for lang, f in counts_of(pairs(docs)).items() for p, c in f.items() if c >= 6]
    assert rows(found, "lang", "phrase", "count") == sorted(expected, key=repr)
    assert any(passes[0]) and not any(passes[-1])


def test_longer_phrases_of_the_border_are_reached(spark):
    """Nothing is proposed by the sample: each pass makes the next length countable."""
    docs = documents(spark, [(i, "Alpha beta gamma delta epsilon.", "en") for i in range(8)])
    passes = []
    found, totals = collocations.frequent_phrases(docs, support=8, sample=0.0, passes=passes)
    assert passes == [[5, 0, 0], [0, 4, 0], [0, 0, 3], [0, 0, 0]]
    assert found.count() == 5 + 4 + 3 + 2
    assert rows(totals) == [("en", 40)]


def test_products_beyond_64_bits(spark):
    """Scores are exact for counts whose product with the factor passes 64 bits."""
    a = 9_000_000_000_000
    score = spark.createDataFrame([(a, a, a + 1)], "a long, l long, r long").selectExpr("CAST(a AS DECIMAL(20, 0)) * 2000000 div (l + r)")
    assert score.first()[0] == 2_000_000 * a // (2 * a + 1)


def test_rules(spark):
    texts = ["one two three"] * 30 + ["one two"] * 5 + ["a,b a\tb a  b A\x0bb"] * 31 + ["x y"] * 29
    docs = documents(spark, [(i, text, None if i % 2 else "und") for i, text in enumerate(texts)])
    found = rows(collocations.collocations(docs), *COLUMNS)
    assert found == plain(pairs(docs))
    assert "one two" not in {row[2] for row in found} and "x y" not in {row[2] for row in found}


def test_odd_rows(spark, sf_dir):
    docs = odd(spark, sf_dir)
    found = rows(collocations.collocations(docs, support=3), *COLUMNS)
    assert found == plain(pairs(docs), support=3)
    assert any(row[0] == "la" for row in found) and LONG[:5] == "Lorem"
    assert collocations.collocations(nothing(spark)).count() == 0
    assert collocations.collocations(documents(spark, [(1, None), (2, " . ")])).count() == 0


def test_stored_chunks_are_read_in_small_parts(spark, monkeypatch):
    """A task's chunks are several row groups without arrays, whose columns' memory grows with all of them."""
    tables = []

    def kept(df, name, **options):
        tables.append((name, written(df, name, **options)))
        return tables[-1][1]

    monkeypatch.setattr(collocations, "written", kept)
    text = "concat_ws(' ', transform(sequence(1, 60000), k -> concat('w', (k * 7919 + id * 104729) % 50000))) AS text"
    docs = spark.range(0, 90, 1, 1).selectExpr("id AS doc_id", text, "'en' AS lang")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    _, totals = collocations.frequent_phrases(docs, support=10**6, sample=0.0)
    assert rows(totals) == [("en", 90 * 60000)]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    (path,) = [f for name, df in tables if name == "phrase-chunks" for f in df.inputFiles()]
    stored = pq.ParquetFile(path.removeprefix("file://"))
    assert all(stored.schema.column(i).max_repetition_level == 0 for i in range(len(stored.schema)))
    sizes = [stored.metadata.row_group(i).total_byte_size for i in range(stored.num_row_groups)]
    assert len(sizes) > 1 and max(sizes) < 12 << 20
