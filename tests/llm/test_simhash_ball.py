import re

import numpy as np
import pytest
import xxhash

from hydrolens.llm import simhash_ball
from hydrolens.llm.queries import op9_simhash
from hydrolens.llm.tables import table
from tests.helpers import rows
from tests.llm.samples import documents, nothing, odd


def fingerprint(text, width=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def connected(values, most=4):
    """The index of the first value that each is connected to."""
    labels = list(range(len(values)))
    found = np.bitwise_count(np.array(values, np.uint64)[:, None] ^ np.array(values, np.uint64)) <= most
    while True:
        new = [min(labels[j] for j in np.flatnonzero(row)) for row in found]
        if new == labels:
            return labels
        labels = new


def test_query_equals_brute_force(spark, sf_dir):
    docs = sorted((d.doc_id, fingerprint(d.text)) for d in table(spark, sf_dir, "documents").collect())
    roots = connected([value for _, value in docs])
    expected = [(i, f"{value:016x}", docs[root][0]) for (i, value), root in zip(docs, roots)]
    assert any(i != root for i, _, root in expected)
    assert rows(op9_simhash(spark, sf_dir), "doc_id", "fingerprint", "component_id") == sorted(expected, key=repr)


@pytest.mark.parametrize(("classes", "variants", "part"), [(128, 1 << 24, 1 << 21), (2, 1 << 12, 1 << 9), (1, 1 << 30, 1 << 10)])
def test_links_at_any_number_of_classes(spark, monkeypatch, classes, variants, part):
    """Chains of 4 bits, pairs of 5, and a dense group, whatever the split."""
    for name, value in (("CLASSES", classes), ("CLASS_VARIANTS", variants), ("SORTED", part)):
        monkeypatch.setattr(simhash_ball, name, value)
    draw = np.random.default_rng(5)
    starts = draw.integers(0, 1 << 63, 12).tolist()
    values = list(starts)
    for start in starts[:6]:
        values += [start ^ 0b1111, start ^ 0b11111111, start ^ (0b11111 << 40)]
    values += [starts[7] ^ (1 << i) for i in range(12)]
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r.node: r.root for r in simhash_ball.components(simhash_ball.links(distinct)).collect()}
    expected = connected(values)
    for i, value in enumerate(values):
        for j, other in enumerate(values):
            assert (expected[i] == expected[j]) == (found.get(value, value) == found.get(other, other))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)], "a long, b long")
    assert {r.root for r in simhash_ball.components(edges).collect()} == {0}


def test_odd_distance_is_refused():
    with pytest.raises(ValueError):
        simhash_ball.flips(3)


def test_odd_rows(spark, sf_dir):
    docs = odd(spark, sf_dir)
    found = rows(simhash_ball.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    assert len(found) == docs.count()
    assert [row for row in found if row[0] == 1] == [(1, "0" * 16, 1)] * 2
    assert [row[2] for row in found if row[0] is None and row[1] == "0" * 16] == [1, 1]
    kept = simhash_ball.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [row.doc_id for row in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(6) == 1
    assert len(ids) == len({row[2] if row[2] is not None else row[1] for row in found})
    assert simhash_ball.near_duplicates(nothing(spark)).count() == 0
    assert simhash_ball.one_of_each(nothing(spark)).count() == 0


def test_repeated_ids_with_other_texts_stay_apart(spark):
    docs = documents(spark, [(1, "alpha beta gamma delta epsilon"), (1, "one two three four five six"), (2, "alpha beta gamma delta epsilon")])
    assert rows(simhash_ball.one_of_each(docs), "doc_id") == [(1,), (1,)]
