import math
import re

import numpy as np
import pytest

from hydrolens.llm import ball_tree
from hydrolens.llm.queries import op11_ranked_search
from hydrolens.llm.tables import table
from tests.helpers import rows
from tests.llm.samples import documents, nothing, odd

NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(NO_TERM, lowered) if w]


def plain(docs, items, k=10):
    """Scores by the definition, one document and item at a time."""
    held = [(i, terms_of(text)) for i, text in docs]
    held = [(i, words) for i, words in held if words]
    n_docs, n_words = len(held), sum(len(words) for _, words in held)
    holding = {}
    for _, words in held:
        for term in set(words):
            holding[term] = holding.get(term, 0) + 1
    found = []
    for item, text in dict.fromkeys(items):
        ranked = []
        for i, words in held:
            m = 10 + 90 * len(words) * n_docs // n_words
            score = 0
            for term in set(terms_of(text)):
                if tf := words.count(term):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[term] + 1)))
                    score += w * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                ranked.append((-score, i is None, i))
        ranked.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        found += [(item, rank + 1, i, -score) for rank, (score, _, i) in enumerate(ranked[:k])]
    return sorted(found, key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(d.doc_id, d.text) for d in table(spark, sf_dir, "documents").collect()]
    items = [(b.item_id, b.text) for b in table(spark, sf_dir, "benchmark").collect()]
    assert rows(op11_ranked_search(spark, sf_dir), "item_id", "rank", "doc_id", "score") == plain(docs, items)


@pytest.mark.parametrize(
    "sizes", [ball_tree.Sizes(700, 7, 1 << 20, 2, 40), ball_tree.Sizes(1 << 20, 64, 300, 1, 1 << 20)], ids=["blocks", "trees"]
)
def test_any_size_of_trees_and_blocks(spark, sf_dir, sizes):
    docs = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").filter("item_id < 6")
    expected = plain([tuple(d) for d in docs.collect()], [(b.item_id, b.text) for b in items.collect()], 4)
    assert rows(ball_tree.search(docs, items, k=4, sizes=sizes), "item_id", "rank", "doc_id", "score") == expected


def vectors_and_items(n, leads, seed):
    """Vectors in clusters, each with terms of its own and some common ones."""
    draw = np.random.default_rng(seed)
    parts = []
    for i in range(n):
        own = 100 + 20 * (i % leads) + draw.choice(20, 8, replace=False)
        terms = np.unique(np.concatenate([own, draw.choice(100, 3, replace=False)])).astype(np.int32)
        parts.append((terms, draw.integers(1, 1_000_000, len(terms))))
    asked = [np.sort(100 + 20 * (g % leads) + draw.choice(20, 6, replace=False)) for g in range(20)]
    weights = [draw.integers(1, 15_000, 6) for _ in asked]
    items = ball_tree.Items(list(range(20)), np.arange(0, 126, 6), np.concatenate(asked), np.concatenate(weights), np.zeros(20, np.int64))
    return parts, items


def tree_of(parts):
    order, tree = ball_tree.build(parts)
    return order, tree | {"ids": order.astype(np.int64), "none": np.zeros(len(order), bool)}


def test_bounds_hold_for_all_documents_of_a_node():
    parts, items = vectors_and_items(600, 5, 3)
    order, tree = tree_of(parts)
    search = ball_tree.Search(tree, items, range(20))
    scores = np.zeros((20, len(parts)), np.int64)
    for place, row in enumerate(order):
        at = np.searchsorted(tree["terms"], parts[row][0])
        scores[:, place] = search.weights[:, at] @ parts[row][1]
    for node, (first, last) in enumerate(zip(tree["first"], tree["last"])):
        bound = search.bound(node)
        assert (bound >= scores[:, first:last].max(axis=1)).all()


def test_subtrees_are_pruned_and_results_whole():
    parts, items = vectors_and_items(4000, 40, 4)
    order, tree = tree_of(parts)
    search = ball_tree.Search(tree, items, range(20))
    for g in range(20):
        best = ball_tree.Best(10, 0)
        search.run(g, best)
        scores = [(-int((search.weights[g, np.searchsorted(tree["terms"], t)] * x).sum()), i) for i, (t, x) in enumerate(parts)]
        assert [(-int(s), int(i)) for s, i in zip(best.scores, best.ids)] == sorted(scores)[:10]
    leaves = int((tree["left"] < 0).sum())
    assert search.leaves < 20 * leaves / 3


def test_equal_documents_are_split_and_ranked_by_id(spark):
    docs = documents(spark, [(i, "alpha beta") for i in range(300, 0, -1)] + [(None, "alpha beta"), (500, "gamma")])
    items = spark.createDataFrame([(1, "Alpha"), (1, "Alpha"), (2, "gamma, delta"), (3, "nothing"), (4, None), (5, "")], "item_id long, text string")
    found = rows(ball_tree.search(docs, items, k=5), "item_id", "rank", "doc_id")
    # All but one hold "alpha": its weight is 0 after flooring, or more.
    expected = [r[:3] for r in plain([(i, "alpha beta") for i in range(1, 301)] + [(None, "alpha beta"), (500, "gamma")], [(1, "alpha"), (2, "gamma delta")], 5)]
    assert found == sorted(expected, key=repr)


def test_odd_rows(spark, sf_dir):
    docs = odd(spark, sf_dir)
    items = spark.createDataFrame([(1, "lorem ipsum", "x"), (2, "one text without", "x"), (None, "🎉 日本語", "x")], "item_id long, text string, score string")
    found = rows(ball_tree.search(docs, items), "item_id", "rank", "doc_id", "score")
    expected = plain([(d.doc_id, d.text) for d in docs.collect()], [(1, "lorem ipsum"), (2, "one text without"), (None, "🎉 日本語")])
    assert found == expected
    assert ball_tree.search(nothing(spark), items).count() == 0
    assert ball_tree.search(docs, items.limit(0)).count() == 0
    assert ball_tree.search(documents(spark, [(1, None), (2, "...")]), items).count() == 0
