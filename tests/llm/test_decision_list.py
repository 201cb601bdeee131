import re
from collections import Counter

from pyspark.sql import functions as F

from hydrolens.llm import decision_list
from hydrolens.llm.decision_list import Condition, DecisionList
from hydrolens.llm.queries import op8_quality
from hydrolens.llm.tables import table
from tests.helpers import rows
from tests.llm.samples import documents, nothing, odd

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = list(zip(words, words[1:], words[2:]))
    times, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_query_equals_brute_force(spark, sf_dir):
    docs = {d.doc_id: d.text for d in table(spark, sf_dir, "documents").collect()}
    found = op8_quality(spark, sf_dir).collect()
    assert sorted(row.doc_id for row in found) == sorted(docs)
    for row in found:
        own = counts(docs[row.doc_id])
        assert tuple(row[name] for name in BASE) == own
        assert row.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert row.kept == (row.reason is None) and not (row.base_failed and row.kept)


def test_learned_rules_find_the_bad_rows(spark):
    """The smallest tables have too few bad rows to learn from."""
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    judged = [row for row in op8_quality(spark, sf_dir).collect() if row.doc_id in labels and not row.base_failed]
    bad = [row for row in judged if labels[row.doc_id] == 0]
    assert bad and sum(not row.kept for row in bad) >= 0.9 * len(bad)
    good = [row for row in judged if labels[row.doc_id] == 1]
    assert sum(row.kept for row in good) >= 0.95 * len(good)


def test_learned_rules_keep_the_good_rows(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    judged = [row for row in op8_quality(spark, sf_dir).collect() if row.doc_id in labels and not row.base_failed]
    good = [row for row in judged if labels[row.doc_id] == 1]
    assert sum(row.kept for row in good) >= 0.95 * len(good)


def test_learning_a_conjunction(spark):
    """Bad: word_length above 6 and symbol_share above 0.5, with a little noise."""
    columns = ["doc_id", *decision_list.FEATURES]
    data = [(i, float(i % 10), (i * 7 % 20) / 20, 0.0, 0.0, None, 0.0) for i in range(3000)]
    bad = {i for i, length, share, *_ in data if length > 6 and share > 0.5}
    schema = "doc_id long, " + ", ".join(f"{name} double" for name in columns[1:])
    table_ = spark.createDataFrame(data, schema)
    labels = spark.createDataFrame([(i, int(i not in bad)) for i, *_ in data if i % 50], "doc_id long, quality int")
    rules = decision_list.learn(table_, labels)
    rejected = {row.doc_id for row in table_.filter(~rules.accepts()).collect()}
    assert len(rejected ^ bad) <= 0.02 * len(bad)
    assert all(len(rule) == 2 for rule in rules.rules)


def test_order_and_nulls(spark):
    rules = DecisionList(((Condition("word_length", True, 5.0),), (Condition("symbol_share", False, 0.1), Condition("upper_share", True, 0.5))))
    data = [(1, 6.0, 0.0, 1.0), (2, 5.0, 0.1, 0.6), (3, None, None, None), (4, 1.0, 0.2, 1.0)]
    table_ = spark.createDataFrame(data, "id long, word_length double, symbol_share double, upper_share double")
    found = table_.select("id", rules.accepts().alias("ok"), rules.reason().alias("why"))
    first, second = "word_length > 5", "symbol_share <= 0.1 and upper_share > 0.5"
    assert rows(found) == [(1, False, first), (2, False, second), (3, True, None), (4, True, None)]


def test_odd_rows(spark, sf_dir):
    docs = odd(spark, sf_dir)
    found = decision_list.measured(docs, prefix="__")
    assert set(docs.columns) < set(found.columns)
    for row in found.collect():
        assert tuple(row[f"__{name}"] for name in BASE) == counts(row.text)
    labels = spark.createDataFrame([(None, 0), (1, None), (50, 0), (50, 1), (51, 1)], "doc_id long, quality int")
    measured = decision_list.measured(docs.select("doc_id", "text"))
    assert decision_list.judge(measured, decision_list.learn(measured, labels)).count() == docs.count()


def test_nothing_to_learn_from(spark, sf_dir):
    measured = decision_list.measured(documents(spark, [(1, "x " * 60)]))
    no_labels = table(spark, sf_dir, "labels").limit(0)
    assert decision_list.learn(measured, no_labels).rules == ()
    assert decision_list.judge(measured, DecisionList(())).select(F.col("kept")).first()[0] is False
    assert decision_list.measured(nothing(spark)).count() == 0
