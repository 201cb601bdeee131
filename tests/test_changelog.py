"""Change logs: last write, deletes, expiry, globs."""

import random

import pytest
from pyspark.sql import functions as F

from hydrolens import schemas
from hydrolens.functions import text
from hydrolens.operators import changelog
from tests.helpers import at, rows, same


def log(spark, *entries):
    data = [(key, i, at(i), op, value, expire) for i, (key, op, value, expire) in enumerate(entries)]
    return spark.createDataFrame(data, schemas.KV_LOG)


@pytest.mark.parametrize("expire, age, live", [(None, 1e6, 1), (0, 1e6, 1), (10, 9, 1), (10, 10, 0)])
def test_expiry(spark, expire, age, live):
    df = log(spark, ("a", "set", "1", expire))
    assert changelog.snapshot(df, at(age)).count() == live


def test_last_write_wins(spark):
    df = log(
        spark, ("a", "set", "1", 5), ("a", "set", "2", None), ("b", "set", "1", None),
        ("b", "delete", None, None), ("c", "delete", None, None), ("c", "set", "3", None),
    )
    assert rows(changelog.snapshot(df, at(100)), "key", "value") == [("a", "2"), ("c", "3")]
    assert rows(changelog.snapshot(df, at(2)), "key", "value") == [("a", "2"), ("b", "1")]


def test_a_log_twice_gives_the_same_snapshot(spark):
    df = log(spark, ("a", "set", "1", None), ("b", "set", "2", 50), ("a", "delete", None, None))
    assert same(changelog.snapshot(df, at(9)), changelog.snapshot(df.union(df), at(9)))


ENTRIES = [
    ("k", 1, 200, "set", "new", None), ("k", 2, 100, "set", "old", None),  # the later time counts
    (None, 3, 5, "set", "of no key", None), (None, 4, 6, "set", "still of none", 900),
    ("t", 5, 7, "set", "a", None), ("t", 5, 7, "set", "b", None), ("t", 5, 7, "delete", None, None),  # a tie
    ("n", None, 8, "set", "no number", None), ("n", -5, 8, "set", "numbered", None),
    ("d", 7, 50, "delete", None, None), ("d", 8, 40, "set", "late", None), ("u", 9, None, "set", "no time", None),
]


def plain(entries, now):
    last = {}
    for key, seq, ts, op, value, expire in entries:
        if ts is not None and ts <= now:
            rank = (ts, -(2**63) if seq is None else seq, op, value or "")
            last[key] = max(last.get(key, (rank, None)), (rank, expire), key=lambda e: e[0])
    live = [(k, rank[3]) for k, (rank, expire) in last.items() if rank[2] == "set" and (not expire or rank[0] + expire > now)]
    return sorted(live, key=repr)


def entries_of(spark, entries):
    data = [(k, seq, None if ts is None else at(ts), *rest) for k, seq, ts, *rest in entries]
    return spark.createDataFrame(data, schemas.KV_LOG)


@pytest.mark.parametrize("now", [6, 8, 45, 150, 1000])
def test_time_then_number(spark, now):
    found = rows(changelog.snapshot(entries_of(spark, ENTRIES), at(now)), "key", "value")
    assert found == plain(ENTRIES, now)


@pytest.mark.parametrize("seed", range(4))
def test_snapshots_from_a_base(spark, seed):
    """A base and what came since, late entries too, give what the whole log gives."""
    rng = random.Random(seed)
    entries = [
        (rng.choice(["a", "b", "c", None]), rng.randrange(30), rng.randrange(100), op, None if op == "delete" else str(rng.randrange(9)),
         rng.choice([None, None, 0, 20]))
        for op in rng.choices(["set", "set", "delete"], k=60)
    ]
    since = [e for e in entries if e[2] > 50 or rng.random() < 0.2]
    before = [e for e in entries if e not in since]
    base = changelog.newest(entries_of(spark, before))
    assert base.count() <= 4
    for now in (50, 75, 100):
        found = changelog.snapshot(base.unionByName(entries_of(spark, since)), at(now))
        assert same(found, changelog.snapshot(entries_of(spark, entries), at(now)))
    again = changelog.newest(base.unionByName(entries_of(spark, since)))
    assert same(again, changelog.newest(entries_of(spark, entries)))


def test_a_snapshot_aggregates_by_hash(spark):
    plan = changelog.snapshot(entries_of(spark, ENTRIES), at(9))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_null_keys_are_looked_up_and_deleted(spark):
    live = changelog.snapshot(entries_of(spark, ENTRIES), at(100))
    keys = spark.createDataFrame([(None,), ("d",)], "key string")
    assert rows(changelog.lookup(live, keys)) == [("d", None, False), (None, "still of none", True)]
    assert (None,) not in rows(changelog.delete_keys(live, keys), "key")
    assert (None,) not in rows(changelog.list_keys(live), "key")


def test_lookup_and_bulk_delete(spark):
    live = changelog.snapshot(log(spark, ("a", "set", "1", None), ("b", "set", "2", None)), at(9))
    keys = spark.createDataFrame([("a",), ("x",)], "key string")
    assert rows(changelog.lookup(live, keys)) == [("a", "1", True), ("x", None, False)]
    assert rows(changelog.delete_keys(live, keys), "key") == [("b",)]


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("*", ["", "a:b", "x\ny"], []),
        ("h?llo", ["hello", "hallo"], ["hllo", "heello"]),
        ("h[ae]llo", ["hello", "hallo"], ["hillo"]),
        ("h[^e]llo", ["hallo"], ["hello"]),
        ("h[a-c]llo", ["hbllo"], ["hdllo"]),
        (r"a\*b", ["a*b"], ["axb"]),
        ("a.b", ["a.b"], ["axb"]),
        ("kpi:2025*", ["kpi:2025010100"], ["kpi:2024010100", "xkpi:2025"]),
        (r"[\]x]", ["]", "x"], ["y"]),
        (r"[\d]", ["d"], ["5"]),
        ("a(b", ["a(b"], ["ab"]),
        ("a[b", ["a[b"], ["ab"]),
        ("a$", ["a$"], ["a"]),
    ],
)
def test_globs(spark, pattern, yes, no):
    df = spark.createDataFrame([(one,) for one in [*yes, *no]], "key string")
    found = rows(df.filter(text.glob_match(F.col("key"), pattern)), "key")
    assert found == sorted([(one,) for one in yes], key=repr)
