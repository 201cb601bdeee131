import zlib
from collections import Counter, defaultdict

from hydrolens.llm import sharding
from hydrolens.llm.queries import op3_shards
from hydrolens.llm.tables import table
from tests.helpers import rows
from tests.llm.samples import documents, nothing, odd


def law_holds(found, shards):
    sizes = Counter(row.shard for row in found)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for row in found:
        slots[row.shard].append(row.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_query(spark, sf_dir):
    found = op3_shards(spark, sf_dir).collect()
    texts = {d.doc_id: (d.text or "").encode() for d in table(spark, sf_dir, "documents").collect()}
    assert sorted(row.doc_id for row in found) == sorted(texts)
    assert all((row.size, row.text_crc32) == (len(texts[row.doc_id]) + 16, zlib.crc32(texts[row.doc_id])) for row in found)
    assert {(row.law, row.grown_shard) for row in found} == {("rows", None)}
    law_holds(found, 40)


def test_query_keeps_equal_texts_together(spark, sf_dir):
    """Links join equal texts; those cut are few, since all groups fit a shard."""
    by_text = defaultdict(list)
    for row in op3_shards(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").collect():
        by_text[row.text or ""].append(row.shard)
    groups = [shards for shards in by_text.values() if 1 < len(shards) <= 5]
    cut = sum(len(shards) - max(Counter(shards).values()) for shards in groups)
    assert groups and cut == 0


def test_equal_texts_stay_together(spark):
    docs = documents(spark, [(i, f"text {i % 37 if i < 111 else i}") for i in range(400)])
    found = sharding.shard_documents(docs, shards=8).collect()
    law_holds(found, 8)
    own = defaultdict(set)
    for row in found:
        own[row.doc_id % 37 if row.doc_id < 111 else row.doc_id].add(row.shard)
    assert all(len(shards) == 1 for shards in own.values())


def test_large_group_is_spread(spark):
    docs = documents(spark, [(i, "same" if i % 3 == 0 else f"text {i}") for i in range(300)])
    found = sharding.shard_documents(docs, shards=10).collect()
    law_holds(found, 10)
    assert len({row.shard for row in found if row.doc_id % 3 == 0}) < 10


def test_large_texts_take_no_more_shards_than_they_need(spark):
    docs = documents(spark, [(i, "same" if i % 3 == 0 else f"text {i // 6}" if i % 6 == 1 else f"text {i}") for i in range(1207)])
    found = sharding.shard_documents(docs, shards=20).collect()
    law_holds(found, 20)
    assert len({row.shard for row in found if row.doc_id % 3 == 0}) == 7  # 403 rows, 60 or 61 in a shard


def test_filled_shards():
    assert sharding.filled([(("a",), 7), (("b",), 3), (("c",), 12)], 22, 4) == [("c", 0, 6, 0), ("c", 6, 12, 1), ("a", 0, 5, 2)]
    assert sharding.filled([(("a",), 9)], 9, 3) == [("a", 0, 3, 0), ("a", 3, 6, 1), ("a", 6, 9, 2)]
    assert sharding.filled([(("a",), 3)], 3, 40) == []


def test_a_round_without_gain_does_not_end_the_rounds(spark, monkeypatch):
    """An odd round may gain nothing where the next even one would."""
    asked = []
    written = sharding.written

    def counting(rows, name):
        out = written(rows, name)
        if name == "shard-asked":
            asked.append(out.count())
        return out

    monkeypatch.setattr(sharding, "written", counting)
    rows_ = sharding.numbered(documents(spark, [(i, str(i)) for i in range(96)]))
    ids = [r.row for r in rows_.orderBy("row").collect()]
    chain = [(ids[i], ids[i + 1]) for i in range(0, 95) if i % 8 != 7]
    sharding.propagate(rows_, spark.createDataFrame(chain, "a long, b long"), 4).collect()
    stalled = [i for i in range(1, len(asked)) if asked[i] >= min(asked[:i])]
    assert len(asked) == sharding.ROUNDS or asked[-1] == 0 or stalled[-2:] == [len(asked) - 2, len(asked) - 1]
    assert stalled and stalled[0] < len(asked) - 1  # a round gained nothing, and another one came


def test_own_links(spark):
    """Half of the rows are linked, in stars of four; the others make room."""
    rows_ = sharding.numbered(documents(spark, [(i, str(i)) for i in range(128)]))
    ids = {r.doc_id: r.row for r in rows_.collect()}
    ring = [(ids[i], ids[i - i % 4 + i // 4 % 4]) for i in range(64) if i % 4 != i // 4 % 4]
    labels = sharding.propagate(rows_, spark.createDataFrame(ring, "a long, b long"), 4).collect()
    shard = {r.row: r.shard for r in labels}
    assert sorted(Counter(shard.values()).values()) == [32] * 4
    assert all(shard[a] == shard[b] for a, b in ring)


def test_grants_keep_counts():
    wants = {(0, 1): 5, (1, 2): 1, (2, 0): 2}
    flows, back = sharding.granted(wants, {0: 9, 1: 9, 2: 9})
    assert flows == wants
    net = Counter()
    for (source, target), n in [*flows.items(), *back.items()]:
        net[source] -= n
        net[target] += n
    assert not any(net.values())
    flows, back = sharding.granted({(0, 1): 5, (1, 0): 2}, {})
    assert flows == {(0, 1): 2, (1, 0): 2} and not back


def test_odd_rows(spark, sf_dir):
    docs = odd(spark, sf_dir)
    found = sharding.shard_documents(docs).collect()
    assert len(found) == docs.count()
    law_holds(found, 40)
    empty = [row for row in found if row.size == 16]
    assert {row.text_crc32 for row in empty} == {0} and len(empty) == 4
    assert rows(sharding.shard_documents(nothing(spark))) == []
