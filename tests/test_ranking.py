"""The ranking that is kept up to date against the batch one."""

import random

import pandas as pd
import pytest

from hydrolens import schemas
from hydrolens.operators import latest
from hydrolens.sources.readings import stream_table
from hydrolens.streaming import ranking, sinks
from tests.helpers import at, rows
from tests.test_groups import Handle
from tests.test_streaming import files


@pytest.mark.parametrize(("seed", "parts", "buckets"), [(1, 1, 64), (2, 7, 1), (3, 5, 3)])
def test_replaced_scores(spark, tmp_path, monkeypatch, seed, parts, buckets):
    """Lower scores replace higher ones of the best, whatever order the readings come in."""
    monkeypatch.setattr(ranking, "BUCKETS", buckets)
    rng = random.Random(seed)
    data = []
    for seq in range(300):
        device = rng.choice([None, 7, 7, 7, 1, 2])
        score = rng.choice([None, 60.0, 59.5, rng.uniform(-10, 60)]) if seq < 150 else rng.uniform(-10, 20)
        data.append((device, seq, at(rng.randrange(40)), "http", score, *[0.0] * 6))
    rng.shuffle(data)
    if seed == 2:
        data.sort(key=lambda row: row[1])  # high scores first, so the best fall
    stream = stream_table(spark, files(spark, data, schemas.READINGS, str(tmp_path), parts), schemas.READINGS, 1)
    tops = sinks.run_to_upserted(ranking.bucket_tops(stream, 5), "ranking", ranking.KEYS)
    expected = latest.temperature_ranking(spark.createDataFrame(data, schemas.READINGS), 5)
    found = [tuple(row) for row in ranking.ranking(tops, 5).collect()]
    assert found == [tuple(row) for row in expected.select("device_id", "id", "temperature").collect()]


def test_nothing_to_rank(spark, tmp_path):
    data = [(1, 1, at(0), "http", None, *[0.0] * 6)]
    stream = stream_table(spark, files(spark, data, schemas.READINGS, str(tmp_path), 1), schemas.READINGS, 1)
    assert rows(ranking.ranking(sinks.run_to_upserted(ranking.bucket_tops(stream), "r", ranking.KEYS))) == []


def test_members_are_kept_in_few_entries(spark, tmp_path):
    """A micro-batch adds some entries a bucket, not one a member."""
    data = [(i % 9, i, at(i * 60), "http", float(i % 601), *[0.0] * 6) for i in range(6000)]
    stream = stream_table(spark, files(spark, data, schemas.READINGS, str(tmp_path), 2), schemas.READINGS, 1)
    tops = ranking.bucket_tops(stream)
    query = sinks.upsert_stream(tops, str(tmp_path / "out"), str(tmp_path / "progress"), keys=ranking.KEYS)
    query.awaitTermination()
    assert max(op["numRowsTotal"] for one in query.recentProgress for op in one["stateOperators"]) < 2000
    found = ranking.ranking(sinks.read_upserted(spark, str(tmp_path / "out"), tops.schema, ranking.KEYS))
    expected = latest.temperature_ranking(spark.createDataFrame(data, schemas.READINGS))
    assert [tuple(row) for row in found.collect()] == [tuple(row) for row in expected.select("device_id", "id", "temperature").collect()]


@pytest.mark.parametrize("seed", range(12))
def test_a_bucket_after_each_batch(monkeypatch, seed):
    """Readings that come again higher, lower and late, over few and many days, against all
    scores settled."""
    monkeypatch.setattr(ranking, "SPARE", 1 + seed % 3)
    rng = random.Random(seed)
    processor, scores, best, seq = ranking.BucketRanking(4), {}, [], 0
    processor.init(Handle())
    for batch in range(60):
        sent = []
        for _ in range(rng.choice([1, 3, 40])):
            seq += 1
            member = (rng.choice([ranking.NONE, 1, 2]), rng.randrange(1, 50 + batch * seed) * 20_000_000)
            number = seq if rng.random() < 0.8 else rng.randrange(1, seq + 1)
            high = 40 if batch < 30 else 10
            sent.append((*member, number, float(rng.choice([rng.randrange(-10, high), high, float("nan") if seed == 3 else 0]))))
            known = scores.get(member)
            if known is None or known[0] <= number:
                scores[member] = (number, sent[-1][3])
        frame = pd.DataFrame(sent, columns=list(ranking.ROW.names))
        for out in processor.handleInputRows((0,), iter([frame[: len(sent) // 2], frame[len(sent) // 2 :]]), None):
            best = list(zip(out["id"], out["device_id"].fillna(ranking.NONE), out["temperature"]))
        every = [(score != score, 0.0 if score != score else score, f"reading:{ms}", device) for (device, ms), (_, score) in scores.items()]
        expected = sorted(every, reverse=True)[:4]
        assert [(score != score, 0.0 if score != score else score, one, device) for one, device, score in best] == expected
