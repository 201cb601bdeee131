"""What Spark will do: pushed filters, pruned columns, few shuffles."""

import pytest

from hydrolens import schemas
from hydrolens.constants import FLAGS
from hydrolens.operators import asof, changelog, latest, quality, rollup, smoothing
from hydrolens.operators.asof import as_of, broadcast_as_of
from hydrolens.plans.queries import BATCH
from hydrolens.sources import events_views as views
from hydrolens.sources.readings import read_table


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def readings(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "readings")
    spark.createDataFrame([], schemas.READINGS).write.parquet(path)
    return read_table(spark, path, schemas.READINGS)


def test_outlier_rules_reach_the_scan(readings):
    text = plan(rollup.hourly_kpis(readings, ordered=False))
    for pushed in ("IsNotNull(ph)", "GreaterThanOrEqual(ph,0.0)", "LessThan(temperature,60.0)"):
        assert pushed in text
    assert "ReadSchema: struct<ts:timestamp,temperature:double,humidity:double,ph:double>" in text


def test_indicators_are_aggregated_before_the_one_shuffle(readings):
    text = plan(rollup.hourly_kpis(readings, by=("device_id",), ordered=False))
    assert text.count("Exchange") == 1 and "partial_avg" in text and "SortAggregate" not in text


def test_counts_take_one_pass(readings):
    text = plan(quality.outlier_counts(readings))
    assert text.count("FileScan") == 1 and "ReadSchema: struct<temperature:double,ph:double>" in text


def test_newest_rows_need_no_full_sort(readings):
    text = plan(latest.latest_n(readings))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_history_is_cut_before_the_shuffle(readings):
    text = plan(latest.history_n(readings))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1


def test_latest_state_is_hash_aggregated(readings):
    text = plan(latest.latest_state(readings))
    assert "HashAggregate" in text and "SortAggregate" not in text and text.count("Exchange") == 1


def test_moving_means_share_one_shuffle_and_sort(readings):
    text = plan(smoothing.moving_mean(readings, {"ph": "a", "conductivity": "b"}))
    assert text.count("Exchange") == 1 and text.count("Sort [") == 1


def test_as_of_a_small_log_shuffles_only_the_log(readings, spark):
    log = spark.createDataFrame([(1, 1, None, 1, 1, 1, 1)], schemas.CONFIG_LOG)
    text = plan(broadcast_as_of(readings, log, FLAGS).filter("auto = 1 and circ_auto = 1"))
    assert text.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in text
    # Only branches below a broadcast, which hold the log, are shuffled.
    assert "hashpartitioning" not in text.split("BroadcastExchange")[0]


def test_as_of_refuses_to_broadcast_a_large_log(readings, spark, monkeypatch):
    monkeypatch.setattr(asof, "BROADCAST_ROWS", 1)
    log = spark.createDataFrame([(1, i, None, 1, 1, 1, 1) for i in range(2)], schemas.CONFIG_LOG)
    with pytest.raises(ValueError):
        broadcast_as_of(readings, log, FLAGS)


def test_ranking_is_one_scan_and_one_shuffle_without_a_sort(readings):
    text = plan(latest.temperature_ranking(readings))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert "TakeOrderedAndProject" in text and "SortAggregate" not in text


def test_snapshot_does_not_sort_to_aggregate(spark, sf_dir):
    assert "SortAggregate" not in plan(changelog.snapshot(views.kv_log(spark, sf_dir)))


def test_as_of_is_one_shuffle_without_a_join(readings, spark):
    log = spark.createDataFrame([(1, 1, None, 1, 1, 1, 1)], schemas.CONFIG_LOG)
    text = plan(as_of(readings, log, FLAGS))
    assert text.count("Exchange") == 1 and "Join" not in text


@pytest.mark.parametrize("name", sorted(BATCH))
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(BATCH[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
