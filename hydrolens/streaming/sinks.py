"""Table sinks for batches and streams.

An upsert table is a log of changes: every micro-batch replaces its own folder,
so a batch that runs twice is written once, and reading keeps the last value
per key. After each ``COMPACT_EVERY`` batches the folders of the batches before are folded
into one base folder, which counts once its success marker is there, so a fold that
fails midway is not seen. Folders that a base replaces are deleted by the next fold, not
by the one that made it: whoever lists the table meanwhile can still read what was listed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hydrolens.operators.latest import latest_state
from hydrolens.session import fresh_dir

BATCH = "batch"
BASE = "base"
COMPACT_EVERY = 100

# Rows of a log, with their batch, to the rows that stand for them.
Fold = Callable[[DataFrame], DataFrame]


def overwrite_parquet(df: DataFrame, path: str, by_date_of: str | None = None) -> None:
    """Replaces a table; with a date column only the dates which occur in ``df``."""
    if by_date_of is None:
        df.write.mode("overwrite").parquet(path)
        return
    dated = df.withColumn("date", F.to_date(by_date_of))
    writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date").parquet(path)


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_stream(
    df: DataFrame, path: str, progress: str, available_now: bool = True, by: str | None = None
) -> StreamingQuery:
    """Appends a stream's rows to a table, each exactly once; ``by`` a column, if given."""
    writer = df.writeStream.format("parquet").outputMode("append")
    writer = writer.partitionBy(by) if by else writer
    writer = writer.option("path", path).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _each_batch(
    df: DataFrame, path: str, progress: str, mode: str, change: Callable, available_now: bool,
    fold: Fold | None = None,
) -> StreamingQuery:
    def write(rows: DataFrame, batch_id: int) -> None:
        changed = change(rows)
        if fold and batch_id and batch_id % COMPACT_EVERY == 0:
            # A batch starts only after the ones before have been committed.
            compact(rows.sparkSession, path, changed.schema, batch_id - 1, fold)
        changed.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    writer = df.writeStream.foreachBatch(write).outputMode(mode)
    writer = writer.option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def upsert_stream(
    df: DataFrame, path: str, progress: str, mode: str = "update", available_now: bool = True,
    keys: Sequence[str] | None = None,
) -> StreamingQuery:
    """Writes changed rows; :func:`read_upserted` gives the last one per key. With ``keys``
    the table is folded now and then."""
    fold = keys and (lambda log: _last_per_key(log, keys, keep_batch=True))
    return _each_batch(df, path, progress, mode, lambda rows: rows, available_now, fold)


def _last_per_key(log: DataFrame, keys: Sequence[str], keep_batch: bool = False) -> DataFrame:
    values = [name for name in log.columns if name not in (*keys, BATCH)]
    last = F.max_by(F.struct(*values, *([BATCH] if keep_batch else [])), BATCH).alias("last")
    return log.groupBy(*keys).agg(last).select(*keys, "last.*")


def read_upserted(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]
) -> DataFrame:
    """The last row per key of an upsert table."""
    return _last_per_key(_read_log(spark, path, schema), keys)


def _latest_of_log(log: DataFrame) -> DataFrame:
    return latest_state(log.withColumnRenamed(BATCH, "seq"))


def latest_stream(
    readings: DataFrame, path: str, progress: str, available_now: bool = True
) -> StreamingQuery:
    """Keeps the latest state: each micro-batch adds one row per device it saw."""
    return _each_batch(readings, path, progress, "append", latest_state, available_now, _latest_of_log)


def readings_stream(
    readings: DataFrame, folder: str, progress: str, available_now: bool = True
) -> StreamingQuery:
    """Keeps the reading log and the latest state by one query.

    The state is derived from the written readings, so a micro-batch and the
    smoothing before it are computed once.
    """
    schema = readings.schema

    def write(rows: DataFrame, batch_id: int) -> None:
        path = f"{folder}/readings/{BATCH}={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        batch = rows.sparkSession.read.schema(schema).parquet(path)
        latest = latest_state(batch)
        if batch_id and batch_id % COMPACT_EVERY == 0:
            compact(rows.sparkSession, f"{folder}/latest", latest.schema, batch_id - 1, _latest_of_log)
        latest.write.mode("overwrite").parquet(f"{folder}/latest/{BATCH}={batch_id}")

    writer = readings.writeStream.foreachBatch(write).outputMode("append")
    writer = writer.option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_latest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Field-wise latest state out of the table of :func:`latest_stream`."""
    return _latest_of_log(_read_log(spark, path, schema))


def _folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of a table's batch folders, and of its complete base folders."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {BATCH: [], BASE: []}
    for status in files.listStatus(hadoop(path)) if files.exists(hadoop(path)) else []:
        kind, _, number = status.getPath().getName().partition("=")
        if kind == BATCH or kind == BASE and files.exists(hadoop(f"{path}/{kind}={number}/_SUCCESS")):
            found[kind].append(int(number))
    return {kind: sorted(numbers) for kind, numbers in found.items()}


def _read_log(
    spark: SparkSession, path: str, schema: T.StructType, upto: int | None = None
) -> DataFrame:
    """All rows with their batch: the newest base, and the batches after it."""
    folders = _folders(spark, path)
    base = max(folders[BASE], default=-1)
    newer = [n for n in folders[BATCH] if n > base and (upto is None or n <= upto)]
    with_batch = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    log = spark.createDataFrame([], with_batch)
    if newer:
        reader = spark.read.schema(with_batch).option("basePath", path)
        log = reader.parquet(*[f"{path}/{BATCH}={n}" for n in newer])
    if base >= 0:
        log = spark.read.schema(with_batch).parquet(f"{path}/{BASE}={base}").unionByName(log)
    return log


def compact(spark: SparkSession, path: str, schema: T.StructType, upto: int, fold: Fold) -> None:
    """Folds all batches up to one into a base, and deletes what the base before it replaced.

    Rows keep their batch if ``fold`` keeps it, else they count as of the newest one.
    """
    folders = _folders(spark, path)
    known = max(folders[BASE], default=-1)
    if upto > known:
        folded = fold(_read_log(spark, path, schema, upto))
        if BATCH not in folded.columns:
            folded = folded.withColumn(BATCH, F.lit(upto).cast("long"))
        folded.write.mode("overwrite").parquet(f"{path}/{BASE}={upto}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    replaced = [f"{BATCH}={n}" for n in folders[BATCH] if n <= known] + [f"{BASE}={n}" for n in folders[BASE] if n < known]
    for name in replaced:
        files.delete(hadoop(f"{path}/{name}"), True)


def run_to_table(df: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all there is now and reads what it appended."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    append_stream(df, path, fresh_dir(spark, f"{name}-progress")).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_to_upserted(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Runs a stream over all there is now and reads the last row per key."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    upsert_stream(df, path, fresh_dir(spark, f"{name}-progress"), keys=keys).awaitTermination()
    return read_upserted(spark, path, df.schema, keys)


def run_to_latest(readings: DataFrame, name: str) -> DataFrame:
    """Runs a stream of readings over all there is now and reads the latest state."""
    spark = readings.sparkSession
    path = fresh_dir(spark, name)
    latest_stream(readings, path, fresh_dir(spark, f"{name}-progress")).awaitTermination()
    return read_latest(spark, path, latest_state(readings).schema)
