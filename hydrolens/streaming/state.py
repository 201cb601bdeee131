"""Stateful operators on streams.

Each gives the rows its batch form gives. Devices are dealt to groups by a hash, and a
group's devices are taken at once: a micro-batch costs some calls a group, not some a device
(spans offline, which need a timer of each device, go by device). With a ``delay`` rows are
held in the state, by time buckets, until the watermark has passed them; a timer for each
bucket gives it on, one after the other in the order of time (:class:`InOrder`). So results
do not depend on how rows are dealt to files, and of two inputs the slower one sets the pace.
A row of a bucket that its device has already given on is late: it takes no part, and is
handed on marked as late. Memory is bounded by a group's rows of a bucket.

Without a delay rows of a micro-batch reach a device unordered and are sorted there; a
micro-batch is bounded by the source's files-per-trigger limit. What follows from elapsed
time is found while handling the next row, so for rows that arrive in the order of time
results do not depend on where micro-batches end; timers only tell of what is still open.
A row that arrives after later ones of its device counts as of its arrival, as it does in
the services.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hydrolens import constants as C
from hydrolens.operators.control import CONFIG, NEVER, READING, SECOND, Controller, Rules

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB provider; it spills to disk and checkpoints changes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def _sorted(batches: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(list(order), kind="stable")


def by_device(rows: DataFrame) -> GroupedData:
    """Grouped by the device as text. pandas turns whole numbers into floats where some
    are null, and a float is another key, so a number can't be the key."""
    return rows.withColumn("_device", F.coalesce(F.col("device_id").cast("string"), F.lit(""))).groupBy("_device")


def device_of(key: tuple[str]) -> int | None:
    return int(key[0]) if key[0] else None


#: Groups that devices are dealt to. Like the state's partitions it is fixed for a stream.
GROUPS = 256
# Spark hands rows on as named tuples, which don't keep names that begin with a line.
DEVICE = "device_text"


def by_group(rows: DataFrame, groups: int = GROUPS) -> GroupedData:
    """Grouped by a hash of the device; the device as text goes along."""
    device = F.coalesce(F.col("device_id").cast("string"), F.lit(""))
    group = F.pmod(F.xxhash64(DEVICE), F.lit(groups)).cast("int")
    return rows.withColumn(DEVICE, device).withColumn("_group", group).groupBy("_group")


def devices_of(rows: pd.DataFrame, key: tuple) -> pd.Series:
    """Each row's device as text; rows that don't tell are of the one the key names."""
    return rows[DEVICE] if DEVICE in rows else pd.Series(str(key[0]), rows.index)


def with_device(rows: pd.DataFrame, key: tuple) -> pd.DataFrame:
    codes, names = pd.factorize(devices_of(rows, key))
    return rows.assign(device_id=pd.array([device_of((name,)) for name in names], "Int64").take(codes))


class Windows:
    """The last values of each device of a group, kept packed."""

    def __init__(self, names: Sequence[str], length: int):
        self.names, self.length = list(names), length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("window", "rows binary")

    def means(self, device: pd.Series, values: pd.DataFrame) -> dict[str, np.ndarray]:
        """Mean of the device's last values at each arrival, absent ones (nan) left out.
        Adds from the oldest on, as a row frame does."""
        fresh = values[self.names].astype(float).assign(**{DEVICE: device.astype(object)})
        kept = _unpacked(bytes(self.kept.get()[0])) if self.kept.exists() else fresh.iloc[:0]
        known = kept[DEVICE].isin(device.unique()).to_numpy(bool)
        both = pd.concat([kept[known], fresh], ignore_index=True) if known.any() else fresh.reset_index(drop=True)
        codes = pd.factorize(both[DEVICE])[0]
        order = np.argsort(codes, kind="stable")
        counts = np.bincount(codes)
        ends = np.repeat(np.cumsum(counts), counts)
        at = np.arange(len(both))
        nth = at - (ends - np.repeat(counts, counts))
        out = {}
        for name in self.names:
            line = both[name].to_numpy(float)[order]
            total, count = np.zeros(len(line)), np.zeros(len(line), int)
            for back in range(self.length - 1, -1, -1):
                taken = line[np.maximum(at - back, 0)]
                present = (nth >= back) & ~np.isnan(taken)
                total = np.where(present, total + np.where(present, taken, 0.0), total)
                count += present
            mean = np.empty(len(line))
            mean[order] = np.divide(total, count, out=np.full(len(line), np.nan), where=count > 0)
            out[name] = mean[known.sum() :]
        last = both.iloc[order[ends - at < self.length]]
        self.kept.update((_packed(pd.concat([kept[~known], last]) if not known.all() else last),))
        return out


def half_up(value: float, digits: int) -> float:
    """Rounded as ``F.round`` does it, by the shortest decimal form of the number."""
    if not np.isfinite(value):
        return value
    return float(Decimal(repr(float(value))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def is_below(values: np.ndarray, bound: float, digits: int) -> np.ndarray:
    """Whether each value, rounded, lies below a bound. Only values within a unit of the
    last digit of it need their decimal form."""
    found = values < bound
    for i in np.flatnonzero(np.abs(values - bound) <= 10.0**-digits):
        found[i] = half_up(values[i], digits) < bound
    return found


#: Span of a bucket: what a device sends in it is held and sorted at once.
WIDTH = "10 minutes"
LATE = "late"


def _micros(span: str) -> int:
    return pd.Timedelta(span).value // 1000


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_pandas()


def _by_device(batches: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """Rows in order, each device's together."""
    rows = pd.concat(list(batches), ignore_index=True)
    if DEVICE not in rows:
        return rows.sort_values(list(order), kind="stable")
    nth = pd.factorize(rows[DEVICE])[0]
    return rows.assign(_nth=nth).sort_values(["_nth", *order], kind="stable").drop(columns="_nth")


class Step(Protocol):
    """What is done with the rows of a group's devices."""

    order: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None: ...

    def feed(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame | None:
        """Each device's rows together and in order, following all that were fed before."""

    def late(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows that can't take part any more, as they are told of."""


class AsArrived(StatefulProcessor):
    """Feeds a step with the rows of each micro-batch, sorted."""

    def __init__(self, step: Step):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.step.init(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if (out := self.step.feed(key, _by_device(rows, *self.step.order))) is not None:
            yield out

    def close(self) -> None:
        pass


class InOrder(StatefulProcessor):
    """Feeds a step in the order of time, one bucket after the other.

    A row's time is ``at``, in microseconds. The rows of a bucket are kept in parts, one
    for each batch of rows that brought some, so a bucket that grows is not read again.
    """

    def __init__(self, step: Step, width: str = WIDTH):
        self.step, self.width = step, max(1000, _micros(width) // 1000 * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "bucket bigint", "n int")
        self.held = handle.getMapState("held", "bucket bigint, part int", "rows binary")
        # The newest bucket given on, and that of each device.
        self.passed = handle.getValueState("passed", "newest bigint, devices binary")
        self.step.init(handle)

    def _passed(self) -> tuple[int | None, pd.Series]:
        if not self.passed.exists():
            return None, pd.Series(dtype="int64")
        newest, devices = self.passed.get()
        known = _unpacked(bytes(devices))
        return newest, pd.Series(known["bucket"].to_numpy(), known[DEVICE])

    def _pass(self, key, bucket: int, rows: pd.DataFrame) -> None:
        newest, known = self._passed()
        given = pd.Series(bucket, devices_of(rows, key).unique())
        known = pd.concat([known[~known.index.isin(given.index)], given]) if len(known) else given
        packed = _packed(pd.DataFrame({DEVICE: known.index.astype(object), "bucket": known.to_numpy()}))
        self.passed.update((bucket if newest is None else max(newest, bucket), packed))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = self.passed.get()[0] if self.passed.exists() else None
        for arrived in rows:
            buckets = arrived["at"] // self.width
            late = buckets.isna()
            if newest is not None and (buckets <= newest).any():
                late |= buckets <= devices_of(arrived, key).map(self._passed()[1])
            if late.any():
                yield self.step.late(key, arrived[late])
                arrived, buckets = arrived[~late], buckets[~late]
            for bucket, part in arrived.groupby(buckets):
                bucket = int(bucket)
                n = self.parts.getValue((bucket,))[0] if self.parts.containsKey((bucket,)) else 0
                if not n:
                    self.handle.registerTimer((bucket + 1) * self.width // 1000)
                self.held.updateValue((bucket, n), (_packed(part),))
                self.parts.updateValue((bucket,), (n + 1,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.width - 1
        for bucket in sorted(bucket for (bucket,) in self.parts.keys() if bucket <= until):
            (n,) = self.parts.getValue((bucket,))
            parts = (_unpacked(bytes(self.held.getValue((bucket, i))[0])) for i in range(n))
            rows = _by_device(parts, *self.step.order)
            out = self.step.feed(key, rows)
            for i in range(n):
                self.held.removeKey((bucket, i))
            self.parts.removeKey((bucket,))
            self._pass(key, bucket, rows)
            if out is not None:
                yield out

    def close(self) -> None:
        pass


class MovingMean:
    """Keeps a device's last values of some columns; other columns pass through. Rows that
    are late keep their own values."""

    order = ("ts", "seq")

    def __init__(self, columns: dict[str, str], length: int, marked: bool):
        self.columns, self.marked = columns, marked
        self.windows = Windows(columns, length)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows.init(handle)

    def feed(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        means = self.windows.means(devices_of(rows, key), rows)
        smoothed = {out: means[name] for name, out in self.columns.items()}
        return with_device(rows, key).assign(**smoothed, **({LATE: False} if self.marked else {}))

    def late(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        absent = {out: np.nan for out in self.columns.values() if out not in rows}
        return with_device(rows, key).assign(**absent, late=True)


def moving_mean(
    readings: DataFrame,
    columns: dict[str, str],
    length: int = C.SMOOTHING_ROWS,
    digits: int | None = None,
    delay: str | None = None,
    width: str = WIDTH,
    groups: int = GROUPS,
) -> DataFrame:
    """Means over the last readings by arrival, the current one included; with a
    ``delay`` by time, and a column ``late``: true for readings that came too late."""
    use_state_store(readings.sparkSession)
    added = [T.StructField(out, T.DoubleType()) for out in columns.values() if out not in readings.columns]
    step = MovingMean(columns, length, delay is not None)
    schema = T.StructType([*readings.schema.fields, *added])
    if delay is None:
        smoothed = by_group(readings, groups).transformWithStateInPandas(
            AsArrived(step), outputStructType=schema, outputMode="Append", timeMode="None"
        )
    else:
        schema = schema.add("at", T.LongType()).add(LATE, T.BooleanType())
        smoothed = _in_order(readings.withWatermark("ts", delay), step, schema, width, groups).drop("at")
    if digits is None:
        return smoothed
    return smoothed.withColumns({out: F.round(out, digits) for out in columns.values()})


def _in_order(rows: DataFrame, step: Step, schema: T.StructType | str, width: str, groups: int) -> DataFrame:
    # The column that carries the watermark would let Spark drop late rows unseen.
    unmarked = F.timestamp_micros(F.unix_micros("ts")).alias("ts")
    timed = rows.withColumns({"ts": unmarked, "at": F.unix_micros("ts")})
    return by_group(timed, groups).transformWithStateInPandas(
        InOrder(step, width), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def smooth_ingest(
    http: DataFrame, digits: int | None = 2, delay: str | None = None, width: str = WIDTH
) -> DataFrame:
    """Final form of network readings: pH and conductivity smoothed."""
    means = {"ph": "ph", "conductivity": "conductivity"}
    smoothed = moving_mean(http, means, digits=digits, delay=delay, width=width)
    return smoothed.withColumn("eletrocondutividade", F.col("conductivity"))


class OfflineSpans(StatefulProcessor):
    """Keeps a device's last arrival, and a timer for its silence."""

    def __init__(self, limit_us: int):
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, timer bigint")

    def _spans(self, key, spans: list[tuple[int, int | None]]) -> pd.DataFrame:
        return pd.DataFrame(
            [(device_of(key), start, end) for start, end in spans],
            columns=["device_id", "from_us", "until_us"],
        ).astype({"device_id": "Int64", "from_us": "int64", "until_us": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, timer = self.last.get() if self.last.exists() else (None, None)
        if timer is not None:
            self.handle.deleteTimer(timer)
        spans = []
        for at in _sorted(rows, "at", "seq")["at"].tolist():
            if last is not None and at - last > self.limit_us:
                spans.append((last + self.limit_us, at))
            last = at if last is None else max(last, at)
        timer = (last + self.limit_us) // 1000 + 1
        self.handle.registerTimer(timer)
        self.last.update((last, timer))
        if spans:
            yield self._spans(key, spans)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _ = self.last.get()
        self.last.update((last, None))
        yield self._spans(key, [(last + self.limit_us, None)])

    def close(self) -> None:
        pass


def offline_spans(
    readings: DataFrame,
    offline_after: float = C.OFFLINE_AFTER_SECONDS,
    delay: str = "0 seconds",
) -> DataFrame:
    """Silences as they are noticed.

    A device which is silent when the watermark passes its limit gives a span
    without end; once it reports again the same span comes again with its end.
    """
    use_state_store(readings.sparkSession)
    asked = readings.select("device_id", "seq", "ts", F.unix_micros("ts").alias("at"))
    spans = by_device(asked.withWatermark("ts", delay)).transformWithStateInPandas(
        OfflineSpans(int(offline_after * SECOND)),
        outputStructType="device_id bigint, from_us bigint, until_us bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    return spans.select(
        "device_id",
        F.timestamp_micros("from_us").alias("offline_from"),
        F.timestamp_micros("until_us").alias("offline_until"),
    )


def settled_spans(spans: DataFrame) -> DataFrame:
    """One row per span of a table of noticed spans, ended where an end is known."""
    return spans.groupBy("device_id", "offline_from").agg(
        F.max("offline_until").alias("offline_until")
    )


class PumpControl:
    """Smooths conductivity and runs the control rules, device by device; rows that are late
    give an action ``late``."""

    order = ("at", "kind", "seq")

    def __init__(self, rules: Rules, length: int):
        self.rules, self.windows = rules, Windows(["conductivity"], length)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pumps = handle.getValueState("pumps", "devices binary")
        self.windows.init(handle)

    def feed(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame | None:
        device = devices_of(rows, key)
        is_read = (rows["kind"] == READING).to_numpy()
        low = np.zeros(len(rows), bool)
        if is_read.any():
            means = self.windows.means(device[is_read], rows[is_read])["conductivity"]
            low[is_read] = is_below(means, self.rules.dose_below, 2)
        pumps = {}
        if self.pumps.exists():
            known = _unpacked(bytes(self.pumps.get()[0]))
            pumps = dict(zip(known[DEVICE].tolist(), zip(*[known[name].tolist() for name in Controller.FIELDS])))
        controller, of, out = Controller(self.rules), None, []
        columns = ["at", "kind", "circ", "auto", "circ_auto"]
        for i, (name, is_low, at, kind, *flags) in enumerate(
            zip(device.tolist(), low.tolist(), *[rows[column].tolist() for column in columns])
        ):
            if name != of:
                if of is not None:
                    pumps[of] = controller.state()
                controller, of = Controller(self.rules, *([pumps[name]] if name in pumps else [])), name
            if kind == CONFIG:
                controller.configure(at, *[int(flag) for flag in flags])
                continue
            for action, off_at, wait in controller.read(at, is_low):
                out.append((i, action, off_at, wait))
        pumps[of] = controller.state()
        states = pd.DataFrame(list(pumps.values()), columns=list(Controller.FIELDS))
        self.pumps.update((_packed(states.assign(**{DEVICE: list(pumps)})),))
        if not out:
            return None
        places, *done = zip(*out)
        return with_device(rows.iloc[list(places)], key).assign(**dict(zip(ACTION[3:], done)))[ACTION]

    def late(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return with_device(rows, key).assign(action=LATE, off_at=NEVER, wait_us=0)[ACTION]


ACTION = ["device_id", "seq", "at", "action", "off_at", "wait_us"]


def pump_actions(
    readings: DataFrame,
    config_log: DataFrame,
    rules: Rules = Rules(),
    length: int = C.SMOOTHING_ROWS,
    delay: str | None = None,
    width: str = WIDTH,
    groups: int = GROUPS,
) -> DataFrame:
    """Actions of the control rules on unsmoothed readings and configuration writes.

    Without a ``delay`` rows count as of their arrival; with one each reading meets the
    flags in force at its time, however the files of the two inputs are split and aligned,
    and rows of both that came too late are listed by an action ``late``.
    """
    use_state_store(readings.sparkSession)
    flags = ("circ", "auto", "circ_auto")
    if delay is not None:
        readings, config_log = (rows.withWatermark("ts", delay) for rows in (readings, config_log))
    read = readings.select(
        "device_id", "seq", "ts", F.lit(READING).alias("kind"), "conductivity",
        *[F.lit(0).alias(name) for name in flags],
    )
    written = config_log.select(
        "device_id", "seq", "ts", F.lit(CONFIG).alias("kind"),
        F.lit(None).cast("double").alias("conductivity"), *flags,
    )
    both, step = read.unionByName(written), PumpControl(rules, length)
    schema = "device_id bigint, seq bigint, at bigint, action string, off_at bigint, wait_us bigint"
    if delay is None:
        timed = both.withColumn("at", F.unix_micros("ts")).drop("ts")
        done = by_group(timed, groups).transformWithStateInPandas(
            AsArrived(step), outputStructType=schema, outputMode="Append", timeMode="None"
        )
    else:
        done = _in_order(both, step, schema, width, groups)
    return done.select(
        "device_id",
        "seq",
        F.timestamp_micros("at").alias("ts"),
        "action",
        F.when(F.col("off_at") != NEVER, F.timestamp_micros("off_at")).alias("off_ts"),
        "wait_us",
    )
