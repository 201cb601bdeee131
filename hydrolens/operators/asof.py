"""As-of lookup: each row with what a log last said by then.

:func:`as_of` is a union with the log and one window per device, cut into slices for
hot devices; it suits any sizes. :func:`broadcast_as_of` is for a caller who knows the
log to be small: its sorted histories are broadcast and searched, so the rows are not
shuffled. It refuses a larger log. Both give the same rows; a null device is a device
like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrolens.operators.slicing import DEVICE, carry, common_cuts, join_same, locate, place

# Rows of a log which may be broadcast, some ten megabytes.
BROADCAST_ROWS = 200_000


def as_of(
    rows: DataFrame,
    log: DataFrame,
    fields: Sequence[str],
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Adds to each row the last value of every field the log held by then.

    Fields are looked up one by one, absent values left out. A log entry at the
    same time as a row counts as earlier.
    """
    return over_events(rows, log, fields, common_cuts(rows, log, rows_per_slice))


def broadcast_as_of(rows: DataFrame, log: DataFrame, fields: Sequence[str]) -> DataFrame:
    """:func:`as_of` by a broadcast of the log; an error if it is too large for that."""
    if log.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"the log has more than {BROADCAST_ROWS} rows; use as_of")
    past = Window.partitionBy(DEVICE).orderBy("ts", "seq")
    past = past.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.struct(*[F.last(name, ignorenulls=True).over(past).alias(name) for name in fields])
    entries = log.select(
        DEVICE,
        F.unix_micros("ts").alias("at"),
        F.row_number().over(Window.partitionBy(DEVICE).orderBy("ts", "seq")).alias("_position"),
        state.alias("_found"),
    )
    times = entries.groupBy(DEVICE).agg(F.array_sort(F.collect_list("at")).alias("times"))
    states = entries.select(DEVICE, "_position", "_found")
    placed = locate(rows, times, BROADCAST_ROWS, F.unix_micros("ts"), "_position")
    found = join_same(placed, F.broadcast(states), [DEVICE, "_position"], "left")
    return found.select(*rows.columns, *[F.col(f"_found.{name}").alias(name) for name in fields])


def over_events(
    rows: DataFrame, log: DataFrame, fields: Sequence[str], cuts: DataFrame | None
) -> DataFrame:
    """:func:`as_of` by a union with the log and one window; no join of rows."""
    names = rows.columns
    asked = rows.withColumn("_kind", F.lit(1))
    known = log.select(DEVICE, "ts", "seq", *fields).withColumn("_kind", F.lit(0))
    events = asked.unionByName(known, allowMissingColumns=True)
    keys = [DEVICE]
    if cuts is not None:
        keys = [DEVICE, "slice"]
        carried = carry(place(known, cuts), cuts, fields)
        events = place(events, cuts).drop("is_hot").unionByName(carried, allowMissingColumns=True)
    past = Window.partitionBy(*keys).orderBy("ts", "_kind", "seq")
    past = past.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = [F.last(name, ignorenulls=True).over(past).alias(name) for name in fields]
    answered = events.select(*names, "_kind", *found)
    return answered.filter(F.col("_kind") == 1).select(*names, *fields)
