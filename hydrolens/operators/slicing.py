"""Ordered work per device without putting a hot device into one task.

Row frames, previous-row lookups and as-of lookups need each device's rows in
order. A plain window partitioned by device is right for almost all devices,
but one device may hold a large part of all rows. Such a *hot* device is cut by
time into slices of about equal row counts, and each slice gets what it needs
from the earlier ones: its last few rows (a halo) or the last known state (a
carry). Results equal the plain window's, row for row.

Which devices are hot is found by one pre-aggregated count. The cut points are
at most ``2 * MAX_SLICES`` numbers overall, whatever the size of the data, so
they can be broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hydrolens.session import written

DEVICE = "device_id"
ROWS_PER_SLICE = 5_000_000
MAX_SLICES = 100_000
MAX_SLICES_PER_DEVICE = 2**14


def join_same(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on equal keys, null keys included; the left table's keys are kept."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    same = F.lit(True)
    for key in keys:
        same = same & left[key].eqNullSafe(renamed[f"_right_{key}"])
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{k}" for k in keys])


def hot_cuts(rows: DataFrame, rows_per_slice: int | None = None) -> DataFrame | None:
    """``(device_id, cuts)`` for the hot devices of ``rows``; None without any.

    ``cuts`` are rising event times in microseconds. They are written to a table,
    so that all uses of them, and tasks run again after a loss, see the same ones.
    """
    counts = rows.groupBy(DEVICE).count()
    total, hottest = counts.agg(F.sum("count"), F.max("count")).first()
    if not total:
        return None
    target = max(rows_per_slice or ROWS_PER_SLICE, math.ceil(total / MAX_SLICES))
    if hottest <= target:
        return None
    steps = math.ceil(math.log2(min(hottest / target, MAX_SLICES_PER_DEVICE)))
    classes = [2**step for step in range(1, max(steps, 1) + 1)]
    exponent = F.ceil(F.log2(F.col("count") / F.lit(target)))
    wanted = F.least(F.lit(classes[-1]), F.pow(F.lit(2), exponent)).cast("int")
    hot = counts.filter(F.col("count") > target).select(DEVICE, wanted.alias("slices"))
    micros = F.unix_micros("ts")

    def quantiles(slices: int) -> Column:
        fractions = [i / slices for i in range(1, slices)]
        own = F.when(F.col("slices") == slices, micros)
        return F.percentile_approx(own, fractions, max(10_000, 10 * slices))

    cuts = F.array_distinct(F.coalesce(*[quantiles(slices) for slices in classes]))
    of_hot = join_same(rows.select(DEVICE, "ts"), F.broadcast(hot), [DEVICE])
    return written(of_hot.groupBy(DEVICE).agg(cuts.alias("cuts")), "cuts")


# Times one search step looks at. Rows joined with their device's times carry a
# copy of them, so these arrays are kept short by searching in two steps.
STRIDE = 256


def _count_until(micros: Column, times: Column, most: int) -> Column:
    """How many of at most ``most`` rising times lie at or before a time."""
    widths = [F.lit(1 << i) for i in reversed(range(most.bit_length()))]

    def advance(found: Column, step: Column) -> Column:
        # Beyond the last time this is null, and the step is not taken.
        return F.when(F.get(times, found + step - 1) <= micros, found + step).otherwise(found)

    return F.aggregate(F.array(*widths), F.lit(0), advance)


def locate(rows: DataFrame, times: DataFrame, most: int, at: Column, name: str) -> DataFrame:
    """Adds how many of its device's ``times`` lie at or before ``at``.

    The number is null for a device which has no times.

    ``times`` holds one rising array of at most ``most`` microseconds per device
    and is broadcast: first every STRIDE-th time, then the stretch in between.
    """
    starts = F.sequence(F.lit(0), F.size("times") - 1, F.lit(STRIDE))
    coarse = times.filter(F.size("times") > 0).select(
        DEVICE, F.transform(starts, lambda i: F.get("times", i)).alias("_coarse")
    )
    fine = times.filter(F.size("times") > 0).select(
        DEVICE, "times", F.posexplode(starts).alias("_stretch", "_first")
    )
    fine = fine.select(
        DEVICE,
        (F.col("_stretch") + 1).alias("_stretch"),
        F.slice("times", F.col("_first") + 1, F.lit(STRIDE)).alias("_fine"),
    )
    stretch = _count_until(at, F.col("_coarse"), -(-most // STRIDE))
    within = _count_until(at, F.col("_fine"), STRIDE)
    position = F.when(F.col("_stretch") > 0, (F.col("_stretch") - 1) * STRIDE + within)
    none_yet = F.when(F.col("_stretch") == 0, F.lit(0))
    return (
        join_same(
            join_same(rows, F.broadcast(coarse), [DEVICE], "left").select(
                *rows.columns, F.when(F.col("_coarse").isNotNull(), stretch).alias("_stretch")
            ),
            F.broadcast(fine),
            [DEVICE, "_stretch"],
            "left",
        ).select(*rows.columns, F.coalesce(position, none_yet).alias(name))
    )


def place(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``slice`` (0 for all rows of other devices) and ``is_hot``."""
    times = cuts.withColumnRenamed("cuts", "times")
    placed = locate(rows, times, MAX_SLICES_PER_DEVICE, F.unix_micros("ts"), "_slice")
    return placed.select(
        *rows.columns,
        F.coalesce("_slice", F.lit(0)).alias("slice"),
        F.col("_slice").isNotNull().alias("is_hot"),
    )


def _ordered(order: Sequence[str], forward: bool) -> list[Column]:
    return [F.col(name).desc() if forward else F.col(name).asc() for name in order]


def over_rows(
    rows: DataFrame,
    add: Callable[[DataFrame, WindowSpec], DataFrame],
    reach: int,
    by: Sequence[str] = (DEVICE,),
    order: Sequence[str] = ("ts", "seq"),
    forward: bool = False,
    rows_per_slice: int | None = None,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Window columns which look at most ``reach`` rows back (or forward).

    ``add`` gets the rows and the ordered window to use; with ``forward`` the
    window runs backwards in time, so "preceding" means later. ``sized_by`` is a
    table whose device counts stand for those of ``rows`` where these are costly
    to count; cuts decide only on balance, never on results.
    """
    direction = _ordered(order, forward)
    cuts = hot_cuts(rows if sized_by is None else sized_by, rows_per_slice)
    if cuts is None:
        return add(rows, Window.partitionBy(*by).orderBy(*direction))

    placed = place(rows, cuts)
    side = F.col("slice").desc() if forward else F.col("slice").asc()
    from_end = Window.partitionBy(*by, "slice").orderBy(*_ordered(order, not forward))
    ends = (
        placed.filter("is_hot")
        .withColumn("_rank", F.row_number().over(from_end))
        .filter(F.col("_rank") <= reach)
        .drop("_rank")
    )
    following = Window.partitionBy(*by).orderBy(side, *direction).rowsBetween(1, reach)
    needed_in = F.array_distinct(F.collect_list("slice").over(following))
    halo = (
        ends.withColumn("_needed_in", needed_in)
        .withColumn("_to", F.explode("_needed_in"))
        .filter(F.col("_to") != F.col("slice"))
        .withColumn("slice", F.col("_to"))
        .drop("_to", "_needed_in")
    )
    both = placed.withColumn("_halo", F.lit(False)).unionByName(
        halo.withColumn("_halo", F.lit(True))
    )
    done = add(both, Window.partitionBy(*by, "slice").orderBy(*direction))
    return done.filter(~F.col("_halo")).drop("_halo", "slice", "is_hot")


def common_cuts(
    rows: DataFrame, log: DataFrame, rows_per_slice: int | None = None
) -> DataFrame | None:
    """Cuts for two tables which are processed together."""
    return hot_cuts(
        rows.select(DEVICE, "ts").unionByName(log.select(DEVICE, "ts")), rows_per_slice
    )


def carry(log: DataFrame, cuts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One entry at the start of each later slice: the state of all before it."""
    when = F.struct("ts", "seq")
    last = log.filter("is_hot").groupBy(DEVICE, "slice").agg(
        *[
            F.max_by(name, F.when(F.col(name).isNotNull(), when)).alias(name)
            for name in fields
        ]
    )
    slices = cuts.select(DEVICE, F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("slice"))
    before = (
        Window.partitionBy(DEVICE).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    filled = join_same(slices, last, [DEVICE, "slice"], "left").select(
        DEVICE,
        "slice",
        *[F.last(name, ignorenulls=True).over(before).alias(name) for name in fields],
    )
    # A null time sorts first, so a carried entry opens its slice.
    return filled.filter(F.col("slice") > 0).select(
        "*",
        F.lit(None).cast("timestamp").alias("ts"),
        F.lit(None).cast("bigint").alias("seq"),
        F.lit(0).alias("_kind"),
    )
