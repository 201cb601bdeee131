"""pH calibration from stored points: log, live points, line, calibrated readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolens import constants as C
from hydrolens.functions import units
from hydrolens.operators.asof import as_of, over_events
from hydrolens.operators.slicing import DEVICE, common_cuts, join_same, place
from hydrolens.session import written


def points_from_requests(
    requests: DataFrame,
    readings: DataFrame,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Calibration entries from requests which name a known pH.

    The voltage comes from the device's latest state: its raw pH, else its pH,
    else 0. A request before the device's first reading yields no entry.
    """
    log = readings.select(DEVICE, "seq", "ts", "raw_ph", "ph", F.lit(True).alias("seen"))
    answered = as_of(requests, log, ["raw_ph", "ph", "seen"], rows_per_slice)
    measured = F.coalesce("raw_ph", "ph", F.lit(0.0))
    return answered.filter("seen").select(
        DEVICE,
        "seq",
        "ts",
        F.lit("add").alias("op"),
        units.ph_to_volts(measured).alias("voltage"),
        F.col("known_ph").alias("ph"),
    )


def live_points(log: DataFrame) -> DataFrame:
    """Points in force: those since the device's last reset, newest per voltage.

    Entries without a readable voltage or pH are skipped.
    """
    resets = log.filter(F.col("op") == "reset").groupBy(DEVICE)
    resets = resets.agg(F.max("seq").alias("reset_seq"))
    added = log.filter(
        (F.col("op") == "add") & F.col("voltage").isNotNull() & F.col("ph").isNotNull()
    )
    in_force = join_same(added, resets, [DEVICE], "left").filter(
        F.col("reset_seq").isNull() | (F.col("seq") > F.col("reset_seq"))
    )
    return in_force.groupBy(DEVICE, "voltage").agg(F.max_by("ph", "seq").alias("ph"))


def status(points: DataFrame) -> DataFrame:
    """Point count per device and whether two points or more calibrate it."""
    counted = points.groupBy(DEVICE).agg(F.count(F.lit(1)).alias("points_count"))
    return counted.withColumn("is_calibrated", F.col("points_count") >= 2)


def report(points: DataFrame) -> DataFrame:
    """The points in force, each with the status of its device."""
    count = F.count(F.lit(1)).over(Window.partitionBy(DEVICE))
    return points.withColumn("points_count", count).withColumn(
        "is_calibrated", F.col("points_count") >= 2
    )


def _line(v_low: Column, ph_low: Column, v_high: Column, ph_high: Column) -> Column:
    """Slope and intercept: through the outermost points, or the standard slope."""
    rise = (ph_high - ph_low) / F.nullif(v_high - v_low, F.lit(0.0))
    slope = F.when(v_low.isNotNull(), F.coalesce(rise, F.lit(C.ONE_POINT_PH_SLOPE)))
    return F.struct(slope.alias("slope"), (ph_low - slope * v_low).alias("intercept"))


def line(points: DataFrame) -> DataFrame:
    """The calibration line of each device which has points."""
    ends = points.groupBy(DEVICE).agg(
        F.count(F.lit(1)).alias("points_count"),
        F.min("voltage").alias("v_low"),
        F.min_by("ph", "voltage").alias("ph_low"),
        F.max("voltage").alias("v_high"),
        F.max_by("ph", "voltage").alias("ph_high"),
    )
    fitted = _line(F.col("v_low"), F.col("ph_low"), F.col("v_high"), F.col("ph_high"))
    return ends.select(DEVICE, "points_count", fitted.alias("line")).select(
        DEVICE, "points_count", "line.slope", "line.intercept"
    )


def calibrated(ph: Column, slope: Column, intercept: Column, digits: int | None = 2) -> Column:
    """pH on the device's line; unchanged where there is no line."""
    value = slope * units.ph_to_volts(ph) + intercept
    value = value if digits is None else F.round(value, digits)
    return F.when(slope.isNull(), ph).otherwise(value)


def apply_current(
    readings: DataFrame, points: DataFrame, digits: int | None = 2
) -> DataFrame:
    """Readings on the line in force now; one row of lines per device, so AQE
    broadcasts it where it is small and splits skewed readings where it is not."""
    joined = join_same(readings, line(points).drop("points_count"), [DEVICE], "left")
    value = calibrated(F.col("raw_ph"), F.col("slope"), F.col("intercept"), digits)
    return joined.withColumn("calibrated_ph", value)


def line_history(log: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """The line in force after each log entry.

    Within one stretch between resets the line needs only the outermost points
    so far, so running extremes are enough and no point list is kept. ``cuts``
    are those of hot devices.
    """
    log = log.filter(
        (F.col("op") == "reset") | (F.col("voltage").isNotNull() & F.col("ph").isNotNull())
    ).select(DEVICE, "seq", "ts", "op", "voltage", "ph")
    keys = [DEVICE]
    entries = log.withColumn("_carried", F.lit(False))
    if cuts is not None:
        keys = [DEVICE, "slice"]
        placed = place(log, cuts)
        carried = _carried_points(placed.filter("is_hot"), cuts)
        entries = placed.drop("is_hot").withColumn("_carried", F.lit(False)).unionByName(carried)
    in_order = Window.partitionBy(*keys).orderBy("ts", "seq")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    resets = F.count_if(F.col("op") == "reset").over(in_order.rowsBetween(*so_far))
    stretch = Window.partitionBy(*keys, "stretch").orderBy("ts", "seq").rowsBetween(*so_far)
    lowest, highest = _outermost()
    known = entries.withColumn("stretch", resets).select(
        DEVICE, "seq", "ts", "_carried",
        lowest.over(stretch).alias("low"),
        highest.over(stretch).alias("high"),
    )
    fitted = _line(F.col("low.v"), F.col("low.p"), F.col("high.v"), F.col("high.p"))
    return known.filter(~F.col("_carried")).select(DEVICE, "seq", "ts", fitted.alias("line"))


def _outermost() -> tuple[Column, Column]:
    """Points at the lowest and highest voltage; of equal voltages the newest."""
    voltage, seq = F.col("voltage"), F.col("seq")
    point = F.struct(voltage.alias("v"), F.col("ph").alias("p"), seq.alias("s"))
    added = voltage.isNotNull()
    return (
        F.min_by(point, F.when(added, F.struct(voltage, -seq))),
        F.max_by(point, F.when(added, F.struct(voltage, seq))),
    )


def _carried_points(hot: DataFrame, cuts: DataFrame) -> DataFrame:
    """For each later slice the outermost points in force when it starts.

    At most one row per slice is aggregated, joined and ordered here.
    """
    at = F.struct("ts", "seq")
    cleared = hot.filter(F.col("op") == "reset").groupBy(DEVICE, "slice")
    cleared = cleared.agg(F.max(at).alias("cleared"))
    lowest, highest = _outermost()
    ends = (
        hot.filter(F.col("op") == "add")
        .transform(lambda added: join_same(added, F.broadcast(cleared), [DEVICE, "slice"], "left"))
        .filter(F.col("cleared").isNull() | (at > F.col("cleared")))
        .groupBy(DEVICE, "slice")
        .agg(lowest.alias("low"), highest.alias("high"))
    )
    slices = cuts.select(DEVICE, F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("slice"))
    states = join_same(slices, cleared, [DEVICE, "slice"], "left")
    states = join_same(states, ends, [DEVICE, "slice"], "left")
    past = Window.partitionBy(DEVICE).orderBy("slice")
    past = past.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = Window.partitionBy(DEVICE, "stretch").orderBy("slice")
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def newest(point: str, extreme, sign: int) -> Column:
        order = F.struct(F.col(f"{point}.v"), sign * F.col(f"{point}.s"))
        return extreme(point, F.when(F.col(point).isNotNull(), order)).over(within)

    running = states.withColumn("stretch", F.count("cleared").over(past)).select(
        DEVICE,
        (F.col("slice") + 1).alias("slice"),
        F.array(newest("low", F.min_by, -1), newest("high", F.max_by, 1)).alias("outermost"),
    ).withColumn("p", F.explode("outermost"))
    # A null time sorts first, so carried points open their slice.
    return running.filter(F.col("p").isNotNull()).select(
        DEVICE,
        F.col("p.s").alias("seq"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.lit("add").alias("op"),
        F.col("p.v").alias("voltage"),
        F.col("p.p").alias("ph"),
        "slice",
        F.lit(True).alias("_carried"),
    )


def apply_as_of(
    readings: DataFrame,
    log: DataFrame,
    digits: int | None = 2,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Readings on the line which was in force at their time."""
    cuts = common_cuts(readings, log, rows_per_slice)
    history = line_history(log, cuts)
    if cuts is not None:
        # It is read twice then: as events and for the carried states.
        history = written(history, "calibration-lines")
    joined = over_events(readings, history, ["line"], cuts)
    value = calibrated(F.col("raw_ph"), F.col("line.slope"), F.col("line.intercept"), digits)
    return joined.withColumn("calibrated_ph", value).drop("line")
