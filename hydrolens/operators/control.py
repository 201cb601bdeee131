"""Pump control: dosing and circulation rules, pump timeline and run time.

Every decision depends on the previous accepted one, so the rules are a fold
over each device's events in time order. Around it everything is native: events
are joined with the flags in force and those which cannot act are removed
before the fold, and switch-offs are derived from the switch-ons after it.

A hot device is folded slice by slice at once, in two passes. The first takes each
slice through from every state it can be entered with (:mod:`~hydrolens.operators.seams`);
the maps from entries to exits, composed, give every slice's true entry. The second folds
each slice from that. The result is exact, whatever the rhythm of the readings. Where
readings lie so close that a seam has more than ``MOST_ENTRIES`` entries, slices are folded
in rounds instead: each from a guess (the flags in force, nothing pending), then from
the ends of the slices before that are new, as often as there are new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens import constants as C
from hydrolens.functions import units
from hydrolens.operators import seams
from hydrolens.operators.config import config_as_of
from hydrolens.operators.seams import NEVER
from hydrolens.operators.slicing import DEVICE, MAX_SLICES_PER_DEVICE, carry, common_cuts, join_same, locate, over_rows, place
from hydrolens.session import fresh_dir, written

# Kinds of events in their order at equal times.
TIMER, CONFIG, READING = 0, 1, 2
ENTRY = -1
# Entries of one seam up to which slices are taken through from all of them.
MOST_ENTRIES = 20_000

SECOND = 1_000_000


@dataclass(frozen=True)
class Rules:
    """Thresholds of the control rules, times in seconds."""

    dose_below: float = C.DOSE_BELOW_EC
    cooldown: float = C.DOSE_COOLDOWN_SECONDS
    dose_for: float = units.dose_seconds()
    cycle_every: float = C.CYCLE_PERIOD_SECONDS
    cycle_for: float = C.CYCLE_RUN_SECONDS

    def __post_init__(self) -> None:
        # Then at most one circulation switch-off is pending at any time.
        if self.cycle_for + self.dose_for > self.cycle_every:
            raise ValueError("a cycle and a dose must fit into the cycle period")

    def micros(self) -> dict[str, int]:
        names = ("cooldown", "dose_for", "cycle_every", "cycle_for")
        return {name: int(getattr(self, name) * SECOND) for name in names}


class Controller:
    """State of one device's pumps; fed with events in order."""

    FIELDS = ("circ", "auto", "circ_auto", "off_at", "last_dose", "last_cycle")

    def __init__(self, rules: Rules, state: tuple[int, ...] = (0, 0, 0, NEVER, NEVER, NEVER)):
        self.cooldown = int(rules.cooldown * SECOND)
        self.dose_for = int(rules.dose_for * SECOND)
        self.cycle_every = int(rules.cycle_every * SECOND)
        self.cycle_for = int(rules.cycle_for * SECOND)
        self.restore(state)

    def restore(self, state: tuple[int, ...]) -> None:
        self.circ, self.auto, self.circ_auto = state[:3]
        self.off_at, self.last_dose, self.last_cycle = state[3:]

    def state(self) -> tuple[int, ...]:
        return tuple(getattr(self, name) for name in self.FIELDS)

    def configure(self, at: int, circ: int, auto: int, circ_auto: int) -> None:
        self._expire(at)
        self.circ, self.auto, self.circ_auto = circ, auto, circ_auto

    def read(self, at: int, low: bool) -> list[tuple[str, int, int]]:
        """Actions of one reading as (action, switch-off time, microseconds to wait)."""
        self._expire(at)
        actions = []
        busy_until = at
        if self.auto and low:
            since = at - self.last_dose
            if not self.circ:
                self.circ = 1
                actions.append(("force_circ", NEVER, 0))
            elif self.last_dose != NEVER and since < self.cooldown:
                actions.append(("skip", NEVER, self.cooldown - since))
            else:
                self.last_dose = at
                busy_until = at + self.dose_for
                actions.append(("dose", busy_until, 0))
        if self.circ_auto and (
            self.last_cycle == NEVER or at - self.last_cycle > self.cycle_every
        ):
            self.circ = 1
            self.last_cycle = at
            # Switch-offs wait for one another, so a dose delays this one.
            self.off_at = busy_until + self.cycle_for
            actions.append(("cycle", self.off_at, 0))
        return actions

    def _expire(self, at: int) -> None:
        if self.off_at != NEVER and self.off_at <= at:
            self.circ = 0
            self.off_at = NEVER


_STATE_COLUMNS = (
    "circ int, auto int, circ_auto int, off_at bigint, last_dose bigint, last_cycle bigint"
)
_OUT_COLUMNS = ["device_id", "slice", "at", "seq", "action", "wait_us", *Controller.FIELDS]
_OUT_SCHEMA = (
    "device_id bigint, slice int, at bigint, seq bigint, action string, wait_us bigint, "
    + _STATE_COLUMNS
)
_IN_COLUMNS = ["device_id", "slice", "at", "kind", "seq", "low", "is_hot", *Controller.FIELDS]


def _fold(events: DataFrame, rules: Rules) -> DataFrame:
    """Runs the rules over rows clustered by device and slice and sorted by time.

    Rows stream through in Arrow batches with the state kept between batches;
    a hot device's slices end with a row of their final state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        controller, key, hot = Controller(rules), None, False

        def ending() -> list[tuple]:
            return [(*key, 0, 0, "exit", 0, *controller.state())] if hot else []

        for batch in batches:
            out: list[tuple] = []
            columns = [batch[name].tolist() for name in _IN_COLUMNS]
            for device, part, at, kind, seq, low, is_hot, *state in zip(*columns):
                if (device, part) != key:
                    out += ending()
                    controller, key, hot = Controller(rules), (device, part), is_hot
                if kind == READING:
                    for action, off_at, wait in controller.read(at, bool(low)):
                        now = (controller.circ, controller.auto, controller.circ_auto)
                        out.append((*key, at, seq, action, wait, *now, off_at, NEVER, NEVER))
                elif kind == CONFIG:
                    controller.configure(at, *state[:3])
                else:
                    controller.restore(tuple(state))
            if out:
                yield pd.DataFrame(out, columns=_OUT_COLUMNS)
        if out := ending():
            yield pd.DataFrame(out, columns=_OUT_COLUMNS)

    clustered = events.select(*_IN_COLUMNS).repartition(DEVICE, "slice")
    ordered = clustered.sortWithinPartitions(DEVICE, "slice", "at", "kind", "seq")
    return ordered.mapInPandas(run, _OUT_SCHEMA)


def _events(
    readings: DataFrame,
    config_log: DataFrame,
    rules: Rules,
    rows_per_slice: int | None,
) -> DataFrame:
    """Configuration writes, and the readings on which some rule may act."""
    judged = config_as_of(readings, config_log, rows_per_slice)
    low = F.coalesce(F.col("conductivity") < rules.dose_below, F.lit(False))
    may_act = ((F.col("auto") == 1) & low) | (F.col("circ_auto") == 1)
    acting = judged.filter(may_act).select(
        DEVICE, "ts", "seq", F.lit(READING).alias("kind"), low.cast("int").alias("low"), *Controller.FIELDS[:3]
    )
    writes = config_log.select(
        DEVICE, "ts", "seq", F.lit(CONFIG).alias("kind"), F.lit(0).alias("low"),
        *Controller.FIELDS[:3],
    )
    pending = [F.lit(NEVER).alias(name) for name in Controller.FIELDS[3:]]
    return acting.unionByName(writes).select("*", F.unix_micros("ts").alias("at"), *pending)


def actions(
    readings: DataFrame,
    config_log: DataFrame,
    rules: Rules = Rules(),
    rows_per_slice: int | None = None,
) -> DataFrame:
    """What the rules did: ``force_circ``, ``skip``, ``dose`` and ``cycle`` rows.

    ``conductivity`` of the readings is the smoothed one. ``off_ts`` is when the
    pump goes off again, ``wait_us`` the rest of the cooldown after a skip.
    """
    cuts = common_cuts(readings, config_log, rows_per_slice)
    events = _events(readings, config_log, rules, rows_per_slice)
    if cuts is None:
        whole = events.select("*", F.lit(0).alias("slice"), F.lit(False).alias("is_hot"))
        done = _fold(whole, rules)
    else:
        done = _fold_slices(place(events, cuts), cuts, config_log, rules)
    ended = F.when(F.col("off_at") != NEVER, F.timestamp_micros("off_at"))
    return done.select(
        DEVICE, "seq", F.timestamp_micros("at").alias("ts"), "action", ended.alias("off_ts"),
        "wait_us",
    )


def _fold_slices(
    placed: DataFrame, cuts: DataFrame, config_log: DataFrame, rules: Rules
) -> DataFrame:
    """Folds all slices, each from its true entry (see the module's text)."""
    placed = written(placed, "control-events")
    starts = cuts.select(DEVICE, F.posexplode("cuts").alias("slice", "start"))
    starts = written(starts.withColumn("slice", F.col("slice") + 1), "control-starts")
    config_at = place(config_log.select(DEVICE, "ts", "seq", *Controller.FIELDS[:3]), cuts)
    flags = carry(config_at, cuts, Controller.FIELDS[:3]).select(
        DEVICE, "slice", *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in Controller.FIELDS[:3]]
    )
    halo = _before_seams(placed, cuts, rules)
    dosing, cycling = F.count_if((F.col("low") == 1) & (F.col("auto") == 1)), F.count_if(F.col("circ_auto") == 1)
    most = halo.groupBy(DEVICE, "slice").agg((6 * (dosing + 1) * (cycling + 1)).alias("entries"))
    if (most.agg(F.max("entries")).first()[0] or 0) > MOST_ENTRIES:
        return _fold_in_rounds(placed.drop("ts"), cuts, starts, flags, rules)
    opened = starts.select(DEVICE, "slice", F.col("start").alias("at"))
    opened = opened.unionByName(cuts.select(DEVICE, F.lit(0).alias("slice"), F.lit(NEVER).alias("at")))
    opened = join_same(opened, flags, [DEVICE, "slice"], "left")
    ends = starts.select(DEVICE, (F.col("slice") - 1).alias("slice"), F.col("start").alias("off_at"))
    opened = join_same(opened, ends, [DEVICE, "slice"], "left").select(
        DEVICE, "slice", "at", "off_at", *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in Controller.FIELDS[:3]]
    )
    opened = written(opened, "control-openings")  # one row per slice
    # The last slice leads nowhere, so only the others are taken through.
    leading = opened.filter("off_at IS NOT NULL")
    rows = placed.filter("is_hot").drop("off_at").unionByName(halo.drop("off_at"), allowMissingColumns=True)
    rows = join_same(rows, F.broadcast(leading.select(DEVICE, "slice", "off_at")), [DEVICE, "slice"])
    opening = leading.withColumns({"kind": F.lit(seams.OPENING), "low": F.lit(0)})
    rows = rows.select(*seams.COLUMNS).unionByName(opening.select(*seams.COLUMNS))
    maps = written(seams.slice_maps(rows, CONFIG, rules.micros()), "control-maps")
    slices = cuts.agg(F.max(F.size("cuts"))).first()[0] + 1
    entered = join_same(seams.true_entries(maps, slices), flags.drop("circ"), [DEVICE, "slice"])
    entered = entered.select(
        DEVICE, "slice", F.lit(ENTRY).alias("kind"), F.lit(NEVER).alias("at"), F.lit(NEVER).alias("seq"),
        F.lit(0).alias("low"), F.lit(True).alias("is_hot"), F.col("circ").cast("int").alias("circ"), *Controller.FIELDS[1:],
    )
    return _fold(placed.drop("ts").unionByName(entered), rules).filter(F.col("action") != "exit")


def _before_seams(placed: DataFrame, cuts: DataFrame, rules: Rules) -> DataFrame:
    """Readings that may still count when a later slice starts, as rows of that slice."""
    reach = max(rules.micros()["cooldown"], rules.micros()["cycle_every"])
    acting = placed.filter(F.col("is_hot") & (F.col("kind") == READING))
    times = cuts.withColumnRenamed("cuts", "times")
    ahead = locate(acting, times, MAX_SLICES_PER_DEVICE, F.col("at") + reach, "_last")
    reached = ahead.filter(F.col("_last") > F.col("slice"))
    each = F.explode(F.sequence(F.col("slice") + 1, F.col("_last")))
    return reached.withColumn("slice", each).drop("_last").withColumn("kind", F.lit(seams.HALO))


def _fold_in_rounds(
    placed: DataFrame, cuts: DataFrame, starts: DataFrame, flags: DataFrame, rules: Rules
) -> DataFrame:
    """Folds all slices, and again for entry states not folded yet.

    A slice's end is the next slice's entry. What a slice does from an entry is folded
    once and kept, so rounds end when no end is a new entry: there are no more rounds
    than different states at a seam, however many slices there are. Then each device's
    slices are walked through once by their kept ends. Each round is a table below the
    shared folder, so a lost executor repeats only its own tasks. Only slices of hot
    devices (a bounded number) are ever compared, joined or folded again.
    """
    spark = placed.sparkSession
    keys = [DEVICE, "slice"]

    def entry_rows(states: DataFrame) -> DataFrame:
        return states.select(
            *keys, *Controller.FIELDS, F.lit(ENTRY).alias("kind"), F.lit(NEVER).alias("at"),
            F.lit(NEVER).alias("seq"), F.lit(0).alias("low"), F.lit(True).alias("is_hot"),
        )

    asked = flags.select(*keys, *Controller.FIELDS[:3], *[F.lit(NEVER).alias(name) for name in Controller.FIELDS[3:]])
    table, entries, ends = (
        fresh_dir(spark, f"control-{name}") for name in ("actions", "entries", "ends")
    )
    state = f"device_id bigint, slice int, {_STATE_COLUMNS}"
    same = [*keys, *Controller.FIELDS]
    asked.write.parquet(f"{entries}/round=0")
    asked = spark.read.schema(state).parquet(f"{entries}/round=0")
    events, number = placed, 0
    while True:
        folded = f"{table}/round={number}"
        _fold(events.unionByName(entry_rows(asked)), rules).write.parquet(folded)
        done = spark.read.schema(_OUT_SCHEMA).parquet(folded).filter(F.col("action") == "exit")
        left = done.select(DEVICE, (F.col("slice") + 1).alias("slice"), *Controller.FIELDS)
        # The last slice leads nowhere. Every other one has an entry row, so a slice
        # without events hands its state on.
        seams = join_same(left, F.broadcast(starts), keys)
        reached = seams.select(*keys, *[v.alias(n) for n, v in _remembered(rules).items()])
        reached.write.parquet(f"{ends}/round={number}")
        reached = spark.read.schema(state).parquet(f"{ends}/round={number}")
        known = spark.read.schema(f"{state}, round int").parquet(entries)
        number += 1
        join_same(reached, known, same, "left_anti").write.parquet(f"{entries}/round={number}")
        asked = spark.read.schema(state).parquet(f"{entries}/round={number}")
        if asked.isEmpty():
            break
        events = join_same(placed, F.broadcast(asked.select(*keys)), keys, "left_semi")

    known = spark.read.schema(f"{state}, round int").parquet(entries)
    after = spark.read.schema(f"{state}, round int").parquet(ends)
    steps = join_same(after.withColumnRenamed("round", "came_by"), known, same)
    every = starts.select(*keys, F.lit(-1).alias("came_by"), F.lit(-1).alias("round"))
    steps = steps.select(*keys, "came_by", "round").unionByName(every)
    chosen = steps.groupBy(DEVICE).applyInPandas(
        _walk, "device_id bigint, slice int, round int"
    )
    chosen = written(chosen.withColumn("chosen", F.lit(True)), "control-chosen")
    hot = cuts.select(DEVICE, F.lit(True).alias("hot"))
    everything = spark.read.schema(_OUT_SCHEMA + ", round int").parquet(table)
    judged = join_same(everything, F.broadcast(chosen), [*keys, "round"], "left")
    judged = join_same(judged, F.broadcast(hot), [DEVICE], "left")
    first = F.col("slice") == 0  # of a hot device too: it has one entry
    valid = judged.filter(F.col("hot").isNull() | first | F.col("chosen"))
    return valid.filter(F.col("action") != "exit").select(*_OUT_COLUMNS)


def _walk(steps: pd.DataFrame) -> pd.DataFrame:
    """One device's slices in order, each by the round that folded the entry the slice
    before leads to. A row tells that slice ``slice - 1``, folded in round ``came_by``,
    leads to the entry folded in round ``round``. A first slice without events leads
    nowhere: then the guess for the second one, folded in round 0, is right."""
    leads = {(s, c): r for s, c, r in zip(steps["slice"], steps["came_by"], steps["round"])}
    out, by = [], 0
    for at in range(1, max(steps["slice"]) + 1):
        by = leads.get((at, by), 0) if at == 1 else leads[at, by]
        out.append((at, by))
    found = pd.DataFrame(out, columns=["slice", "round"])
    found.insert(0, "device_id", steps["device_id"].iloc[0])
    return found


def _remembered(rules: Rules) -> dict[str, Column]:
    """A state as events from ``start`` on see it: what is over is forgotten."""
    state = {name: F.col(name) for name in Controller.FIELDS}
    never, start = F.lit(NEVER), F.col("start")
    off = (state["off_at"] != never) & (state["off_at"] <= start)
    rested = start - state["last_dose"] >= int(rules.cooldown * SECOND)
    due = start - state["last_cycle"] > int(rules.cycle_every * SECOND)
    return state | {
        "circ": F.when(off, F.lit(0)).otherwise(state["circ"]),
        "off_at": F.when(off, never).otherwise(state["off_at"]),
        "last_dose": F.when(rested, never).otherwise(state["last_dose"]),
        "last_cycle": F.when(due, never).otherwise(state["last_cycle"]),
    }


def dose_events(done: DataFrame) -> DataFrame:
    """Accepted and skipped doses; a skip tells the seconds left in the cooldown."""
    return done.filter(F.col("action").isin("dose", "skip")).select(
        DEVICE, "seq", "ts", "action", "off_ts", (F.col("wait_us") / SECOND).alias("wait_s")
    )


def circulation_cycles(done: DataFrame) -> DataFrame:
    return done.filter(F.col("action") == "cycle").select(DEVICE, "seq", "ts", "off_ts")


def last_actions(done: DataFrame) -> DataFrame:
    """When each device last dosed and last started a cycle."""

    def last(action: str) -> Column:
        return F.max(F.when(F.col("action") == action, F.col("ts")))

    acted = done.filter(F.col("action").isin("dose", "cycle")).groupBy(DEVICE)
    return acted.agg(last("dose").alias("last_dose"), last("cycle").alias("last_cycle"))


def pump_changes(config_log: DataFrame, done: DataFrame) -> DataFrame:
    """All writes of a pump's state: configuration, rules and their switch-offs."""

    def change(kind: int, ts: str, pump: Column, state: Column) -> Column:
        return F.struct(
            F.col(ts).alias("ts"), F.lit(kind).alias("kind"), pump.alias("pump"),
            state.alias("state"),
        )

    written = F.array(
        change(CONFIG, "ts", F.lit("circ"), F.col("circ")),
        change(CONFIG, "ts", F.lit("nutri"), F.col("nutri")),
    )
    pump = F.when(F.col("action") == "dose", F.lit("nutri")).otherwise(F.lit("circ"))
    switched = F.array(
        change(READING, "ts", pump, F.lit(1)), change(TIMER, "off_ts", pump, F.lit(0))
    )
    by_config = config_log.select(DEVICE, "seq", F.explode(written).alias("change"))
    acted = done.filter(F.col("action") != "skip")
    by_rules = acted.select(DEVICE, "seq", F.explode(switched).alias("change"))
    both = by_config.unionByName(by_rules).select(DEVICE, "seq", "change.*")
    return both.filter(F.col("ts").isNotNull())


def pump_timeline(
    config_log: DataFrame,
    done: DataFrame,
    rows_per_slice: int | None = None,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """State of each pump from each write to the next one.

    ``sized_by`` is a table whose device counts stand for those of the changes, such
    as the readings the rules ran over; without one the configuration log is.
    Counting ``done`` itself would run the rules a second time.
    """

    def add(rows: DataFrame, window) -> DataFrame:
        return rows.withColumn("until", F.lag("ts").over(window))

    return over_rows(
        pump_changes(config_log, done), add, 1, by=(DEVICE, "pump"),
        order=("ts", "kind", "seq"), forward=True, rows_per_slice=rows_per_slice,
        sized_by=config_log if sized_by is None else sized_by,
    )


def pump_runtime(timeline: DataFrame, now: datetime | None = None) -> DataFrame:
    """Microseconds each pump ran in each hour; a running pump counts until now."""
    clock = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    on = timeline.filter(F.col("state") == 1).select(
        DEVICE, "pump", F.col("ts").alias("on_ts"), F.coalesce("until", clock).alias("off_ts")
    )
    on = on.filter(F.col("off_ts") > F.col("on_ts"))
    hour = F.expr("interval 1 hour")
    hours = F.sequence(F.date_trunc("hour", "on_ts"), F.date_trunc("hour", "off_ts"), hour)
    split = on.withColumn("hour", F.explode(hours))
    start = F.greatest(F.unix_micros("on_ts"), F.unix_micros("hour"))
    end = F.least(F.unix_micros("off_ts"), F.unix_micros(F.col("hour") + hour))
    return (
        split.groupBy(DEVICE, "pump", "hour")
        .agg(F.sum(end - start).alias("on_us"))
        .filter(F.col("on_us") > 0)
    )
