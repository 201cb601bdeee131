"""Control rules over a slice from every state it can be entered with.

What a slice of a device's events does to the pumps depends on the state before it.
Doses and cycles that still count at a slice's start were made by readings shortly
before it, so the states it can be entered with are finitely many, and known without
the slices before. All of them are taken through the slice side by side; states that
have become equal go on as one. A slice is then a finite map from entries to exits, and
maps of neighbouring slices are composed pairwise, like a prefix sum, until every slice's
one true entry is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolens.operators.slicing import DEVICE
from hydrolens.session import written

# Stands for "never" in whole-number columns.
NEVER = -(2**62)
FIELDS = ("circ", "off_at", "last_dose", "last_cycle")
# Steps of the slowest state after which equal states are looked for.
MERGE_AFTER = 64


def entry_states(start: int, dosing: np.ndarray, cycling: np.ndarray, times: dict[str, int]) -> np.ndarray:
    """States that events from ``start`` on can meet, one row of FIELDS each; ``dosing`` and
    ``cycling`` are the times before it of readings which may have dosed or cycled."""
    doses = [NEVER, *dosing[start - dosing < times["cooldown"]].tolist()]
    cycles = [NEVER, *cycling[start - cycling <= times["cycle_every"]].tolist()]
    pending = [
        (off, cycle)
        for cycle in cycles
        for off in (NEVER, cycle + times["cycle_for"], cycle + times["dose_for"] + times["cycle_for"])
        if off == NEVER or cycle != NEVER and off > start
    ]
    return np.array([(on, off, dose, cycle) for on in (0, 1) for off, cycle in pending for dose in doses], np.int64)


class States:
    """Many states of one device's pumps, fed the same events."""

    def __init__(self, states: np.ndarray, auto: int, circ_auto: int, times: dict[str, int]):
        self.states, self.which = states.copy(), np.arange(len(states))
        self.auto, self.circ_auto, self.times = auto, circ_auto, times

    def settle(self, at: np.ndarray | int) -> None:
        """Forgets what is over for events from ``at`` on."""
        circ, off, dose, cycle = self.states.T
        over = (off != NEVER) & (off <= at)
        circ[over], off[over] = 0, NEVER
        dose[at - dose >= self.times["cooldown"]] = NEVER
        cycle[at - cycle > self.times["cycle_every"]] = NEVER

    def merge(self, places: np.ndarray) -> np.ndarray:
        """Joins states that are equal and equally far; gives the places of those left."""
        rows, which = np.unique(np.column_stack([self.states, places]), axis=0, return_inverse=True)
        self.states, self.which = np.ascontiguousarray(rows[:, :-1]), which.ravel()[self.which]
        return rows[:, -1].copy()

    def configure(self, at: int, circ: int, auto: int, circ_auto: int) -> None:
        self.settle(at)
        self.states[:, 0], self.auto, self.circ_auto = circ, auto, circ_auto
        self.merge(np.zeros(len(self.states), np.int64))

    def read(self, at: np.ndarray, low: np.ndarray) -> None:
        """The readings of a stretch without configuration writes, in order of time.

        Each state goes from one reading that changes it straight to the next such one.
        """
        n = len(at)
        later = np.minimum.accumulate(np.where(low, np.arange(n), n)[::-1])[::-1]
        next_low = np.append(later, n)  # the first low reading from a place on
        places, steps = np.zeros(len(self.states), np.int64), 0
        while True:
            changed = np.minimum(self._next(places, at, next_low), n)
            live = np.flatnonzero(changed < n)
            if not len(live):
                return
            self._act(live, at[changed[live]], low[changed[live]])
            places = changed + 1
            steps += 1
            if steps % MERGE_AFTER == 0:
                reached = places < n
                self.settle(np.where(reached, at[np.minimum(places, n - 1)], NEVER))
                places = self.merge(np.minimum(places, n))

    def _next(self, places: np.ndarray, at: np.ndarray, next_low: np.ndarray) -> np.ndarray:
        circ, off, dose, cycle = self.states.T
        n = len(at)
        ends = np.where(off == NEVER, n, np.searchsorted(at, off))
        due = rested = np.zeros(len(circ), np.int64)
        due = np.where(cycle == NEVER, due, np.searchsorted(at, cycle + self.times["cycle_every"], "right"))
        due = due if self.circ_auto else np.full(len(circ), n)
        rested = np.where((circ == 0) | (dose == NEVER), rested, np.searchsorted(at, dose + self.times["cooldown"]))
        acts = next_low[np.clip(np.maximum(places, rested), 0, n)] if self.auto else np.full(len(circ), n)
        return np.maximum(places, np.minimum(np.minimum(ends, due), acts))

    def _act(self, live: np.ndarray, at: np.ndarray, low: np.ndarray) -> None:
        circ, off, dose, cycle = self.states[live].T.copy()
        over = (off != NEVER) & (off <= at)
        circ[over], off[over] = 0, NEVER
        free = at.copy()
        if self.auto:
            dosed = low & (circ == 1) & (at - dose >= self.times["cooldown"])
            circ[low] = 1
            dose[dosed] = at[dosed]
            free[dosed] += self.times["dose_for"]
        if self.circ_auto:
            started = at - cycle > self.times["cycle_every"]
            circ[started], cycle[started] = 1, at[started]
            off[started] = free[started] + self.times["cycle_for"]
        self.states[live] = np.column_stack([circ, off, dose, cycle])


COLUMNS = ["device_id", "slice", "at", "kind", "low", "circ", "auto", "circ_auto", "off_at"]
_ENTERED = ", ".join(f"{name} bigint" for name in FIELDS)
_LEFT = ", ".join(f"to_{name} bigint" for name in FIELDS)
MAP_SCHEMA = f"device_id bigint, slice int, {_ENTERED}, {_LEFT}"
# Readings before a slice, and the row that opens it; other kinds are the events' own.
HALO, OPENING = -2, -1


def slice_map(rows: pd.DataFrame, config: int, times: dict[str, int]) -> pd.DataFrame:
    """Entries and exits of one slice. Its opening row holds its start, the flags in
    force and, as ``off_at``, its end."""
    kind, at = rows["kind"].to_numpy(), rows["at"].to_numpy()
    opening = rows[kind == OPENING].iloc[0]
    before = rows[kind == HALO]
    dosing = before["at"][(before["low"] == 1) & (before["auto"] == 1)].to_numpy()
    cycling = before["at"][before["circ_auto"] == 1].to_numpy()
    entries = entry_states(int(opening["at"]), dosing, cycling, times)
    states = States(entries, int(opening["auto"]), int(opening["circ_auto"]), times)
    own = np.flatnonzero(kind >= 0)
    at, low = at[own], rows["low"].to_numpy()[own] == 1
    flags = rows[["circ", "auto", "circ_auto"]].to_numpy()[own]
    first = 0
    for write in [*np.flatnonzero(kind[own] == config).tolist(), len(own)]:
        if write > first:
            states.read(at[first:write], low[first:write])
        if write < len(own):
            states.configure(int(at[write]), *flags[write].tolist())
        first = write + 1
    states.settle(int(opening["off_at"]))
    table = np.column_stack([entries, states.states[states.which]])
    found = pd.DataFrame(table, columns=[*FIELDS, *[f"to_{name}" for name in FIELDS]])
    found.insert(0, "device_id", opening["device_id"])
    found.insert(1, "slice", opening["slice"])
    return found


def slice_maps(rows: DataFrame, config: int, times: dict[str, int]) -> DataFrame:
    """The map of every slice that has an opening row; a slice is held by its task, and
    is of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []
        for batch in batches:
            keys = batch[["device_id", "slice"]]
            breaks = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy()[1:]) + 1 if len(batch) else []
            for part in np.split(np.arange(len(batch)), breaks):
                piece = batch.iloc[part]
                if parts and tuple(parts[-1].iloc[-1][["device_id", "slice"]]) != tuple(piece.iloc[0][["device_id", "slice"]]):
                    yield slice_map(pd.concat(parts, ignore_index=True), config, times)
                    parts = []
                parts.append(piece)
        if parts:
            yield slice_map(pd.concat(parts, ignore_index=True), config, times)

    clustered = rows.select(*COLUMNS).repartition(DEVICE, "slice")
    return clustered.sortWithinPartitions(DEVICE, "slice", "at", "kind").mapInPandas(run, MAP_SCHEMA)


def true_entries(maps: DataFrame, slices: int) -> DataFrame:
    """Each slice's entry, from the maps of all slices but the last ones.

    Neighbouring blocks of slices become one block of twice the size until one holds
    all; then each block tells its second half what it is entered with.
    """
    left = [f"to_{name}" for name in FIELDS]

    def follow(states: DataFrame, by: DataFrame, was: list[str]) -> DataFrame:
        """States taken through the maps of their blocks."""
        renamed = by.select(
            F.col(DEVICE).alias("_device"), F.col("slice").alias("_slice"),
            *[F.col(name).alias(f"_{name}") for name in FIELDS], *[F.col(name).alias(f"_{name}") for name in left],
        )
        same = [F.col(one) == F.col(f"_{name}") for one, name in zip(was, FIELDS)]
        on = F.col(DEVICE).eqNullSafe(F.col("_device")) & (F.col("_next") == F.col("_slice"))
        return states.join(renamed, reduce(and_, same, on))

    levels = [maps]
    while 2 ** len(levels) < slices:
        level = levels[-1]
        halves = level.filter("slice % 2 = 0").withColumn("_next", F.col("slice") + 1)
        both = follow(halves, level, left).select(
            DEVICE, F.expr("slice div 2").cast("int").alias("slice"), *FIELDS, *[F.col(f"_{name}").alias(name) for name in left]
        )
        levels.append(written(both, "control-maps"))
    entries = maps.select(DEVICE).distinct().select(
        DEVICE, F.lit(0).alias("slice"), F.lit(0).cast("bigint").alias("circ"), *[F.lit(NEVER).alias(name) for name in FIELDS[1:]]
    )
    for level in reversed(levels):
        halves = entries.withColumn("_next", 2 * F.col("slice"))
        first = halves.select(DEVICE, F.col("_next").alias("slice"), *FIELDS)
        second = follow(halves, level, list(FIELDS)).select(
            DEVICE, (F.col("_next") + 1).alias("slice"), *[F.col(f"_{name}").alias(n) for name, n in zip(left, FIELDS)]
        )
        entries = first.unionByName(second)
    return entries.filter(F.col("slice") > 0)
