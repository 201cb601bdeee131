"""Control rules against an independent simulation with explicit timers."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolens import schemas
from hydrolens.operators import config, control, seams
from tests.helpers import at, rows, seconds

READINGS = "device_id bigint, seq bigint, ts timestamp, conductivity double"
ON = (0, 0, 1, 1)


def tables(spark, readings, writes):
    read = [(1, 1000 + i, at(t), ec) for i, (t, ec) in enumerate(readings)]
    log = [(1, i, at(t), *flags) for i, (t, flags) in enumerate(writes)]
    return spark.createDataFrame(read, READINGS), spark.createDataFrame(log, schemas.CONFIG_LOG)


def run(spark, readings, writes, **kw):
    done = control.actions(*tables(spark, readings, writes), **kw).orderBy("ts", "action")
    return [(seconds(row["ts"]), row["action"], seconds(row["off_ts"])) for row in done.collect()]


def simulate(readings, writes, rules=control.Rules()):
    """Straight from the rules: a queue of timers, one loop over all events."""
    events = [(t, 1, i, flags) for i, (t, flags) in enumerate(writes)]
    events += [(t, 2, i, ec) for i, (t, ec) in enumerate(readings)]
    pumps = {"circ": 0, "nutri": 0}
    auto = circ_auto = 0
    last_dose = last_cycle = None
    timers, out = [], []
    for t, kind, _, what in sorted(events, key=lambda e: e[:3]):
        while timers and timers[0][0] <= t:
            pumps[heapq.heappop(timers)[1]] = 0
        if kind == 1:
            pumps["circ"], pumps["nutri"], auto, circ_auto = what
            continue
        free = t
        if auto and what < rules.dose_below:
            if not pumps["circ"]:
                pumps["circ"] = 1
                out.append((t, "force_circ", None))
            elif last_dose is not None and t - last_dose < rules.cooldown:
                out.append((t, "skip", None))
            else:
                pumps["nutri"], last_dose, free = 1, t, t + rules.dose_for
                heapq.heappush(timers, (free, "nutri"))
                out.append((t, "dose", free))
        if circ_auto and (last_cycle is None or t - last_cycle > rules.cycle_every):
            pumps["circ"], last_cycle = 1, t
            heapq.heappush(timers, (free + rules.cycle_for, "circ"))
            out.append((t, "cycle", free + rules.cycle_for))
    return sorted(out, key=lambda a: (a[0], a[1]))


@pytest.mark.parametrize("ec, acts", [(310.0, False), (309.99, True)])
def test_conductivity_bound(spark, ec, acts):
    found = run(spark, [(1, ec)], [(0, (1, 0, 1, 0))])
    assert found == ([(1, "dose", 6)] if acts else [])


@pytest.mark.parametrize("later, action", [(59.999, "skip"), (60.0, "dose")])
def test_cooldown_bound(spark, later, action):
    found = run(spark, [(1, 100.0), (1 + later, 100.0)], [(0, (1, 0, 1, 0))])
    assert [one[1] for one in found] == ["dose", action]


@pytest.mark.parametrize("later, cycles", [(120.0, 1), (120.001, 2)])
def test_cycle_bound(spark, later, cycles):
    found = run(spark, [(1, 900.0), (1 + later, 900.0)], [(0, (0, 0, 0, 1))])
    assert [one[1] for one in found] == ["cycle"] * cycles


def test_circulation_is_forced_before_a_dose(spark):
    found = run(spark, [(1, 100.0), (6, 100.0), (11, 100.0)], [(0, (0, 0, 1, 0))])
    assert [(t, a) for t, a, _ in found] == [(1, "force_circ"), (6, "dose"), (11, "skip")]


def test_a_forced_circulation_has_no_switch_off_of_its_own(spark):
    found = run(spark, [(1, 100.0), (500, 100.0)], [(0, (0, 0, 1, 0))])
    assert [a for _, a, _ in found] == ["force_circ", "dose"]


def test_a_dose_delays_the_switch_off_of_a_cycle(spark):
    assert run(spark, [(1, 100.0)], [(0, (1, 0, 1, 1))]) == [(1, "cycle", 66), (1, "dose", 6)]


def test_nothing_happens_without_automation(spark):
    assert run(spark, [(1, 100.0), (200, 100.0)], [(0, (1, 1, 0, 0))]) == []
    assert run(spark, [(1, 100.0)], [(2, ON)]) == []


def test_a_write_at_the_time_of_a_reading_comes_first(spark):
    assert run(spark, [(5, 900.0)], [(5, (0, 0, 0, 1))]) == [(5, "cycle", 65)]


def test_rest_of_the_cooldown(spark):
    done = control.actions(*tables(spark, [(1, 1.0), (21.5, 1.0)], [(0, (1, 0, 1, 0))]))
    skipped = control.dose_events(done).filter("action = 'skip'").first()
    assert skipped["wait_s"] == 39.5


def test_rules_which_overlap_are_refused():
    with pytest.raises(ValueError):
        control.Rules(cycle_for=118, cycle_every=120)


def random_events(seed, n, step):
    rng = random.Random(seed)
    clock, readings, writes = 0.0, [], []
    for _ in range(n):
        clock += rng.choice(step)
        if rng.random() < 0.05:
            writes.append((clock, tuple(rng.randrange(2) for _ in range(2)) + (
                int(rng.random() < 0.8), int(rng.random() < 0.7))))
        else:
            readings.append((clock, rng.choice([100.0, 200.0, 309.99, 310.0, 900.0])))
    return readings, writes


@pytest.mark.parametrize(("seed", "rows_per_slice"), [(1, None), (2, None), (3, None), (1, 10), (2, 40), (3, 40), (3, 200)])
def test_actions_equal_the_simulation(spark, seed, rows_per_slice):
    readings, writes = random_events(seed, 300, [1.0, 5.0, 5.0, 5.0, 30.0, 61.0])
    found = run(spark, readings, writes, rows_per_slice=rows_per_slice)
    assert found == simulate(readings, writes)


def test_rounds_of_a_steady_rhythm_follow_its_states(spark, monkeypatch):
    """Nothing ever makes a slice forget its past. Yet some thirty slices take no more
    rounds than the cycle has states (four phases, with the pump on or off), since a
    state met again is not folded again."""
    rules = control.Rules(cycle_every=36.0, cycle_for=10.0, cooldown=36.0, dose_for=5.0)
    readings = [(10.0 * i, 900.0) for i in range(1, 200)]
    writes = [(0, (0, 0, 0, 1))]
    folds, fold = [], control._fold
    monkeypatch.setattr(control, "MOST_ENTRIES", 0)
    monkeypatch.setattr(control, "_fold", lambda *given: folds.append(1) or fold(*given))
    found = run(spark, readings, writes, rules=rules, rows_per_slice=7)
    assert found == simulate(readings, writes, rules)
    assert len(folds) <= 8


@pytest.mark.parametrize("writes", [[(0, (1, 0, 1, 1))], [(0, (0, 0, 1, 1)), (777, (0, 0, 1, 0)), (1500, (1, 0, 1, 1)), (1501, ON)]])
def test_two_folds_at_any_rhythm(spark, monkeypatch, writes):
    """A reading each five seconds never lets the phases of doses and cycles meet."""
    readings = [(5.0 * i, 900.0 if i % 7 == 3 else 100.0) for i in range(1, 500)]
    passes, fold, maps = [], control._fold, seams.slice_maps
    monkeypatch.setattr(control, "_fold", lambda *given: passes.append("fold") or fold(*given))
    monkeypatch.setattr(seams, "slice_maps", lambda *given: passes.append("maps") or maps(*given))
    found = run(spark, readings, writes, rows_per_slice=40)
    assert found == simulate(readings, writes)
    assert passes == ["maps", "fold"]


@pytest.mark.parametrize("rows_per_slice", [5, 40])
def test_rounds_give_the_same(spark, monkeypatch, rows_per_slice):
    monkeypatch.setattr(control, "MOST_ENTRIES", 0)
    readings, writes = random_events(8, 300, [1.0, 5.0, 5.0, 30.0, 61.0])
    assert run(spark, readings, writes, rows_per_slice=rows_per_slice) == simulate(readings, writes)


@pytest.mark.parametrize("seed", range(20))
def test_states_side_by_side_equal_one_after_the_other(seed, monkeypatch):
    monkeypatch.setattr(seams, "MERGE_AFTER", 3)
    rules, rng = control.Rules(), random.Random(seed)
    start = 1_000_000 * control.SECOND
    before = np.array(sorted(start - rng.randrange(1, 125 * control.SECOND) for _ in range(6)))
    entries = seams.entry_states(start, before, before, rules.micros())
    states = seams.States(entries, 1, 1, rules.micros())
    controllers = [control.Controller(rules, (c, 1, 1, off, dose, cycle)) for c, off, dose, cycle in entries.tolist()]
    at = start
    for _ in range(4):
        times = np.cumsum([rng.choice([1, 5, 30, 61]) * control.SECOND for _ in range(40)]) + at
        low = np.array([rng.random() < 0.7 for _ in times])
        states.read(times, low)
        at = int(times[-1]) + control.SECOND
        flags = [rng.randrange(2) for _ in range(3)]
        states.configure(at, *flags)
        for controller in controllers:
            for t, is_low in zip(times.tolist(), low.tolist()):
                controller.read(t, is_low)
            controller.configure(at, *flags)
        found = states.states[states.which]
        one = seams.States(np.array([(c.circ, c.off_at, c.last_dose, c.last_cycle) for c in controllers]), 0, 0, rules.micros())
        one.settle(at)
        assert (found == one.states).all()


def test_accepted_doses_keep_the_cooldown(spark):
    readings, writes = random_events(9, 400, [5.0])
    done = run(spark, readings, writes)
    doses = [t for t, action, _ in done if action == "dose"]
    assert len(doses) > 5 and all(b - a >= 60 for a, b in zip(doses, doses[1:]))
    for t in [t for t, action, _ in done if action == "skip"]:
        assert any(0 < t - dose < 60 for dose in doses)


@pytest.mark.parametrize("batch", [1, 7, 100])
def test_state_lives_across_arrow_batches(spark, batch):
    readings, writes = random_events(4, 300, [1.0, 5.0, 61.0])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        assert run(spark, readings, writes) == simulate(readings, writes)
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("rows_per_slice", [None, 3])
def test_timeline_and_run_time(spark, rows_per_slice):
    read, log = tables(
        spark, [(10, 100.0), (3590, 900.0)], [(0, (1, 0, 1, 0)), (100, (0, 0, 0, 1))]
    )
    done = control.actions(read, log)
    line = control.pump_timeline(log, done, rows_per_slice)
    found = sorted(
        (row["pump"], seconds(row["ts"]), row["state"], seconds(row["until"]))
        for row in line.collect()
    )
    assert found == [
        ("circ", 0, 1, 100), ("circ", 100, 0, 3590), ("circ", 3590, 1, 3650), ("circ", 3650, 0, None),
        ("nutri", 0, 0, 10), ("nutri", 10, 1, 15), ("nutri", 15, 0, 100), ("nutri", 100, 0, None),
    ]
    on = [
        (row["pump"], seconds(row["hour"]), row["on_us"] / 1e6)
        for row in control.pump_runtime(line, at(9999)).orderBy("pump", "hour").collect()
    ]
    assert on == [("circ", 0, 110.0), ("circ", 3600, 50.0), ("nutri", 0, 5.0)]


def test_a_running_pump_counts_until_now(spark):
    _, log = tables(spark, [], [(0, (1, 0, 0, 0))])
    read = spark.createDataFrame([], READINGS)
    line = control.pump_timeline(log, control.actions(read, log))
    found = rows(control.pump_runtime(line, at(5400)), "pump", "on_us")
    assert found == [("circ", 1_800_000_000), ("circ", 3_600_000_000)]


def test_flags_are_numbers_and_default_to_off(spark):
    writes = spark.createDataFrame(
        [(1, 1, at(0), True, None)], "device_id bigint, seq bigint, ts timestamp, circ boolean, auto boolean"
    )
    assert rows(config.config_writes(writes), "circ", "nutri", "auto", "circ_auto") == [(1, 0, 0, 0)]
    read = spark.createDataFrame([(1, 2, at(-1), 1.0), (2, 3, at(9), 1.0), (1, 4, at(0), 1.0)], READINGS)
    found = config.config_as_of(read, config.config_writes(writes))
    assert rows(found, "seq", "circ", "auto") == [(2, 0, 0), (3, 0, 0), (4, 1, 0)]
    current = config.config_current(config.config_writes(writes).withColumn("circ", F.lit(1)))
    assert rows(current, "device_id", "circ") == [(1, 1)]
