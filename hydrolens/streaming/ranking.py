"""A ranking that is kept up to date, as a stream.

Members are dealt to buckets by a hash, so a device that most members belong to is spread.
A bucket's state holds what it was sent, in parts by the members' days, and its best, some
more than are asked for. A reading of the same millisecond with a higher number replaces a
score, by a lower one too. Most readings are only added to their day's parts: a day is read
again for a score that would be among the best, to see that it was not replaced before, and
all days when too many of the best have fallen. A day's parts are settled into one, a row a
member, when they have doubled. The best of all are found among those of the buckets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hydrolens import constants as C
from hydrolens.streaming.state import use_state_store

BUCKETS = 64
#: How many times as many members as asked for are kept at hand.
SPARE = 10
TOP = "bucket int, place int, device_id bigint, id string, temperature double"
KEYS = ("bucket", "place")

NONE = -(2**63)
DAY_MS = 86_400_000
ROW = np.dtype([("device", "i8"), ("ms", "i8"), ("seq", "i8"), ("temperature", "f8")])

# Device, millisecond, number and score of a member.
Member = tuple[int, int, int, float]


def _settled(rows: np.ndarray) -> np.ndarray:
    """The last row of each member: the highest number, of equal ones the later arrival."""
    rows = rows[np.lexsort((rows["seq"], rows["ms"], rows["device"]))]
    last = np.ones(len(rows), bool)
    last[:-1] = (rows["device"][1:] != rows["device"][:-1]) | (rows["ms"][1:] != rows["ms"][:-1])
    return rows[last]


def _id(ms: int) -> str:
    return f"{C.RANKING_MEMBER_PREFIX}{ms}"


def _rank(member: Member) -> tuple:
    """Score, id text and device as they are compared: what is no number comes first, no
    device after all others."""
    device, ms, _, score = member
    return score != score, 0.0 if score != score else score, _id(ms), device


def _best(rows: np.ndarray, n: int, above: Member | None = None) -> list[Member]:
    """The first ``n`` of settled rows, of those above a member."""
    score = np.where(np.isnan(rows["temperature"]), np.inf, rows["temperature"])
    if above is not None:
        least = np.inf if np.isnan(above[3]) else above[3]
        rows, score = rows[score >= least], score[score >= least]
    if len(rows) > n:  # with all that tie with the last
        rows = rows[score >= np.partition(score, -n)[-n]]
    found = [row for row in rows.tolist() if above is None or _rank(row) > _rank(above)]
    return sorted(found, key=_rank, reverse=True)[:n]


class BucketRanking(StatefulProcessor):
    """The scores of a bucket's members, and its best ``k``."""

    def __init__(self, k: int):
        self.k, self.most = k, k * SPARE

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Parts of a day, rows of its first part and of those after it.
        self.days = handle.getMapState("days", "day bigint", "parts int, first bigint, more bigint")
        self.held = handle.getMapState("held", "day bigint, part int", "rows binary")
        # All members that rank above the floor, or all there are if there is none.
        self.top = handle.getValueState("top", "best binary, floor binary")

    def _of_day(self, day: int, parts: int) -> np.ndarray:
        packed = b"".join(bytes(self.held.getValue((day, i))[0]) for i in range(parts))
        return _settled(np.frombuffer(packed, ROW))

    def _add(self, arrived: np.ndarray) -> None:
        days = arrived["ms"] // DAY_MS
        for day in np.unique(days).tolist():
            rows = arrived[days == day]
            parts, first, more = self.days.getValue((day,)) if self.days.containsKey((day,)) else (0, 0, 0)
            self.held.updateValue((day, parts), (rows.tobytes(),))
            if not parts:
                self.days.updateValue((day,), (1, len(rows), 0))
            elif more + len(rows) < first:
                self.days.updateValue((day,), (parts + 1, first, more + len(rows)))
            else:
                settled = self._of_day(day, parts + 1)
                self.held.updateValue((day, 0), (settled.tobytes(),))
                for part in range(1, parts + 1):
                    self.held.removeKey((day, part))
                self.days.updateValue((day,), (1, len(settled), 0))

    def _standing(self, members: Iterable[Member]) -> list[Member]:
        """Those that no reading known has replaced."""
        of_day: dict[int, list[Member]] = {}
        for one in members:
            of_day.setdefault(one[1] // DAY_MS, []).append(one)
        out = []
        for day, some in of_day.items():
            known = self._of_day(day, self.days.getValue((day,))[0])
            known = known[np.isin(known["ms"], [one[1] for one in some])]
            newest = {(device, ms): seq for device, ms, seq, _ in known.tolist()}
            out += [one for one in some if newest[one[:2]] <= one[2]]
        return out

    def _entering(self, rows: np.ndarray, floor: Member | None) -> list[Member]:
        """Members that enter the best: as many as fit, and none that were replaced before."""
        if floor is None:
            return _best(rows, self.most)
        every, found = _best(rows, len(rows), floor), []
        for start in range(0, len(every), self.most):
            found += self._standing(every[start : start + self.most])
            if len(found) >= self.most:
                break
        return found

    def _every(self) -> tuple[list[Member], Member | None]:
        """The best of all days, and the last of them if there are others."""
        best, others = [], False
        for (day,) in list(self.days.keys()):
            rows = self._of_day(day, self.days.getValue((day,))[0])
            best = sorted([*best, *_best(rows, self.most)], key=_rank, reverse=True)
            others |= len(rows) > self.most or len(best) > self.most
            best = best[: self.most]
        return best, best[-1] if others else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best, floor = ([], None)
        if self.top.exists():
            best, floor = (np.frombuffer(bytes(packed), ROW).tolist() for packed in self.top.get())
            floor = floor[0] if floor else None
        before = [_rank(one) for one in best[: self.k]]
        sent = pd.concat([one[list(ROW.names)] for one in rows], ignore_index=True)
        arrived = np.empty(len(sent), ROW)
        for name in ROW.names:
            arrived[name] = sent[name].to_numpy()
        arrived = _settled(arrived)
        self._add(arrived)
        # Members at hand are known with their numbers; the others may be known by their day.
        at_hand = {one[:2]: one for one in best}
        met = np.isin(arrived["ms"], [ms for _, ms in at_hand])
        met[met] = [row[:2] in at_hand for row in arrived[met].tolist()]
        for row in arrived[met].tolist():
            if at_hand[row[:2]][2] <= row[2]:
                at_hand[row[:2]] = row
        left = [one for one in at_hand.values() if floor is None or _rank(one) >= _rank(floor)]
        best = sorted([*left, *self._entering(arrived[~met], floor)], key=_rank, reverse=True)
        if len(best) >= self.most:  # others may have been left out
            best = best[: self.most]
            floor = best[-1]
        if len(best) < self.k and floor is not None:  # too many have fallen below others
            best, floor = self._every()
        self.top.update(tuple(np.array(some, ROW).tobytes() for some in (best, [floor] if floor else [])))
        if [_rank(one) for one in best[: self.k]] != before:
            device, ms, _, score = zip(*best[: self.k])
            found = pd.DataFrame({"device_id": pd.array(device, "Int64"), "id": [_id(at) for at in ms], "temperature": score})
            found["device_id"] = found["device_id"].mask(found["device_id"] == NONE)
            yield found.assign(bucket=key[0], place=range(len(found)))

    def close(self) -> None:
        pass


def bucket_tops(readings: DataFrame, limit: int = C.RANKING_LIMIT) -> DataFrame:
    """The best of each bucket whenever they change, to be upserted by ``KEYS``."""
    use_state_store(readings.sparkSession)
    device = F.coalesce("device_id", F.lit(NONE)).alias("device")
    present = readings.filter(F.col("temperature").isNotNull() & F.col("ts").isNotNull())
    seq = F.coalesce("seq", F.lit(NONE)).alias("seq")
    dealt = present.select(device, F.unix_millis("ts").alias("ms"), seq, "temperature")
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("device", "ms"), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(
        BucketRanking(limit), outputStructType=TOP, outputMode="Update", timeMode="None"
    )


def ranking(tops: DataFrame, limit: int = C.RANKING_LIMIT) -> DataFrame:
    """The best of all, from the upserted best of the buckets."""
    order = F.struct("temperature", "id", "device_id")
    return tops.select("device_id", "id", "temperature").orderBy(order.desc()).limit(limit)
