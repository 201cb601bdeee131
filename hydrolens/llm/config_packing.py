"""Best-fit packing of token sequences by a configuration linear program.

Documents become token ids, ended by one id more; longer ones than a sequence are cut.
What the plan needs of any number of pieces is the histogram of their lengths, at most
``capacity`` numbers, which alone comes to the driver. There a configuration is a set of
lengths that fits a sequence, and the linear program asks for the fewest sequences, in
fractions of configurations, that hold all pieces. It is solved by multiplicative weights:
each length has a weight that shrinks as it is covered; pricing, a knapsack by dynamic
programming over the lengths' weights, gives the best configuration, and for each length
the best one that holds it; those within ``EPSILON`` of the best are taken, too, before the
next pricing. Weights start at the lengths themselves, which is the dual solution where
all sequences can be full.

The fractions are rounded to whole sequences, fullest and most used configurations first,
never beyond the pieces that are left; the program is solved again for the rest as
long as that places much; what then remains goes where it fits best, longest first, by
length and number, not one by one. Pieces of equal length are interchangeable: they are
numbered (in parts of bounded size, whose sums give the offsets) and a piece's number tells
its sequence. So the driver's work and what is sent to the tasks depend on the capacity,
not on the data.

Defined cases: a null or empty text is the closing id alone; a null id passes through;
repeated rows are packed each; very long texts are cut as said; an empty table gives an
empty table. Only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrolens.llm.tables import written

CAPACITY = 4096
END = 1
EPSILON = 0.05
ROUNDS = 4  # solutions of the program, each for what the one before left
PRICINGS = 40  # knapsacks of one solution
NUMBERED = 20_000  # pieces numbered by one task at a time
REMEMBERED = 400_000  # words whose ids a worker remembers, in each of three dictionaries
READ_ROWS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"

Configuration = tuple[int, ...]  # lengths, longest first


class Words:
    """Token ids of texts, as bytes of four; ids of words are remembered.

    The tokenizer drops white space, and no token, character composition or special
    token reaches over a space or a line's end, so texts are cut there. Of a word of plain
    Latin letters and then ASCII marks, letters and marks are tokens' borders, too; its
    letters go to the tokenizer's model at once. All other words take the whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _run(self, run: str) -> bytes:
        """Ids of a run of lower-case letters, or of marks."""
        if (found := self.runs.get(run)) is None:
            found = array("I", [t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(SHOWN))]).tobytes()
            if len(self.runs) >= REMEMBERED:
                self.runs = {}
            self.runs[run] = found
        return found

    def _word(self, word: str) -> bytes:
        if (found := self.older.get(word)) is None:
            if plain := PLAIN.fullmatch(word):
                found = self._run(plain[1].lower()) + (self._run(plain[2]) if plain[2] else b"")
            else:
                found = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= 64:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        known, word = self.known.get, self._word
        return b"".join([known(w) or word(w) for w in (text or "").replace("\n", " ").split(" ")])


def _shown() -> dict[int, str]:
    """How the vocabulary writes bytes: printable ones of Latin-1 as themselves, the
    others as the characters from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


SHOWN = _shown()
# Letters that compose with nothing beside them, and ASCII marks without the apostrophe.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


@functools.cache
def words_of(path: str) -> Words:
    """One for each Python worker, which runs many tasks."""
    return Words(path)


def pieces(
    docs: DataFrame, path: str, capacity: int, end: int, id_col: str, text_col: str, with_ids: bool
) -> DataFrame:
    """The pieces of all documents with the CRC-32 of their ids, and the ids if asked for."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(docs.sparkSession.createDataFrame([], PIECES).schema)
    closing, step = array("I", [end]).tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for batch in batches:
            for first in range(0, len(batch), READ_ROWS):
                some = batch.slice(first, READ_ROWS)
                rows = []
                for i, text in zip(*some.columns):
                    i, ids = i.as_py(), words.encode(text.as_py()) + closing
                    for at in range(0, len(ids), step):
                        part = ids[at : at + step]
                        values = np.frombuffer(part, "<i4") if with_ids else None
                        rows.append((i, at // step, at // 4, len(part) // 4, zlib.crc32(part), values))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


class Knapsack:
    """Best values of the lengths by capacity; a length may be taken again and again."""

    def __init__(self, lengths: np.ndarray, values: np.ndarray, capacity: int):
        self.lengths = lengths
        self.best = best = np.zeros(capacity + 1)
        self.last = last = np.full(capacity + 1, -1)  # index of a length taken, -1 for none
        fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
        for c in range(int(lengths[0]), capacity + 1):
            options = best[c - lengths[: fitting[c]]] + values[: fitting[c]]
            choice = int(options.argmax())
            if options[choice] > best[c - 1]:
                best[c], last[c] = options[choice], choice
            else:
                best[c] = best[c - 1]

    def configuration(self, capacity: int) -> list[int]:
        taken = []
        while capacity > 0:
            if (choice := int(self.last[capacity])) < 0:
                capacity -= 1
            else:
                taken.append(choice)
                capacity -= int(self.lengths[choice])
        return taken


def solve(histogram: dict[int, int], capacity: int) -> dict[Configuration, float]:
    """A solution of the configuration program, up to the accuracy of the weights."""
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[length] for length in lengths.tolist()], float)
    covered = np.zeros(len(lengths))  # how many times over each length is held
    used: Counter[tuple[int, ...]] = Counter()
    prices = lengths / capacity
    for _ in range(PRICINGS):
        values = prices * np.exp(-covered)
        knapsack = Knapsack(lengths, values, capacity)
        enough = (1 - EPSILON) * knapsack.best[capacity]
        for forced in np.argsort(covered, kind="stable").tolist():
            taken = [forced, *knapsack.configuration(capacity - int(lengths[forced]))]
            if values[taken].sum() < enough:
                continue
            kinds, times = np.unique(taken, return_counts=True)
            step = EPSILON * float((counts[kinds] / times).min())
            used[tuple(sorted(taken, reverse=True))] += step
            covered[kinds] += step * times / counts[kinds]
            values[kinds] = prices[kinds] * np.exp(-covered[kinds])
    scale = max(float(covered.min()), EPSILON)
    return {tuple(lengths[list(taken)].tolist()): x / scale for taken, x in used.items()}


def rounded(fractions: dict[Configuration, float], left: Counter[int]) -> dict[Configuration, int]:
    """Whole numbers of configurations, as many as the pieces left allow; takes these off."""
    plan = {}
    for taken, x in sorted(fractions.items(), key=lambda f: (-sum(f[0]), -f[1], f[0])):
        times = Counter(taken)
        most = min(left[length] // n for length, n in times.items())
        if number := min(most, int(np.ceil(x))):
            plan[taken] = number
            for length, n in times.items():
                left[length] -= n * number
    return plan


def best_fit(left: Counter[int], capacity: int) -> dict[Configuration, int]:
    """The rest, longest first, each into the fullest sequence it fits; equal sequences and
    equal pieces are handled together."""
    by_room: dict[int, Counter[Configuration]] = {}
    for length in sorted(+left, reverse=True):
        number = left[length]
        while number:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                # New sequences, each filled with this length as far as pieces go.
                each = min(capacity // length, number)
                opened = number // each
                by_room.setdefault(capacity - each * length, Counter())[(length,) * each] += opened
                number -= opened * each
                continue
            taken, open_now = next(iter(by_room[room].items()))
            each = min(room // length, number)
            filled = min(open_now, number // each)
            by_room[room][taken] -= filled
            if not by_room[room][taken]:
                del by_room[room][taken]
            if not by_room[room]:
                del by_room[room]
            by_room.setdefault(room - each * length, Counter())[taken + (length,) * each] += filled
            number -= filled * each
    plan: Counter[Configuration] = Counter()
    for sequences in by_room.values():
        plan.update(sequences)
    return dict(plan)


def plan(histogram: dict[int, int], capacity: int) -> dict[Configuration, int]:
    """Configurations and their numbers that hold every piece exactly once."""
    left, out = Counter(histogram), Counter()
    for _ in range(ROUNDS):
        left = +left
        before = sum(left.values())
        if not before:
            break
        out.update(rounded(solve(left, capacity), left))
        if sum(left.values()) > 0.9 * before:
            break
    out.update(best_fit(left, capacity))
    return dict(out)


def slots(planned: dict[Configuration, int]) -> dict[int, np.ndarray]:
    """For each length the rows (first number, number in a sequence, first sequence, offset):
    pieces numbered from there on lie in these sequences, so many in each."""
    out: dict[int, list[tuple]] = {}
    numbered: Counter[int] = Counter()
    sequence = 0
    for taken, number in planned.items():
        offset = 0
        for length, each in sorted(Counter(taken).items(), reverse=True):
            out.setdefault(length, []).append((numbered[length], each, sequence, offset))
            numbered[length] += each * number
            offset += each * length
        sequence += number
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with their ``number`` among those of their length, from 0 without gaps.

    A part is up to ``NUMBERED`` rows that were written one after the other, so a length
    that most pieces have is numbered in many tasks.
    """
    rows = pieces.withColumn("part", F.expr(f"row - row % {NUMBERED}"))
    sums = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("count"))
    before = counts.select("length", "part", F.coalesce(F.sum("count").over(sums), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1
    return rows.withColumn("own", own).join(before, ["length", "part"]).withColumn("number", F.col("before") + F.col("own")).drop("part", "own", "before")


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end: int = END,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Each piece of each document with its place: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset``, and with ``with_ids`` the token ids."""
    spark = docs.sparkSession
    made = pieces(docs, path, capacity, end, id_col, text_col, with_ids)
    made = made if with_ids else made.drop("ids")
    rows = written(made.withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    histogram = {r.length: r["count"] for r in rows.groupBy("length").count().collect()}  # up to capacity rows
    shared = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), np.int64)
        for value, index in length.groupby(length).indices.items():
            known, n = shared.value[value], number.to_numpy()[index]
            first, each, sequence, offset = known[np.searchsorted(known[:, 0], n, side="right") - 1].T
            out[index, 0] = sequence + (n - first) // each
            out[index, 1] = offset + (n - first) % each * value
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    placed = numbered(rows).withColumn("at", place("length", "number"))
    ids = ["ids"] if with_ids else []
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *ids)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``ids`` and ``doc_ids`` of each sequence; takes rows packed ``with_ids``."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids")
    )
