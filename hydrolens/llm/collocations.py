"""Collocations by Toivonen's mining of contiguous phrases.

A phrase is frequent in its language if it occurs ``support`` times. A sample of the
texts, counted with a lower threshold, proposes phrases; its negative border are the
phrases that are not proposed although all their parts are. One full pass counts both
exactly: a phrase is counted if its words but the last and its words but the first are
proposed, single words always. A phrase of the border that proves frequent makes longer
phrases possible that were not counted; they are proposed, and another pass counts
just what that adds. Passes end when no border phrase proves frequent, so every frequent
phrase has been counted over all texts, whatever the sample was.

What is proposed goes to the tasks as bit maps of a fixed size, one for each length
(``Sizes.bits``); two phrases on one bit only make a pass count more than it must.

Most phrases of the border are rare. So before the full pass counts phrases one by one, all
that it may count are counted by hash, in a table of a fixed size; a hash that doesn't reach
the support tells that none of its phrases does.

Texts are read once, into a written table of chunks: the words of a chunk and the word
numbers in order of the text. Passes work on chunks, in numpy, and add counts up before
they are shuffled by phrase. Chunks end within long texts; the words before the cut are
repeated as context (as negative numbers), in which no phrase may end.

Defined cases: a null text counts as empty, a null language as ``und``; repeated rows
count each; very long texts are cut as said, without loss; equal scores go by count, then
by the phrase's bytes; a table without words gives an empty table. Only the named
columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydrolens.llm.tables import written

LONGEST = 4
SUPPORT = 30
SAMPLE = 0.2
SEED = 12
BUCKETS = 1 << 24  # counts by hash, of a task and of all
BLOCK = 1 << 16  # of these handled at once


@dataclass(frozen=True)
class Sizes:
    """Bits of a bit map, words of a chunk, and bytes of a text that are split at once."""

    bits: int = 1 << 24
    chunk_words: int = 1 << 19
    slice_bytes: int = 1 << 20


SIZES = Sizes()

#: Words joined by blanks and numbers as bytes: as arrays an executor would hold each of them in
#: several columns of its own, for all chunks of a row group at once.
CHUNK = "lang string, n long, sampled int, vocabulary binary, numbers binary"
#: A chunk is a row of some MB, so row groups have few rows and a page ends after any row; the
#: default codec keeps buffers of the largest page outside the heap, this one doesn't.
STORED = {"compression": "zstd", "parquet.block.row.count.limit": "4", "parquet.page.size.row.check.min": "1"}
#: Rows of texts and of chunks that go to Python at once; Spark's default goes up to 64 MB, held several times.
BATCH_TEXTS, BATCH_CHUNKS = 1000, 16
COUNTS = "lang string, n int, phrase string, count long"

MARK = b"."  # stands for all marks that end a piece, and is in no word
SPLIT = bytes(
    ord(MARK) if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


class Numbers(dict):
    """Word to number, in order of first sight; the mark is number 0."""

    def __init__(self):
        self[MARK] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def slices(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Words and marks of a text, in parts of about ``size`` bytes."""
    text, at = text.translate(SPLIT), 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].replace(MARK, b" . ").split()
        at = end


class Chunk:
    """Numbered words of many texts of one language; those of sampled texts come first."""

    def __init__(self):
        self.numbers, self.parts = Numbers(), {True: [], False: []}

    def add(self, words: list[bytes], context: list[bytes], sampled: bool) -> None:
        number = self.numbers.__getitem__
        before = ~np.fromiter(map(number, context), np.int32, len(context))
        own = np.fromiter(map(number, words), np.int32, len(words))
        # A mark at the end, and none within the context (~0 is a mark there).
        self.parts[sampled] += [before, own, np.zeros(1, np.int32)]


def _schema(ddl: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def chunks(docs: DataFrame, lang_col: str, text_col: str, sample: float, sizes: Sizes = SIZES) -> DataFrame:
    """The words of all texts as numbers; the first ``sampled`` are those of the sample."""
    out = _schema(CHUNK, docs.sparkSession)

    def rows(open_chunks: dict) -> Iterator[pa.RecordBatch]:
        for lang, chunk in open_chunks.items():
            numbers = np.concatenate([*chunk.parts[True], *chunk.parts[False]])
            own = pa.array([int((numbers > 0).sum())])
            sampled = pa.array([sum(map(len, chunk.parts[True]))], pa.int32())
            columns = [pa.array([lang]), own, sampled, pa.array([b" ".join(chunk.numbers)]), pa.array([numbers.tobytes()])]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_chunks, size = {}, 0
        for batch in batches:
            for lang, sampled, text in zip(*batch.columns):
                context = []
                for words in slices(text.as_py(), sizes.slice_bytes):
                    chunk = open_chunks.setdefault(lang.as_py(), Chunk())
                    chunk.add(words, context, sampled.as_py())
                    size += len(words)
                    context = (context + words)[1 - LONGEST :]
                    if size >= sizes.chunk_words:
                        yield from rows(open_chunks)
                        open_chunks, size = {}, 0
        yield from rows(open_chunks)

    picked = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        (F.rand(SEED) < sample).alias("sampled"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    return picked.mapInArrow(run, CHUNK)


def word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    """Hashes of strings: polynomials of their bytes, and the language. A hash only decides
    where a bit lies, so nothing depends on how well it spreads but time."""
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    starts, lengths = ends[:-1] - ends[0], np.diff(ends)
    within = np.arange(len(data)) - np.repeat(starts, lengths)
    longest = int(lengths.max(initial=0))
    powers = np.cumprod(np.full(longest + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * powers[within], dtype=np.uint64)])
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode(), SEED))
    return followed(np.full(len(words), seed), sums[starts + lengths] - sums[starts])


def followed(phrases: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    mixed = (phrases ^ (phrases >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def bits_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(7)) % np.uint64(bits)


def has_bit(bit_map: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = bits_of(hashes, 8 * len(bit_map))
    return (bit_map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


@dataclass
class Proposed:
    """For each length but the longest a bit map of the phrases that are proposed."""

    maps: list[np.ndarray]

    @classmethod
    def none(cls, bits: int) -> Proposed:
        return cls([np.zeros(bits // 8, np.uint8) for _ in range(1, LONGEST)])

    def has(self, n: int, hashes: np.ndarray) -> np.ndarray:
        return has_bit(self.maps[n - 1], hashes)

    def joined(self, other: Proposed) -> Proposed:
        return Proposed([a | b for a, b in zip(self.maps, other.maps)])


def countable(
    lang: str, vocabulary: pa.Array, numbers: np.ndarray, old: Proposed | None, new: Proposed, lengths: range
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lengths, the places where phrases end that ``new`` makes countable and ``old`` did not,
    and these phrases' hashes; with no ``old`` all that ``new`` makes countable, and single words."""
    own = numbers >= 0
    words = np.where(own, numbers, ~numbers)
    of_words = word_hashes(lang, vocabulary)
    is_word = np.arange(len(vocabulary)) > 0
    if old is None and 1 in lengths:
        ends = np.flatnonzero(own & (words > 0))
        yield 1, ends, of_words[words[ends]]
    # For each place whether the phrase of the length before that ends here is proposed.
    in_new = (new.has(1, of_words) & is_word)[words]
    in_old = (old.has(1, of_words) & is_word)[words] if old else np.zeros(len(words), bool)
    hashes = of_words[words]
    for n in range(2, lengths.stop):
        ends = np.flatnonzero(in_new[:-1] & in_new[1:]) + 1
        longer = followed(hashes[ends - 1], of_words[words[ends]])
        was_old = in_old[ends - 1] & in_old[ends]
        if n in lengths:
            asked = own[ends] & ~was_old
            yield n, ends[asked], longer[asked]
        in_new, in_old = np.zeros(len(words), bool), np.zeros(len(words), bool)
        if n < LONGEST:
            in_new[ends] = new.has(n, longer)
            if old:
                in_old[ends] = was_old & old.has(n, longer)
        hashes = np.zeros(len(words), np.uint64)
        hashes[ends] = longer


def counts_at(ends: np.ndarray, n: int, numbers: np.ndarray, vocabulary: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different phrases of ``n`` words that end at some places, and how often."""
    words = np.where(numbers >= 0, numbers, ~numbers)
    if n == 1:
        first, counts = np.unique(words[ends], return_counts=True)
        return vocabulary.take(pa.array(first)), counts
    keys = words[ends - n + 1].astype(np.int64)
    for back in range(n - 2, -1, -1):
        _, first, keys, counts = np.unique(
            keys * len(vocabulary) + words[ends - back], return_index=True, return_inverse=True, return_counts=True
        )
    texts = [vocabulary.take(pa.array(words[ends[first] - back])) for back in range(n - 1, -1, -1)]
    return pc.binary_join_element_wise(*texts, " "), counts


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within gives Python so many rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _chunks_of(batches: Iterator[pa.RecordBatch], sample: bool = False) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    for batch in batches:
        for i, (lang, sampled) in enumerate(zip(*batch.columns[:2])):
            words = pc.split_pattern(batch.column(2).slice(i, 1).cast(pa.string()), " ").flatten()
            numbers = np.frombuffer(batch.column(3)[i].as_buffer(), np.int32)
            yield lang.as_py(), words, numbers[: sampled.as_py()] if sample else numbers


def reaching(chunks: DataFrame, new: Proposed, lengths: range, least: int) -> np.ndarray:
    """A bit map of hashes, of ``BUCKETS`` bits: without a phrase's bit it can't occur ``least`` times.

    Each task counts its phrases by hash, up to ``least`` (more can't matter); the counts of
    all tasks are added up, and hashes that reach ``least`` keep their bit.
    """
    spark = chunks.sparkSession
    shared, kind = spark.sparkContext.broadcast(new), np.min_scalar_type(least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, kind)
        for chunk in _chunks_of(batches):
            for _, _, hashes in countable(*chunk, None, shared.value, lengths):
                at, often = np.unique(bits_of(hashes, BUCKETS), return_counts=True)
                counts[at] = np.minimum(counts[at] + often, least)
        for block, part in enumerate(np.split(counts, BUCKETS // BLOCK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()])], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(BLOCK, np.int64)

        def full() -> pa.RecordBatch:
            bits = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits])], ["block", "counts"])

        for batch in batches:
            for one, counts in zip(*batch.columns):
                if one.as_py() != block:
                    if block is not None:
                        yield full()
                    block, total = one.as_py(), np.zeros(BLOCK, np.int64)
                total += np.frombuffer(counts.as_py(), kind)
        if block is not None:
            yield full()

    parts = chunks.select("lang", "sampled", "vocabulary", "numbers").mapInArrow(count, "block int, counts binary")
    sums = parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, counts binary")
    out = np.zeros(BUCKETS // 8, np.uint8)
    with batches_of(spark, BATCH_CHUNKS):
        found = sums.collect()  # BUCKETS bits at most
    for row in found:
        out[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = np.frombuffer(row.counts, np.uint8)
    shared.unpersist()
    return out


def counted(
    chunks: DataFrame, old: Proposed | None, new: Proposed, lengths: range, least: int, reached: np.ndarray | None = None,
    sample: bool = False,
) -> DataFrame:
    """Counts of at least ``least`` over all chunks of what :func:`countable` gives, a written
    table; phrases without a bit in ``reached`` are passed over."""
    spark = chunks.sparkSession
    out, shared = _schema(COUNTS, spark), spark.sparkContext.broadcast((old, new, reached))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new, reached = shared.value
        for lang, vocabulary, numbers in _chunks_of(batches, sample):
            for n, ends, hashes in countable(lang, vocabulary, numbers, old, new, lengths):
                if reached is not None:
                    ends = ends[has_bit(reached, hashes)]
                phrases, counts = counts_at(ends, n, numbers, vocabulary)
                for i in range(0, len(counts), 1 << 16):
                    some = counts[i : i + (1 << 16)]
                    columns = [
                        pa.array([lang] * len(some)),
                        pa.array(np.full(len(some), n, np.int32)),
                        phrases.slice(i, len(some)),
                        pa.array(some.astype(np.int64)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=out)

    rows = chunks.select("lang", "sampled", "vocabulary", "numbers").mapInArrow(run, COUNTS)
    sums = rows.groupBy("lang", "n", "phrase").agg(F.sum("count").alias("count")).filter(F.col("count") >= least)
    with batches_of(spark, BATCH_CHUNKS):
        table = written(sums, "phrase-counts")
    shared.unpersist()
    return table


def proposed(frequent: DataFrame, n_bits: int) -> Proposed:
    """Bit maps of these phrases; what comes to the driver has ``n_bits`` bits for a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, lengths = batch.column(0), batch.column(1).to_numpy()
            for lang in langs.unique():
                for n in range(1, LONGEST):
                    own = pc.and_(pc.equal(langs, lang), pa.array(lengths == n))
                    words = pc.split_pattern(batch.column(2).filter(own), " ").flatten()
                    if not len(words):
                        continue
                    each = word_hashes(lang.as_py(), words).reshape(-1, n)
                    hashed = each[:, 0]
                    for i in range(1, n):
                        hashed = followed(hashed, each[:, i])
                    bits = pa.array(bits_of(hashed, n_bits).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), n, np.int32)), bits], ["n", "bit"])

    rows = frequent.select("lang", "n", "phrase").filter(F.col("n") < LONGEST).mapInArrow(run, "n int, bit long")
    # Spark's bit maps number bits from 1 on, in buckets of equal size.
    maps = rows.groupBy("n", F.expr("bitmap_bucket_number(bit + 1)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits")
    )
    out = Proposed.none(n_bits)
    for row in maps.collect():
        bits = np.frombuffer(row.bits, np.uint8)
        at = (row.bucket - 1) * len(bits)
        part = out.maps[row.n - 1][at : at + len(bits)]
        part |= bits[: len(part)]
    return out


def sample_proposal(chunks: DataFrame, least: int, bits: int) -> Proposed:
    """What is frequent in the sampled chunks, one length after the other."""
    found = Proposed.none(bits)
    for n in range(1, LONGEST):
        found = found.joined(proposed(counted(chunks, None, found, range(n, n + 1), least, sample=True), bits))
    return found


def frequent_phrases(
    docs: DataFrame,
    support: int = SUPPORT,
    sample: float = SAMPLE,
    lang_col: str = "lang",
    text_col: str = "text",
    passes: list | None = None,
    sizes: Sizes = SIZES,
) -> tuple[DataFrame, DataFrame]:
    """Exact counts (``lang``, ``n``, ``phrase``, ``count``) of all phrases of up to ``LONGEST``
    words with at least ``support`` occurrences, and the number of words per language. What
    each full pass found goes to ``passes``."""
    with batches_of(docs.sparkSession, BATCH_TEXTS):
        texts = written(chunks(docs, lang_col, text_col, sample, sizes), "phrase-chunks", **STORED)
    expected = support * sample
    # Half a standard deviation below what a phrase at the support has in the sample. Lower,
    # more infrequent phrases are proposed and their longer ones counted; higher, more pass by.
    least = max(2, round(expected - (expected * (1 - sample)) ** 0.5 / 2))
    new, old = sample_proposal(texts, least, sizes.bits), None
    result = None
    while True:
        # Phrases that became proposed make longer ones countable.
        lengths = range(1 if old is None else 2 + next(i for i, n in enumerate(failures) if n), LONGEST + 1)
        # The first pass meets far more phrases of the border than can be frequent.
        reached = reaching(texts, new, lengths, support) if old is None else None
        found = counted(texts, old, new, lengths, support, reached)
        result = found if result is None else result.unionByName(found)
        known = proposed(found, sizes.bits)
        grown = new.joined(known)
        failures = [int(np.bitwise_count(a ^ b).sum()) for a, b in zip(grown.maps, new.maps)]
        if passes is not None:
            passes.append(failures)
        if not any(failures):
            break
        old, new = new, grown
    return result, texts.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(
    docs: DataFrame,
    support: int = SUPPORT,
    top: int = 2000,
    sample: float = SAMPLE,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """Each language's ``top`` phrases: ``rank``, ``phrase``, ``a`` its count, ``l`` and ``r`` the
    counts of its parts at the weakest cut, ``n`` words of the language, ``score``."""
    found, totals = frequent_phrases(docs, support, sample, lang_col, text_col)
    words = F.split("phrase", " ")
    candidates = found.filter("n > 1").select("lang", "phrase", "n", F.col("count").alias("a"), words.alias("words"))
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("count"))
    text = "array_join(slice(words, {}, {}), ' ')"
    # Both parts of each cut, each looked up once.
    cut = f"""explode(flatten(transform(sequence(1, n - 1), k -> array(
        struct(k, true AS head, {text.format(1, "k")} AS part),
        struct(k, false AS head, {text.format("k + 1", "n - k")} AS part))))) AS cut"""
    cuts = candidates.selectExpr("lang", "phrase", "a", cut).select("lang", "phrase", "a", "cut.*").join(parts, ["lang", "part"])
    cuts = cuts.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("head"), F.col("count"))).alias("l"), F.max(F.when(~F.col("head"), F.col("count"))).alias("r")
    )
    score = F.expr("CAST(a AS DECIMAL(20, 0)) * 2000000 div (l + r)")
    weakest = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    scored = weakest.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    # Phrases of which most occurrences lie within one longer phrase go.
    inner = f"""explode(flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1), i ->
        {text.format("i", "m")})))) AS phrase"""
    longer = candidates.filter("n > 2").selectExpr("lang", "a AS longer", inner).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter("longer IS NULL OR longer * 100.0 < a * 80.0")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select(
        "lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
