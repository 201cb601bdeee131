"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``max_bits`` bits exactly if some value lies
within half of that of both. So every distinct fingerprint is given all its
variants within the half radius (2,081 for 4 of 64 bits), and fingerprints with a
variant in common are linked: each to the smallest one of the variant, which spans
the same components as all pairs and makes no pairs within a group. Links are
verified by their bit distance.

Variants are shuffled by a linear hash of their bits. The hash of a variant is the
hash of the fingerprint xor the hash of the flipped bits, so a fingerprint crosses
the shuffle once for each class of flips (``CLASSES`` or more) instead of once for
each variant, and the receiving task makes the variants of its class. The number of
classes follows the number of distinct fingerprints, so a class has at most
``CLASS_VARIANTS`` variants at any size, and a task sorts ``SORTED`` at a time.

Defined cases: a null text counts as empty; texts without words have fingerprint
zero, which links like any other; a text with fewer words than a shingle is one
shingle; of very long texts all shingles count, some 65,000 at a time; a null id gets the smallest id of its component, null if there is none;
repeated rows get equal results; an empty table gives an empty table. Results have
the columns named here only, so extra columns can't clash.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens.llm.tables import fold, written

BITS = 64
CLASSES = 128
CLASS_VARIANTS = 1 << 24
SORTED = 1 << 21
SEED = 42


def fingerprint(text: str | None, width: int) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(word) + 1 for word in words))
    starts = [0, *ends[: max(0, len(words) - width)]]
    stops = [end - 1 for end in ends[min(width, len(words)) - 1 :]]
    hashed = map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts, stops)), repeat(SEED))
    hashes = np.fromiter(hashed, np.uint64, len(starts))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        seen = np.bincount((octets + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
        counts += (seen @ OCTET_BITS).ravel()
    return int(((2 * counts > len(hashes)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


OCTET_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprints(
    docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp``, the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(text.as_py(), width) for text in batch.column(1)], np.uint64)
            columns = [batch.column(0), batch.column(2), pa.array(bits.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.xxhash64(text_col).alias("text_hash"),
    )
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def flips(max_bits: int) -> np.ndarray:
    """All values with at most half of ``max_bits`` bits set."""
    if max_bits < 0 or max_bits % 2:
        raise ValueError("max_bits must be even, so that two half radii make it up")
    each = (bits for n in range(max_bits // 2 + 1) for bits in combinations(range(BITS), n))
    return np.array([sum(1 << bit for bit in bits) for bits in each], np.uint64)


def parity_rows(n: int) -> list[int]:
    """Fixed random bit masks: the parity under each is one bit of the linear hash."""
    draw = random.Random(SEED)
    return [draw.getrandbits(BITS) for _ in range(n)]


def linear_hash(values: np.ndarray, rows: list[int]) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for bit, row in enumerate(rows):
        out |= (np.bitwise_count(values & np.uint64(row)) & 1).astype(np.int64) << bit
    return out


def linear_hash_column(value: Column, rows: list[int]) -> Column:
    signed = [row - (1 << BITS) if row >> (BITS - 1) else row for row in rows]
    if not rows:
        return F.lit(0)
    return fold([F.bit_count(value.bitwiseAND(F.lit(row))) % 2 * (1 << bit) for bit, row in enumerate(signed)])


def class_links(
    fps: np.ndarray, own: int, class_bits: int, masks: np.ndarray, max_bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a class with another one in reach, and the smallest that
    each is connected to by variants of this class."""
    fps = np.unique(fps)
    # Variants are made and sorted in parts, told apart by further bits of the hash.
    per_class = len(fps) * len(masks) >> class_bits
    extra = max(0, (per_class // SORTED).bit_length())
    rows = parity_rows(class_bits + extra)
    of_masks = linear_hash(masks, rows)
    masks = masks[np.argsort(of_masks, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(of_masks, minlength=1 << len(rows)))])
    of_fps = linear_hash(fps, rows)
    left, right = [], []
    for part in range(1 << extra):
        wanted = of_fps ^ (part << class_bits | own)
        counts = first[wanted + 1] - first[wanted]
        source = np.repeat(np.arange(len(fps)), counts)
        nth = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts)
        variants = fps[source] ^ masks[first[wanted[source]] + nth]
        ordered = np.sort(variants)
        met = ordered[1:][ordered[1:] == ordered[:-1]]
        marked = np.zeros(1 << 22, bool)  # narrows down; equality decides
        low = np.uint64(len(marked) - 1)
        marked[met & low] = True
        chosen = np.flatnonzero(marked[variants & low])
        chosen = chosen[np.lexsort((source[chosen], variants[chosen]))]
        values, members = variants[chosen], source[chosen]
        new = np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]
        heads = members[np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))]
        keep = heads != members
        pairs = np.unique(np.stack([heads[keep], members[keep]]), axis=1)
        left.append(pairs[0])
        right.append(pairs[1])
    a, b = np.concatenate(left), np.concatenate(right)
    near = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
    a, b = a[near], b[near]
    labels = np.arange(len(fps))
    while True:
        least = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, a, least)
        np.minimum.at(labels, b, least)
        labels = labels[labels]
        if np.array_equal(before, labels):
            break
    linked = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[linked], fps[labels[linked]]


def links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """``a`` and ``b``: enough links between the distinct fingerprints in column
    ``fp`` to connect all that are connected."""
    masks = flips(max_bits)
    n = distinct.count()
    class_bits = max(CLASSES, -(-n * len(masks) // CLASS_VARIANTS)).bit_length() - 1
    class_bits += (1 << class_bits) * CLASS_VARIANTS < n * len(masks)
    rows = parity_rows(class_bits)
    reached = sorted(set(linear_hash(masks, rows).tolist()))  # one for each flip at most

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        a, b = class_links(fps, key[0].as_py(), class_bits, masks, max_bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    own = linear_hash_column(F.col("fp"), rows).cast("int")
    dealt = distinct.select("fp", F.explode(F.lit(reached).cast("array<int>")).alias("flip"))
    classes = dealt.select("fp", F.col("flip").bitwiseXOR(own).alias("class"))
    return classes.groupBy("class").applyInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected to, for all nodes of
    the links. Each round takes the neighbours' and then the root's own root."""
    edges = written(edges, "ball-links")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), "ball-roots")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "root")
        heard = heard.groupBy("node").agg(F.min("root").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.col("root").alias("was"), F.least("root", "heard").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = written(
            nearer.join(jump, "root", "left").select("node", "was", F.coalesce("above", "root").alias("root")),
            "ball-roots",
        )
        labels = after.select("node", "root")
        if after.filter("was <> root").isEmpty():
            return labels


def _rooted(docs: DataFrame, width: int, max_bits: int, id_col: str, text_col: str) -> DataFrame:
    """All rows with ``fp``, ``root``, the smallest fingerprint of the component, and
    ``component_id``."""
    rows = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(
    docs: DataFrame, width: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the
    smallest ``doc_id`` reachable over links, for every row."""
    return _rooted(docs, width, max_bits, id_col, text_col).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, width: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents, all columns, with one row of each component: the one with the
    smallest id. Null ids come last; of rows equal in id and text one stays."""
    rows = _rooted(docs, width, max_bits, id_col, text_col)
    copies = rows.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")
    first = copies.groupBy("root").agg(F.min(order).alias("w"))
    first = written(first.select(F.col("w.doc_id").alias("__id"), F.col("w.text_hash").alias("__hash"), F.col("w.n").alias("__n")), "first-rows")

    def of(keys: DataFrame) -> DataFrame:
        same = docs[id_col].cast("long").eqNullSafe(keys["__id"]) & (F.xxhash64(docs[text_col]) == keys["__hash"])
        return docs.join(keys, same, "left_semi")

    single, several = first.filter("__n = 1"), first.filter("__n > 1")
    return of(single).unionByName(of(several).dropDuplicates([id_col, text_col]))
