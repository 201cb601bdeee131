"""Ranked lexical search as exact inner-product search in sparse ball trees.

A document is a sparse vector of whole-numbered impacts, one for each of its terms that
some item asks for; an item is a vector of whole-numbered weights; a score is their
inner product. Document vectors are dealt into trees of neighbours (by the term that
weighs most, then the id, so that a common term or id is spread over many tasks). Each
node of a tree keeps a whole-numbered centroid, the terms its documents have, and the
largest squared distance to the centroid, all exact. What a document of the node can
score is at most

    item . centroid + |item, on the node's terms| * radius

where only the square root is rounded, upwards. Nodes are taken best-first; a node whose
bound is below the lowest score still wanted is pruned with all below it; leaves are
scored in 64-bit integers. Two passes read the trees: the first looks into one leaf of each
tree, which gives every item a score that its last result has at least; the second
searches with these scores as a start, so a task hands on few rows besides the results.

Items are taken in blocks of about 4 MB of text, so the vocabulary that goes to all tasks
is bounded; each block reads the documents once. A tree has at most 4,096 documents and
about a million terms of documents (``Sizes``).

Defined cases: a null or empty text has no terms, so such a document is never found and
such an item has no rows; equal scores go by ascending id, null ids last; repeated
documents are each ranked; items equal in id and text are one, items with equal ids and
other texts are ranked each on its own; very long texts are read whole, a vector has
no more entries than a block has terms; empty tables give an empty table. Only the
named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrolens.llm.tables import written

SPLIT_ROUNDS = 4
READ_ROWS = 512


@dataclass(frozen=True)
class Sizes:
    """Bytes of a block's texts, documents and their terms in a tree, documents in a leaf,
    and entries of the weight matrix that a tree meets at once."""

    block_bytes: int = 4 << 20
    tree_rows: int = 4096
    tree_terms: int = 1 << 20
    leaf_rows: int = 48
    group: int = 4 << 20


SIZES = Sizes()

VECTOR = "doc_id long, n long, terms array<int>, counts array<int>"
LEAD = "doc_id long, lead int, terms array<int>, impacts array<long>"
TREE = (
    "ids array<long>, starts array<int>, places array<int>, impacts array<long>, terms array<int>, "
    "first array<int>, last array<int>, left array<int>, radius2 array<long>, "
    "node_starts array<int>, node_places array<int>, centroids array<long>"
)
FOUND = "item int, doc_id long, score long"

# What is no term splits: all of ASCII but digits and letters.
SPLIT = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order, repeats included."""
    return (text or b"").translate(SPLIT).split()


@dataclass
class Items:
    """A block of items: the terms of item i are ``terms[starts[i]:starts[i + 1]]``."""

    ids: list
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray | None = None
    floors: np.ndarray | None = None  # a score that the last wanted result has at least


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _arrow(schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``n``, the number of a text's terms, and how often it has each term of the vocabulary."""
    spark = docs.sparkSession
    shared, out = spark.sparkContext.broadcast(vocabulary), _arrow(VECTOR, spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            for at in range(0, len(batch), READ_ROWS):
                some = batch.slice(at, READ_ROWS)
                n, terms, counts = [], [], []
                for text in some.column(1):
                    found = words(text.as_py())
                    n.append(len(found))
                    known = [i for i in map(number, found) if i is not None]
                    have, often = np.unique(np.array(known, np.int32), return_counts=True)
                    terms.append(have)
                    counts.append(often)
                columns = [some.column(0), pa.array(n, pa.int64()), _lists(terms, pa.int32()), _lists(counts, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, VECTOR)


def leads(vectors: DataFrame, weights: np.ndarray, documents: int, terms: int) -> DataFrame:
    """Impacts of the documents with asked terms, and the term that weighs most."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    length = F.expr(f"10 + CAST(90 * CAST(n AS DECIMAL(20, 0)) * {documents} AS DECIMAL(38, 0)) div {terms}")
    impacts = F.expr("transform(counts, x -> (1000000000L * x) div (1000L * x + 8L * length))")
    rows = vectors.filter(F.size("terms") > 0).withColumn("length", length.cast("long"))
    rows = rows.select("doc_id", "terms", impacts.alias("impacts"))
    out = _arrow(LEAD, spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy()
            score = shared.value[flat] * batch.column(2).flatten().to_numpy()
            starts = batch.column(1).offsets.to_numpy()
            starts = starts - starts[0]
            best = [int(flat[a + score[a:b].argmax()]) for a, b in zip(starts[:-1], starts[1:])]
            columns = [batch.column(0), pa.array(best, pa.int32()), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return rows.mapInArrow(run, LEAD)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs between starts; no run is empty."""
    return np.add.reduceat(values, starts[:-1]) if len(starts) > 1 else np.zeros(0, np.int64)


class Vectors:
    """Some documents' vectors, in an order that the tree changes."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        self.terms, flat = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        self.places = [p for p in np.split(flat, np.cumsum([len(t) for t, _ in parts])[:-1])]
        self.impacts = [x for _, x in parts]

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, places and impacts of these rows, one after the other."""
        places = [self.places[r] for r in rows]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in places])])
        return starts, np.concatenate(places), np.concatenate([self.impacts[r] for r in rows])


def _halves(starts: np.ndarray, places: np.ndarray, impacts: np.ndarray, far: int, width: int) -> np.ndarray:
    """Order of the rows along the line between two far ones, then between the centres of
    the two halves; the middle cuts it, also where all rows are equal."""

    def along(line: np.ndarray) -> np.ndarray:
        return _sums(impacts * line[places], starts)

    def dense(rows: np.ndarray) -> np.ndarray:
        of_rows = np.repeat(np.isin(np.arange(len(starts) - 1), rows), np.diff(starts))
        return np.bincount(places[of_rows], weights=impacts[of_rows], minlength=width) / len(rows)

    one = dense(np.array([far]))
    other = dense(np.array([(_sums(impacts * impacts, starts) - 2 * along(one)).argmax()]))
    middle = (len(starts) - 1) // 2
    for _ in range(SPLIT_ROUNDS):
        order = np.argsort(along(one - other), kind="stable")
        other, one = dense(order[:middle]), dense(order[middle:])
    return order


def build(parts: list[tuple[np.ndarray, np.ndarray]], leaf_rows: int = SIZES.leaf_rows) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Order of the documents, and the tree over them in that order."""
    docs, order, nodes, sparse = Vectors(parts), np.arange(len(parts)), [], []
    width, spans = len(docs.terms), [(0, len(parts))]
    for first, last in spans:  # grows: the two halves of a node come one after the other
        starts, places, impacts = docs.of(order[first:last])
        total = np.bincount(places, weights=impacts, minlength=width)  # a centroid may be any point
        have = np.flatnonzero(np.bincount(places, minlength=width))
        centroid = np.zeros(width, np.int64)
        centroid[have] = np.rint(total[have] / (last - first)).astype(np.int64)
        distance = _sums(impacts * (impacts - 2 * centroid[places]), starts) + int((centroid * centroid).sum())
        split = last - first > leaf_rows
        nodes.append((first, last, len(spans) if split else -1, int(distance.max())))
        sparse.append((have, centroid[have]))
        if split:
            order[first:last] = order[first:last][_halves(starts, places, impacts, int(distance.argmax()), width)]
            middle = (first + last) // 2
            spans += [(first, middle), (middle, last)]
    starts, places, impacts = docs.of(order)
    table = np.array(nodes, np.int64)
    tree = {
        "starts": starts,
        "places": places,
        "impacts": impacts,
        "terms": docs.terms,
        "first": table[:, 0],
        "last": table[:, 1],
        "left": table[:, 2],
        "radius2": table[:, 3],
        "node_starts": np.cumsum([0, *[len(have) for have, _ in sparse]]),
        "node_places": np.concatenate([have for have, _ in sparse]),
        "centroids": np.concatenate([c for _, c in sparse]),
    }
    return order, tree


def trees(leads: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """One row per tree of neighbouring documents."""
    out = _arrow(TREE, leads.sparkSession)

    def row(ids: list, parts: list) -> pa.RecordBatch:
        order, tree = build(parts, sizes.leaf_rows)
        lists = {"ids": pa.array([[ids[i] for i in order]], out.field("ids").type)}
        for field in list(out)[1:]:
            lists[field.name] = _lists([tree[field.name]], field.type.value_type)
        return pa.RecordBatch.from_arrays([lists[f.name] for f in out], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size = [], [], 0
        for batch in batches:
            for i, terms, impacts in zip(*map(batch.column, range(3))):
                ids.append(i.as_py())
                parts.append((terms.values.to_numpy(), impacts.values.to_numpy()))
                size += len(parts[-1][0])
                if len(ids) >= sizes.tree_rows or size >= sizes.tree_terms:
                    yield row(ids, parts)
                    ids, parts, size = [], [], 0
        if ids:
            yield row(ids, parts)

    dealt = leads.repartitionByRange("lead", "doc_id")
    return dealt.select("doc_id", "terms", "impacts").mapInArrow(run, TREE)


class Best:
    """The best results of one item so far, and the score from which more are wanted."""

    def __init__(self, k: int, floor: int):
        self.k, self.wanted = k, max(1, floor)
        self.scores, self.ids, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        fit = scores >= self.wanted
        if not fit.any():
            return
        scores, ids, none = (np.concatenate(both) for both in ((self.scores, scores[fit]), (self.ids, ids[fit]), (self.none, none[fit])))
        order = np.lexsort((ids, none, -scores))[: self.k]
        self.scores, self.ids, self.none = scores[order], ids[order], none[order]
        if len(order) == self.k:
            self.wanted = max(self.wanted, int(self.scores[-1]))


class Search:
    """One tree and a group of items: bounds are computed once for each touched node."""

    def __init__(self, tree: dict[str, np.ndarray], items: Items, group: range):
        self.tree, self.bounds, self.leaves = tree, {}, 0
        terms = tree["terms"]
        self.weights = np.zeros((len(group), len(terms)), np.int64)
        for g, item in enumerate(group):
            asked = slice(items.starts[item], items.starts[item + 1])
            at = np.minimum(np.searchsorted(terms, items.terms[asked]), len(terms) - 1)
            held = terms[at] == items.terms[asked]
            self.weights[g, at[held]] = items.weights[asked][held]

    def bound(self, node: int) -> np.ndarray:
        """The most that a document of the node can score, for each item of the group."""
        if node not in self.bounds:
            part = slice(self.tree["node_starts"][node], self.tree["node_starts"][node + 1])
            weights = self.weights[:, self.tree["node_places"][part]]
            centre = weights @ self.tree["centroids"][part]
            squares = (weights * weights).sum(axis=1).astype(np.float64) * float(self.tree["radius2"][node])
            # Each rounding is within one part in 2**52; sixteen of them and one more are added.
            reach = np.ceil(np.sqrt(squares) * (1 + 2.0**-48)) + 1
            self.bounds[node] = centre + reach.astype(np.int64)
        return self.bounds[node]

    def run(self, g: int, best: Best, only_first: bool = False) -> None:
        tree, heap = self.tree, [(-int(self.bound(0)[g]), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < best.wanted:
                return  # all that wait have no higher bound
            if (left := int(tree["left"][node])) >= 0:
                for child in (left, left + 1):
                    heapq.heappush(heap, (-int(self.bound(child)[g]), child))
                continue
            self.leaves += 1
            rows = slice(tree["first"][node], tree["last"][node])
            starts = tree["starts"][tree["first"][node] : tree["last"][node] + 1]
            part = slice(starts[0], starts[-1])
            scores = _sums(self.weights[g, tree["places"][part]] * tree["impacts"][part], starts - starts[0])
            best.add(scores, tree["ids"][rows], tree["none"][rows])
            if only_first:
                return


def _read(batch: pa.RecordBatch, i: int) -> dict[str, np.ndarray]:
    tree = {f.name: batch.column(f.name)[i].values for f in batch.schema}
    ids = tree.pop("ids")
    return {name: values.to_numpy() for name, values in tree.items()} | {
        "ids": ids.fill_null(0).to_numpy(),
        "none": ids.is_null().to_numpy(zero_copy_only=False),
    }


def best_of_tasks(trees: DataFrame, items: Items, k: int, only_first: bool = False, group_size: int = SIZES.group) -> DataFrame:
    """Each task's best ``k`` documents of every item; with ``only_first`` from one leaf of each tree."""
    spark = trees.sparkSession
    shared, out = spark.sparkContext.broadcast(items), _arrow(FOUND, spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = [Best(k, int(floor)) for floor in items.floors]
        for batch in batches:
            for i in range(len(batch)):
                tree = _read(batch, i)
                size = max(1, group_size // len(tree["terms"]))
                for at in range(0, len(best), size):
                    group = range(at, min(at + size, len(best)))
                    search = Search(tree, items, group)
                    for g, item in enumerate(group):
                        search.run(g, best[item], only_first)
        for item, b in enumerate(best):
            if len(b.scores):
                columns = [pa.array(np.full(len(b.ids), item), pa.int32()), pa.array(b.ids, mask=b.none), pa.array(b.scores)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return trees.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def blocks(items: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Items with a column ``block``, and the number of blocks. No block of more than one
    item has over twice ``size`` bytes; sizes are measured."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // size))
    while n > 1:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text", F.lit(n)), F.lit(n)).cast("int"))
        sizes = dealt.groupBy("block").agg(F.count("*").alias("items"), F.sum(F.octet_length("text")).alias("size"))
        if (sizes.filter("items > 1").agg(F.max("size")).first()[0] or 0) <= 2 * size:
            return dealt, n
        n *= 2
    return items.withColumn("block", F.lit(0)), 1


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    sizes: Sizes = SIZES,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's ``k`` best documents."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    asked, n_blocks = blocks(asked.filter("text IS NOT NULL").distinct(), sizes.block_bytes)
    schema = spark.createDataFrame([], "item int, rank int, doc_id long, score long").schema
    result = None
    for block in range(n_blocks):
        texts = asked.filter(F.col("block") == block).select("item_id", "text").collect()  # bounded by the block
        texts = sorted(((t.item_id, sorted(set(words(t.text.encode())))) for t in texts), key=repr)
        vocabulary = {term: i for i, term in enumerate(sorted({term for _, terms in texts for term in terms}))}
        block_items = Items(
            [i for i, _ in texts],
            np.cumsum([0, *[len(terms) for _, terms in texts]]),
            np.array([vocabulary[term] for _, terms in texts for term in terms], np.int64),
        )
        found = _search_block(docs, block_items, vocabulary, k, id_col, text_col, sizes)
        ids = spark.createDataFrame(list(enumerate(block_items.ids)), f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        rows = (spark.createDataFrame([], schema) if found is None else found).join(F.broadcast(ids), "item")
        rows = rows.select("item_id", "rank", "doc_id", "score")
        result = rows if result is None else result.unionByName(rows)
    return result


def _search_block(docs: DataFrame, items: Items, vocabulary: dict, k: int, id_col: str, text_col: str, sizes: Sizes) -> DataFrame | None:
    counted = written(vectors(docs, vocabulary, id_col, text_col), "search-vectors")
    documents, terms = counted.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not documents or not vocabulary:
        return None
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most the vocabulary
    weights = np.array([weight(documents, 0)] * len(vocabulary), np.int64)
    for term, count in holding:
        weights[term] = weight(documents, count)
    items.weights = weights[items.terms]
    items.floors = np.zeros(len(items.ids), np.int64)
    index = written(trees(leads(counted, weights, documents, terms), sizes), "search-trees")
    first = _ranked(best_of_tasks(index, items, k, True, sizes.group), k)
    for row in first.filter(F.col("rank") == k).select("item", "score").collect():  # one row per item of the block
        items.floors[row.item] = row.score
    return _ranked(best_of_tasks(index, items, k, False, sizes.group), k).select("item", "rank", "doc_id", "score")
