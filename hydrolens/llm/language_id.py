"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of its byte 2-grams and 3-grams (lower-cased,
everything but letters as one space), hashed to ``DIMS`` dimensions and
normalised. Every language has up to ``CLUSTERS`` centroids, found by spherical
k-means; the predicted language is that of the centroid with the largest cosine. A
text is rejected if it lies further from all centroids than texts of its length do.

Document frequencies cover all learning rows. Centroids and distances are fitted on
about ``sample`` rows of each language, twice that at most, the rows with the lowest
hashes of id and text, so the fit is the same however rows are dealt.

Defined cases: a null text or one without a letter is ``und`` with score 0, and
rejected; so is every text if there is nothing to learn from; rows with a null label
are not learnt from; all grams of very long texts count; a null id is neither learnt from nor held out; ties go to the
alphabetically first language; repeated rows get equal results; an empty table gives
an empty table. ``identify`` hands on all columns and takes the names of its own from
the caller, so that none need clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolens.llm.tables import hidden

DIMS = 1 << 13
CLUSTERS = 4
SAMPLE = 600
SIZES = 20  # classes of text length, by powers of two
SLACK = 0.3  # of the least cosine seen in a class of lengths
UNKNOWN = "und"
BLOCK = 64  # texts multiplied with the centroids at a time

#: Bytes of letters: a-z, and all that aren't ASCII. The rest counts as a space.
LETTER = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def grams(text: str) -> np.ndarray:
    """Dimensions of the 2-grams and 3-grams of a text, in order."""
    octets = LETTER[np.frombuffer(f" {text} ".lower().encode(), np.uint8)]
    if len(octets) > 2:
        octets = octets[np.concatenate([[True], (octets[1:] != 32) | (octets[:-1] != 32)])]
    two = octets[:-1] << 8 | octets[1:]
    three = two[:-1] << 8 | octets[2:]
    keys = np.concatenate([two, three | 1 << 24])
    return (keys * np.uint32(2654435761) >> np.uint32(32 - DIMS.bit_length() + 1)).astype(np.int64)


def counts(text: str) -> np.ndarray:
    return np.bincount(grams(text), minlength=DIMS)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def size_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(int), SIZES - 1)


@dataclass(frozen=True)
class Model:
    languages: list[str]  # of each centroid
    weights: np.ndarray  # inverse document frequencies
    centroids: np.ndarray
    floors: np.ndarray  # least accepted cosine by class of lengths

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best centroid and its cosine, and whether the text is rejected."""
        rows = np.stack([counts(text) for text in texts])
        cosines = unit(rows, self.weights) @ self.centroids.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(texts)), best], 0, 1)
        return best, score, score < self.floors[size_class(rows.sum(axis=1))]


def unit(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    vectors = (np.log1p(rows) * weights).astype(np.float32)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def cluster(vectors: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from the mean and then the furthest vectors."""
    centroids = [vectors.mean(axis=0)]
    for _ in range(1, min(k, len(vectors))):
        near = np.max([vectors @ c / max(np.linalg.norm(c), 1e-9) for c in centroids], axis=0)
        centroids.append(vectors[near.argmin()])
    centres = np.stack(centroids)
    for _ in range(12):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        own = (vectors @ centres.T).argmax(axis=1)
        centres = np.stack([vectors[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centres)])
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)


def _document_frequencies(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                found[np.unique(grams(text.as_py()))] += 1
                n += 1
        dims = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*dims.tolist(), -1]), pa.array([*found[dims].tolist(), n])], ["dim", "n"]
        )

    return rows.mapInArrow(run, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit to the rows whose text and label are known."""
    known = rows.select(
        F.col(text_col).cast("string").alias("text"),
        F.col(label_col).cast("string").alias("label"),
        F.xxhash64(id_col, text_col).alias("draw"),
    ).filter("text is not null and label is not null")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    frequency = np.zeros(DIMS + 1, np.int64)
    for row in _document_frequencies(known.select("text")).collect():  # DIMS + 1 rows at most
        frequency[row["dim"]] = row["n"]
    weights = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
    if not sizes:
        return Model([], weights, np.zeros((0, DIMS), np.float32), np.ones(SIZES))
    share = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, min(1.0, sample / n))])
    drawn = known.filter(F.pmod("draw", F.lit(1 << 30)) < share[F.col("label")] * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(grams(text.as_py()), return_counts=True) for text in batch.column(2)]
            dims, n = [pa.array([f[i].tolist() for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), dims, n], ["label", "draw", "dims", "n"])

    first = drawn.orderBy("draw", "label").limit(2 * sample * len(sizes)).select("label", "draw", "text")
    chosen = first.mapInArrow(run, "label string, draw long, dims array<int>, n array<int>").collect()
    chosen.sort(key=lambda r: (r["label"], r["draw"]))
    dense = np.zeros((len(chosen), DIMS), np.int32)
    for i, row in enumerate(chosen):
        dense[i, row["dims"]] = row["n"]
    parts = [unit(dense[at : at + BLOCK], weights) for at in range(0, len(dense), BLOCK)]  # bounds memory
    vectors, labels = np.concatenate(parts), np.array([row["label"] for row in chosen])
    languages, centroids = [], []
    for label in sorted(set(labels)):
        found = cluster(vectors[labels == label], CLUSTERS)
        languages += [str(label)] * len(found)
        centroids.append(found)
    centres = np.concatenate(centroids).astype(np.float32)
    near, of = (vectors @ centres.T).max(axis=1), size_class(dense.sum(axis=1))
    # Shorter texts lie further off: a floor never exceeds that of longer ones.
    floors = np.array([near[of >= size].min(initial=np.inf) for size in range(SIZES)])
    return Model(languages, weights, centres, np.where(np.isfinite(floors), floors, near.min()) * SLACK)


def identify(
    docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", rejected_col: str = "rejected"
) -> DataFrame:
    """All rows and columns, with the language, the cosine and whether the text was
    rejected; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS values a centroid

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for texts in batches:
            out = [(UNKNOWN, 0.0, True)] * len(texts)
            asked = [i for i, text in enumerate(texts) if has_letter(text)] if fitted.languages else []
            for at in range(0, len(asked), BLOCK):
                some = asked[at : at + BLOCK]
                for i, best, score, rejected in zip(some, *fitted.nearest([texts.iloc[i] for i in some])):
                    out[i] = (fitted.languages[best], float(score), bool(rejected))
            yield pd.DataFrame(out, columns=["lang", "score", "rejected"])

    found = predicted(F.col(text_col).cast("string"))
    own = hidden(docs, "found")
    results = {lang_col: "lang", score_col: "score", rejected_col: "rejected"}
    return docs.withColumns({own: found}).withColumns({name: F.col(own)[part] for name, part in results.items()}).drop(own)


def held_out(id_col: str = "doc_id"):
    """A third of the rows, by the id, kept from learning."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learning_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col))
