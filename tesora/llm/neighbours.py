"""Quality by the votes of the nearest labelled documents in a latent-semantic space.

Texts are bags of hashed terms (byte trigrams, words, word shapes and repeats),
weighted by log term frequency and inverse document frequency over all
documents, each kind of term to unit length. A truncated singular value decomposition of the labelled sample gives
the space. The sample's vectors, at most ``rows`` of each label, are sent to
every task; each document's exact cosines with all of them come from one matrix
product per block, and the nearest ones vote with their similarity as weight.

Defined results: null, empty and blank texts are the zero vector and get the
plain share of label 1 in the sample; without any label the score is 0.5; a
document whose label rows disagree is not learned from; repeated rows get equal
results; a null id is in fold zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tesora.llm.base import ASCII_LOWER, add_columns, chunks, documents, fold, order_hash, staged, texts
from tesora.llm.quality import labels_of, trusted_rows, word_hashes, word_shapes

#: Hashed terms of each kind: words, shapes, repeated words, trigrams.
BITS = 11
KIND = 1 << BITS
TERMS = 4 * KIND
_TRIGRAM = np.uint64(0x165667B19E3779F9)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(64 - BITS)


@dataclass(frozen=True)
class Space:
    idf: np.ndarray  # (terms,)
    axes: np.ndarray  # (terms, dimensions)
    vectors: np.ndarray  # unit vectors of the labelled sample
    labels: np.ndarray


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of a whole text and how often they occur."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    plain = word_hashes(data.translate(ASCII_LOWER).split())
    shapes = word_hashes(word_shapes(data))
    again = shapes[1:][plain[1:] == plain[:-1]]
    kinds = [(h * _MIX) >> _SHIFT for h in (plain, shapes, again)]
    wide = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    kinds.append((((wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:]) * _TRIGRAM) >> _SHIFT)
    codes = [kind.astype(np.int64) + i * KIND for i, kind in enumerate(kinds)]
    counts = np.bincount(np.concatenate(codes), minlength=TERMS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term weights; each kind that occurs has unit length, so none drowns the others."""
    w = (1 + np.log(counts)) * idf[at]
    squares = np.bincount(at >> BITS, w * w, 4)
    return w / np.sqrt(np.where(squares > 0, squares, 1))[at >> BITS]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per term and documents, over the whole table (one number per term reaches the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for text in texts(batch):
                at, _ = term_counts(text)
                total[at] += 1
            total[TERMS] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(TERMS + 1, np.int64)
    for r in rows:
        found[r["term"]] = r["n"]
    return found[:TERMS], int(found[TERMS])


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> list:
    """(good, terms, counts) of at most ``rows`` documents of each label."""
    picked = [trusted_rows(labels, rows, v).withColumn("good", F.lit(v)) for v in (1, 0)]
    ids = F.broadcast(staged(picked[0].unionByName(picked[1]), "quality_sample"))
    chosen = docs.select(F.col("doc_id").alias("__id"), "text").join(ids, F.col("__id") == F.col("__target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 256):
            found = [term_counts(t) for t in texts(batch)]
            packed = [pa.array([x.astype("<i4").tobytes() for x in column], pa.binary()) for column in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("good"), *packed], ["id", "good", "terms", "counts"])

    parts = chosen.select("__id", "good", "text").mapInArrow(run, "id long, good int, terms binary, counts binary")
    return parts.orderBy(order_hash("id"), "id").limit(2 * rows).collect()


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = 1500, dimensions: int = 64, rounds: int = 4) -> Space:
    """The space from all documents' term statistics and at most ``rows`` learnable labelled rows of each label."""
    present, total = document_frequencies(docs)
    idf = np.log((total + 1) / (present + 1)) + 0.1
    sample = _sample(docs, labels.where(learn), rows)
    matrix = np.zeros((len(sample), TERMS), np.float32)
    for i, r in enumerate(sample):
        at, counts = np.frombuffer(r["terms"], "<i4"), np.frombuffer(r["counts"], "<i4")
        matrix[i, at] = weigh(at, counts, idf)
    good = np.array([r["good"] for r in sample], np.float64)
    k = min(dimensions, len(sample))
    axes = np.random.default_rng(3).standard_normal((TERMS, k)).astype(np.float32)
    for _ in range(rounds if k else 0):  # subspace iteration
        axes, _r = np.linalg.qr(matrix.T @ (matrix @ axes))
    vectors = unit(matrix @ axes) if k else np.zeros((0, 0), np.float32)
    return Space(idf.astype(np.float32), axes.astype(np.float32), vectors, good)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def vote(space: Space, bags: list[tuple[np.ndarray, np.ndarray]], nearest: int) -> np.ndarray:
    """Weighted share of label 1 among the most similar labelled documents, for a block of bags."""
    if not len(space.labels):
        return np.full(len(bags), 0.5)
    x = np.stack([weigh(at, c, space.idf).astype(np.float32) @ space.axes[at] for at, c in bags])
    cosine = unit(x) @ space.vectors.T
    k = min(nearest, cosine.shape[1])
    top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, top, axis=1), 0).astype(np.float64) ** 4
    mass = weight.sum(axis=1)
    share = (weight * space.labels[top]).sum(axis=1) / np.where(mass > 0, mass, 1)
    return np.clip(np.where(mass > 0, share, space.labels.mean()), 0, 1)


def score(docs: DataFrame, space: Space, nearest: int = 15, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    def compute(batch: pa.RecordBatch):
        found = []
        for at in range(0, batch.num_rows, 256):
            found.append(vote(space, [term_counts(t) for t in texts(batch.slice(at, 256))], nearest))
        return [np.concatenate(found)]

    return add_columns(docs, [(name, DoubleType())], compute, keep)


def op7_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    space = fit(docs, labels_of(spark, sf_dir), fold(5) != 0)
    marked = docs.withColumn("held_out", fold(5) == 0)
    found = score(marked, space, keep=["doc_id", "held_out"])
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
