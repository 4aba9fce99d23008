"""Approximate nearest neighbours from hash-prefix forests.

Rows are dealt evenly to segments of a bounded size. A segment's forest has, per
tree, the sorted array of its rows' hash strings, 32 signs of random directions
around the centre. A query descends all trees by binary search: the rows that
share a prefix of some length with it are one range of each sorted array. From
the longest shared prefix the query ascends in all trees at once, one bit at a
time, until the ranges hold enough candidates; all rows in the ranges are
measured exactly in double precision. Each segment answers each query with its
nearest rows, and the best of all segments are the result: every query visits
every segment, in blocks of queries, so no candidate is out of reach.

A range is taken whole however many rows it holds, so equal or very close
vectors are never cut off. The centre is the mean of at most ``fit_rows`` rows,
chosen by a hash of their id; it only moves the hash borders.

Defined results: vectors that are null, empty, zero, of another length than most
or hold a null or non-finite component take no part, as query or as candidate;
rows without an id neither; a query's own row is its id (repeated ids are all
its own); ties go to the smaller id; with fewer candidates than asked all are
returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BITS = 32
#: Rows of a segment, queries of a block, trees, candidates a segment's forest is asked for.
SEGMENT, QUERIES, TREES, CANDIDATES = 16_384, 4096, 64, 5600
_KEY = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)


def usable(vector: str) -> Column:
    """Whether a vector can take part."""
    ok = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(F.col(vector), lambda x: x != 0), F.lit(False))


class Forest:
    """Sorted arrays of hash strings over the rows of one segment."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, trees: int):
        rng = np.random.default_rng(5)
        self.planes = rng.standard_normal((vectors.shape[1], trees * BITS)).astype(np.float32)
        self.centre, self.vectors = centre, vectors
        keys = self.hashes(vectors)
        self.order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def hashes(self, vectors: np.ndarray) -> np.ndarray:
        """(trees, rows) hash strings as integers, first sign highest."""
        out = []
        for at in range(0, len(vectors), 1024):
            signs = (vectors[at : at + 1024] - self.centre).astype(np.float32) @ self.planes > 0
            out.append((signs.reshape(signs.shape[0], -1, BITS) * _KEY).sum(axis=2, dtype=np.uint64))
        return np.concatenate(out).T

    def ranges(self, keys: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges (trees, queries) of rows that share the first ``depth`` bits with each query."""
        drop = (BITS - depth).astype(np.uint64)
        low = (keys >> drop) << drop
        ends = low + (np.uint64(1) << drop)
        found = [(np.searchsorted(row, a), np.searchsorted(row, b)) for row, a, b in zip(self.keys, low, ends, strict=True)]
        return np.array([x[0] for x in found]), np.array([x[1] for x in found])

    def depths(self, keys: np.ndarray, wanted: int) -> np.ndarray:
        """Each query's longest common depth at which its ranges hold enough rows: descend, then ascend in all trees at once."""
        enough = min(wanted, self.order.size)
        low, high = np.zeros(keys.shape[1], np.int64), np.full(keys.shape[1], BITS + 1)
        while (high - low > 1).any():  # counts only grow upwards, so the levels can be halved
            middle = (low + high) // 2
            a, b = self.ranges(keys, middle)
            found = (b - a).sum(axis=0) >= enough
            low, high = np.where(found, middle, low), np.where(found, high, np.maximum(middle, low + 1))
        return low

    def rows(self, keys: np.ndarray, depth: int) -> np.ndarray:
        """Rows in the ranges of one query's keys at a depth."""
        a, b = self.ranges(keys[:, None], np.array([depth]))
        taken = np.zeros(len(self.vectors), bool)
        for order, start, end in zip(self.order, a[:, 0], b[:, 0], strict=True):
            taken[order[start:end]] = True
        return np.flatnonzero(taken)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    nearest: int = 10,
    segment: int = SEGMENT,
    block: int = QUERIES,
    trees: int = TREES,
    candidates: int = CANDIDATES,
    fit_rows: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): nearest of ``vectors`` (vec_id, v) for each of ``queries`` (query_id, v).

    Both sides hold arrays of one length. Counts of rows and queries fix the
    numbers of segments and blocks.
    """
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    asked = queries.count()
    segments, blocks = max(1, -(-size["n"] // segment)), max(1, -(-asked // block))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("v").collect()
    centre = np.mean([r["v"] for r in sample], axis=0) if sample else np.zeros(1)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    rows = vectors.select(deal("vec_id", segments).alias("segment"), every(blocks, "block"), "vec_id", F.col("v").cast("array<double>").alias("v"))
    asks = queries.select(every(segments, "segment"), deal("query_id", blocks).alias("block"), "query_id", F.col("v").cast("array<double>").alias("v"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            right = right.sort_values("query_id", ignore_index=True)
            own, ids = np.stack(left["v"].to_numpy()), left["vec_id"].to_numpy()
            targets, asked_ids = np.stack(right["v"].to_numpy()), right["query_id"].to_numpy()
            forest = Forest(own, centre, trees)
            keys = forest.hashes(targets)
            for q, depth in enumerate(forest.depths(keys, candidates).tolist()):
                found = forest.rows(keys[:, q], depth)
                found = found[ids[found] != asked_ids[q]]
                while len(found) < nearest and depth:  # its own rows are no candidates
                    depth -= 1
                    found = forest.rows(keys[:, q], depth)
                    found = found[ids[found] != asked_ids[q]]
                distance = np.sqrt(((own[found] - targets[q]) ** 2).sum(axis=1))
                if len(found) > nearest:
                    last = np.partition(distance, nearest - 1)[nearest - 1]
                    near = distance <= last
                    found, distance = found[near], distance[near]
                best = np.lexsort((ids[found], distance))[:nearest]
                columns["query_id"].append(np.full(len(best), asked_ids[q]))
                columns["vec_id"].append(ids[found[best]])
                columns["score"].append(distance[best])
        return pd.DataFrame({k: np.concatenate(v) if v else [] for k, v in columns.items()})

    found = rows.groupBy("segment", "block").cogroup(asks.groupBy("segment", "block")).applyInPandas(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def usable_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that can take part; the most common length decides which do."""
    ok = table.where(usable(vector) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    common = ok.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return ok.where(F.size("v") == (common["d"] if common else 0))


def op4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return search(vectors, queries)
