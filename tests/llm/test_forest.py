from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesora.llm import forest


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def plain(rows, query, nearest):
    target = np.array(dict(rows)[query], np.float32).astype(float)
    found = sorted((float(np.sqrt(((np.array(v, np.float32).astype(float) - target) ** 2).sum())), i) for i, v in rows if i != query)
    return [i for _, i in found[:nearest]]


def run(spark, rows, queries, **more):
    vectors = forest.usable_vectors(table(spark, rows))
    asked = vectors.where(F.col("vec_id").isin(queries)).select(F.col("vec_id").alias("query_id"), "v")
    out = {}
    for r in sorted(forest.search(vectors, asked, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 32))
    rows = [(i, (centres[i % 20] + 0.3 * rng.standard_normal(32)).tolist()) for i in range(3000)]
    queries = list(range(0, 3000, 100))
    got = run(spark, rows, queries, segment=1000, block=10, candidates=300)
    hits = sum(len({v for _, v, _ in got[q]} & set(plain(rows, q, 10))) for q in queries)
    assert hits / (10 * len(queries)) >= 0.9
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q in queries:
        assert [r for r, _, _ in got[q]] == list(range(1, 11))
        assert all(math.isclose(s, np.linalg.norm(vectors[v] - vectors[q]), rel_tol=1e-12) for _, v, s in got[q])
        assert all(v != q for _, v, _ in got[q])


def test_prefixes_decide_the_candidates():
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((500, 16))
    trees = forest.Forest(vectors, np.zeros(16), 4)
    queries = vectors[:5]
    keys = trees.hashes(queries)
    every = trees.hashes(vectors)
    for q, deepest in enumerate(trees.depths(keys, 40)):
        for depth in range(forest.BITS, -1, -1):
            same = [(every[t] >> np.uint64(forest.BITS - depth)) == (keys[t, q] >> np.uint64(forest.BITS - depth)) for t in range(4)]
            if sum(s.sum() for s in same) >= 40:
                break
        assert depth == deepest and trees.rows(keys[:, q], depth).tolist() == np.flatnonzero(np.any(same, axis=0)).tolist()


def test_ties_repeats_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(30)] + [(100, [0.0, 1.0, 0.0]), (200, [1.0, 0.1, 0.0])]
    rows += [(300, None), (400, []), (500, [0.0, 0.0, 0.0]), (600, [float("nan"), 1.0, 0.0]), (700, [float("inf"), 1.0, 0.0])]
    rows += [(800, [None, 1.0, 0.0]), (900, [1.0, 2.0]), (None, [1.0, 0.0, 0.0])]
    got = run(spark, rows, [0, 100, 200, 300, 500, 900], candidates=5)
    assert [v for _, v, _ in got[0]] == list(range(1, 11)) and set(got) == {0, 100, 200}
    assert [s for _, _, s in got[0]] == [0.0] * 10


def test_fewer_candidates_than_asked(spark):
    got = run(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [3.0, 3.0])], [0])
    assert [(r, v) for r, v, _ in got[0]] == [(1, 1), (2, 2)]


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0])]])
def test_empty_tables(spark, rows):
    vectors = forest.usable_vectors(table(spark, rows))
    assert forest.search(vectors, vectors.select(F.col("vec_id").alias("query_id"), "v")).count() == 0
