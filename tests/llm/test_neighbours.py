from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesora.llm import neighbours

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(DATA).exists(), reason="shared tables are absent")
def test_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = neighbours.op7_quality_votes(spark, DATA).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(labels[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in labels]
    good, bad = ([s for q, s in held if q == v] for v in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.95
    assert np.mean(np.array(good) >= 0.3) >= 0.98


def test_votes_equal_a_plain_search():
    rng = np.random.default_rng(1)
    texts = ["the cat sat", "THE!! CAT!!", "a b a b", "le chat noir", "x y z w"]
    bags = [neighbours.term_counts(t) for t in texts]
    axes = rng.standard_normal((neighbours.TERMS, 8)).astype(np.float32)
    idf = np.ones(neighbours.TERMS, np.float32)
    dense = np.zeros((5, neighbours.TERMS))
    for i, (at, counts) in enumerate(bags):
        dense[i, at] = neighbours.weigh(at, counts, idf)
    vectors = neighbours.unit((dense @ axes).astype(np.float32))
    labels = np.array([1, 0, 0, 1, 1.0])
    space = neighbours.Space(idf, axes, vectors, labels)
    got = neighbours.vote(space, bags, 3)
    for i in range(5):
        cosine = vectors @ vectors[i]
        top = np.argsort(-cosine)[:3]
        weight = np.maximum(cosine[top], 0) ** 4
        assert got[i] == pytest.approx((weight * labels[top]).sum() / weight.sum(), abs=1e-4)


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 1), (13, 0), (10, 0), (9, 1), (9, 0), (None, 1)], "doc_id long, quality int")
    space = neighbours.fit(awkward, labels, F.lit(True))
    assert sorted(space.labels.tolist()) == [0, 0, 1, 1]  # a document with both labels is left out
    got = neighbours.score(awkward, space, name="__score").collect()
    assert len(got) == awkward.count()
    for r in got:
        assert 0 <= r["__score"] <= 1
        if r.text is None or not r.text.strip():
            assert r["__score"] == 0.5
    unlabelled = neighbours.fit(awkward, labels.where("false"), F.lit(True))
    assert {r["__score"] for r in neighbours.score(awkward, unlabelled, name="__score").collect()} == {0.5}
    assert neighbours.score(nothing, neighbours.fit(nothing, labels, F.lit(True)), name="__score").count() == 0
