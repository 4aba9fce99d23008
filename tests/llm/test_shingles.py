from __future__ import annotations

import numpy as np
import pytest
from conftest import SCHEMA, words

import corpus_pipeline as pipeline
from tesora.llm import shingles, simhash
from tesora.llm.base import words_of


def plain_shingles(text):
    found = words_of(text)
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def plain_kept(rows, least=0.8):
    """Ids that stay, by comparing all pairs of (id, text)."""
    sets = [plain_shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for (d, _), g in zip(rows, group, strict=True):
        best[g] = min(d, best.get(g, d))
    return sorted(best.values())


def planted(groups=25, copies=8):
    """Texts and copies of each with a few words changed: similarities around 0.8 and up."""
    rng, rows = np.random.default_rng(5), []
    for g in range(groups):
        base = words(int(rng.integers(60, 400)), g).split()
        for _ in range(copies):
            new = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(0, 2 + len(base) // 35))):
                new[at] = f"changed{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(new)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None, *[None] * 10) for d, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("tile", [shingles.TILE, 3])
def test_planted_near_copies(spark, tile):
    rows = planted()
    kept = shingles.keep_one(frame(spark, rows), tile=tile)
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)


def test_keys_with_the_same_sets_are_compared_once(spark, monkeypatch):
    texts = []
    found = spark.createDataFrame([(k, s) for k in range(20) for s in (1, 2)] + [(50, 1), (50, 3), (60, 9)], "key long, set long")
    bodies = spark.createDataFrame([(s, words(200, 1) + f" end{s}") for s in (1, 2, 3, 9)], "set long, text string")
    real = type(found).mapInArrow
    monkeypatch.setattr(type(found), "mapInArrow", lambda self, f, schema: texts.append(self.count()) or real(self, f, schema))
    assert sorted(map(tuple, shingles.links(found, bodies).collect())) == [(2, 1), (3, 1)]
    assert texts == [4]  # two sets of one of twenty keys, and two of another


def test_sets_of_linked_fingerprints_are_candidates(spark):
    fps = [0b0, 0b111, 0b111111, 1 << 40 | 0xFFFF << 20, 0b0, 0b1]
    sets = spark.createDataFrame([(i + 1, fp) for i, fp in enumerate(fps)] + [(0, 0)], "set long, fp long")
    key = {r.set: r.key for r in shingles.fingerprint_keys(sets).collect()}
    assert sorted(key) == [1, 2, 3, 4, 5, 6]  # texts without words are one set already
    assert len({key[i] for i in (1, 2, 3, 5, 6)}) == 1 and key[4] != key[1]


def test_copies_are_found_by_fingerprints_alone(spark, monkeypatch):
    base = words(2000, 3).split()
    near = [*base[:700], "changed", *base[701:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, words(2000, 4))]
    one, two = (simhash.majority(shingles.shingle_set(t)) for _, t in rows[:2])
    assert 0 < (one ^ two).bit_count() <= 3 or one == two
    monkeypatch.setattr(shingles, "cells", lambda marked, text: spark.createDataFrame([], "key long, set long"))
    assert sorted(r.doc_id for r in shingles.keep_one(frame(spark, rows)).collect()) == plain_kept(rows) == [1, 3]


def test_the_stage_takes_similarities_of_four_fifths(spark):
    rows = planted(6)
    want = plain_kept(rows)
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, frame(spark, rows), "").collect()) == want


def test_pairs_at_the_limit_share_a_key():
    rng, met = np.random.default_rng(7), 0
    for _ in range(2000):
        both, a, b = np.split(rng.integers(1, 1 << 63, 100, np.uint64), [80, 90])
        one, two = (shingles.band_keys(np.unique(np.concatenate([both, x]))) for x in (a, b))
        met += bool(np.isin(one, two).any())
    assert met >= 1998


def test_awkward_rows(spark, awkward, nothing):
    kept = shingles.keep_one(awkward)
    assert kept.columns == awkward.columns
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    named = [r for r in rows if r[0] is not None]
    got = kept.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == plain_kept(named)
    assert [r.text for r in got if r.doc_id is None] == [t for d, t in rows if d is None and t]
    assert shingles.keep_one(nothing).count() == 0
