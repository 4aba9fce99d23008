from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from conftest import SCHEMA, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesora.llm import simhash


def plain_fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Smallest reachable fingerprint of each, by searching all pairs."""
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def plain_result(rows):
    fps = {plain_fingerprint(t) for _, t in rows}
    label = plain_components(sorted(fps))
    least = {}
    for d, t in rows:
        root = label[plain_fingerprint(t)]
        least.setdefault(root, set()).add(d)
    known = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(((d, f"{plain_fingerprint(t):016x}", known[label[plain_fingerprint(t)]]) for d, t in rows), key=str)


def test_awkward_rows(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = sorted(map(tuple, simhash.near_duplicates(awkward).collect()), key=str)
    assert got == plain_result(rows)
    assert {r[2] for r in got if r[1] == "0" * 16} == {2}  # null, empty and blank link


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.keep_one(nothing).count() == 0


@settings(max_examples=100)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_near_fingerprints_meet_in_a_cell(a, flipped):
    b = a
    for bit in flipped:
        b ^= 1 << bit
    counts = simhash.segment_counts(np.array([a, b], np.uint64))
    parts = [[int(c >> np.uint64(2 * i)) & 3 for i in range(32)] for c in counts]
    assert parts[0] == [(a >> 2 * i & 3).bit_count() for i in range(32)]
    halves = [sum(abs(x - y) for x, y in zip(parts[0][h : h + 16], parts[1][h : h + 16], strict=True)) for h in (0, 16)]
    assert sum(halves) <= len(flipped) and min(halves) <= 1


def clusters(seed, groups, size):
    """Fingerprints in chains of near ones."""
    rng, out = np.random.default_rng(seed), set()
    for _ in range(groups):
        f = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(size):
            out.add(f)
            for bit in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                f ^= 1 << int(bit)
    return sorted(out)


@pytest.mark.parametrize("tile", [4096, 5])
def test_links_connect_what_all_pairs_connect(spark, tile):
    values = clusters(1, 12, 12) + [0, 1, 3, 7]
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), tile=tile)
    for r in edges.collect():
        assert r.u > r.v and ((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 3
    label = {r.node: r.label for r in simhash.components(edges).collect()}
    want = plain_components(values)
    groups = {}
    for v in values:
        groups.setdefault(want[v], set()).add(v - 2**64 if v >= 2**63 else v)
    for members in groups.values():
        assert {label.get(m, m) for m in members} == {min(members)}


def test_cells_are_not_broadcast(spark):
    """Spark sizes the cells like their fingerprints, so a small table must merge as well."""
    fps = spark.range(40).select(F.xxhash64("id").alias("fp"))
    edges = simhash.links(fps.unionByName(fps.select(F.col("fp").bitwiseXOR(1).alias("fp"))))
    assert edges.count() == 40
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_large_cells_are_searched_whole():
    rng = np.random.default_rng(3)
    centre = np.uint64(0x0123456789ABCDEF)
    near = {int(centre) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (600, 2))}
    far = {int(x) for x in rng.integers(0, 2**63, 200)}
    fps = np.array(sorted(near | far), np.uint64).view(np.int64)
    edges = simhash._spanning(fps, 3)
    parent = {int(f): int(f) for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        assert root(u) != root(v), "a forest has no cycle"
        parent[root(u)] = root(v)
    want = plain_components([int(x) for x in fps.view(np.uint64)])
    assert len({root(int(f)) for f in fps}) == len(set(want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 300)], "u long, v long")
    label = {r.node: r.label for r in simhash.components(edges).collect()}
    assert label == {i: 0 for i in range(201)} | {500: 300, 300: 300}


def test_one_document_of_each_component_stays(spark, awkward):
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    want = {c: f for _, f, c in plain_result([(r.doc_id, r.text) for r in awkward.collect()])}
    rows = kept.collect()
    assert len(rows) == len(want) and {plain_fingerprint(r.text) for r in rows} <= {int(f, 16) for f in want.values()} | {0}
    assert {r.doc_id for r in rows} == set(want)


def test_exact_and_near_copies_go(spark):
    text = words(300, 1)
    rows = [(i, text if i % 2 else text.replace("w1", "w1", 1), "en", "s", 1, *[None] * 10) for i in range(40)]
    rows += [(100 + i, words(300, 50 + i), "en", "s", 1, *[None] * 10) for i in range(10)]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(100, 110)]


def test_radius_is_checked(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), radius=4)
