from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesora.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=80))
def test_best_fit_equals_the_plain_rule(sizes):
    bins, offsets, fill = packing.best_fit(np.array(sizes, np.int64), 64)
    plain: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fitting = [(64 - f - sizes[i]) for f in plain if f + sizes[i] <= 64]
        if fitting:
            best = plain.index(64 - sizes[i] - min(fitting))
            plain[best] += sizes[i]
        else:
            plain.append(sizes[i])
    assert sorted(fill.tolist()) == sorted(plain)
    for b in range(len(fill)):
        at = 0
        for i in sorted(np.flatnonzero(bins == b), key=lambda i: offsets[i]):
            assert offsets[i] == at
            at += sizes[i]
        assert at == fill[b] <= 64


def assert_packed(rows, capacity):
    found = {}
    for r in rows:
        found.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in found.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return found


def pieces_of(spark, lengths):
    return spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")


def test_rounds_merge_underfull_bins(spark):
    rng = np.random.default_rng(0)
    lengths = np.concatenate([rng.integers(1, 1400, 600), rng.integers(1030, 2047, 300), [2048] * 5])
    pieces = pieces_of(spark, lengths)
    rows = packing.pack(pieces, items=40, carry=30, fan=3).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(lengths)))
    many = assert_packed(rows, 2048)
    _, _, best = packing.best_fit(lengths[lengths < 2048])
    assert len(many) <= 1.06 * (len(best) + 5)  # forty pieces a task
    single = packing.pack(pieces, items=1, carry=30, fan=2).collect()
    assert len(assert_packed(single, 2048)) < 0.95 * len(lengths)  # merged although each task had one piece or so


def test_carry_bounds_what_moves_up():
    up = packing._up(np.array([2048, 100, 2000, 2041, 50, 1500]), 2048, 8, 2)
    assert up.tolist() == [False, True, False, False, True, False]


def test_awkward_rows(spark, awkward, nothing):
    encode = Tokenizer.from_file(PATH)
    want = []
    for r in awkward.collect():
        ids = np.array([*encode.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want.append((r.doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())))
    rows = packing.pack_documents(awkward, PATH).collect()
    key = lambda t: [(x is not None, x) for x in t]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    found = assert_packed(rows, 2048)
    assert len(found) == -(-sum(w[3] for w in want) // 2048)
    assert packing.pack_documents(nothing, PATH).count() == 0


@pytest.mark.parametrize("capacity", [1, 2, 7])
def test_small_capacities(spark, awkward, capacity):
    rows = packing.pack_documents(awkward.where("length(text) < 300"), PATH, capacity).collect()
    assert_packed(rows, capacity)
    assert {r.length for r in rows} <= set(range(1, capacity + 1))
