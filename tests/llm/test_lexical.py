from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tesora.llm import lexical
from tesora.llm.lexical import Postings, Vocabulary, search_shard

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return [t.translate(ASCII) for t in TERM.findall(text or "")]


def plain(docs, items, top=10):
    """Every document scored for every item."""
    terms = [(d, t) for d, text in docs if (t := plain_terms(text))]
    n, total = len(terms), sum(len(t) for _, t in terms)
    df = {}
    for _, t in terms:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    weight = {x: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for x, c in df.items()}
    out = []
    for item, text in set(items):
        scored = []
        for d, t in terms:
            m = 10 + 90 * len(t) * n // total
            score = sum(weight[x] * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in set(plain_terms(text)) if x in t)
            if score:
                scored.append((-score, math.inf if d is None else d, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored, key=lambda r: r[:2])[:top], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **kw):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, lexical.rank_documents(docs, items, **kw).collect()), key=str)


def corpus(rows, vocabulary=60, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" if i % 5 else f"a-rather-long-compound{i:015d}" for i in range(vocabulary)]
    pick = lambda k: " ".join(words[min(int(rng.expovariate(4 / vocabulary)), vocabulary - 1)] for _ in range(k))
    return [(i, pick(rng.randint(1, 40))) for i in range(rows)], [(i, pick(8)) for i in range(12)]


@pytest.mark.parametrize("shard", [1, 300, 1 << 20])
def test_equals_scoring_everything(spark, monkeypatch, shard):
    docs, items = corpus(400)
    build = lexical.index
    monkeypatch.setattr(lexical, "index", lambda *args: build(*args[:5], shard))
    assert found(spark, docs, items) == plain(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 5)
    docs, items = corpus(60, seed=3)
    assert found(spark, docs, items) == plain(docs, items)


def test_ties_repeats_and_missing_ids(spark):
    docs = [(i % 7, "same words here") for i in range(40)] + [(None, "same words here"), (None, None), (3, ""), (4, "!!")]
    items = [(1, "Same WORDS"), (1, "Same WORDS"), (1, "here"), (2, None), (3, "absent"), (None, "words here")]
    assert found(spark, docs, items) == plain(docs, items)


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    items = [(i, (t or "")[:4000]) for i, (_, t) in enumerate(rows)] + [(99, "x" * 150_000 + " É ÇA 12345")]
    wanted = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, lexical.rank_documents(awkward, wanted).collect()), key=str) == plain(rows, items)
    assert lexical.rank_documents(nothing, wanted).count() == 0
    assert lexical.rank_documents(awkward, wanted.limit(0)).count() == 0


def test_joint_maxima_are_exact_and_tighter():
    rng = np.random.default_rng(5)
    held = rng.random((200, 6)) < 0.3
    doc, terms = np.nonzero(held)
    ends = np.concatenate(([0], np.cumsum(held.sum(axis=1))))
    weight, pairs = np.arange(1, 7) * 100, np.array([(0, 1), (2, 5), (3, 3)])
    n = rng.integers(1, 50, 200)
    shard = lexical.build_shard(n, ends, terms, rng.integers(1, 9, len(terms)), weight, pairs, 200, int(n.sum()))
    postings = Postings(shard["starts"], shard["docs"], shard["impacts"])
    for p, (a, b) in enumerate(pairs.tolist()):
        sums, lists = np.zeros(200, np.int64), [set(postings.of(t)[0].tolist()) for t in (a, b)]
        for t in {a, b}:
            d, i = postings.of(t)
            sums[d] += i
        assert shard["joint"][p] == sums.max() <= shard["best"][a] + shard["best"][b]
        both = shard["pair_docs"][shard["pair_starts"][p] : shard["pair_starts"][p + 1]].tolist()
        assert both == sorted(lists[0] & lists[1]) * (a != b)


def test_a_pair_bound_opens_only_its_intersection():
    postings = Postings(np.array([0, 3, 6]), np.array([0, 1, 2, 2, 3, 4]), np.array([10, 10, 10, 9, 9, 9]))
    at, score = search_shard(postings, np.array([10, 9]), [(0, 1, 19, np.array([2]))], 5, 15, 10)
    assert (at.tolist(), score.tolist()) == ([2], [19])
    at, _ = search_shard(postings, np.array([10, 9]), [(0, 1, 19, np.array([2]))], 5, 20, 10)
    assert not len(at)


def test_vocabulary_of_all_lengths():
    words = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefghj", "abcdefghijklmnop", "abcdefghijklmnopq", "é" * 30, "b"]
    known = Vocabulary([w.encode() for w in words])
    text = pa.array([" ".join([*words, "abc", "abcdefghk", "abcdefghijklmnoq", "é" * 29, "x" * 16])])
    _, data, offsets = next(iter(lexical.steps(text)))
    starts, lengths, _ = lexical.spans(data, offsets, lexical._TERM)
    assert known.numbers(data, starts, lengths).tolist() == [known.terms.index(w.encode()) for w in words] + [-1] * 5
    assert Vocabulary([]).numbers(data, starts, lengths).tolist() == [-1] * 14


def test_length_norm_beyond_64_bits():
    n = np.array([1, 10**9])
    assert lexical.length_norm(n, 10**10, 10**13).tolist() == [10, 10 + 90 * 10**19 // 10**13]
