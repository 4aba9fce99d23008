from __future__ import annotations

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import words
from pyspark.sql import functions as F

from tesora.llm import maxent
from tesora.llm.base import staged, words_of

KEEP = ["doc_id"]


def plain_base(texts, learn):
    counts = Counter(w for t in learn for w in [*words_of(t), b""])
    n, v = sum(counts.values()), len(counts)
    zero = math.log10(n + 0.5 * (v + 1))
    out = []
    for t in texts:
        tokens = [*words_of(t), b""]
        out.append((len(tokens), sum(counts[w] > 0 for w in tokens), sum(math.log10(counts[w] + 0.5) - zero for w in tokens)))
    return out, n


def check(docs, learn, listed):
    counts = staged(maxent.count_words(learn), "t")
    lex = maxent.lexicon(counts, listed)
    got = maxent.score(docs, counts, lex, maxent.unigram(lex), KEEP).collect()
    rows = docs.collect()
    want, n = plain_base([r.text for r in rows], [r.text for r in learn.collect()])
    pairs = Counter((r.doc_id, a, b, round(c, 5)) for r, (a, b, c) in zip(rows, want, strict=True))
    assert pairs == Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got)
    assert {r.train_tokens for r in got} == {n}
    return got


@pytest.mark.parametrize("listed", [maxent.LISTED, 40])
def test_base_scores(awkward, listed):
    got = check(awkward, awkward.where("doc_id is null or doc_id <> 5"), listed)
    assert all(r.score < 0 for r in got)


def test_no_training_documents(awkward, nothing):
    counts = staged(maxent.count_words(nothing), "t")
    lex, model = maxent.fit(nothing, counts)
    got = maxent.score(awkward, counts, lex, model, KEEP).collect()
    assert len(got) == awkward.count() and all(abs(r.base_score) < 1e-6 and abs(r.score) < 1e-3 and r.n_known == 0 for r in got)
    assert maxent.score(nothing, counts, lex, model, KEEP).count() == 0


def trained(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):  # two languages: the word before tells much
        base = "abcdefgh" if i % 2 else "stuvwxyz"
        rows.append((i, " ".join(base[int(j)] * 2 for j in rng.integers(0, 8, 200)) + f" rare{i}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = staged(maxent.count_words(docs), "t")
    return docs, counts, *maxent.fit(docs, counts)


def test_training_beats_the_unigram_model_and_stays_a_distribution(spark):
    docs, counts, lex, model = trained(spark)
    new = spark.createDataFrame([(1, "aa bb cc dd " * 30), (2, "ss tt uu zz " * 30)], "doc_id long, text string")
    for r in maxent.score(new, counts, lex, model, KEEP).collect():
        assert r.score > r.base_score + 10  # about a factor of two a word
    hashes = maxent.token_hashes("aa bb cc")
    features = maxent.contexts(hashes, np.array([0]))[:, 2:3]
    every = np.append(np.arange(len(lex.head)), -1)
    logs = maxent.token_logs(model, np.repeat(features, len(every), axis=1), every)
    assert math.isclose(np.exp(logs).sum(), 1, abs_tol=1e-4)


def test_gradient_steps_raise_the_likelihood():
    hashes = np.concatenate([maxent.token_hashes("a b c d " * 200)] * 3)
    values, counts = np.unique(hashes, return_counts=True)
    order = np.argsort(-counts)
    lex = maxent.Lexicon(len(hashes), len(values), values[order], counts[order], values, counts)
    model, starts = maxent.unigram(lex), np.arange(3) * (len(hashes) // 3)
    features, rank = maxent.contexts(hashes, starts), lex.look_up(hashes)[0]
    before = maxent.token_logs(model, features, rank).sum()
    state = [np.ones(maxent.CLASS_ROWS), np.zeros(maxent.CLASS_ROWS), np.ones(maxent.WORD_ROWS), np.zeros(maxent.WORD_ROWS)]
    for _ in range(20):
        maxent.train_block(model, state, features, rank, 0.25)
    assert maxent.token_logs(model, features, rank).sum() > 0.5 * before


def test_contexts_do_not_cross_texts():
    one, two = maxent.token_hashes("a b c"), maxent.token_hashes("d e")
    both = maxent.contexts(np.concatenate([one, two]), np.array([0, len(one)]))
    assert (both[:, len(one) :] == maxent.contexts(two, np.array([0]))).all()
    assert (both[:, : len(one)] == maxent.contexts(one, np.array([0]))).all()


def test_query_folds(spark, awkward):
    held = awkward.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).select("doc_id").collect()
    assert {r.doc_id for r in held} == {r.doc_id for r in awkward.collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1}


def test_hashes_tell_words_apart():
    found = {int(maxent.token_hashes(f"{a}{b}")[0]) for a in words(300).split() for b in "xyz"}
    assert len(found) == len({f"{a}{b}" for a in words(300).split() for b in "xyz"})


def test_the_word_three_back_is_a_feature():
    one, other = (maxent.contexts(maxent.token_hashes(t), np.array([0])) for t in ("a b c d", "x b c d"))
    assert (one[:3, 3] == other[:3, 3]).all() and one[3, 3] != other[3, 3]


def plain_step(model, hashes, rank, rate):
    """Log chances of all tokens, and both tables after one step, token by token."""
    features = maxent.contexts(hashes, np.array([0]))
    logs, sums = [], ({}, {})
    for t, r in enumerate(rank):
        c = maxent.CLASSES if r < 0 else int(r) // maxent.WIDTH
        factors = [(0, model.class_bias, model.class_rows, [int(f) % maxent.CLASS_ROWS for f in features[:, t]], c)]
        if r >= 0:
            places = maxent._word_index(features[:, t : t + 1], np.array([c]))[:, 0].tolist()
            factors.append((1, model.word_bias[c], model.word_rows, places, int(r) % maxent.WIDTH))
        total = 0.0
        for table, bias, rows, places, target in factors:
            logits = [float(bias[j]) + sum(float(rows[p, j]) for p in places) for j in range(maxent.WIDTH)]
            whole = sum(math.exp(x) for x in logits)
            total += logits[target] - math.log(whole)
            gradient = np.array([math.exp(x) / whole - (j == target) for j, x in enumerate(logits)])
            for p in places:  # a row picked twice by one token counts twice
                sums[table][p] = sums[table].get(p, 0) + gradient
        logs.append(total)
    after = [model.class_rows.copy(), model.word_rows.copy()]
    for rows, found in zip(after, sums, strict=True):
        for p, g in found.items():
            rows[p] -= rate * g / math.sqrt(1 + float(g @ g))
    return logs, after


def test_chances_and_one_step_equal_plain_loops():
    rng = np.random.default_rng(7)
    hashes = maxent.token_hashes(" ".join(f"w{int(i)}" for i in rng.integers(0, 150, 120)))
    values, counts = np.unique(hashes, return_counts=True)
    order = np.argsort(-counts, kind="stable")[:70]  # the rest is outside the vocabulary
    lex = maxent.Lexicon(len(hashes), len(values), values[order], counts[order], values, counts)
    model = maxent.unigram(lex)
    model.class_rows[:] = rng.normal(0, 0.3, model.class_rows.shape)
    model.word_rows[:] = rng.normal(0, 0.3, model.word_rows.shape)
    rank = lex.look_up(hashes)[0]
    assert (rank < 0).any() and len(hashes) < maxent.STEP
    logs, after = plain_step(model, hashes, rank, 0.25)
    features = maxent.contexts(hashes, np.array([0]))
    assert maxent.token_logs(model, features, rank) == pytest.approx(logs, rel=1e-4, abs=1e-4)
    state = [np.ones(maxent.CLASS_ROWS), np.zeros(maxent.CLASS_ROWS), np.ones(maxent.WORD_ROWS), np.zeros(maxent.WORD_ROWS)]
    maxent.train_block(model, state, features, rank, 0.25)
    assert np.allclose(model.class_rows, after[0], atol=1e-4) and np.allclose(model.word_rows, after[1], atol=1e-4)


def test_rows_of_scored_tokens_stay_in_the_cache():
    rng, n = np.random.default_rng(5), 20_000
    bias = (rng.normal(size=maxent.WIDTH).astype(np.float32), rng.normal(size=(maxent.CLASSES, maxent.WIDTH)).astype(np.float32))
    model = maxent.Model(*bias)
    features, rank = rng.integers(0, 1 << 63, (maxent.FEATURES, n), np.uint64), rng.integers(-1, maxent.CLASSES * maxent.WIDTH, n)
    tracemalloc.start()
    maxent.token_logs(model, features, rank)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000


@pytest.mark.parametrize("size", [1, 30, 300])
def test_softmax_of_small_and_large_weights(size):
    rng = np.random.default_rng(6)
    bias = rng.normal(size=maxent.WIDTH).astype(np.float32)
    bias[5] = -1e9
    rows = (rng.normal(size=(50, maxent.WIDTH)) * size).astype(np.float32)
    index = rng.integers(0, 50, (maxent.FEATURES, 200))
    got = maxent._softmax(bias, rows, index, maxent._most(bias, rows))
    x = (bias + rows[index].sum(axis=0)).astype(np.float64)
    x = np.exp(x - x.max(axis=1, keepdims=True))
    assert got == pytest.approx(x / x.sum(axis=1, keepdims=True), rel=1e-3, abs=1e-5)


def test_sums_of_runs():
    rng = np.random.default_rng(7)
    values, index = rng.normal(size=(500, 4)), np.concatenate([rng.integers(0, 300, 1500), np.full(500, 7)]).reshape(4, 500)
    rows, squares, seen = np.zeros((301, 4)), np.zeros(301), np.zeros(301)
    maxent._update(rows, squares, seen, index, values.astype(np.float32), 0.0)
    want = np.zeros((301, 4))
    np.add.at(want, index.reshape(-1), np.tile(values, (4, 1)))
    assert squares == pytest.approx((want**2).sum(axis=1), rel=1e-3, abs=1e-4) and (seen == np.bincount(index.reshape(-1), minlength=301)).all()
