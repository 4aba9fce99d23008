from __future__ import annotations

import re

import numpy as np
import pytest
from conftest import words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesora.llm import quality


def plain_measures(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines, seen, repeats = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#é漢\x0b\x1c"), max_size=120))
def test_base_measures(text):
    assert quality.base_measures(text) == plain_measures(text)


def test_word_shapes():
    assert quality.word_shapes("Hello WORLD!! x99 éà### a|b".encode()) == [b"Aa", b"A!!", b"a0", b"a###", b"a|a"]


def sample(spark, bad=12, good=60):
    clean = [(i, words(60 + i, i) + ".", "en", "a") for i in range(good)]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in words(60 + i, 500 + i).split()), "en", "a") for i in range(bad)]
    docs = spark.createDataFrame([*clean, *junk], "doc_id long, text string, lang string, source string")
    rows = [(i, 1, 0) for i in range(0, good, 2)] + [(1000 + i, 0, 0) for i in range(0, bad, 2)]
    return docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_junk_goes_and_clean_stays(spark):
    docs, labels = sample(spark)
    got = quality.judge(docs, quality.fit(docs, labels)).collect()
    assert {r.doc_id for r in got if r.kept} == set(range(60))


def test_ratio_equals_a_plain_count(spark):
    docs, labels = sample(spark)
    buckets = 256
    model = quality.fit(docs, labels, buckets=buckets)
    raw, target = np.zeros(2 * buckets), np.zeros(2 * buckets)
    held = {r.doc_id for r in spark.createDataFrame([(i,) for i in range(60)], "doc_id long").where("pmod(xxhash64(doc_id), 4) = 0").collect()}
    for r in docs.collect():
        for b in quality.gram_buckets(r.text.encode(), buckets):
            raw[b] += 1
            target[b] += r.doc_id < 60 and r.doc_id % 2 == 0 and r.doc_id not in held
    half = [slice(0, buckets), slice(buckets, None)]
    share = lambda x: np.concatenate([np.log((x[h] + 1) / (x[h].sum() + buckets)) for h in half])
    assert np.allclose(model.ratio, share(target) - share(raw), atol=1e-6)
    scores = {r.doc_id: r.llr for r in quality.judge(docs, model).collect()}
    text = docs.where("doc_id = 7").first().text
    assert scores[7] == pytest.approx(float(model.ratio[quality.gram_buckets(text.encode(), buckets)].mean()), abs=1e-9)


def test_no_label_is_left_out(spark):
    """Of 30,000 labelled ids, those with the largest hashes have documents: all of them count."""
    buckets = 256
    ids = spark.range(30_000).orderBy(F.xxhash64("id").desc()).limit(400)
    last = sorted(r.id for r in ids.collect())
    plain = [(i, words(25, i)) for i in last] + [(100_000 + i, words(25, i).upper()) for i in range(50)]
    docs = spark.createDataFrame(plain, "doc_id long, text string")
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    model = quality.fit(docs, labels, buckets=buckets)
    tune = {r.id for r in ids.where("pmod(xxhash64(id), 4) = 0").collect()}
    raw, target = np.zeros(2 * buckets), np.zeros(2 * buckets)
    for i, text in plain:
        np.add.at(raw, quality.gram_buckets(text.encode(), buckets), 1)
        if i in last and i not in tune:
            np.add.at(target, quality.gram_buckets(text.encode(), buckets), 1)
    assert target.sum() and tune
    half = [slice(0, buckets), slice(buckets, None)]
    share = lambda x: np.concatenate([np.log((x[h] + 1) / (x[h].sum() + buckets)) for h in half])
    want = share(target) - share(raw)
    assert np.allclose(model.ratio, want, atol=1e-6)
    scores = [quality.mean_ratio(text, want) for i, text in plain if i in tune]
    assert model.threshold == pytest.approx(np.quantile(scores, 0.001), abs=1e-9)


def test_the_filter_only_spares_moves(spark):
    """Ids that share bits with listed ones, repeated and null ones, and ids of another type join as plain ones do."""
    docs = spark.range(3_000).selectExpr("id % 1500 as __id", "cast(id as string) as text")
    docs = docs.unionByName(spark.createDataFrame([(None, "x")], "__id long, text string"))
    ids = spark.range(0, 3_000, 3).selectExpr("id as __target", "id % 2 = 0 as good")
    plain = sorted(map(tuple, docs.join(ids, F.col("__id") == F.col("__target")).collect()))
    assert len(plain) == 1_000
    for bits in (quality.FILTER_BITS, 1 << 15, 1 << 10):
        assert sorted(map(tuple, quality.having(docs, ids, bits).collect())) == plain
    text_ids = docs.withColumn("__id", F.lpad(F.col("__id").cast("string"), 5, "0"))
    got = quality.having(text_ids, ids).select(F.col("__id").cast("long"), "text", "__target", "good")
    assert sorted(map(tuple, got.collect())) == plain
    assert quality.having(docs, ids.where("false")).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.001, 0.5, 0.95, 1.0])
def test_percentile_is_exact(spark, share):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 1, 501), rng.normal(0, 1e-300, 50), [0.0] * 20, [-1.5] * 30, [1e300, -1e300]])
    frame = spark.createDataFrame([(float(v), int(k)) for v, k in zip(values, quality.ordered(values), strict=True)], "v double, key long")
    assert quality.percentile(frame, share) == frame.agg(F.percentile("v", share)).first()[0]
    assert quality.percentile(frame.where("false"), share) is None
    assert np.array_equal(np.argsort(values, kind="stable"), np.argsort(quality.ordered(values), kind="stable"))


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (1, 1, None), (1, 0, 0), (None, 1, 1), (10, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(awkward, labels)
    judged = quality.judge(awkward, model, prefix="__")
    assert judged.columns[: len(awkward.columns)] == awkward.columns and judged.count() == awkward.count()
    for r in judged.collect():
        base = (r["__n_words"], r["__word_chars"], r["__n_symbols"], r["__n_dup_lines"], r["__n_repeat_words"])
        if r.text is None or len(r.text) < 10_000:
            assert base == plain_measures(r.text)
        assert r["__base_failed"] == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert r["__kept"] == (not r["__base_failed"] and r["__llr"] >= model.threshold)


def test_without_labels_the_base_rules_decide(spark, awkward, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(awkward, quality.fit(awkward, labels), prefix="__").collect()
    assert all(r["__kept"] != r["__base_failed"] and r["__llr"] == 0 for r in got)
    assert quality.judge(nothing, quality.fit(nothing, labels), keep=["doc_id"], prefix="__").count() == 0
