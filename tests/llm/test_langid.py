from __future__ import annotations

import itertools
import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesora.llm import langid

DATA = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    emit, trans = rng.standard_normal((4, 2, 3)), rng.standard_normal((3, 3))
    lengths = np.array([4, 2])
    got, expected = langid.forward_backward(emit.copy(), lengths, trans)
    total = np.zeros((3, 3))
    for n, length in enumerate(lengths):
        mass, marginal, pairs = 0.0, np.zeros((length, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(length)):
            p = np.exp(sum(emit[t, n, s] for t, s in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
            mass += p
            for t, s in enumerate(path):
                marginal[t, s] += p
            for a, b in itertools.pairwise(path):
                pairs[a, b] += p
        assert np.allclose(got[:length, n], marginal / mass)
        total += pairs / mass
    assert np.allclose(expected, total)


def test_features_stay_inside_words():
    words = langid.analyse(b"ab c")
    grams = [[words.grams[k][i] for i in np.flatnonzero(words.ok[k])] for k in range(3)]
    alone = [langid.analyse(w) for w in (b"ab", b"c")]
    for k in range(3):
        assert grams[k] == [g for a in alone for g in a.grams[k][a.ok[k]]]
    assert words.hashes.tolist() == [h for a in alone for h in a.hashes]
    assert len(langid.analyse(b"").starts) == 0


@pytest.fixture(scope="module")
def trained(spark):
    if not Path(DATA).exists():
        pytest.skip("shared tables are absent")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    return docs, langid.fit(docs, F.col("doc_id") % 3 != 0)


def test_held_out_accuracy(trained):
    docs, crf = trained
    got = langid.predict(docs.where("doc_id % 3 = 0"), crf).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_words_of_code_switched_text(trained):
    docs, crf = trained
    texts = {lang: [t for t in docs.where(f"lang = '{lang}' and doc_id % 3 = 0").limit(5).toPandas()["text"]] for lang in ("de", "es")}
    runs = [(lang, langid.normalised(t).split(b" ")[:20]) for pair in zip(texts["de"], texts["es"], strict=False) for lang, t in zip(("de", "es"), pair, strict=True)]
    data = b" ".join(w for _, ws in runs for w in ws)
    truth = [crf.langs.index(lang) for lang, ws in runs for _ in ws]
    found = langid.marginals(langid.emissions(crf, langid.analyse(data)), langid.spans(len(truth)), crf.transitions).argmax(axis=1)
    assert np.mean(found == truth) >= 0.85
    assert np.diag(crf.transitions).mean() > crf.transitions.mean()  # staying in a language is learned


def test_parts_of_long_texts_make_the_same_answer(trained):
    docs, crf = trained
    text = " ".join(docs.where("lang = 'fr'").limit(20).toPandas()["text"])
    data = langid.normalised(text)
    assert b" ".join(langid.pieces(data, 1000)) == data
    assert langid.label_texts([text, None, "!!! 123", ""], crf)[0][0] == "fr"


def test_scripts_without_blanks(spark):
    """Chinese, Thai and English texts of common characters, some of one word only, some with blanks."""
    rng = np.random.default_rng(3)
    signs = {"zh": [chr(c) for c in range(0x4E00, 0x4E00 + 400)], "th": [chr(c) for c in range(0x0E01, 0x0E2F)]}
    english = "the of and to in is that for it was on are with as at be this have from or had by not but what all were when".split()
    rows = []
    for i in range(240):
        for lang, letters in signs.items():
            blank = " " if i % 5 == 0 else ""
            rows.append((f"{lang}{i}", blank.join("".join(rng.choice(letters, 60)) for _ in range(3)), lang))
        rows.append((f"en{i}", " ".join(rng.choice(english, 40)), "en"))
    docs = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    crf = langid.fit(docs, F.col("doc_id") % 4 != 0)
    got = langid.predict(docs.where("doc_id % 4 = 0"), crf).collect()
    for lang in ("zh", "th", "en"):
        assert np.mean([r.lang_pred == lang for r in got if r.lang == lang]) >= 0.95


def test_long_words_are_cut_between_characters():
    text = "a" * 95 + " b " + "漢" * 30 + "é" + "x" * 39
    data = langid.normalised(text)
    assert max(map(len, data.split(b" "))) <= langid.LONGEST
    assert data.replace(b" ", b"").decode() == text.replace(" ", "")
    assert langid.normalised("x" * 40) == b"x" * 40


def test_awkward_rows(spark, awkward, nothing):
    learn = F.lit(True)
    crf = langid.fit(awkward, learn)
    assert crf.langs == ("de", "en", "es", "fr")
    got = langid.predict(awkward, crf, names=("__lang", "__share")).collect()
    assert len(got) == awkward.count()
    for r in got:
        lettered = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r["__lang"] == "und") == (not lettered) and (lettered or r["__share"] == 0)
    empty = langid.fit(nothing, learn)
    assert langid.predict(nothing, empty, names=("__lang", "__share")).count() == 0
    assert {r["__lang"] for r in langid.predict(awkward, empty, names=("__lang", "__share")).collect()} == {"und"}


def test_memory_of_a_prediction_is_bounded():
    rng, k = np.random.default_rng(3), 4
    weights = rng.normal(size=(1 << langid.BITS, k)).astype(np.float32)
    crf = langid.Crf(tuple("abcd"), weights, np.empty(0, np.uint64), np.empty(0, int), np.zeros((k + 1, k)), np.zeros((k, k)))
    tracemalloc.start()
    found = langid.label_texts([" ".join(f"word{i}" for i in range(300_000))], crf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0][0] in crf.langs and peak < 60_000_000
