from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesora.llm import wavelet
from tesora.llm.tokens import Encoder
from tesora.llm.wavelet import WaveletMatrix

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path):
    found = Tokenizer.from_file(path)
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 1023), min_size=1, max_size=5000))
def test_access_count_and_occurrences(values):
    ids = np.array(values)
    matrix = WaveletMatrix.build(ids, 10)
    assert matrix.decode().tolist() == values
    for i in {0, len(values) // 2, len(values) - 1}:
        assert matrix.access(i) == values[i]
    for token in {values[0], values[-1], 5}:
        where = np.flatnonzero(ids == token)
        assert matrix.occurrences(token) == where.tolist()
        assert matrix.count(token, 1, len(values)) == int((where >= 1).sum())
    with pytest.raises(IndexError):
        matrix.select(values[0], values.count(values[0]))


def test_file_round_trip():
    ids = np.random.default_rng(0).integers(0, 50_000, 10_000)
    data = wavelet.shard_bytes(WaveletMatrix.build(ids, 16), [None, 3, 3, -7], np.array([0, 1, 4000, 5999]))
    matrix, docs, sizes = wavelet.open_shard(data)
    assert matrix.decode().tolist() == ids.tolist() and docs == [None, 3, 3, -7] and sizes.tolist() == [0, 1, 4000, 5999]
    assert matrix.count(60_000) == int((ids == 60_000).sum()) and matrix.count(1 << 20) == 0
    with pytest.raises(ValueError):
        wavelet.open_shard(b"x" * 64)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\x1c  '.,;!?aAzZéÉßİ1漢😀́|<>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_chunks_encode_like_whole_texts(text):
    for path, leading in ((BYTES, True), (WORDS, False)):
        encoder, whole = _encoders[path]
        assert encoder.encode(text).tolist() == whole(text), (text, leading)


_encoders = {p: (Encoder(p, leading), library(p)) for p, leading in ((BYTES, True), (WORDS, False))}


def test_the_table_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr("tesora.llm.tokens.REMEMBERED", {True: 50})
    monkeypatch.setattr("tesora.llm.tokens.PIECES", 7)
    encoder, whole = Encoder(BYTES, True), library(BYTES)
    for i in range(20):
        text = " ".join(f"word{i}x{j}." for j in range(30))
        assert encoder.encode(text).tolist() == whole(text)
        assert encoder.count < 50 + 31 and len(encoder.pieces) <= 7


def test_words_at_line_ends_and_before_signs_are_encoded_once():
    words = [f"w{a}{b}".translate(str.maketrans("0123456789", "abcdefghij")) for a in range(6) for b in range(6)]
    text = " ".join(f"{x}.\n{y}!! {y}," for x in words for y in words)
    for path, leading in ((BYTES, True), (WORDS, False)):
        encoder, whole = Encoder(path, leading), library(path)
        assert encoder.encode(text).tolist() == whole(text)
        assert encoder.count <= 6 * len(words)  # not one chunk for each two words that meet at a line end


def test_blanks_beside_blanks_and_line_ends():
    parts = ["a\r\nb", "a\n\nb", "a\n\n\n b", "a \nb", "a\t\n b", "a\n b", "a\n\tb", "\na", " \na", "a\n", "a ", "  a", "a\x1c\nb", "a\u3000\nb c"]
    for path, leading in ((BYTES, True), (WORDS, False)):
        encoder, whole = Encoder(path, leading), library(path)
        for text in [x + glue + y for x in parts for y in parts for glue in ("", " ", "\n", " c ")]:
            assert encoder.encode(text).tolist() == whole(text), (text, leading)


def expected(rows):
    encode, start, out = library(BYTES), 0, []
    for doc_id, text in rows:
        ids = np.array([*encode(text), 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_documents_come_back_from_the_files(spark, awkward, tmp_path):
    path = str(tmp_path / "shards")
    wavelet.write_shards(awkward, path, BYTES, shard_tokens=5000)
    got = wavelet.read_documents(spark, path).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    texts = {}
    for r in awkward.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    # documents of one id stand in some fixed order: take the order of the files
    want = {(d, n, c) for d, _, n, c in expected([(d, t) for d, ts in texts.items() for t in ts])}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want
    starts = np.cumsum([0] + [r.n_tokens for r in got])
    assert [r.start for r in got] == starts[:-1].tolist()
    shards = spark.read.parquet(path)
    assert shards.count() >= 3 and len({(r.part, r.seq) for r in shards.collect()}) == shards.count()
    assert len(list((tmp_path / "shards").glob("part-*.parquet"))) == shards.count()


def test_tokens_are_found_in_the_files(spark, awkward, tmp_path):
    path = str(tmp_path / "shards")
    wavelet.write_shards(awkward, path, BYTES, shard_tokens=5000)
    encode = library(BYTES)
    token = encode(" one")[0]
    want = sorted((r.doc_id, i) for r in awkward.collect() for i, t in enumerate(encode(r.text)) if t == token)
    found = wavelet.find_tokens(spark, path, [token, 0]).where(f"token = {token}").collect()
    assert sorted((r.doc_id, r.place) for r in found) == want and want
    counts = wavelet.find_tokens(spark, path, [token], positions=False).groupBy().sum("count").first()[0]
    assert counts == len(want)


def test_empty_table(spark, nothing, tmp_path):
    path = str(tmp_path / "shards")
    wavelet.write_shards(nothing, path, BYTES)
    assert wavelet.read_documents(spark, path).count() == 0
