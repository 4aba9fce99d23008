"""Language of every word by a linear-chain conditional random field, and of the text by its words.

A word's features are byte n-grams of two to four bytes with its borders (those
at a border are its affixes) and its entry in a lexicon of typical words. The
chain's labels are languages; emission weights of hashed features, lexicon
weights and transitions are learned together by gradient ascent on the
likelihood, with expectations from forward-backward. Chains are spans of at most
``SPAN`` words; all spans of a batch advance in lockstep in numpy, so a long
text is many short chains and never one long loop.

Training reads a bounded sample: at most ``rows`` documents, about as many per
language, one run of at most ``run_words`` words of each. Runs of several
documents are chained together, so that transitions between languages are seen.

Words of more than ``LONGEST`` bytes, such as the sentences of scripts without
blanks, are read as several words of at most that length, cut between
characters, both in training and in prediction.

Defined results: null texts and texts without a letter are ``und`` with score 0,
as is everything if nothing was labelled; score is the mean probability of the
predicted language over the words with letters; ties go to the smaller name;
repeated rows get equal results; a null id is in fold zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from tesora.llm.base import add_columns, documents, fold, order_hash, ragged

SPAN = 64
BITS = 16
#: Bytes of a word; longer ones are cut.
LONGEST = 40
_LONG = re.compile(rb"[^ ]{%d,}" % (LONGEST + 1))
#: Bytes whose emissions are computed at once.
BLOCK = 1 << 18
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)
_GRAM = {2: np.uint64(0xC2B2AE3D27D4EB4F), 3: np.uint64(0x165667B19E3779F9), 4: np.uint64(0x27D4EB2F165667C5)}
_LETTER = np.array([chr(i).isalpha() or i >= 128 for i in range(256)])


@dataclass(frozen=True)
class Crf:
    langs: tuple[str, ...]
    weights: np.ndarray  # (buckets, langs)
    lexicon: np.ndarray  # sorted word hashes
    lexicon_lang: np.ndarray
    lexicon_weights: np.ndarray  # (langs + 1, langs); the last row is for words not listed
    transitions: np.ndarray  # (langs, langs)


@dataclass
class Words:
    """Words of a buffer: one line per byte position and n-gram length, summed per word."""

    grams: np.ndarray  # (3, bytes) buckets
    ok: np.ndarray  # (3, bytes) whether the n-gram lies in one word with its borders
    starts: np.ndarray  # first byte (the border before it) per word
    hashes: np.ndarray
    letters: np.ndarray


def _cut(found: re.Match) -> bytes:
    """A long word with blanks between pieces of whole characters."""
    word, parts, at = found.group(), [], 0
    while at < len(word):
        end = at + LONGEST
        while end < len(word) and word[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(word[at:end])
        at = end
    return b" ".join(parts)


def normalised(text: str | None) -> bytes:
    """Lower-cased words with one blank between them, long ones cut."""
    return _LONG.sub(_cut, b" ".join((text or "").lower().encode("utf-8", "replace").split()))


def analyse(buffer: bytes) -> Words:
    """Features of all words of a blank-separated buffer, each with a blank on both sides."""
    data = np.frombuffer(b" " + buffer + b"    ", np.uint8)
    n = len(buffer) + 1
    wide = data.astype(np.uint64)
    blank = data == 32
    starts = np.flatnonzero(blank[: n - 1]) if buffer else np.empty(0, np.int64)
    code, grams, ok = wide[:n].copy(), [], []
    inner = np.zeros(n, bool)  # a blank among the bytes after the first and before the last
    for size in (2, 3, 4):
        if size > 2:
            inner |= blank[size - 2 : size - 2 + n]
        code = (code << np.uint64(8)) | wide[size - 1 : size - 1 + n]
        grams.append(((code * _GRAM[size]) >> np.uint64(64 - BITS)).astype(np.int32))
        ok.append(~inner)
    ends = np.append(starts[1:], n)
    place = np.minimum(ragged(ends - starts), 63)
    spread = (wide[:n] + np.uint64(1)) * _POWERS[place]
    has = np.add.reduceat(_LETTER[data[:n]].astype(np.int32), starts) > 0 if len(starts) else np.empty(0, bool)
    return Words(np.stack(grams), np.stack(ok), starts, np.add.reduceat(spread, starts) if len(starts) else np.empty(0, np.uint64), has)


def lexicon_rows(crf: Crf, hashes: np.ndarray) -> np.ndarray:
    missing = len(crf.langs)
    if not len(crf.lexicon):
        return np.full(len(hashes), missing)
    at = np.minimum(np.searchsorted(crf.lexicon, hashes), len(crf.lexicon) - 1)
    return np.where(crf.lexicon[at] == hashes, crf.lexicon_lang[at], missing)


def emissions(crf: Crf, words: Words) -> np.ndarray:
    out = crf.lexicon_weights[lexicon_rows(crf, words.hashes)].astype(np.float32)
    for grams, ok in zip(words.grams, words.ok, strict=True):
        rows = crf.weights[grams]
        rows[~ok] = 0
        out += np.add.reduceat(rows, words.starts, axis=0)
    return out


def forward_backward(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (T, n, L) and expected transitions (L, L) of n padded chains, emissions (T, n, L)."""
    steps, n, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    a = np.exp(transitions - transitions.max())
    forward, backward = np.empty_like(e), np.ones_like(e)
    state = e[0] / e[0].sum(1, keepdims=True)
    forward[0] = state
    for t in range(1, steps):
        state = (state @ a) * e[t]
        state /= state.sum(1, keepdims=True)
        forward[t] = state
    expected = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        ahead = e[t + 1] * backward[t + 1]
        back = ahead @ a.T
        back /= back.sum(1, keepdims=True)
        inside = (lengths > t + 1)[:, None]
        backward[t] = np.where(inside, back, 1)
        scale = np.einsum("ni,ij,nj->n", forward[t], a, ahead)
        left = forward[t] * (inside / np.maximum(scale, 1e-30)[:, None])
        expected += a * (left.T @ ahead)
    marginal = forward * backward
    return marginal / marginal.sum(2, keepdims=True), expected


def marginals(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of words (rows of ``emit``), chained by ``lengths``."""
    steps, k = int(lengths.max()), emit.shape[1]
    chain, at = np.repeat(np.arange(len(lengths)), lengths), ragged(lengths)
    padded = np.zeros((steps, len(lengths), k), emit.dtype)
    padded[at, chain] = emit
    return forward_backward(padded, lengths, transitions)[0][at, chain]


def spans(count: int) -> np.ndarray:
    full, rest = divmod(int(count), SPAN)
    return np.array([SPAN] * full + ([rest] if rest else []), np.int64)


def language_shares(texts: list[bytes], crf: Crf) -> np.ndarray:
    """Mean label probabilities over the words with letters, per normalised text."""
    out = np.zeros((len(texts), len(crf.langs)))
    filled = [i for i, t in enumerate(texts) if t]
    if not filled:
        return out
    words = analyse(b" ".join(texts[i] for i in filled))
    counts = np.array([texts[i].count(b" ") + 1 for i in filled])
    lengths = np.concatenate([spans(c) for c in counts])
    p = marginals(emissions(crf, words), lengths, crf.transitions) * words.letters[:, None]
    first = np.cumsum(counts) - counts
    seen = np.maximum(np.add.reduceat(words.letters.astype(np.int64), first), 1)
    out[filled] = np.add.reduceat(p, first, axis=0) / seen[:, None]
    return out


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """A long normalised text in parts that end between words."""
    while len(data) > size:
        cut = data.find(b" ", size)
        if cut < 0:
            break
        yield data[:cut]
        data = data[cut + 1 :]
    yield data


def label_texts(texts: list[str | None], crf: Crf) -> list[tuple[str, float]]:
    """Language and score of whole texts; several short ones go through the chain together."""
    answers: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if not crf.langs:
        return answers
    weight, total = np.zeros(len(texts)), np.zeros((len(texts), len(crf.langs)))

    def flush(group: list[tuple[int, bytes]]) -> None:
        shares = language_shares([d for _, d in group], crf)
        for (i, d), share in zip(group, shares, strict=True):
            total[i] += share * len(d)
            weight[i] += len(d)

    block = BLOCK * 4 // max(4, len(crf.langs))
    group, held = [], 0
    for i, text in enumerate(texts):
        if text and any(map(str.isalpha, text)):
            for part in pieces(normalised(text), block):
                group.append((i, part))
                held += len(part)
                if held >= block:
                    flush(group)
                    group, held = [], 0
    flush(group)
    for i in np.flatnonzero(weight):
        best = int(np.argmax(total[i]))
        answers[i] = (crf.langs[best], float(min(max(total[i, best] / weight[i], 0.0), 1.0)))
    return answers


def training_runs(docs: DataFrame, learn: Column, rows: int, run_words: int) -> tuple[list, list[str]]:
    """(lang, words) of the bounded sample, and all languages."""
    body = docs.where(learn & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in body.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], []
    each = max(1, rows // len(langs))
    share = F.element_at(F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(each / counts[lang]))]), F.col("lang"))
    place = F.pmod(order_hash("doc_id"), F.lit(1 << 30)) / (1 << 30)
    ids = body.where(place < share).orderBy(order_hash("doc_id"), "doc_id").select("doc_id").limit(2 * rows)
    chosen = body.where(place < share).join(F.broadcast(ids.distinct()), "doc_id", "left_semi")

    def cut(batches):
        for batch in batches:
            found = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = normalised(text.as_py()).split(b" ")
                at = (key or 0) * 2654435761 % max(1, len(words) - run_words + 1)
                found.append(b" ".join(words[at : at + run_words]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "lang", "words"])

    sample = chosen.select("doc_id", "text", "lang").mapInArrow(cut, "doc_id long, lang string, words binary")
    found = sample.orderBy(order_hash("doc_id"), "doc_id", "lang", "words").limit(2 * rows).collect()
    return [(r["lang"], bytes(r["words"])) for r in found if r["words"]], langs


def _lexicon(runs: list, langs: list[str], least: int = 5, share: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words seen often and mostly in one language."""
    index = {lang: i for i, lang in enumerate(langs)}
    hashes, label = [], []
    for lang, words in runs:
        found = analyse(words)
        hashes.append(found.hashes[found.letters])
        label.append(np.full(len(hashes[-1]), index[lang]))
    keys, at = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = np.zeros((len(keys), len(langs)))
    np.add.at(counts, (at, np.concatenate(label)), 1)
    total, best = counts.sum(1), counts.argmax(1)
    take = (total >= least) & (counts.max(1) >= share * total)
    return keys[take], best[take]


def fit(
    docs: DataFrame, learn: Column, rows: int = 4000, run_words: int = 192, epochs: int = 4, rate: float = 0.3, piece: int = 24
) -> Crf:
    """Learns from at most ``2 * rows`` labelled documents (about ``rows``), in seeded order."""
    runs, langs = training_runs(docs, learn, rows, run_words)
    k = len(langs)
    if not runs:
        return Crf((), np.zeros((1 << BITS, 0), np.float32), np.empty(0, np.uint64), np.empty(0, int), np.zeros((1, 0)), np.zeros((0, 0)))
    index, rng = {lang: i for i, lang in enumerate(langs)}, np.random.default_rng(7)
    lexicon, lexicon_lang = _lexicon(runs, langs)
    parts = []  # (label, words): short pieces, so that chains change language
    for lang, words in runs:
        tokens = words.split(b" ")
        at = 0
        while at < len(tokens):
            size = int(rng.integers(3, piece + 1))
            parts.append((index[lang], tokens[at : at + size]))
            at += size
    crf = Crf(tuple(langs), np.zeros((1 << BITS, k), np.float32), lexicon, lexicon_lang, np.zeros((k + 1, k)), np.zeros((k, k)))
    squares = [np.full_like(x, 1e-2, dtype=np.float64) for x in (crf.weights, crf.lexicon_weights, crf.transitions)]
    for _ in range(epochs):
        order = rng.permutation(len(parts))
        for at in range(0, len(order), 512):
            _step(crf, [parts[i] for i in order[at : at + 512]], squares, rate)
    return crf


def _step(crf: Crf, parts: list, squares: list[np.ndarray], rate: float) -> None:
    """One adaptive gradient step on the log likelihood of one batch of chains."""
    k = len(crf.langs)
    truth = np.concatenate([np.full(len(w), label) for label, w in parts])
    words = analyse(b" ".join(w for _, ws in parts for w in ws))
    lengths = spans(len(truth))
    emit = emissions(crf, words)
    chain, at = np.repeat(np.arange(len(lengths)), lengths), ragged(lengths)
    padded = np.zeros((int(lengths.max()), len(lengths), k), np.float64)
    padded[at, chain] = emit
    marginal, expected = forward_backward(padded, lengths, crf.transitions)
    error = -marginal[at, chain]
    error[np.arange(len(truth)), truth] += 1
    n = len(truth)
    grads = [np.zeros((1 << BITS, k)), np.zeros((k + 1, k)), -expected]
    widths = np.diff(np.append(words.starts, words.grams.shape[1]))
    owner = np.repeat(np.arange(n), widths)
    for grams, ok in zip(words.grams, words.ok, strict=True):
        rows, who = grams[ok], owner[ok]
        for j in range(k):
            grads[0][:, j] += np.bincount(rows, error[who, j], 1 << BITS)
    np.add.at(grads[1], lexicon_rows(crf, words.hashes), error)
    inside = np.flatnonzero(at[1:] > 0)
    np.add.at(grads[2], (truth[inside], truth[inside + 1]), 1)
    for weight, grad, square in zip((crf.weights, crf.lexicon_weights, crf.transitions), grads, squares, strict=True):
        grad /= n
        square += grad * grad
        weight += (rate * grad / np.sqrt(square)).astype(weight.dtype)


def predict(docs: DataFrame, crf: Crf, text: str = "text", keep: list[str] | None = None, names=("lang_pred", "score")) -> DataFrame:
    def compute(batch: pa.RecordBatch):
        found = []
        for at in range(0, batch.num_rows, 256):
            found += label_texts(batch.column(text).slice(at, 256).to_pylist(), crf)
        return [list(x) for x in zip(*found, strict=True)]

    return add_columns(docs, [(names[0], StringType()), (names[1], DoubleType())], compute, keep)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    crf = fit(docs, fold(4) != 2)
    marked = docs.select("doc_id", "text", (fold(4) == 2).alias("held_out"))
    return predict(marked, crf, keep=["doc_id", "held_out"])
