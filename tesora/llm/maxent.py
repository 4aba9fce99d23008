"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

Words are counted over all training documents. The most frequent ones, the end
of a text among them, are the model's vocabulary, dealt to classes by rank; one
more class stands for all other words. The model gives

    p(word | context) = p(class | context) * p(word | class, context),

each factor a softmax over the sum of the weight rows that the context's hashed
features pick: the word before, the two words before, and each of the two words back from there (skipping one or two). A
word outside the vocabulary has p(other | context) times its add-half share
among the other words, unseen ones counting as one more word. So probabilities
sum to one over all words.

Weights start at the unigram model and learn by distributed gradient updates:
in each round every partition runs adaptive gradient steps over its share of the
training documents and sends the change of each weight row; changes are averaged
by how often a partition saw the row. Each training token is used once.

Counts of frequent words travel to the scoring tasks as at most ``LISTED``
hashes; counts of all the others are joined by shuffle. Words are told apart by
64-bit hashes.

Defined results: null and blank texts are the end token alone; without training
documents every word is the one unseen word; repeated rows are scored one by
one; a null id is in fold zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesora.llm.base import ASCII_LOWER, chunks, documents, fold, order_hash, ragged, staged

WIDTH = 64  # classes, and words in a class
CLASSES = WIDTH - 1  # the last class is for words outside the vocabulary
FEATURES = 4
CLASS_ROWS, WORD_ROWS = 1 << 12, 1 << 14
#: Most hashes with their counts that are sent to the tasks.
LISTED = 1 << 19
#: Tokens per gradient step, and tokens scored or trained at once.
STEP, BLOCK = 4096, 1 << 17
#: Tokens scored at once, so that their rows stay in the cache.
SCORED = 1024
#: Sums of weights up to here need no common factor taken out before exp.
SAFE, LOW = 40.0, -1e8
#: The end of a text; no word has this hash by construction.
END = np.uint64(1)
_LOG10 = np.log(10)
_POWERS = np.random.default_rng(11).integers(1, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX, _TURN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FEATURE = np.random.default_rng(12).integers(1, 1 << 63, (FEATURES, 3), np.uint64) * np.uint64(2) + np.uint64(1)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _TURN
    return x ^ (x >> np.uint64(31))


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a whole text (A-Z lowered), then the end."""
    words = (text or "").encode("utf-8", "replace").translate(ASCII_LOWER).split()
    out = np.full(len(words) + 1, END)
    if words:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
        place = ragged(sizes)
        if sizes.max() > len(_POWERS):
            place %= len(_POWERS)
        data *= _POWERS[place]
        sums = np.add.reduceat(data, np.cumsum(sizes) - sizes)
        out[:-1] = np.maximum(_finish(sums), np.uint64(2))
    return out


@dataclass
class Lexicon:
    """Training counts: totals, and the listed words."""

    tokens: int
    words: int
    head: np.ndarray  # hashes of the vocabulary by rank
    head_counts: np.ndarray
    listed: np.ndarray  # sorted hashes of all listed words, the vocabulary among them
    listed_counts: np.ndarray

    def __post_init__(self) -> None:
        rank = np.full(len(self.listed), -1, np.int32)
        rank[np.searchsorted(self.listed, self.head)] = np.arange(len(self.head))
        self.listed_rank = rank
        # hashes are uniform: the first 20 bits lead to a place among the sorted ones, or close before it
        self.places = np.searchsorted(self.listed, np.arange((1 << 20) + 1, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        self.places[-1] = len(self.listed)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank in the vocabulary (-1: outside) and count (-1: not listed)."""
        if not len(self.listed):
            return np.full(len(hashes), -1, np.int32), np.full(len(hashes), -1, np.int64)
        top = (hashes >> np.uint64(44)).astype(np.int64)
        at, end = self.places[top], self.places[top + 1]
        last = len(self.listed) - 1
        found = self.listed[np.minimum(at, last)] == hashes
        rest = np.flatnonzero(~found & (end - at > 1))
        while len(rest):  # a few rounds: buckets hold one or two on average
            at[rest] += 1
            found[rest] = self.listed[at[rest]] == hashes[rest]
            rest = rest[~found[rest] & (end[rest] - at[rest] > 1)]
        at = np.minimum(at, last)
        return np.where(found, self.listed_rank[at], -1), np.where(found, self.listed_counts[at], -1)


@dataclass
class Model:
    class_bias: np.ndarray  # (WIDTH,)
    word_bias: np.ndarray  # (CLASSES, WIDTH)
    class_rows: np.ndarray = field(default_factory=lambda: np.zeros((CLASS_ROWS, WIDTH), np.float32))
    word_rows: np.ndarray = field(default_factory=lambda: np.zeros((WORD_ROWS, WIDTH), np.float32))


def count_words(docs: DataFrame) -> DataFrame:
    """(hash, c): training counts of all words and of the end; each batch counts its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            hashes, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["hash", "c"])

        for batch in batches:
            for text in batch.column(0):
                held.append(token_hashes(text.as_py()))
                size += len(held[-1])
                if size > 1 << 21:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c"))


def lexicon(counts: DataFrame, listed: int = LISTED) -> Lexicon:
    """Totals, the vocabulary and the listed words from the written counts.

    Listed are the words whose count reaches the least eighth of an octave that
    keeps their number within the bound; counts per eighth are at most a few
    hundred rows.
    """
    octave = F.floor(F.log2("c") * 8).cast("int")
    bands = counts.groupBy(octave.alias("band")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).orderBy(F.desc("band")).collect()
    seen, least = 0, None
    for r in bands:
        seen += r["n"]
        if seen > listed:
            break
        least = r["band"]
    rows = counts.orderBy(F.desc("c"), "hash").limit(CLASSES * WIDTH).collect()
    head = np.array([r["hash"] for r in rows], np.int64).view(np.uint64)
    head_counts = np.array([r["c"] for r in rows], np.int64)
    # as Arrow columns: sixteen bytes a word on the driver
    more = counts.where(F.lit(False) if least is None else octave >= least).select("hash", "c").toArrow()
    hashes = np.concatenate([head, more["hash"].to_numpy().view(np.uint64)])
    values = np.concatenate([head_counts, more["c"].to_numpy()])
    hashes, first = np.unique(hashes, return_index=True)
    return Lexicon(sum(r["c"] for r in bands), sum(r["n"] for r in bands), head, head_counts, hashes, values[first])


def unigram(lex: Lexicon) -> Model:
    """The model before training: classes and words at their unigram shares."""
    slots = np.zeros(CLASSES * WIDTH)
    slots[: len(lex.head)] = lex.head_counts
    slots = slots.reshape(CLASSES, WIDTH)
    other = lex.tokens - lex.head_counts.sum() + 0.5
    classes = np.append(slots.sum(axis=1), other)
    low = np.float32(-1e9)
    with np.errstate(divide="ignore"):
        class_bias = np.where(classes > 0, np.log(classes / classes.sum()), low)
        word_bias = np.where(slots > 0, np.log(slots / np.maximum(slots.sum(axis=1, keepdims=True), 1)), low)
    return Model(class_bias.astype(np.float32), word_bias.astype(np.float32))


def contexts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Feature hashes (FEATURES, tokens); a text's start is seen as end tokens before it."""
    place = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    before = []
    for back in (1, 2, 3):
        shifted = np.full(len(hashes), END)
        shifted[back:] = hashes[: len(hashes) - back]
        shifted[place < back] = END
        before.append(shifted)
    one, two, three = before
    f = _FEATURE
    found = [one * f[0, 0], one * f[1, 0] + two * f[1, 1], two * f[2, 0], three * f[3, 0]]
    return np.stack([_finish(x) for x in found])


def _class_index(features: np.ndarray) -> np.ndarray:
    return (features & np.uint64(CLASS_ROWS - 1)).astype(np.int64)


def _word_index(features: np.ndarray, classes: np.ndarray) -> np.ndarray:
    mixed = (features ^ (classes.astype(np.uint64) * _MIX)) * _TURN
    return (mixed >> np.uint64(64 - WORD_ROWS.bit_length() + 1)).astype(np.int64)


def _exponentials(bias: np.ndarray, rows: np.ndarray, index: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """exp of the summed weights, up to a factor a token, and their sums; no sum of weights exceeds ``most``."""
    x = rows.take(index[0], axis=0)
    x += bias
    more = np.empty_like(x)
    for i in index[1:]:
        x += rows.take(i, axis=0, out=more, mode="clip")
    if most > SAFE:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def _most(bias: np.ndarray, rows: np.ndarray) -> float:
    """Bound of a summed weight in either direction, apart from words that are not there."""
    shown = bias[bias > LOW]
    return float(np.abs(shown).max(initial=0.0) + FEATURES * max(rows.max(), -rows.min()))


def _softmax(bias: np.ndarray, rows: np.ndarray, index: np.ndarray, most: float) -> np.ndarray:
    x, total = _exponentials(bias, rows, index, most)
    x *= (1 / total)[:, None]
    return x


def token_logs(model: Model, features: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """log p(class) + log p(word | class) per token; of the other class, the first term alone."""
    out = np.empty(len(rank))
    most = [_most(model.class_bias, model.class_rows), _most(model.word_bias, model.word_rows)]
    for at in range(0, len(rank), SCORED):
        f, r = features[:, at : at + SCORED], rank[at : at + SCORED]
        classes = np.where(r < 0, CLASSES, r // WIDTH)
        x, total = _exponentials(model.class_bias, model.class_rows, _class_index(f), most[0])
        p = x[np.arange(len(r)), classes] / total
        known = np.flatnonzero(r >= 0)
        if len(known):
            c = classes[known]
            x, total = _exponentials(model.word_bias.take(c, axis=0), model.word_rows, _word_index(f[:, known], c), most[1])
            p[known] *= x[np.arange(len(known)), r[known] % WIDTH] / total
        out[at : at + SCORED] = np.log(np.maximum(p, 1e-37))
    return out


def _run_sums(values: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of ordered rows, longest run first. All advance one row a round, the few long ones are summed apart."""
    total = values.take(order[starts], axis=0)
    live = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1))  # runs with more than 1, 2, ... rows
    done, more = 1, np.empty_like(total)
    while live[done - 1] > 64:
        n = live[done - 1]
        total[:n] += values.take(order[starts[:n] + done], axis=0, out=more[:n], mode="clip")
        done += 1
    for i in range(live[done - 1]):
        total[i] += values[order[starts[i] + done : starts[i] + sizes[i]]].sum(axis=0)
    return total


def _update(rows: np.ndarray, squares: np.ndarray, seen: np.ndarray, index: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """One adaptive step on the rows that a block's features pick."""
    flat = index.reshape(-1).astype(np.uint16)  # both tables have at most 65536 rows; sixteen bits sort by radix
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sizes = np.diff(np.append(starts, len(flat)))
    longest = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[longest], sizes[longest]
    which = ordered[starts].astype(np.int64)
    token = np.tile(np.arange(gradient.shape[0]), len(index)).take(order)
    total = _run_sums(gradient, token, starts, sizes)
    squares[which] += np.einsum("ij,ij->i", total, total)
    seen[which] += sizes
    total *= (rate / np.sqrt(squares[which]))[:, None].astype(np.float32)
    rows[which] -= total


def train_block(model: Model, state: list[np.ndarray], features: np.ndarray, rank: np.ndarray, rate: float) -> None:
    """Gradient steps over the tokens of one block, both factors; biases stay."""
    for at in range(0, len(rank), STEP):
        f, r = features[:, at : at + STEP], rank[at : at + STEP]
        classes = np.where(r < 0, CLASSES, r // WIDTH)
        index = _class_index(f)
        p = _softmax(model.class_bias, model.class_rows, index, _most(model.class_bias, model.class_rows))
        p[np.arange(len(r)), classes] -= 1
        _update(model.class_rows, state[0], state[1], index, p, rate)
        known = np.flatnonzero(r >= 0)
        if len(known):
            c = classes[known]
            index = _word_index(f[:, known], c)
            q = _softmax(model.word_bias[c], model.word_rows, index, _most(model.word_bias, model.word_rows))
            q[np.arange(len(known)), r[known] % WIDTH] -= 1
            _update(model.word_rows, state[2], state[3], index, q, rate)


def _blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Documents in groups of about ``size`` tokens, each with its tokens' hashes."""
    for batch in chunks(batches, 512):
        at, held, total = 0, [], 0
        for i, text in enumerate(batch.column(column)):
            held.append(token_hashes(text.as_py()))
            total += len(held[-1])
            if total >= size:
                yield batch.slice(at, i + 1 - at), held
                at, held, total = i + 1, [], 0
        if held:
            yield batch.slice(at), held


def _round(docs: DataFrame, model: Model, lex: Lexicon, rate: float, parts: int = 16) -> Model:
    """One round: every partition's gradient steps, and the average change of each weight row."""
    sizes = (CLASS_ROWS, WORD_ROWS)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model.class_bias, model.word_bias, model.class_rows.copy(), model.word_rows.copy())
        state = [np.full(sizes[0], 1.0), np.zeros(sizes[0]), np.full(sizes[1], 1.0), np.zeros(sizes[1])]
        used = False
        for _, held in _blocks(batches, "text"):
            hashes = np.concatenate(held)
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            train_block(own, state, contexts(hashes, np.cumsum(lengths) - lengths), lex.look_up(hashes)[0], rate)
            used = True
        if not used:
            return
        change = np.concatenate([own.class_rows - model.class_rows, own.word_rows - model.word_rows]).astype(np.float16)
        seen = np.concatenate([state[1], state[3]]).astype(np.float32)
        for part, rows in enumerate(np.array_split(np.arange(len(seen)), parts)):
            cells = [[part], [change[rows].tobytes()], [seen[rows].tobytes()]]
            kinds = [pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["part", "change", "seen"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, change, seen in zip(*batch.columns, strict=True):
                weight = np.frombuffer(seen.as_buffer(), np.float32)
                delta = np.frombuffer(change.as_buffer(), np.float16).reshape(len(weight), WIDTH).astype(np.float32)
                total = sums.setdefault(part.as_py(), [np.zeros_like(delta), np.zeros_like(weight)])
                total[0] += delta * weight[:, None]
                total[1] += weight
        for part, (delta, weight) in sums.items():
            mean = (delta / np.maximum(weight, 1)[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["part", "change"])

    sent = docs.select("text").mapInArrow(learn, "part int, change binary, seen binary")
    rows = sent.repartition(parts, "part").mapInArrow(average, "part int, change binary").collect()
    if not rows:
        return model
    change = np.concatenate([np.frombuffer(r["change"], np.float32) for r in sorted(rows, key=lambda r: r["part"])]).reshape(-1, WIDTH)
    return Model(model.class_bias, model.word_bias, model.class_rows + change[: sizes[0]], model.word_rows + change[sizes[0] :])


def fit(docs: DataFrame, counts: DataFrame, rounds: int = 2, rate: float = 0.25, doc_id: str = "doc_id") -> tuple[Lexicon, Model]:
    """Learns from all of ``docs``; each round takes its share of them by a hash of the id."""
    lex = lexicon(counts)
    model = unigram(lex)
    for i in range(rounds if lex.tokens else 0):
        model = _round(docs.where(F.pmod(order_hash(doc_id), F.lit(rounds)) == i), model, lex, rate)
    return lex, model


def score(docs: DataFrame, counts: DataFrame, lex: Lexicon, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with n_tokens, n_known, train_tokens, base_score and score (log10) of every text."""
    fields = [docs.schema[c] for c in keep]
    own = ["row", "n_tokens", "n_known", "n_other", "base_sum", "other_sum", "model_sum", "open_hash", "open_count"]
    kinds = "row long, n_tokens long, n_known long, n_other long, base_sum double, other_sum double, model_sum double, open_hash array<long>, open_count array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch, held in _blocks(batches, "text"):
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            starts = np.cumsum(lengths) - lengths
            hashes = np.concatenate(held)
            rank, count = lex.look_up(hashes)
            logs = token_logs(model, contexts(hashes, starts), rank)
            total = lambda x: np.add.reduceat(x, starts)
            listed = np.where(count >= 0, np.log10(np.maximum(count, 0) + 0.5), 0.0)
            unlisted = np.flatnonzero(count < 0)
            doc = np.searchsorted(starts, unlisted, side="right") - 1
            order = np.lexsort((hashes[unlisted], doc))
            doc, open_hash = doc[order], hashes[unlisted][order]
            first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (open_hash[1:] != open_hash[:-1])))[: len(doc)])
            open_count = np.diff(np.append(first, len(doc)))
            open_hash = open_hash[first].view(np.int64)
            offsets = np.searchsorted(doc[first], np.arange(len(held) + 1))
            place = pa.array(offsets, pa.int32())
            values = [
                pa.array(np.arange(row, row + len(held))), pa.array(lengths), pa.array(total((count > 0).astype(np.int64))),
                pa.array(total((rank < 0).astype(np.int64))), pa.array(total(listed)), pa.array(total(np.where(rank < 0, listed, 0.0))),
                pa.array(total(logs) / _LOG10),
                *[pa.ListArray.from_arrays(place, pa.array(x)) for x in (open_hash, open_count)],
            ]
            row += len(held)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *values], [*keep, *own])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + kinds
    scored = staged(docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema), "maxent_scores")
    opened = scored.select("row", F.explode(F.arrays_zip("open_hash", "open_count")).alias("o"))
    opened = opened.select("row", F.col("o.open_hash").alias("hash"), F.col("o.open_count").alias("times"))
    met = opened.join(counts, "hash", "left")
    known = F.col("c").isNotNull()
    late = met.groupBy("row").agg(
        F.sum(F.when(known, F.col("times")).otherwise(0)).alias("late_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("late_sum"),
    )
    whole = scored.drop("open_hash", "open_count").join(late, "row", "left").na.fill(0, ["late_known"]).na.fill(0.0, ["late_sum"])
    n, v = lex.tokens, lex.words
    others, kinds_ = n - int(lex.head_counts.sum()), v - len(lex.head)
    base = F.col("base_sum") + F.col("late_sum") - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))
    other = F.col("other_sum") + F.col("late_sum") - F.col("n_other") * float(np.log10(others + 0.5 * (kinds_ + 1)))
    return whole.select(
        *keep,
        "n_tokens",
        (F.col("n_known") + F.col("late_known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("model_sum") + other).alias("score"),
    )


def op8_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", fold(5) == 1)
    learn = docs.where(~F.col("held_out"))
    counts = staged(count_words(learn), "maxent_counts")
    lex, model = fit(learn, counts)
    return score(docs, counts, lex, model, ["doc_id", "held_out"])
