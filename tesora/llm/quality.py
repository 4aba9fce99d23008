"""Quality rules: counting rules plus a log-likelihood ratio of hashed n-grams.

Words, word shapes and pairs of either in every text are hashed into buckets.
Two multinomials over the buckets are estimated with additive smoothing: one
from trusted target documents, one from the whole corpus. A document's score is the mean log ratio
of its n-grams, so length does not matter. It is kept if no counting rule fails
and its score reaches a threshold. That is fixed once, from labelled documents
outside the target counts: nearly all trusted ones reach it, and if most of the
untrusted ones score lower, it lies a quarter of the way down to them.

Every labelled document is used, a quarter of the trusted ones for the
threshold; corpus counts cover every document. The texts of labelled documents
are picked by a filter of their ids in a bounded bitmap and moved to meet their
labels. Without any trusted document the score is zero and the counting rules
decide alone.

Defined results: null, empty and blank texts have no words and fail the base
rules; repeated rows count as often as they occur and get equal results; a null
id is never labelled; other columns are carried along untouched by ``judge``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType

from tesora.llm.base import ASCII_LOWER, add_columns, chunks, documents, order_hash, staged, texts

BUCKETS = 1 << 13
WINDOW = 8
#: Bits of the filter of labelled ids, 8 MB whatever their number, and of one of its rows.
FILTER_BITS, _ROW_BITS = 1 << 26, 1 << 15
_PAIR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Each byte as a capital, another letter (all of UTF-8's longer forms), a digit or itself.
_CLASS = bytes(65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b > 127 else 48 if 48 <= b < 58 else b for b in range(256))
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Model:
    """Log ratio per bucket, and the least score of a kept document."""

    ratio: np.ndarray
    threshold: float


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def word_shapes(data: bytes) -> list[bytes]:
    """Words with runs of capitals, other letters and digits as one character each; signs stay."""
    data = data.translate(_CLASS)
    for run, one in ((b"aa", b"a"), (b"AA", b"A"), (b"00", b"0")):
        while run in data:
            data = data.replace(run * 4, one).replace(run, one)
    return data.split()


def _grams(hashes: np.ndarray, buckets: int) -> np.ndarray:
    shift = np.uint64(64 - buckets.bit_length() + 1)
    pairs = (hashes[:-1] * _PAIR + hashes[1:]) * _MIX
    return (np.concatenate([hashes * _MIX, pairs]) >> shift).astype(np.int64)


def gram_buckets(data: bytes, buckets: int) -> np.ndarray:
    """Buckets of all lower-cased words, of all word shapes, and of all pairs of neighbours of either.

    Words have the first ``buckets``, shapes the second. A word that repeats the
    one before has a shape of its own.
    """
    words = word_hashes(data.translate(ASCII_LOWER).split())
    shapes = word_hashes(word_shapes(data))
    if not len(words):
        return np.empty(0, np.int64)
    shapes[1:][words[1:] == words[:-1]] ^= _PAIR
    return np.concatenate([_grams(words, buckets), _grams(shapes, buckets) + buckets])


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words covered by windows that occur twice or more, first ones included."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    for i in range(window):
        key = key * _MULTIPLIER + (hashes[i : i + n] ^ (hashes[i : i + n] >> np.uint64(29)))
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    starts = np.zeros(n, bool)
    starts[order[:-1][same]] = True
    starts[order[1:][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int32)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + window] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def repeated_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def base_measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "replace")
    words = data.split()
    blanks = len(data) - sum(map(len, words))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    return len(words), len(text) - blanks, symbols, repeated_lines(data), repeated_words(word_hashes(words))


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def agreed_rows(labels: DataFrame) -> DataFrame:
    """(__target, quality): all ids whose labels are all the same."""
    ids = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("__target"))
    return ids.agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")


def trusted_rows(labels: DataFrame, rows: int, value: int = 1) -> DataFrame:
    """At most ``rows`` ids all of whose labels are ``value``, by the order of a hash."""
    picked = agreed_rows(labels).where(F.col("quality") == value)
    return picked.orderBy(order_hash("__target"), "__target").limit(rows).select("__target")


def having(docs: DataFrame, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``docs`` whose ``__id`` is a ``__target`` of ``ids``, with the columns of ``ids``.

    A bitmap of hashed ids, broadcast, lets all of them and a few others pass; only
    these rows move, and the join decides. It is a merge at every size: ids in a
    file take a fraction of what they take on the driver.
    """
    if docs.schema["__id"].dataType == ids.schema["__target"].dataType:  # else equal ids may have different hashes
        place = [F.pmod(F.xxhash64(c), F.lit(bits)) for c in ("__id", "__target")]
        row, bit = (lambda p: F.floor(p / _ROW_BITS)), (lambda p: p % _ROW_BITS)
        bitmap = ids.groupBy(row(place[1]).alias("__row")).agg(F.bitmap_construct_agg(bit(place[1])).alias("__bitmap"))
        byte = F.conv(F.hex(F.substring("__bitmap", (F.floor(bit(place[0]) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        passed = docs.join(F.broadcast(bitmap), row(place[0]) == F.col("__row")).where(F.getbit(byte, bit(place[0]) % 8) == 1)
        docs = passed.select(*docs.columns)
    return docs.join(ids.hint("merge"), F.col("__id") == F.col("__target"))


def gram_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of the n-grams of all texts; only one count a bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * buckets, np.int64)
        for batch in chunks(batches, 256):
            found = [gram_buckets((text or "").encode("utf-8", "replace"), buckets) for text in texts(batch)]
            total += np.bincount(np.concatenate(found), minlength=2 * buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    parts = docs.select("text").mapInArrow(run, "bucket long, n long")
    counts = np.zeros(2 * buckets)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def log_ratio(raw: np.ndarray, target: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of the two multinomials, of words and of shapes."""
    if not target.sum():
        return np.zeros(len(raw))
    both = np.stack([raw, target]).reshape(2, 2, -1) + smoothing
    raw, target = np.log(both / both.sum(axis=2, keepdims=True))
    return (target - raw).reshape(-1)


def mean_ratio(text: str | None, ratio: np.ndarray) -> float:
    grams = gram_buckets((text or "").encode("utf-8", "replace"), len(ratio) // 2)
    return float(ratio[grams].mean()) if len(grams) else 0.0


def ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as longs in the same order, and such longs as doubles in their bits."""
    bits = values.view(np.int64)
    return bits ^ ((bits >> 63) & np.iinfo(np.int64).max)


def ranked(keys: DataFrame, ranks: Iterable[int]) -> dict[int, int]:
    """The ``key`` of each rank, from 0; 16 bits a pass, so at most 65,536 counts a rank reach the driver at once."""
    at = {rank: (0, rank) for rank in ranks}
    for shift in (48, 32, 16, 0):
        if shift < 48:
            within = keys.where(F.shiftright("key", shift + 16).isin([prefix for prefix, _ in at.values()]))
        else:
            within = keys
        counts = within.groupBy(F.shiftright("key", shift).alias("k")).agg(F.count("*").alias("n")).collect()
        for rank, (prefix, left) in at.items():
            for k, n in sorted((r["k"], r["n"]) for r in counts if shift == 48 or r["k"] >> 16 == prefix):
                if left < n:
                    at[rank] = (k, left)
                    break
                left -= n
    return {rank: key for rank, (key, _) in at.items()}


def percentile(keys: DataFrame, share: float) -> float | None:
    """The exact percentile, as Spark interpolates it, of the doubles whose ``ordered`` forms are ``key``."""
    n = keys.count()
    if not n:
        return None
    place = share * (n - 1)
    low, high = math.floor(place), math.ceil(place)
    found = ranked(keys, {low, high})
    a, b = ordered(np.array([found[low], found[high]])).view(np.float64).tolist()
    return a if a == b else (high - place) * a + (place - low) * b


def fit(docs: DataFrame, labels: DataFrame, keep_share: float = 0.999, buckets: int = BUCKETS, doc_id: str = "doc_id") -> Model:
    """Both multinomials (two counts per bucket reach the driver) and the threshold, from all labelled documents.

    No step's memory grows with the number of labels: only a bitmap of the ids
    is broadcast, and percentiles are counted.
    """
    body = docs.select(F.col(doc_id).alias("__id"), "text")
    known = agreed_rows(labels).where("quality in (0, 1)").select("__target", (F.col("quality") == 1).alias("good"))
    known = staged(known.withColumn("tune", F.col("good") & (F.pmod(order_hash("__target"), F.lit(4)) == 0)), "labelled")
    target = having(body, known.where("good and not tune").select("__target"))
    ratio = log_ratio(gram_counts(body, buckets), gram_counts(target, buckets))

    def score(batch: pa.RecordBatch):
        found, passed = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
        for i, text in enumerate(texts(batch)):
            base = base_measures(text)
            if not base_fails(base[0], base[4]):
                found[i], passed[i] = mean_ratio(text, ratio), True
        return [ordered(found + 0.0), passed]

    tuning = having(body, known.where("tune or not good").select("__target", "good"))
    scored = add_columns(tuning, [("key", LongType()), ("passed", BooleanType())], score, keep=["good"])
    scores = staged(scored.where("passed").select("good", "key"), "scores")
    least = percentile(scores.where("good"), 1 - keep_share)
    most = percentile(scores.where("not good"), 0.95)
    if least is None:
        return Model(ratio.astype(np.float32), -np.inf)
    gap = most is not None and most < least
    return Model(ratio.astype(np.float32), float((3 * least + most) / 4 if gap else least))


def judge(docs: DataFrame, model: Model, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Adds the measures, the score and both verdicts to every document."""

    def compute(batch: pa.RecordBatch):
        rows = []
        for text in texts(batch):
            base = base_measures(text)
            failed, score = base_fails(base[0], base[4]), mean_ratio(text, model.ratio)
            rows.append((*base, failed, score, not failed and score >= model.threshold))
        return zip(*rows, strict=True)

    long, flag = LongType(), BooleanType()
    new = [("n_words", long), ("word_chars", long), ("n_symbols", long), ("n_dup_lines", long), ("n_repeat_words", long)]
    new += [("base_failed", flag), ("llr", DoubleType()), ("kept", flag)]
    return add_columns(docs, [(prefix + n, t) for n, t in new], lambda b: map(list, compute(b)), keep)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return judge(docs, fit(docs, labels_of(spark, sf_dir)), keep=["doc_id"])
