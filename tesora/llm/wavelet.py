"""Token ids in wavelet matrices, one compressed file per shard.

A shard is a run of whole documents in ascending id order. Its file holds one
bit-plane per bit of an id, most significant first; each plane orders the tokens
by the bits before (zeros first, stable), so that access, counting and lookup of
occurrences take one rank or select per plane. Ranks come from a directory of
one-counts per 2048 bits. Planes, directory and the list of documents are
compressed one by one. The shards are rows of a Parquet table with one row per
file, written by Spark, so that they can lie in any store Spark reaches, and a
repeated task replaces its own files only.

Defined results: a null or empty text is the end id alone; null ids come first,
repeated ids are kept in the order of their text's hash; an empty table gives no
shard; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesora.llm.base import chunks, documents, order_hash
from tesora.llm.tokens import encoder
from tesora.session import shared_folder

END = 0
#: Tokens after which a shard is closed; a longer document makes a longer shard.
SHARD_TOKENS = 1 << 21
_MAGIC = b"WVMX1\x00\x00\x00"
_HEAD = struct.Struct("<8sIIQQ")  # magic, bits, sections, tokens, documents
_BLOCK = 2048


class WaveletMatrix:
    """A static sequence of ids with access, rank (count) and select (occurrence)."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.planes, self.ranks = n, planes, ranks  # planes: packed bits, ranks: ones before each block
        self.zeros = [n - self._rank1(i, n) for i in range(len(planes))]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        rest, other = ids.astype(kind), np.empty(len(ids), kind)
        n, planes, ranks = len(rest), [], []
        padded = -(-max(n, 1) // _BLOCK) * _BLOCK // 8
        for level in range(bits - 1, -1, -1):
            bit = (rest & kind(1 << level)).astype(bool)
            plane = np.zeros(padded, np.uint8)
            packed = np.packbits(bit, bitorder="little")
            plane[: len(packed)] = packed
            ones = np.bitwise_count(plane.view(np.uint64)).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.int64)
            planes.append(plane)
            ranks.append(np.concatenate(([0], np.cumsum(ones))))
            zeros = n - int(ranks[-1][-1])
            np.compress(~bit, rest, out=other[:zeros])
            np.compress(bit, rest, out=other[zeros:])
            rest, other = other, rest
        return cls(n, planes, ranks)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i."""
        block = i // _BLOCK
        inside = self.planes[level][block * _BLOCK // 8 : (i + 7) // 8]
        count = int(self.ranks[level][block])
        if len(inside):
            count += int(np.bitwise_count(inside[: (i >> 3) - block * _BLOCK // 8]).sum())
            if i & 7:
                count += int(np.bitwise_count(inside[-1] & np.uint8((1 << (i & 7)) - 1)))
        return count

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that value."""
        ranks = self.ranks[level]
        before = ranks if bit else np.arange(len(ranks)) * _BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.planes[level][block * _BLOCK // 8 : (block + 1) * _BLOCK // 8], bitorder="little")
        return block * _BLOCK + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if token >> (len(self.planes) - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in [start, end)."""
        if token >> len(self.planes):
            return 0
        low, high = self._range(token, start, self.n if end is None else end)
        return high - low

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        low, high = self._range(token, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(f"token {token} occurs {high - low} times")
        i = low + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """The whole sequence, from the last plane up."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        rest = np.zeros(self.n, kind)
        for level in range(bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            mixed = np.empty(self.n, kind)
            zeros = self.zeros[level]
            mixed[np.flatnonzero(~bit)] = rest[:zeros]
            mixed[np.flatnonzero(bit)] = rest[zeros:] | kind(1 << (bits - 1 - level))
            rest = mixed
        return rest


def shard_bytes(matrix: WaveletMatrix, doc_ids: Sequence[int | None], sizes: np.ndarray) -> bytes:
    """The file of one shard: header, section lengths, then compressed sections."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    sections = [known.tobytes(), np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes(), np.asarray(sizes, "<u4").tobytes()]
    for plane, rank in zip(matrix.planes, matrix.ranks, strict=True):
        sections += [plane.tobytes(), rank.astype("<u4").tobytes()]
    press = zstandard.ZstdCompressor(level=1)
    packed = [press.compress(s) for s in sections]
    head = _HEAD.pack(_MAGIC, len(matrix.planes), len(packed), matrix.n, len(ids))
    return head + np.array([len(p) for p in packed], "<u8").tobytes() + b"".join(packed)


def open_shard(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    magic, bits, sections, n, docs = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a wavelet matrix file")
    lengths = np.frombuffer(data, "<u8", sections, _HEAD.size).astype(np.int64)
    ends = _HEAD.size + 8 * sections + np.cumsum(lengths)
    press = zstandard.ZstdDecompressor()
    read = lambda i, kind: np.frombuffer(press.decompress(data[int(ends[i] - lengths[i]) : int(ends[i])]), kind)
    known, ids, sizes = read(0, np.uint8), np.cumsum(read(1, "<i8")), read(2, "<u4").astype(np.int64)
    planes = [read(3 + 2 * i, np.uint8) for i in range(bits)]
    ranks = [read(4 + 2 * i, "<u4").astype(np.int64) for i in range(bits)]
    return WaveletMatrix(n, planes, ranks), [int(d) if k else None for d, k in zip(ids, known, strict=True)], sizes


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, bits: int = 16, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS
) -> None:
    """Writes the shards of all documents, in ascending id order, below ``path``.

    A shard's place is (part, seq): the range partition it comes from and its
    number there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, True).encode, TaskContext.get().partitionId()
        ids: list = []
        parts: list[np.ndarray] = []
        held, seq = 0, 0

        def close() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(parts), bits)
            data = shard_bytes(matrix, ids, np.array([len(p) for p in parts]))
            row = {"part": [part], "seq": [seq], "n_docs": [len(ids)], "n_tokens": [matrix.n]}
            return pa.RecordBatch.from_arrays([*[pa.array(v, pa.int64()) for v in row.values()], pa.array([data], pa.binary())], [*row, "shard"])

        for batch in chunks(batches, 512):
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.append(encode(value.as_py()), END)
                parts.append(found.astype(np.uint16 if bits <= 16 else np.uint32))
                ids.append(key)
                held += len(found)
                if held >= shard_tokens:
                    yield close()
                    ids, parts, held, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = slim.repartitionByRange("doc_id", order_hash("text")).sortWithinPartitions("doc_id", order_hash("text"))
    shards = placed.mapInArrow(run, "part long, seq long, n_docs long, n_tokens long, shard binary")
    shards.write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, shard_start): ids before each shard. One row per partition meets in one window."""
    sizes = spark.read.parquet(path).select("part", "seq", "n_tokens")
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part")) - F.col("total")
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    offsets = totals.select("part", before.alias("before"))
    return sizes.withColumn("own", own).join(offsets, "part").select("part", "seq", (F.col("before") + F.col("own")).alias("shard_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, seq) of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*[batch.column(i) for i in range(3)], strict=True):
                matrix, ids, sizes = open_shard(data.as_py())
                tokens = matrix.decode()
                starts = np.cumsum(sizes) - sizes
                crc = [zlib.crc32(tokens[a : a + n].astype("<u4").tobytes()) for a, n in zip(starts, sizes, strict=True)]
                places = [np.full(len(ids), x.as_py(), np.int64) for x in (part, seq)]
                columns = [pa.array(ids, pa.int64()), *map(pa.array, (starts, sizes)), pa.array(crc, pa.int64()), *map(pa.array, places)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "inner", "n_tokens", "ids_crc32", "part", "seq"])

    shards = spark.read.parquet(path).select("part", "seq", "shard")
    found = shards.mapInArrow(run, "doc_id long, inner long, n_tokens long, ids_crc32 long, part long, seq long")
    placed = found.join(shard_starts(spark, path), ["part", "seq"])
    return placed.select("doc_id", (F.col("shard_start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def find_tokens(spark: SparkSession, path: str, tokens: Sequence[int], positions: bool = True) -> DataFrame:
    """(token, doc_id, place): every occurrence by select, or (token, part, seq, count) by rank alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*[batch.column(i) for i in range(3)], strict=True):
                matrix, ids, sizes = open_shard(data.as_py())
                if not positions:
                    rows = [(t, part.as_py(), seq.as_py(), matrix.count(t)) for t in tokens]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["token", "part", "seq", "count"])
                    continue
                ends = np.cumsum(sizes)
                for token in tokens:
                    at = np.array(matrix.occurrences(token), np.int64)
                    doc = np.searchsorted(ends, at, side="right")
                    place = at - (ends - sizes)[doc]
                    columns = [pa.array(np.full(len(at), token)), pa.array([ids[d] for d in doc], pa.int64()), pa.array(place)]
                    yield pa.RecordBatch.from_arrays(columns, ["token", "doc_id", "place"])

    kind = "token long, doc_id long, place long" if positions else "token long, part long, seq long, count long"
    return spark.read.parquet(path).select("part", "seq", "shard").mapInArrow(run, kind)


def op1_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "wavelet")
    write_shards(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
