"""Hierarchical residual packing of token pieces into sequences.

Texts become pieces of at most ``capacity`` tokens. Full pieces are sequences of
their own. The others are dealt evenly to tasks of a bounded number of pieces;
each task packs its own by best fit, longest first, and closes bins that are
nearly full. Bins with more room move up as items: groups of tasks merge theirs
by best fit again, until one group is left. A task passes up its emptiest bins
only (``carry``), which bounds every merge; the others are closed as they are,
with all their pieces.

Defined results: a null or empty text is the end id alone; repeated rows are
packed one by one; a null id stays null; equal lengths go in the order of id and
piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesora.llm.base import chunks, documents, small_batches, staged
from tesora.llm.tokens import encoder

CAPACITY = 2048
END = 0
#: Pieces packed by one task, bins it passes up, tasks merged at once, tokens a closed bin may lack.
ITEMS, CARRY, FAN, SLACK = 50_000, 2048, 8, 8


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of whole texts, each with an end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, False).encode
        for batch in chunks(batches, 512):
            keys = batch.column(0).to_pylist()
            out: list[tuple] = []
            for key, text in zip(keys, batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), END).astype("<u4")
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((key, piece, at, len(part), zlib.crc32(part.tobytes())))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item (longest first, ties in the given order), and the fill of each bin."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is free
    mask = 0  # bit r is set if a bin with r free tokens is open
    bins, offsets, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
        else:
            b, free = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if free > size:
            room[free - size].append(b)
            mask |= 1 << (free - size)
    return bins, offsets, np.array(fill, np.int64)


def _up(fill: np.ndarray, capacity: int, slack: int, carry: int) -> np.ndarray:
    """Which bins are passed up: those with more room than ``slack``, at most the ``carry`` emptiest."""
    open_ = fill < capacity - slack
    chosen = np.argsort(fill, kind="stable")[:carry]
    up = np.zeros(len(fill), bool)
    up[chosen] = True
    return up & open_


def pack(pieces: DataFrame, capacity: int = CAPACITY, items: int = ITEMS, carry: int = CARRY, fan: int = FAN, slack: int = SLACK) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``doc_id``, ``piece`` and ``length``.

    ``pieces`` must be a written table: it is read for its count and once more.
    """
    names = pieces.columns
    tasks = max(1, -(-pieces.where(F.col("length") < capacity).count() // items))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        held = pa.Table.from_batches(own).sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        length = held.column("length").to_numpy()
        bins, offsets, fill = best_fit(length, capacity)
        task = TaskContext.get().partitionId()
        ids = (np.int64(task) << np.int64(32)) + bins
        extra = [ids, offsets, fill[bins], _up(fill, capacity, slack, carry)[bins], np.full(len(bins), task)]
        for name, values in zip(("bin", "offset", "fill", "up", "task"), extra, strict=True):
            held = held.append_column(name, pa.array(values))
        yield from held.combine_chunks().to_batches(max_chunksize=65536)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    residual = pieces.where(F.col("length") < capacity).repartition(tasks)
    packed = staged(residual.mapInArrow(local, f"{kinds}, bin long, offset long, fill long, up boolean, task long"), "packed")
    bins = packed.where("up").groupBy("bin").agg(F.first("fill").alias("fill"), F.first("task").alias("task"))
    homes, level = None, 1
    while tasks > 1:
        tasks = -(-tasks // fan)
        merged = staged(_merge(bins, capacity, fan, carry, slack, level), "merged")
        step = merged.select(F.col("bin").alias("child"), F.col("parent"), F.col("at"))
        if homes is None:
            homes = step
        else:
            nested = homes.withColumnRenamed("parent", "inner").withColumnRenamed("at", "deep")
            higher = step.select(F.col("child").alias("inner"), "parent", "at")
            homes = nested.join(higher, "inner", "left").select(
                "child", F.coalesce("parent", "inner").alias("parent"), (F.col("deep") + F.coalesce("at", F.lit(0))).alias("at")
            )
        bins = merged.where("up").groupBy("parent").agg(F.first("fill").alias("fill"), F.first("task").alias("task"))
        bins = bins.withColumnRenamed("parent", "bin")
        level += 1
    kept = [F.col(f"`{n}`") for n in names]
    if homes is None:
        placed = packed.select(*kept, F.col("bin").alias("sequence_id"), "offset")
    else:
        placed = packed.join(homes, F.col("bin") == F.col("child"), "left").select(
            *kept, F.coalesce("parent", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset")
        )
    whole = pieces.where(F.col("length") >= capacity)
    alone = (-F.monotonically_increasing_id() - 1).alias("sequence_id")
    return placed.unionByName(whole.select(*kept, alone, F.lit(0).cast("long").alias("offset")))


def _merge(bins: DataFrame, capacity: int, fan: int, carry: int, slack: int, level: int) -> DataFrame:
    """Underfull bins as items: (bin, parent, at, fill, up, task), best fit within groups of tasks."""

    def run(key, group):
        group = group.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        parent, at, fill = best_fit(group["fill"].to_numpy(), capacity)
        task = int(key[0])
        group["parent"] = (np.int64(level) << np.int64(56)) + (np.int64(task) << np.int64(32)) + parent
        group["at"], group["up"] = at, _up(fill, capacity, slack, carry)[parent]
        group["fill"], group["task"] = fill[parent], task
        return group[["bin", "parent", "at", "fill", "up", "task"]]

    grouped = bins.withColumn("task", F.floor(F.col("task") / fan)).groupBy("task")
    return grouped.applyInPandas(run, "bin long, parent long, at long, fill long, up boolean, task long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(staged(token_pieces(docs, path, capacity), "pieces"), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
