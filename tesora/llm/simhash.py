"""Near-duplicates by SimHash fingerprints, found in a grid of per-segment bit counts.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to its 32
bit counts. One differing bit changes one count by at most one, so the Manhattan
distance of two count vectors never exceeds the Hamming distance. The vector is
halved: if two vectors are within distance 3, one of their halves is within 1.
Each half spans a grid with cells of side one. A fingerprint stands in its own
cell and in the cells one step up, so any two that are within 1 in a half meet
in a cell; the exact Hamming distance decides there.

Defined results: null, empty and blank texts have fingerprint zero and link like
any other; a null id never becomes a component id unless all ids of the
component are null; repeated rows get equal results; columns other than the id
and the text are neither read nor required.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tesora.llm.base import add_columns, documents, staged, texts, words_of

SEED = 42
SHINGLE = 3
#: Fingerprints compared with one another in one task; larger cells are cut into pairs of tiles.
TILE = 4096
_LOW = np.uint64(0x5555555555555555)


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a whole text: bits set in over half of the shingle hashes."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), ">u8", n))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of some hashes; none for no hashes."""
    data, counts = hashes.astype(">u8", copy=False), np.zeros(64, np.int64)
    for at in range(0, len(data), 65536):  # bits of a long text are unpacked in blocks
        counts += np.unpackbits(data[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(data)).tobytes(), "big")


def add_fingerprint(docs: DataFrame, out: str = "fp", text: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint as a signed long."""

    def compute(batch: pa.RecordBatch):
        found = np.fromiter((simhash(t, shingle) for t in texts(batch, text)), np.uint64, batch.num_rows)
        return [found.view(np.int64)]

    return add_columns(docs, [(out, LongType())], compute, keep)


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, packed into two bits each."""
    x = fp.view(np.uint64)
    return (x & _LOW) + ((x >> np.uint64(1)) & _LOW)


def grid_cells(fps: DataFrame) -> DataFrame:
    """(cell, fp, own): each distinct fingerprint in its own cell and those one step up, in both halves."""
    names = ["cell", "fp", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            packed = segment_counts(fp)
            for half in (0, 1):
                part = ((packed >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                base = part + (half << 32)
                yield pa.RecordBatch.from_arrays([pa.array(base), pa.array(fp), pa.array(np.ones(len(fp), bool))], names)
                for segment in range(16):
                    up = (part >> (2 * segment)) & 3 < 2  # a segment counts two bits at most
                    step = [base[up] + (1 << 2 * segment), fp[up], np.zeros(int(up.sum()), bool)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in step], names)

    return fps.mapInArrow(run, "cell long, fp long, own boolean")


def _spanning(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the link graph among a few thousand fingerprints."""
    x, edges = fps.view(np.uint64), []
    rest = np.argsort(fps, kind="stable")
    while rest.size:
        root, frontier, rest = rest[0], [rest[0]], rest[1:]
        while frontier and rest.size:
            at = frontier.pop()
            near = np.bitwise_count(x[rest] ^ x[at]) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                edges += [(int(fps[root]), int(fps[i])) for i in found]
                frontier += list(found)
    return edges


def _link_groups(key: np.ndarray, fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links inside complete groups of equal keys (sorted): a spanning forest of each group."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
    size = ends - starts
    a, b = [], []
    small = np.repeat((size > 1) & (size <= 8), size)
    x = fps.view(np.uint64)
    for lag in range(1, 8):
        i = np.flatnonzero(small[:-lag] & (key[:-lag] == key[lag:])) if len(key) > lag else np.empty(0, np.int64)
        i = i[np.bitwise_count(x[i] ^ x[i + lag]) <= radius]
        a += fps[i].tolist()
        b += fps[i + lag].tolist()
    for g in np.flatnonzero(size > 8):
        for u, v in _spanning(fps[starts[g] : ends[g]], radius):
            a.append(u)
            b.append(v)
    return a, b


def _link_sorted(radius: int):
    """Runs over partitions sorted by key; a group may span batches, and is one tile pair at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(k, f):
            a, b = _link_groups(k, f, radius)
            lo, hi = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
            pairs = np.unique(np.stack([lo, hi], 1), axis=0) if len(lo) else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], ["u", "v"])

        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False)])
            if len(key) and key[0] != key[-1]:
                cut = int(np.searchsorted(key, key[-1]))
                yield out(key[:cut], fps[:cut])
                key, fps = key[cut:], fps[cut:]
        if len(key) > 1:
            yield out(key, fps)

    return run


def links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(u, v), u > v: enough verified links between distinct fingerprints to connect all that link.

    Two that link meet in the own cell of one of them, so a cell that is nobody's
    own, or holds one fingerprint only, has nothing to compare.
    A cell with more than ``tile`` fingerprints is dealt to tiles by hash, and
    every pair of tiles is one group, so no task holds a whole large cell and no
    cell emits more links than it has members per tile pair.

    Spark takes the cells for little larger than the fingerprints, though each
    stands in some 25 of them; left to choose, it would broadcast cells that the
    driver cannot hold, so their join is a merge at every size.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the grid finds fingerprints at 3 or fewer differing bits")
    cells = grid_cells(fps)
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("n > 1 and own").drop("own")
    cells = cells.join(sizes.hint("merge"), "cell")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("fp"), tiles)
    pairs = F.transform(
        F.sequence(F.lit(0), tiles - 1), lambda other: F.struct(F.least(other, mine).alias("i"), F.greatest(other, mine).alias("j"))
    )
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j")))
    dealt = cells.select("cell", "fp", F.explode(F.when(tiles > 1, pairs).otherwise(one)).alias("t"))
    keyed = dealt.select(
        F.when((F.col("t.i") == 0) & (F.col("t.j") == 0), F.col("cell")).otherwise(F.xxhash64("cell", "t.i", "t.j")).alias("key"), "fp"
    )
    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link_sorted(radius), "u long, v long")
    return found.distinct()


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, label): the smallest node each node of an edge list (u > v) can reach.

    Alternates connecting larger neighbours and smaller neighbours to the
    smallest one until nothing changes; every round is a written table.
    """
    def mark(e: DataFrame):
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return row["n"], row["s"]

    edges = staged(edges.select("u", "v"), purpose)
    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = staged(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), purpose)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    labels = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return labels.unionByName(roots)


def fingerprint_components(marked: DataFrame, doc_id: str = "doc_id", radius: int = 3) -> DataFrame:
    """(fp, label, component_id): one row per distinct fingerprint of ``marked`` (id, fp)."""
    nodes = marked.groupBy("fp").agg(F.min(doc_id).alias("least_id"))
    fps = nodes.select("fp")
    label = components(links(fps, radius)).withColumnRenamed("node", "fp")
    named = nodes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    return named.select("fp", "label").join(least, "label")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """Every document with its fingerprint and the smallest id it is linked to."""
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = staged(add_fingerprint(ids, keep=["doc_id"]), "simhash")
    parts = staged(fingerprint_components(marked, radius=radius), "simhash_parts")
    return marked.join(parts, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """One whole document of each component, the one with the smallest id; all columns stay.

    Rows that share that id are told apart by a hash of the row, and equal rows
    count once.
    """
    columns = docs.columns
    body = docs.withColumn("__row", F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))))
    marked = staged(add_fingerprint(body, "__fp", text), "simhash_rows")
    ids = marked.select(F.col(doc_id).alias("__id"), F.col("__fp").alias("fp"), "__row")
    parts = fingerprint_components(ids, doc_id="__id", radius=radius).select("fp", "label")
    order = F.struct(F.col("__id").isNull().alias("unnamed"), "__id", "__row")
    best = ids.join(parts, "fp").groupBy("label").agg(F.min(order)["__row"].alias("__row"))
    kept = marked.join(best.select("__row"), "__row").dropDuplicates(["__row"])
    return kept.select(*[F.col(f"`{c}`") for c in columns])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
