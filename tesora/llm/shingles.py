"""Near copies by exact Jaccard similarity of five-word shingles, for the pipeline's near-duplicate stage.

A text is the set of its distinct shingles (a shorter text is one shingle), kept
as 64-bit hashes. Equal sets collapse first. Every set has a SimHash fingerprint
of its hashes; fingerprints that ``simhash`` links, in its grid of segment
counts, make their sets candidates. 64 bits at 3 or fewer differing ones do not
reach down to a similarity of 0.8, so every set also has ``BANDS`` keys, each
mixed from ``ROWS`` minima of its permuted hashes; two sets of similarity s
share at least one key with probability 1 - (1 - s^ROWS)^BANDS, which is
0.99997 at 0.8 and more above. Sets that share a fingerprint's component or a
key are candidates, and the similarity counted over both whole texts decides.
Keys with the same sets, known by their number, sum and two digests, are one
key, so near copies meet once and not once for each of the many keys that they
share.

All members of a key are compared, whatever their number: a key with more than
``TILE`` sets is dealt to tiles, every pair of tiles is one task's group, and a
search from member to member compares one set with all others of the group at
once, giving at most a spanning forest.

Defined results: texts without words are copies of one another; a null id goes
after all others; equal rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tesora.llm import simhash
from tesora.llm.base import add_columns, staged, texts, words_of
from tesora.llm.simhash import components

SHINGLE = 5
LEAST = 0.8
ROWS, BANDS = 4, 20
#: Sets of a key that are one tile; a task compares two tiles at once.
TILE = 512
#: Shingles permuted at once.
BLOCK = 512
_RANDOM = np.random.default_rng(21)
_TURN, _ADD = (_RANDOM.integers(1, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_FOLD = _RANDOM.integers(1, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh3_64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in spans), np.uint64, n))


def set_id(found: np.ndarray) -> int:
    """One number for equal sets; 0 for the empty one."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) if len(found) else 0


def band_keys(found: np.ndarray) -> np.ndarray:
    """The set's keys; sets that share one are candidates."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), BLOCK):
        x = (found[at : at + BLOCK, None] ^ _ADD) * _TURN
        x ^= x >> np.uint64(32)
        x *= _TURN
        np.minimum(least, x.min(axis=0), out=least)
    mixed = (least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(31))) * _FOLD[:, 0]


def cells(marked: DataFrame, text: str) -> DataFrame:
    """(key, set): the keys of all distinct sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = np.unique(batch.column("__set").to_numpy(zero_copy_only=False), return_index=True)
            found = [shingle_set(batch.column(text)[int(i)].as_py()) for i in first]
            own = [i for i, f in enumerate(found) if len(f)]
            keys = np.concatenate([band_keys(found[i]) for i in own]) if own else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(ids[own], BANDS))], ["key", "set"])

    return marked.select(F.col(f"`{text}`"), "__set").mapInArrow(run, "key long, set long").distinct()


def fingerprint_keys(sets: DataFrame, radius: int = 3) -> DataFrame:
    """(key, set) of the non-empty sets of ``sets`` (set, fp): one key for each component of SimHash links."""
    own = sets.where("set <> 0").select("set", "fp")
    label = components(simhash.links(own.select("fp").distinct(), radius), "shingle_fingerprints").withColumnRenamed("node", "fp")
    key = F.xxhash64(F.lit("fingerprint"), F.coalesce("label", "fp")).alias("key")
    return own.join(label, "fp", "left").select(key, "set")


def _similar(ids: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the link graph among the sets of one group."""
    size = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    starts = ends - size
    mark = np.zeros(flat.max() + 1, np.int32)
    rest, edges = np.ones(len(ids), bool), []
    for root in range(len(ids)):
        if not rest[root]:
            continue
        rest[root], frontier = False, [root]
        while frontier and rest.any():
            at = frontier.pop()
            mine = flat[starts[at] : ends[at]]
            mark[mine] = 1
            both = np.add.reduceat(mark[flat], starts)
            mark[mine] = 0
            near = np.flatnonzero(rest & (both >= least * (size + size[at] - both)))
            rest[near] = False
            edges += [(ids[root], ids[i]) for i in near]
            frontier += near.tolist()
    return edges


def _link_sorted(least: float):
    """Runs over partitions sorted by key; a group may span batches, and is one tile pair at most."""

    def out(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        edges = _similar(ids, sets, least) if len(ids) > 1 else []
        pairs = np.sort(np.array(edges, np.int64).reshape(-1, 2), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, sets = None, [], []
        for batch in batches:
            columns = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("key", "set"))
            for key, own, text in zip(*columns, texts(batch), strict=True):
                if key != last and ids:
                    yield out(ids, sets)
                    ids, sets = [], []
                last = key
                ids.append(own)
                sets.append(shingle_set(text))
        if ids:
            yield out(ids, sets)

    return run


def candidates(found: DataFrame, tile: int = TILE) -> DataFrame:
    """(key, set): the groups to compare, from the keys (key, set); sets that meet no other are left out."""
    # near copies share most of their keys: of the keys with the same sets one is enough
    members = [F.bit_xor(F.xxhash64(F.lit(seed), "set")).alias(f"m{seed}") for seed in (0, 1)]
    sizes = found.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("set").cast("decimal(20,0)")).alias("total"), *members).where("n > 1")
    sizes = sizes.groupBy("n", "total", "m0", "m1").agg(F.min("key").alias("key")).select("key", "n")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    mine = F.pmod(F.xxhash64("set"), tiles)
    pairs = F.transform(
        F.sequence(F.lit(0), tiles - 1), lambda other: F.struct(F.least(other, mine).alias("i"), F.greatest(other, mine).alias("j"))
    )
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("j")))
    dealt = found.join(sizes, "key").select("key", "set", F.explode(F.when(tiles > 1, pairs).otherwise(one)).alias("t"))
    group = F.when((F.col("t.i") == 0) & (F.col("t.j") == 0), F.col("key")).otherwise(F.xxhash64("key", "t.i", "t.j")).alias("key")
    return dealt.select(group, "set")


def verified(groups: DataFrame, bodies: DataFrame, least: float = LEAST) -> DataFrame:
    """(u, v), u > v: a spanning forest of the links in every group (key, set)."""
    keyed = groups.join(bodies, "set").select("key", "set", "text")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link_sorted(least), "u long, v long").distinct()


def links(found: DataFrame, bodies: DataFrame, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """(u, v), u > v: enough verified links to connect all sets that link.

    ``found`` has the keys (key, set), ``bodies`` one text of each set (set, text).
    """
    return verified(candidates(found, tile), bodies, least)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, tile: int = TILE) -> DataFrame:
    """One whole document of each component of near copies, the one with the smallest id; all columns stay.

    Rows that share that id are told apart by a hash of the row, and equal rows
    count once.
    """
    columns = docs.columns
    body = docs.withColumn("__row", F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))))

    def compute(batch: pa.RecordBatch):
        out = np.empty((2, batch.num_rows), np.uint64)
        for i, t in enumerate(texts(batch, text)):
            found = shingle_set(t)
            out[:, i] = set_id(found), simhash.majority(found)
        return list(out.view(np.int64))

    marked = staged(add_columns(body, [("__set", LongType()), ("__fp", LongType())], compute), "shingle_rows")
    order = F.struct(F.col(f"`{doc_id}`").isNull().alias("unnamed"), F.col(f"`{doc_id}`").alias("id"), "__row")
    sets = marked.groupBy(F.col("__set").alias("set")).agg(F.min(order).alias("best"), F.min("__fp").alias("fp"))
    sets = staged(sets, "shingle_sets")
    found = staged(cells(marked, text).unionByName(fingerprint_keys(sets)), "shingle_cells")
    groups = staged(candidates(found, tile), "shingle_groups")
    # only texts that are compared move to their groups
    compared = groups.select("set").distinct().join(sets, "set").select(F.col("best.__row").alias("__row"))
    bodies = marked.join(compared, "__row").dropDuplicates(["__row"])
    edges = verified(groups, bodies.select(F.col("__set").alias("set"), F.col(f"`{text}`").alias("text")), least)
    label = components(edges, "shingle_components").withColumnRenamed("node", "set")
    named = sets.join(label, "set", "left").groupBy(F.coalesce("label", "set")).agg(F.min("best")["__row"].alias("__row"))
    kept = marked.join(named.select("__row"), "__row").dropDuplicates(["__row"])
    return kept.select(*[F.col(f"`{c}`") for c in columns])
