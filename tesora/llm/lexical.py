"""Ranked lexical search of a stated set of items over all documents, by MaxScore with bounds of term pairs.

1. One pass over the whole texts keeps, per document, its length and the counts
   of the terms that occur in the items. Item terms are shipped in blocks of a
   bounded size.
2. Global counts fix each term's weight. Rows of step 1 become shards of about
   ``SHARD`` postings, one written row each: postings with their exact impacts
   by term and, for the pairs of terms that items put side by side, the list of
   documents holding both and the largest impact the two have together.
3. Every item is evaluated in every shard. Its pairs are visited from the
   largest bound to the smallest. A document not met yet can still reach the
   threshold (the tenth best score so far) only if the pair's joint maximum and
   all later bounds allow it; if only the joint maximum does, just the pair's
   intersection list opens documents; and met documents go as soon as the later
   bounds cannot lift them. Bounds are exact integers, and only documents below
   the threshold are skipped, so the result is that of scoring everything.

A task carries each item's best ten from shard to shard, and the last ranking
sees ten rows an item and task.

Defined results: null texts have no terms; each row is a document, also an equal
or unnamed one (null ids rank last among ties); equal items count once, and rows
of one item id with different texts are items of their own; an item without
terms, or without a document that holds one, has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesora.llm.base import documents, staged
from tesora.llm.terms import long_terms, packed, spans, steps, term_bytes

BEST = 10
#: Items and terms of items that one pass over the documents answers.
ITEMS, ITEM_TERMS = 4096, 1 << 18
#: Postings of a shard.
SHARD = 1 << 18
_TERM = term_bytes(digits=True)
_SHORT = 16


class Vocabulary:
    """Numbers of the terms of a block of items, looked up by packed words or, for long terms, by bytes."""

    def __init__(self, terms: Sequence[bytes]) -> None:
        self.terms = sorted(set(terms))
        number = {t: i for i, t in enumerate(self.terms)}
        short = [t for t in self.terms if len(t) <= _SHORT]
        at = np.frombuffer(b"".join(t.ljust(_SHORT, b"\0") for t in short), ">u8").reshape(-1, 2).astype(np.uint64)
        # short terms sort as their two words do, so the first word finds a range and the second one decides
        self.first, self.second = at[:, 0].copy(), at[:, 1].copy()
        self.short = np.array([number[t] for t in short], np.int64)
        self.long = {t: number[t] for t in self.terms if len(t) > _SHORT}

    def numbers(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of each term, -1 where no item has it."""
        out = np.full(len(starts), -1, np.int64)
        for inside in (lengths <= 8, (lengths > 8) & (lengths <= _SHORT)):
            at = np.flatnonzero(inside)
            if not len(at) or not len(self.first):
                continue
            word = packed(data, starts[at], lengths[at])
            place = np.searchsorted(self.first, word)
            found = np.flatnonzero(self.first[np.minimum(place, len(self.first) - 1)] == word)
            at, place, word = at[found], place[found], word[found]
            rest = packed(data, starts[at], lengths[at], 1) if len(at) and lengths[at[0]] > 8 else np.zeros(len(at), np.uint64)
            while len(at):
                hit = self.second[place] == rest
                out[at[hit]] = self.short[place[hit]]
                place = place + 1
                more = ~hit & (place < len(self.first))
                more[more] = self.first[place[more]] == word[more]
                at, place, word, rest = at[more], place[more], word[more], rest[more]
        if self.long:
            at = np.flatnonzero(lengths > _SHORT)
            for inside, terms in long_terms(data, starts[at], lengths[at]):
                out[at[inside]] = [self.long.get(t, -1) for t in terms.tolist()]
        return out


def terms_of(text: str | None) -> list[bytes]:
    """Distinct terms of one text."""
    found: dict[bytes, None] = {}
    for _, data, offsets in steps(pa.array([text], pa.string())):
        starts, lengths, _ = spans(data, offsets, _TERM)
        raw = data.tobytes()
        found |= dict.fromkeys(raw[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True))
    return list(found)


def matched(docs: DataFrame, known: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tf) of every document with a term: its length and what it holds of the item terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in steps(batch.column("text")):
                rows = len(offsets) - 1
                starts, lengths, row = spans(data, offsets, _TERM)
                n = np.bincount(row, minlength=rows)
                number = known.numbers(data, starts, lengths)
                own = np.flatnonzero(number >= 0)
                cell, tf = np.unique(row[own] * (len(known.terms) + 1) + number[own], return_counts=True)
                held_row, held = np.divmod(cell, len(known.terms) + 1)
                ends = np.concatenate(([0], np.cumsum(np.bincount(held_row, minlength=rows)))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int64))) for v in (held, tf)]
                found = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, rows), pa.array(n), *lists], ["doc_id", "n", "terms", "tf"])
                yield found.filter(pa.array(n > 0))

    picked = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n long, terms array<long>, tf array<long>")


def length_norm(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 - 90 + (90 * n * docs) div total, also where the product needs more than 64 bits."""
    if len(n) and 90 * int(n.max()) * docs >= 1 << 63:
        return np.array([10 + 90 * int(x) * docs // total for x in n], np.int64)
    return 10 + 90 * n * docs // max(total, 1)


@dataclass
class Postings:
    """Documents and impacts by term, documents ascending in each list."""

    start: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[term], self.start[term + 1]
        return self.docs[a:b], self.impacts[a:b]


def pairs_of(items: Sequence[np.ndarray], weight: np.ndarray) -> list[list[tuple[int, int]]]:
    """Each item's terms two by two, heaviest first; a last odd one stands with itself."""
    out = []
    for terms in items:
        ranked = terms[np.lexsort((terms, -weight[terms]))].tolist()
        out.append([(a, b) if a < b else (b, a) for a, b in zip(ranked[::2], [*ranked[1::2], ranked[-1]][: len(ranked[::2])], strict=True)] if ranked else [])
    return out


def build_shard(n: np.ndarray, ends: np.ndarray, terms: np.ndarray, tf: np.ndarray, weight: np.ndarray, pairs: np.ndarray, docs: int, total: int) -> dict:
    """Postings by term with exact impacts, and the intersection list and joint maximum of every pair."""
    doc = np.repeat(np.arange(len(n)), np.diff(ends))
    m = length_norm(n, docs, total)[doc]
    impact = weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
    order = np.argsort(terms, kind="stable")
    start = np.concatenate(([0], np.cumsum(np.bincount(terms, minlength=len(weight)))))
    found = Postings(start, doc[order].astype(np.int32), impact[order])
    best = np.zeros(len(weight), np.int64)
    np.maximum.at(best, terms, impact)
    both, joint = [], []
    for a, b in pairs.tolist():
        (da, ia), (db, ib) = found.of(a), found.of(b)
        if a == b or not len(da) or not len(db):
            both.append(np.empty(0, np.int32))
            joint.append(max(int(best[a]), int(best[b])))
            continue
        at = np.minimum(np.searchsorted(db, da), len(db) - 1)
        same = np.flatnonzero(db[at] == da)
        both.append(da[same])
        top = int((ia[same] + ib[at[same]]).max()) if len(same) else 0
        joint.append(max(top, int(best[a]), int(best[b])))
    pair_ends = np.concatenate(([0], np.cumsum([len(x) for x in both]))) if both else np.zeros(1, np.int64)
    held = np.concatenate(both) if both else np.empty(0, np.int32)
    return {"starts": start, "docs": found.docs, "impacts": found.impacts, "best": best, "joint": joint, "pair_starts": pair_ends, "pair_docs": held}


_SHARD = (
    "doc_ids array<long>, starts array<long>, docs array<int>, impacts array<long>, best array<long>, "
    "joint array<long>, pair_starts array<long>, pair_docs array<int>"
)
_SHARD_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]


def index(rows: DataFrame, weight: np.ndarray, pairs: np.ndarray, docs: int, total: int, shard: int = SHARD) -> DataFrame:
    """Shards of about ``shard`` postings, one row each."""
    names = [f.split()[0] for f in _SHARD.split(", ")]

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        n, (terms, tf) = table["n"].to_numpy(), (table[c].combine_chunks() for c in ("terms", "tf"))
        ends = np.asarray(terms.offsets, np.int64)
        values = [v.flatten().to_numpy() for v in (terms, tf)]
        made = build_shard(n, ends - ends[0], *values, weight, pairs, docs, total) | {"doc_ids": table["doc_id"].combine_chunks()}
        return pa.RecordBatch.from_arrays([pa.array([made[c]], pa.list_(t)) for c, t in zip(names, _SHARD_TYPES, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                held.append(piece)
                size += len(piece.column("terms").flatten())
                if size >= shard:
                    yield close(held)
                    held, size = [], 0
        if size:
            yield close(held)

    return rows.where(F.size("terms") > 0).mapInArrow(run, _SHARD)


def search_shard(
    found: Postings, best: np.ndarray, units: Sequence[tuple[int, int, int, np.ndarray]], rows: int, floor: int, top: int
) -> tuple[np.ndarray, np.ndarray]:
    """(documents, exact scores) of a shard that score ``floor`` or more, and all that can be among its ``top``.

    ``units`` are an item's pairs: (term, other term, joint maximum, documents
    holding both).
    """
    ranked = sorted(units, key=lambda u: -u[2])
    bounds = np.array([u[2] for u in ranked], np.int64)
    later = (bounds.sum() - np.cumsum(bounds)).tolist()
    score, met = np.zeros(rows, np.int64), np.zeros(rows, bool)
    for (a, b, joint, both), rest in zip(ranked, later, strict=True):
        if not joint:
            break
        lists = [found.of(t) for t in ((a,) if a == b else (a, b))]
        if rest + joint >= floor:  # both together can lift a new document to the threshold
            met[both] = True
        for term, (held, _) in zip((a, b), lists, strict=False):
            if rest + best[term] >= floor:  # so can this one alone
                met[held] = True
        for held, impact in lists:
            own = met[held]
            score[held[own]] += impact[own]
        at = np.flatnonzero(met)
        now = score[at]
        if len(now) >= top:
            floor = max(floor, int(np.partition(now, len(now) - top)[len(now) - top]))
        met[at[now + rest < floor]] = False
    at = np.flatnonzero(met)
    return at, score[at]


def _merge(held: list[tuple[int, float, int | None]], new: Sequence[tuple[int, int | None]], top: int) -> list[tuple[int, float, int | None]]:
    """The best of both: highest score, then smallest id, null ids last."""
    rows = held + [(-s, math.inf if d is None else d, d) for s, d in new]
    return sorted(rows, key=lambda r: r[:2])[:top]


def search(shards: DataFrame, units: Sequence[Sequence[int]], pairs: np.ndarray, top: int = BEST) -> DataFrame:
    """(item, doc_id, score): the best documents of each item within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in units]
        for batch in batches:
            for i in range(batch.num_rows):
                column = {c: batch.column(c)[i].values for c in batch.schema.names}
                value = {c: v.to_numpy(zero_copy_only=False) for c, v in column.items() if c != "doc_ids"}
                found, ids = Postings(value["starts"], value["docs"], value["impacts"]), column["doc_ids"]
                cut = value["pair_starts"]
                lists = [value["pair_docs"][cut[p] : cut[p + 1]] for p in range(len(pairs))]
                for item, own in enumerate(units):
                    floor = -held[item][-1][0] if len(held[item]) == top else 1
                    with_bounds = [(*pairs[p].tolist(), int(value["joint"][p]), lists[p]) for p in own]
                    at, score = search_shard(found, value["best"], with_bounds, len(ids), floor, top)
                    fit = score >= max(floor, 1)
                    if fit.any():
                        held[item] = _merge(held[item], list(zip(score[fit].tolist(), ids.take(pa.array(at[fit])).to_pylist(), strict=True)), top)
        rows = [(item, d, -s) for item, best in enumerate(held) for s, _, d in best]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return shards.mapInArrow(run, "item long, doc_id long, score long")


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Blocks of (id, distinct terms) of the stated items, at most ``ITEMS`` items or about ``ITEM_TERMS`` terms each."""
    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).distinct()
    block, size = [], 0
    for row in rows.orderBy("id", "text").toLocalIterator():
        block.append((row.id, terms_of(row.text)))
        size += len(block[-1][1])
        if len(block) == ITEMS or size >= ITEM_TERMS:
            yield block
            block, size = [], 0
    if block:
        yield block


def rank_block(docs: DataFrame, block: Sequence[tuple[int | None, list[bytes]]], top: int = BEST, shard: int = SHARD) -> DataFrame:
    """(item_id, item, rank, doc_id, score) of one block of items over all documents."""
    spark = docs.sparkSession
    known = Vocabulary([t for _, terms in block for t in terms])
    number = {t: i for i, t in enumerate(known.terms)}
    rows = staged(matched(docs, known), "lexical_rows")
    size = rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    held = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator())
    weight = [math.floor(1000 * math.log((2 * size.docs + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(known.terms))]
    weight = np.array(weight, np.int64)
    chosen = pairs_of([np.array([number[t] for t in terms], np.int64) for _, terms in block], weight)
    pairs = sorted({p for own in chosen for p in own})
    place = {p: i for i, p in enumerate(pairs)}
    pair_table = np.array(pairs, np.int64).reshape(-1, 2)
    shards = staged(index(rows, weight, pair_table, size.docs, size.total, shard), "lexical_shards")
    best = search(shards, [[place[p] for p in own] for own in chosen], pair_table, top)
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item long, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item, one pass over the documents a block of items."""
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items, item_id, text):
        out = out.unionByName(rank_block(docs, block, top))
    return out


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_TERMS = """list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
    lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"""
OP12_SQL = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_SQL_TERMS} AS terms FROM documents),
held AS (SELECT k, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM held),
items AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_SQL_TERMS}) AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
wanted AS (SELECT i, item_id, unnest(terms) AS term FROM items),
tf AS (SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, n, unnest(terms) AS term FROM held) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, size GROUP BY term, docs),
impacts AS (SELECT k, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))) AS impact
  FROM tf JOIN weights USING (term), size WHERE term IN (SELECT term FROM wanted)),
scores AS (SELECT i, item_id, k, doc_id, sum(impact)::BIGINT AS score FROM wanted JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10"""
