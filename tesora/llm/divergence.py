"""How far the sources of a language differ in their words, by exact integer shares of its common terms.

Counting follows length-bucketed packing. The terms of a piece of an Arrow batch
become one number (to 8 bytes) or two (to 16 bytes); a radix sort by term and
group leaves each term's documents next to each other, and runs give counts and
document numbers. Longer terms are sorted as bytes, one bucket a length. Pieces
add up by Spark's partial aggregation, so a hot source ships one row a task for
each of its terms.

Distances between sources are summed over blocks of terms and tiles of sources:
a task holds the shares of two tiles for one block.

Defined results: null text, lang and source are empty; each row is a document,
also an equal or unnamed one; a language without common terms gives distances of
0 and no term rows; an empty table gives no rows; other columns have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesora.llm.base import documents, staged
from tesora.llm.terms import long_terms, packed, radix_order, spans, steps, term_bytes, unpacked

LEAST_DOCS = 30
#: Added to every count, and the number that the shares of a group come near in sum.
SMOOTH, WHOLE = 5, 1_000_000_000
TOP = 50
#: Terms of a block and sources of a tile: a task of the distances holds block x 2 tiles shares.
BLOCK, TILE = 4096, 256
#: Terms of up to so many bytes are one or two packed words.
SHORT = 8
_TERM = term_bytes(digits=False)
_COUNTED = "lang string, source string, term string, n long, docs long"


def _runs(order: np.ndarray, group: np.ndarray, row: np.ndarray, *words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, terms, documents) of each run of one group and term, in sorted order."""
    if not len(order):
        return (np.empty(0, np.int64),) * 3
    change = np.zeros(len(order), bool)
    change[0] = True
    for values in (group, *words):
        held = values[order]
        change[1:] |= held[1:] != held[:-1]
    new_row = change.copy()
    held = row[order]
    new_row[1:] |= held[1:] != held[:-1]
    first = np.flatnonzero(change)
    return first, np.diff(np.append(first, len(order))), np.add.reduceat(new_row.astype(np.int64), first)


def count_terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """(group, term, occurrences, documents) of the rows of one piece, a bucket of lengths at a time."""
    starts, lengths, row = spans(data, offsets, _TERM)
    of = group[row].astype(np.uint64)
    for low, width in ((0, 1), (SHORT, 2)):
        at = np.flatnonzero((lengths > low) & (lengths <= low + SHORT))
        words = [packed(data, starts[at], lengths[at], w) for w in range(width)]
        order = radix_order(of[at], *words)
        first, n, docs = _runs(order, of[at], row[at], *words)
        picked = order[first]
        yield of[at][picked], unpacked([w[picked] for w in words]), n, docs
    at = np.flatnonzero(lengths > 2 * SHORT)
    for inside, terms in long_terms(data, starts[at], lengths[at]):
        own = at[inside]
        order = np.argsort(terms, kind="stable")
        order = order[radix_order(of[own][order])]
        first, n, docs = _runs(order, of[own], row[own], terms)
        picked = order[first]
        yield of[own][picked], terms[picked].tolist(), n, docs


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all terms of all whole texts."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"]).to_pylist()
            numbers: dict[tuple[str, str], int] = {}
            group = np.array([numbers.setdefault((k["lang"], k["source"]), len(numbers)) for k in keys], np.int64)
            lang, source = (pa.array([k[i] for k in numbers], pa.string()) for i in (0, 1))
            for row, data, offsets in steps(batch.column("text")):
                for of, terms, n, held in count_terms(data, offsets, group[row : row + len(offsets) - 1]):
                    of = pa.array(of.astype(np.int64))
                    found = [lang.take(of), source.take(of), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n), pa.array(held)]
                    yield pa.RecordBatch.from_arrays(found, ["lang", "source", "term", "n", "docs"])

    counted = docs.select(*text).mapInArrow(run, _COUNTED)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (count + SMOOTH) / (total + SMOOTH * terms)), three digits at a time so that no product overflows."""
    part, whole = count + SMOOTH, total + SMOOTH * terms
    digits = F.lit(1).cast("long")
    for scale in (1_000_000, 1_000, 1):
        shifted = part * 1_000
        digits = digits + _div(shifted, whole) * scale
        part = shifted % whole
    return digits


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def profiles(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Written tables of the groups (lang, source, total, terms, lang_total) and of the counts of kept terms.

    The counts are (lang, source, term, n, lang_n); a group without a term of
    its language has no row there.
    """
    counts = staged(term_counts(docs), "divergence_counts")
    common = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    common = staged(common.where(F.col("docs") >= least_docs).drop("docs"), "divergence_terms")
    kept = staged(counts.drop("docs").join(common, ["lang", "term"]), "divergence_kept")
    names = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = common.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = names.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    return staged(groups.fillna(0, ["total", "terms", "lang_total"]), "divergence_groups"), kept


def _distances(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of absolute differences between the sources of two tiles over one block of terms.

    Rows without a term name a source, the share of a term it lacks and the
    number of terms of the block; those that no source of the two tiles holds
    differ by these shares alone.
    """
    tile_a, tile_b = key[2].as_py(), key[3].as_py()
    names = table.filter(pc.is_null(table["term"])).sort_by("number")
    cells = table.filter(pc.is_valid(table["term"]))
    number, base, tile = (names[c].to_numpy() for c in ("number", "p", "tile"))
    terms = cells["term"].combine_chunks().dictionary_encode()
    shares = np.repeat(base[:, None], len(terms.dictionary), axis=1)
    elsewhere = (names["in_block"][0].as_py() if len(names) else 0) - len(terms.dictionary)
    shares[np.searchsorted(number, cells["number"].to_numpy()), terms.indices.to_numpy()] = cells["p"].to_numpy()
    left, right = np.flatnonzero(tile == tile_a), np.flatnonzero(tile == tile_b)
    a, b, value = [], [], []
    for i in left:
        others = right[right > i] if tile_a == tile_b else right
        a.append(np.full(len(others), number[i]))
        b.append(number[others])
        value.append(np.abs(shares[others] - shares[i]).sum(axis=1) + elsewhere * np.abs(base[others] - base[i]))
    columns = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b, value)]
    return pa.table([pa.array([key[0].as_py()] * len(columns[0]), pa.string()), *columns], ["lang", "a", "b", "value"])


def pair_rows(groups: DataFrame, kept: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, item, value): the distance of every source of a language from each other one."""
    by = Window.partitionBy("lang").orderBy("source")
    numbered = staged(groups.withColumn("number", F.row_number().over(by).cast("long") - 1), "divergence_numbers")
    tiles = _div(F.max("number").over(Window.partitionBy("lang")), F.lit(tile)).cast("int")
    blocks = F.greatest(F.ceil(F.col("terms") / block), F.lit(1)).cast("int")
    of = numbered.withColumns({"tile": _div(F.col("number"), F.lit(tile)).cast("int"), "tiles": tiles, "blocks": blocks})
    known = ["lang", "number", "tile", "tiles"]
    lacking = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.greatest("terms", F.lit(1)))).otherwise(0)
    mine = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    met = kept.join(of, ["lang", "source"])
    cells = met.select(*known, mine, "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    cells = cells.withColumn("in_block", F.lit(0).cast("long"))
    sizes = cells.select("lang", "block", "term").distinct().groupBy("lang", "block").agg(F.count("*").alias("in_block"))
    named = of.select(*known, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), lacking.alias("p"))
    named = named.join(sizes, ["lang", "block"], "left").fillna(0, ["in_block"])
    both = F.transform(F.sequence(F.lit(0), F.col("tiles")), lambda t: F.struct(F.least(t, "tile").alias("a"), F.greatest(t, "tile").alias("b")))
    dealt = named.unionByName(cells).select("*", F.explode(both).alias("pair"))
    dealt = dealt.select("lang", "block", F.col("pair.a").alias("tile_a"), F.col("pair.b").alias("tile_b"), "number", "tile", "term", "p", "in_block")
    parts = dealt.groupBy("lang", "block", "tile_a", "tile_b").applyInArrow(_distances, "lang string, a long, b long, value long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(*[F.struct(F.col(x).alias("own"), F.col(y).alias("other")) for x, y in (("a", "b"), ("b", "a"))]))
    way = sums.select("lang", "value", ways.alias("w")).select("lang", "value", "w.*")
    own = numbered.select("lang", F.col("number").alias("own"), "source")
    other = numbered.select("lang", F.col("number").alias("other"), F.col("source").alias("item"))
    return way.join(own, ["lang", "own"]).join(other, ["lang", "other"]).select("lang", "source", "item", "value")


def term_rows(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value): how far a term's share exceeds the one it has in the whole language."""
    met = kept.join(groups, ["lang", "source"])
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    return met.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by).alias("rank"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between sources, and the terms that set a source apart."""
    groups, kept = profiles(docs, least_docs)
    terms = _ranked(term_rows(groups, kept), "term").where(F.col("rank") <= top)
    return _ranked(pair_rows(groups, kept), "pair").unionByName(terms)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


_P = "1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * v)"
OP13_SQL = f"""WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_transform(
    regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'),
    lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents),
numbered AS (SELECT row_number() OVER () AS k, * FROM d),
occurring AS (SELECT k, lang, source, unnest(terms) AS term FROM numbered),
common AS (SELECT lang, term, count(*) AS lang_n FROM occurring GROUP BY 1, 2 HAVING count(DISTINCT k) >= 30),
n AS (SELECT lang, source, term, count(*) AS n FROM occurring GROUP BY 1, 2, 3),
of_lang AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM common GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, c.term, c.lang_n, coalesce(n.n, 0) AS n, v, lang_total,
    sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN common c USING (lang) JOIN of_lang USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = c.term),
p AS (SELECT *, {_P.format(n="n", total="total")} AS p, {_P.format(n="lang_n", total="lang_total")} AS q FROM dense),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
