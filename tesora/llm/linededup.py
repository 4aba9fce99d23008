"""Lines that many documents repeat: kept in one of them, dropped in all others.

Built from DataFrame functions alone. The lines of all whole texts become 128-bit
hashes of their keys with document and position, written once. They are range
partitioned by hash and sorted by document and position behind it; one pass over
the sorted rows streams the first occurrence of each document, which gives the
number of documents of a hash and the largest of them. A hash is cut into
``shuffle_width`` slices of documents, so one line with a third of all rows is
many ranges; the slices of one hash meet as one row each.

The answer is a bitmap per document, not text: words of 64 lines with a bit for
each dropped line, and for each word the number of words before it that keep all
their lines. :func:`without_dropped` applies bitmaps to texts.

Defined results: a null or empty text is one empty line; rows with one id are one
document when documents are counted, rows without an id are another one, smaller
than all others; equal rows get equal bitmaps, and rows that share an id only
each their own (told apart by a hash of the text); an empty table gives no rows;
other columns have no effect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesora.llm.base import documents, staged
from tesora.session import shuffle_width

LEAST_CHARS = 40
LEAST_DOCS = 5
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """Blanks off both ends, A-Z in lower case; all-ASCII lines take the faster function that does the same there."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def line_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc, body, pos, h1, h2): id, hash of the text, line number and key hash of every line with a key long enough."""
    body = F.col(f"`{text}`")
    keys = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc"), F.xxhash64(body).alias("body"), F.posexplode(lines_of(body)).alias("pos", "line")
    ).where(F.char_length("line") >= least_chars)
    keyed = keys.select("doc", "body", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    return keyed.select("doc", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def drops(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc, body, bitmap, n_dropped) of every document that loses lines."""
    slices = shuffle_width(docs.sparkSession)
    own = F.pmod(F.xxhash64("doc"), F.lit(slices)).cast("int")
    lines = staged(line_rows(docs, doc_id, text, least_chars).withColumn("slice", own), "dedup_lines")
    cut = ["h1", "h2", "slice"]
    order = [F.desc_nulls_last("doc"), F.asc("pos")]
    dealt = lines.select(*cut, "doc", "pos").repartitionByRange(*cut).sortWithinPartitions(*cut, *order)
    stream = Window.partitionBy(*cut).orderBy(*order)
    # within a slice the largest id comes first and a document's lines follow each other
    first = dealt.withColumn("at", F.row_number().over(stream)).withColumn("before", F.lag("doc").over(stream))
    first = first.where((F.col("at") == 1) | ~F.col("doc").eqNullSafe(F.col("before")))
    sliced = first.groupBy(*cut).agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
    sliced = staged(sliced, "dedup_slices")
    whole = sliced.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper")).where(F.col("n") >= least_docs)
    meant = sliced.select(*cut).join(whole.select("h1", "h2", "keeper"), ["h1", "h2"])
    lost = lines.join(meant, cut).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)
    words = lost.distinct().groupBy("doc", "body", _div(F.col("pos"), 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    listed = words.groupBy("doc", "body").agg(
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"), F.sum(F.bit_count("bits")).alias("n_dropped")
    )
    before = F.concat(F.array(F.lit(-1)), F.col("w.word"))
    bitmap = F.transform("w", lambda w, i: F.struct((w["word"] - F.get(F.col("before"), i) - 1).alias("skip"), w["bits"].alias("bits")))
    return listed.withColumn("before", before).select("doc", "body", bitmap.alias("bitmap"), F.col("n_dropped").cast("long").alias("n_dropped"))


def dropped_words(bitmap: Column) -> Column:
    """The words of a bitmap in full length up to the last one that drops a line."""
    return F.flatten(F.transform(bitmap, lambda w: F.concat(F.array_repeat(F.lit(0).cast("long"), w["skip"]), F.array(w["bits"]))))


def without_dropped(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``__lines``, ``__kept`` (the lines that stay) and ``__dropped``."""
    named = found.select(F.col("doc").alias("__doc"), F.col("body").alias("__body"), dropped_words(F.col("bitmap")).alias("__words"), F.col("n_dropped").alias("__n"))
    id_, body = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")
    met = docs.join(named, id_.eqNullSafe(F.col("__doc")) & (F.xxhash64(body) == F.col("__body")), "left")
    met = met.withColumn("__lines", lines_of(body))
    gone = lambda i: F.call_function("shiftright", F.get(F.col("__words"), _div(i, 64).cast("int")), i % 64).bitwiseAND(F.lit(1).cast("long"))
    kept = F.array_join(F.filter("__lines", lambda line, i: F.coalesce(gone(i), F.lit(0).cast("long")) == 0), "\n")
    return met.withColumn("__kept", F.when(F.col("__words").isNull(), F.coalesce(body, F.lit(""))).otherwise(kept)).withColumn(
        "__dropped", F.coalesce("__n", F.lit(0).cast("long"))
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return without_dropped(docs, drops(docs)).select(
        "doc_id",
        F.size("__lines").cast("long").alias("n_lines"),
        F.col("__dropped").alias("n_dropped"),
        F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"),
    )


OP11_SQL = """WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT k, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 5),
judged AS (SELECT keyed.*, common.key IS NOT NULL AND keeper IS DISTINCT FROM doc_id AS gone FROM keyed LEFT JOIN common USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY k"""
