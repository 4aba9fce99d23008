"""Fixity audit of replicated WARC records with Merkle trees.

Pages become WARC records in the order of their ids. The manifest has each
record's digest, length and offset. Each replica, the manifest's own included,
is hashed by itself: a leaf of its tree is a range of ``SPAN`` bytes of offsets,
with the digest of offset, length and digest of the records that begin there in
order; a node covers ``FAN`` neighbours. The audit compares the roots and goes
on with the children of nodes that differ. Only records of ranges that differ
meet: those at the same place with the same bytes are intact, then equal bytes
of an id at another offset are ``moved``, then what is left of an id is
``altered`` or ``resized``, and the rest is ``missing`` or ``extra``.

Defined results: a null url or page is an empty one; a null id comes first;
repeated ids are paired in the order of their offsets; equal rows of a replica
at one offset are one; a record of a replica without an offset (null, or no such
column) has no place in its tree and is compared by id and bytes alone; equal
replicas give no row; an empty table has no root. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesora.llm.base import staged

FAN = 64
#: Bytes of offsets that make a leaf of the tree.
SPAN = 1 << 16
#: Bytes of offsets that are numbered by one window.
PIECE = 1 << 28
_DATE = "1970-01-01T00:00:00Z"


def warc_text(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC record as text; its bytes are the UTF-8 form."""
    key, uri, body = F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:md5:"), F.md5(F.concat(key, F.lit(" "), uri)),
        F.lit(f">\r\nWARC-Date: {_DATE}\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def warc_records(pages: DataFrame) -> DataFrame:
    """(page_id, record): the bytes of each page's record."""
    return pages.select("page_id", F.encode(warc_text(F.col("page_id"), F.col("url"), F.col("html")), "UTF-8").alias("record"))


def digests(records: DataFrame) -> DataFrame:
    """(page_id, digest, length) of records, and record_offset where they have one; given digests stay as they are."""
    place = [F.col("record_offset").cast("long")] if "record_offset" in records.columns else []
    if "record" not in records.columns:
        return records.select("page_id", "digest", "length", *place)
    return records.select("page_id", F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("length"), *place)


def manifest(records: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, digest, length, record_offset) of all records in id order; a written table.

    Records are dealt by ranges of id and digest; one row per range meets in the
    window that carries offsets. ``extra`` columns are carried along.
    """
    body = records.select("page_id", F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("length"), *extra)
    dealt = body.repartitionByRange("page_id", "digest").withColumn("part", F.spark_partition_id())
    dealt = staged(dealt, "fixity_digests")
    inside = Window.partitionBy("part").orderBy("page_id", "digest", *extra)
    own = dealt.withColumn("inner", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    totals = dealt.groupBy("part").agg(F.sum("length").alias("total"))
    carried = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    placed = own.join(carried, "part").withColumn("record_offset", F.col("before") + F.col("inner"))
    return staged(placed.drop("inner", "before", "part"), "fixity_manifest")


def tree(records: DataFrame, height: int, fan: int = FAN, span: int = SPAN) -> list[DataFrame]:
    """(idx, digest) of all nodes of one replica, one written table per level, the leaves first and the root last.

    Reads nothing but the replica's own offsets, lengths and digests.
    """
    def above(nodes: DataFrame, index: Column, fields: list[str]) -> DataFrame:
        inside = F.array_sort(F.collect_list(F.struct(*fields)))
        text = F.concat_ws(" ", F.transform(inside, lambda c: F.concat_ws(":", *[c[f].cast("string") for f in fields])))
        return staged(nodes.groupBy(index.cast("long").alias("idx")).agg(F.sha2(text, 256).alias("digest")), "fixity_tree")

    levels = [above(records, F.floor(F.col("record_offset") / span), ["record_offset", "length", "digest"])]
    for _ in range(height):
        levels.append(above(levels[-1], F.floor(F.col("idx") / fan), ["idx", "digest"]))
    return levels


def differing(ours: list[DataFrame], theirs: list[DataFrame], fan: int = FAN) -> DataFrame:
    """idx of the leaves that differ, reached from the root through differing nodes only."""
    suspects = None
    for mine, other in zip(reversed(ours), reversed(theirs), strict=True):
        a, b = mine.withColumnRenamed("digest", "a"), other.withColumnRenamed("digest", "b")
        if suspects is not None:
            up = suspects.withColumnRenamed("idx", "up")
            a, b = (nodes.withColumn("up", F.floor(F.col("idx") / fan).cast("long")).join(up, "up", "left_semi").drop("up") for nodes in (a, b))
        both = a.join(b, "idx", "full").where(~F.col("a").eqNullSafe(F.col("b")))
        suspects = staged(both.select("idx"), "fixity_level")
    return suspects


def _numbered(records: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``nth``, the place by offset among records of the same keys; a hot key is numbered piece by piece."""
    cut = records.withColumn("piece", F.coalesce(F.floor(F.col("record_offset") / PIECE), -1 - F.col("lot")))
    counts = cut.groupBy(*keys, "piece").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(
        *[F.col(k).alias(f"of_{k}") for k in keys], F.col("piece").alias("in"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    same = F.col("piece") == F.col("in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "piece").orderBy("record_offset", "digest"))
    own = cut.withColumn("inside", inside).join(carried, same)
    return own.withColumn("nth", F.col("before") + F.col("inside")).drop("piece", "in", "before", "inside", *[f"of_{k}" for k in keys])


_FIELDS = ["page_id", "record_offset", "length", "digest", "lot"]


def _paired(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Full join of records with equal keys, one to one in the order of offsets; the replica's columns start with ``r_``."""
    other = _numbered(theirs, keys).select(*[F.col(c).alias(f"r_{c}") for c in [*_FIELDS, "nth"]])
    same = F.col("nth") == F.col("r_nth")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return staged(_numbered(ours, keys).join(other, same, "full"), "fixity_pairs")


def audit(places: DataFrame, replica: DataFrame, fan: int = FAN, span: int = SPAN) -> DataFrame:
    """(page_id, record_offset, length, digest, found, found_offset, status) of every record that is not intact.

    ``replica``: page_id, record (or digest and length) and its own record_offset.
    """
    theirs = digests(replica)
    if "record_offset" not in theirs.columns:
        theirs = theirs.withColumn("record_offset", F.lit(None).cast("long"))
    theirs = staged(theirs, "fixity_replica")
    placed = theirs.where("record_offset is not null").dropDuplicates(["page_id", "record_offset", "length", "digest"])
    furthest = places.select("record_offset").unionByName(placed.select("record_offset")).agg(F.max("record_offset")).first()[0]
    height, leaves = 0, (furthest or 0) // span
    while leaves:
        leaves, height = leaves // fan, height + 1
    bad = differing(tree(places, height, fan, span), tree(placed, height, fan, span), fan)
    here = lambda rows: rows.withColumn("idx", F.floor(F.col("record_offset") / span).cast("long")).join(bad, "idx", "left_semi").drop("idx")
    a, b = here(places.select("page_id", "record_offset", "length", "digest")), here(placed)

    def without(rows: DataFrame, known: DataFrame) -> DataFrame:
        known = known.select(*[F.col(c).alias(f"k_{c}") for c in _FIELDS[:4]])
        same = F.col("page_id").eqNullSafe(F.col("k_page_id"))
        for c in _FIELDS[1:4]:
            same = same & (F.col(c) == F.col(f"k_{c}"))
        return rows.join(known, same, "left_anti")

    lots = lambda rows, name: staged(rows.select(*_FIELDS[:4], F.spark_partition_id().alias("lot")), name)
    rest_a = lots(without(a, b), "fixity_ours")
    rest_b = lots(without(b, a).unionByName(theirs.where("record_offset is null").select(*b.columns)), "fixity_theirs")
    equal = _paired(rest_a, rest_b, ["page_id", "digest"])
    left_a = equal.where("r_nth is null").select(*_FIELDS)
    left_b = equal.where("nth is null").select(*[F.col(f"r_{c}").alias(c) for c in _FIELDS])
    changed = _paired(left_a, left_b, ["page_id"])
    status = (
        F.when(F.col("r_nth").isNull(), "missing").when(F.col("nth").isNull(), "extra")
        .when(F.col("length") != F.col("r_length"), "resized").otherwise("altered")
    )
    moved = equal.where("nth is not null and r_record_offset is not null").withColumn("status", F.lit("moved"))
    rows = moved.unionByName(changed.withColumn("status", status))
    is_extra = F.col("nth").isNull()
    return rows.select(
        F.when(is_extra, F.col("r_page_id")).otherwise(F.col("page_id")).alias("page_id"), "record_offset",
        F.when(is_extra, F.col("r_length")).otherwise(F.col("length")).alias("length"), "digest",
        F.col("r_digest").alias("found"), F.col("r_record_offset").alias("found_offset"), "status",
    )


def damaged(records: DataFrame) -> DataFrame:
    """Adds ``copy_digest`` and ``copy_length`` of a second copy of each record: some altered, cut short or lost (null)."""
    key, size = F.col("page_id"), F.octet_length("record")
    altered = F.concat(F.substring("record", F.lit(1), size - 1), F.encode(F.lit("!"), "UTF-8"))
    cut = F.substring("record", F.lit(1), size - 10)
    body = F.when(key % 101 == 7, altered).when(key % 103 == 11, cut).otherwise(F.col("record"))
    body = F.when(F.coalesce(key % 107 != 13, F.lit(True)), body)
    return records.withColumns({"copy_digest": F.sha2(body, 256), "copy_length": F.octet_length(body).cast("long")})


def op3_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record in the manifest and what the audit of the second copy says about it.

    The copy's records stand where they were written, so a lost or short one leaves a hole.
    """
    records = warc_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    both = manifest(damaged(records), ("copy_digest", "copy_length"))
    copy = both.where("copy_digest is not null")
    copy = copy.select("page_id", "record_offset", F.col("copy_digest").alias("digest"), F.col("copy_length").alias("length"))
    places = both.drop("copy_digest", "copy_length")
    bad = audit(places, copy).where("record_offset is not null").select(F.col("record_offset").alias("at"), "status")
    joined = places.join(bad, F.col("record_offset") == F.col("at"), "left")
    return joined.select("page_id", "record_offset", "length", "digest", F.coalesce("status", F.lit("intact")).alias("status"))


OP3_SQL = f"""
WITH records AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:md5:'
    || md5(coalesce(CAST(page_id AS VARCHAR), '') || ' ' || coalesce(url, '')) || '>' || chr(13) || chr(10) || 'WARC-Date: {_DATE}'
    || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
    || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
), digests AS (
  SELECT page_id, sha256(record) AS digest, CAST(strlen(record) AS BIGINT) AS length FROM records
)
SELECT page_id, length, digest,
       CAST(sum(length) OVER (ORDER BY page_id NULLS FIRST, digest ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS record_offset,
       CASE WHEN page_id % 107 = 13 THEN 'missing' WHEN page_id % 101 = 7 THEN 'altered' WHEN page_id % 103 = 11 THEN 'resized'
            ELSE 'intact' END AS status
FROM digests
"""
