"""Files as rows: signatures, digests, manifests, archive members and dispatch by name."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Leading bytes by file kind, and name tokens by parser in order of precedence.
SIGNATURES = {
    "504B0304": "ZIP_OR_XLSX",
    "D0CF11E0A1B11AE1": "OLE_COMPOUND",
    "526172211A07": "RAR",
    "25504446": "PDF",
}
DISPATCH_RULES = (
    ("budget_quality", ("расчет по итогам",)),
    ("article136", ("ст.136", "ст 136")),
    ("prospective_financial_plan", ("перспективный финансовый план",)),
    ("expenditure_obligations", ("реестр расходных обязательств", "свод реестров")),
    ("classification_mapping", ("сопоставительная таблица", "приложение к порядку")),
    ("budget_execution_archive", ("исполн", "бюджет")),
)
MEMBERS = "path string, member_name string, size_bytes long, compressed_bytes long, unsafe boolean, problem string"


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def signature(content: Column | str) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    kind = F.lit("UNKNOWN")
    for lead, name in SIGNATURES.items():
        kind = F.when(head.startswith(lead), name).otherwise(kind)
    return kind


def file_signatures(files: DataFrame) -> DataFrame:
    return files.select("path", signature("content").alias("signature"))


def text_digest(content: Column | str) -> tuple[Column, Column]:
    """SHA-256 and length with CRLF read as LF, so both platforms agree.

    Latin-1 maps each byte to one character and back, which makes the
    replacement exact for any content.
    """
    content = F.col(content) if isinstance(content, str) else content
    unix = F.encode(F.replace(F.decode(content, "ISO-8859-1"), F.lit("\r\n"), F.lit("\n")), "ISO-8859-1")
    return F.sha2(unix, 256), F.length(unix).cast("long")


def relative_path(path: Column | str, root: str) -> Column:
    """The part of a path below a root folder; the root is taken literally."""
    path = F.col(path) if isinstance(path, str) else path
    bare = F.regexp_replace(path, "^file:/+", "/")
    lead = root.rstrip("/") + "/"
    return F.when(bare.startswith(lead), F.substring(bare, F.lit(len(lead) + 1), F.length(bare))).otherwise(bare)


def build_manifest(
    files: DataFrame, *, root: str, extensions: Sequence[str] = (".csv", ".json"), exclude: Sequence[str] = ()
) -> DataFrame:
    """Relative path, digest and size of the wanted files. ``exclude`` are regular expressions."""
    rel = relative_path("path", root)
    df = files.withColumn("path", rel)
    wanted = F.lit(False)
    for ext in extensions:
        wanted = wanted | F.lower("path").endswith(ext.lower())
    df = df.where(wanted)
    for pattern in exclude:
        df = df.where(~F.col("path").rlike(pattern))
    sha, size = text_digest("content")
    return df.select("path", sha.alias("sha256"), size.alias("size_bytes"))


def lineage(files: DataFrame, source_id: str) -> DataFrame:
    """One lineage row per source file."""
    return files.select(
        F.lit(source_id).alias("source_id"),
        F.element_at(F.split("path", "/"), -1).alias("source_file"),
        F.sha2("content", 256).alias("source_sha256"),
        F.col("length").alias("size_bytes"),
    )


def upsert_manifest(existing: DataFrame, new: DataFrame, *, source_id: str = "source_id") -> DataFrame:
    """Replace all manifest rows of the sources that appear in ``new``."""
    kept = existing.join(new.select(source_id).distinct(), source_id, "left_anti").select(*existing.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def table_digest(df: DataFrame, *, parts: int = 256) -> DataFrame:
    """Order-free digest of a table: row digests are combined per part, then over the parts.

    Parts are cut by the digest itself and each holds sums of row digests, so no
    task sees more than running totals.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    slices = [F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    rows = df.select(row.alias("d"))
    part = F.pmod(F.xxhash64("d"), F.lit(parts))
    sums = rows.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"s{i}") for i, s in enumerate(slices)]
    )
    text = F.concat_ws(":", F.sum("n").cast("string"), *[F.sum(f"s{i}").cast("string") for i in range(4)])
    return sums.agg(F.sum("n").alias("rows"), F.sha2(text, 256).alias("snapshot_id"))


# ---- archives ----------------------------------------------------------------


def _is_unsafe(name: str) -> bool:
    p = PurePosixPath(name.replace("\\", "/"))
    return p.is_absolute() or ".." in p.parts


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "member_name", "size_bytes", "compressed_bytes", "unsafe", "problem"]
    for batch in batches:
        rows: list[tuple] = []
        for path, content in zip(batch["path"], batch["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    infos = [i for i in archive.infolist() if not i.is_dir()]
            except zipfile.BadZipFile:
                rows.append((path, None, None, None, None, "NOT_AN_ARCHIVE"))
                continue
            rows += [(path, i.filename, i.file_size, i.compress_size, _is_unsafe(i.filename), None) for i in infos]
        yield pd.DataFrame(rows, columns=names)


def archive_members(files: DataFrame) -> DataFrame:
    """Members of every archive; names leaving the archive are marked unsafe, never followed."""
    return files.select("path", "content").mapInPandas(_members, MEMBERS)


def safe_archives(members: DataFrame) -> DataFrame:
    """Archives without an unsafe member, with member counts and sizes."""
    per = members.where(F.col("problem").isNull()).groupBy("path").agg(
        F.max("unsafe").alias("_u"), F.count(F.lit(1)).alias("members"), F.sum("size_bytes").alias("size_bytes")
    )
    return per.where(~F.col("_u")).drop("_u")


# ---- dispatch ----------------------------------------------------------------


def parser_id(file_name: Column | str, rules: Sequence[tuple[str, Sequence[str]]] = DISPATCH_RULES) -> Column:
    """Parser of the first rule with a token in the lower-cased name, otherwise ``unknown``."""
    name = F.lower(F.col(file_name) if isinstance(file_name, str) else file_name)
    out = F.lit("unknown")
    for parser, tokens in reversed(rules):
        hit = F.lit(False)
        for token in tokens:
            hit = hit | name.contains(token)
        out = F.when(hit, parser).otherwise(out)
    return out


def dispatch(df: DataFrame, path: str = "path", rules: Sequence[tuple[str, Sequence[str]]] = DISPATCH_RULES) -> DataFrame:
    base = F.element_at(F.split(F.col(path), "/"), -1)
    return df.withColumn("parser_id", parser_id(base, rules)).withColumn(
        "status", F.when(F.col("parser_id") == "unknown", "QUARANTINE").otherwise("READY")
    )
