"""Delimited text under a contract: explicit columns, mapped columns, and unknown encodings."""

from __future__ import annotations

import codecs
import csv
import io
import itertools
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import IO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesora.functions.scalar import parse_number
from tesora.operators.contracts import ERROR, Rule, Split, clean_header, missing_columns, split
from tesora.sources.faults import member_problem, opened, small_member

# Known public sources and the columns a mapping must define.
PUBLIC_SOURCES = ("fns_5_ndfl", "fns_7_ndfl", "fns_kkt", "rosstat_pmo", "other_public")
INCOME_SOURCES = ("fns_5_ndfl", "fns_7_ndfl")
MAPPED_COLUMNS = ("oktmo", "period", "indicator", "value", "unit")
ENCODINGS = ("utf-8-sig", "utf-8", "cp1251")
SPARK_ENCODINGS = ("utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32")


def scan_export(spark: SparkSession, path: str, required: Sequence[str], *, sep: str = ";") -> DataFrame:
    """All columns as text, header trimmed and freed of a byte order mark, required columns present."""
    df = clean_header(spark.read.option("header", True).option("sep", sep).option("quote", '"').csv(path))
    missing = missing_columns(df, required)
    if missing:
        raise ValueError("columns missing: " + ", ".join(missing))
    return df


def scan_zipped_export(spark: SparkSession, path: str, required: Sequence[str], *, sep: str = ";") -> Split:
    """The same export packed as zip archives."""
    return unpacked_exports(spark.read.format("binaryFile").load(path), required, sep=sep)


def unpacked_exports(files: DataFrame, required: Sequence[str], *, sep: str = ";") -> Split:
    """Rows of archives holding exactly one CSV file each; other archives go aside with a reason.

    A small member is read once, a larger one is streamed, never unpacked whole.
    A broken, encrypted or unreadable archive only sets itself aside. Both sides
    are read from the archives; ``marked`` has them from one reading.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):  # one archive at a time
                path = path.as_py()
                with opened(content.as_py()) as (archive, problem):
                    names = [] if problem else [n for n in archive.namelist() if n.lower().endswith(".csv")]
                    held = small_member(archive, names[0]) if len(names) == 1 else None
                    if not problem and held is None:
                        problem = member_problem(archive, names[0]) if len(names) == 1 else "NOT_ONE_CSV"
                    if problem:
                        yield path, 0, [], [], problem
                    elif held is not None:
                        yield from _lines(path, lambda held=held: io.BytesIO(held), ENCODINGS, sep)
                    else:
                        yield from _lines(path, lambda archive=archive, name=names[0]: archive.open(name), ENCODINGS, sep)

    cells = [f"_c{i}" for i in range(len(required))]
    schema = ", ".join(["path string", "line_no int", *[f"{c} string" for c in cells], "problem string"])
    records = files.select("path", "content").mapInArrow(lambda batches: _named(unpack(batches), required), schema)
    named = [F.col(cell).alias(c) for cell, c in zip(cells, required)]
    clean = records.where(F.col("problem").isNull()).select("path", "line_no", *named)
    bad = records.where(F.col("problem").isNotNull()).select("path", F.col("problem").alias("reason_code"))
    return Split(clean, bad, records.select("path", "line_no", *named, F.col("problem").alias("reason_code")))


def scan_mapped(spark: SparkSession, path: str, config: Mapping) -> Split:
    """A public aggregate file read as text and renamed by its mapping.

    ``config``: source, columns (canonical name to file column), category,
    period_format (Spark pattern), available_at, and optional separator and encoding.
    """
    source, category = config["source"], config["category"]
    if source not in PUBLIC_SOURCES:
        raise ValueError("unknown source")
    mapping = config["columns"]
    if set(mapping) != set(MAPPED_COLUMNS):
        raise ValueError("a mapping defines exactly " + ", ".join(MAPPED_COLUMNS))
    if source in INCOME_SOURCES and category != "all":
        raise ValueError("personal income is an all-category feature")
    sep, encoding = config.get("separator", ","), config.get("encoding", "utf-8")
    wanted = list(mapping.values())
    if encoding.lower() in SPARK_ENCODINGS:
        df = clean_header(spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path))
    else:
        df = rows_with_header(scan_unknown_encoding(spark, path, encodings=(encoding,), sep=sep), wanted)
    missing = missing_columns(df, list(mapping.values()))
    if missing:
        raise ValueError("source columns missing: " + ", ".join(missing))
    raw = df.select(*[F.col(f"`{mapping[c]}`").alias(c) for c in MAPPED_COLUMNS])
    typed = raw.select(
        "oktmo",
        F.try_to_timestamp("period", F.lit(config["period_format"])).cast("timestamp_ntz").alias("period"),
        F.lit(category).alias("category"),
        "indicator",
        parse_number("value").alias("value"),
        "unit",
        F.lit(source).alias("source"),
        F.lit(config["available_at"]).cast("timestamp_ntz").alias("available_at"),
        F.lit(False).alias("is_estimated"),
    )
    rules = [
        Rule("BAD_CODE", ERROR, F.coalesce(~F.col("oktmo").rlike("^[0-9]{8}([0-9]{3})?$"), F.lit(True))),
        Rule("BAD_PERIOD", ERROR, F.col("period").isNull()),
        Rule("BAD_VALUE", ERROR, F.coalesce(F.col("value") < 0, F.lit(True))),
    ]
    return split(typed, rules)


RECORDS = "path string, line_no int, header array<string>, fields array<string>, problem string"


def _encoding_of(open_: Callable[[], IO[bytes]], encodings: Sequence[str]) -> str | None:
    """The first encoding that decodes the whole stream; the stream is read in pieces."""
    for encoding in encodings:
        decoder = codecs.getincrementaldecoder(encoding)()
        try:
            with open_() as stream:
                while piece := stream.read(1 << 20):
                    decoder.decode(piece)
            decoder.decode(b"", True)
            return encoding
        except UnicodeDecodeError:
            continue
    return None


def _separator(header: str) -> str:
    """The separator seen most often in the header line."""
    return max(",;\t|", key=header.count)


def _lines(path: str, open_: Callable[[], IO[bytes]], encodings: Sequence[str], sep: str | None) -> Iterator[tuple]:
    """The records of one file, read as they come."""
    encoding = _encoding_of(open_, encodings)
    if encoding is None:
        yield path, 0, [], [], "UNREADABLE_TEXT"
        return
    with io.TextIOWrapper(open_(), encoding=encoding, newline="") as text:
        blank, head = [], ""
        for head in text:  # up to the first line with something on it
            head = head if blank else head.lstrip("\ufeff")
            if head.strip("\r\n"):
                break
            blank.append(head)
        lines = csv.reader(itertools.chain(blank, [head], text), delimiter=sep or _separator(head))
        i, header = 0, []
        while True:
            try:
                fields = next(lines, None)
            except csv.Error:
                yield path, i, header, [], "UNREADABLE_CSV"
                return
            if fields is None:
                return
            header = header if i else [c.strip() for c in fields]
            yield path, i, header, fields, None
            i += 1


def _frames(records: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Records in tables of a bounded size."""
    names = ["path", "line_no", "header", "fields", "problem"]
    csv.field_size_limit(sys.maxsize)
    rows, held = [], 0
    for record in records:
        rows.append(record)
        held += sum(map(len, record[3]))
        if len(rows) >= 10_000 or held >= 1 << 24:
            yield pd.DataFrame(rows, columns=names)
            rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names)


def _named(records: Iterator[tuple], columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The lines below each header with the cells of the wanted columns, and the files with a problem.

    A header is matched once a file; a line that is too short has no value there.
    """
    schema = pa.schema([("path", pa.string()), ("line_no", pa.int32()), *[(f"_c{i}", pa.string()) for i in range(len(columns))], ("problem", pa.string())])
    csv.field_size_limit(sys.maxsize)
    rows, held, matched, places = [], 0, None, []
    for path, i, header, fields, problem in records:
        if problem is None and i == 0:
            continue
        if header is not matched:
            matched, places = header, [header.index(c) if c in header else sys.maxsize for c in columns]
        cells = [None] * len(columns) if problem else [fields[at] if at < len(fields) else None for at in places]
        rows.append((path, i, *cells, problem))
        held += sum(map(len, fields))
        if len(rows) >= 10_000 or held >= 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def text_records(files: DataFrame, *, encodings: Sequence[str] = ENCODINGS, sep: str | None = None) -> DataFrame:
    """``(path, line_no, header, fields, problem)`` from files given as ``path`` and ``content``.

    The first encoding that decodes a file counts; a missing separator is
    guessed from the file's first lines. Line 0 holds the header, which every
    line of the file carries. Lines may end in any of the usual ways and fields
    may have any length. A file that cannot be read goes on with its problem
    and never stops the others; so does one that arrives with a ``problem``.
    """

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for path, content, problem in zip(batch["path"], batch["content"], batch["problem"]):
                if problem or content is None:
                    yield path, 0, [], [], problem or "UNREADABLE_TEXT"
                else:
                    yield from _lines(path, lambda content=content: io.BytesIO(content), encodings, sep)

    problem = F.col("problem") if "problem" in files.columns else F.lit(None).cast("string")
    return files.select("path", "content", problem.alias("problem")).mapInPandas(lambda batches: _frames(records(batches)), RECORDS)


def scan_unknown_encoding(
    spark: SparkSession, path: str, *, encodings: Sequence[str] = ENCODINGS, sep: str | None = None
) -> DataFrame:
    """Many uploaded files at once, each with its own encoding and separator.

    A file is read whole by one task (uploads are small); the parallel axis is
    the number of files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return text_records(files, encodings=encodings, sep=sep)


def rows_with_header(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Named columns from scanned records, matched by each file's own header line."""
    body = records.where((F.col("line_no") > 0) & F.col("problem").isNull())
    cells = [
        F.when(F.array_position("header", c) > 0, F.try_element_at("fields", F.array_position("header", c).cast("int"))).alias(c)
        for c in columns
    ]
    return body.select("path", "line_no", *cells)


def typed_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to the declared types; what does not parse is NULL."""
    out = []
    for f in schema.fields:
        c = F.col(f.name)
        out.append((parse_number(c) if isinstance(f.dataType, T.DoubleType) else c.try_cast(f.dataType)).alias(f.name))
    return df.select(*out)
