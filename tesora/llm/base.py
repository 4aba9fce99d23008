"""What the operators of this package share: whole-text scans, words, folds and written intermediates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tesora.session import shared_folder

Build = Callable[[SparkSession, str], DataFrame]

#: Words are runs of anything but the six ASCII blanks, which is how ``bytes.split()`` cuts.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Lower case for A-Z only; safe on UTF-8 because other code points have no ASCII bytes.
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of rows that Spark sends to Python at once, and its setting.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in small batches (all of them; a longer text is a batch of its own).

    Spark's default is 10,000 rows, which both the executor and the worker hold,
    at twice their size while they grow. A session that sets a size keeps it.
    """
    if not spark.conf.get(_BATCH, None):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text; none for null."""
    return text.encode("utf-8", "replace").translate(ASCII_LOWER).split() if text else []


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def order_hash(*columns: str) -> Column:
    """A pseudo-random but repeatable order of rows."""
    return F.xxhash64(*[F.col(c) for c in columns])


def write_shared(df: DataFrame, purpose: str) -> str:
    """Write a table below the cluster's checkpoint folder; returns its path."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return path


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage with a written table: a lost executor then costs one task."""
    return df.sparkSession.read.schema(df.schema).parquet(write_shared(df, purpose))


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str | None]:
    """One text at a time, so that only one is a Python object."""
    for value in batch.column(column):
        yield value.as_py()


def add_columns(
    df: DataFrame,
    new: Sequence[tuple[str, DataType]],
    compute: Callable[[pa.RecordBatch], Iterable],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of ``df`` with columns computed per Arrow batch.

    ``compute`` returns one array per new column. ``keep`` names the columns to
    carry along (all by default).
    """
    keep = list(df.columns if keep is None else keep)
    fields = [df.schema[c] for c in keep]
    schema = StructType([*fields, *[StructField(n, t) for n, t in new]])
    names = [*keep, *[n for n, _ in new]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                arrays = [batch.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(x) for x in compute(batch)]], names)

    return df.mapInArrow(run, schema)


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Smaller batches, to bound what one step holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length, one after another."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    return out - np.repeat(np.cumsum(lengths) - lengths, lengths)
