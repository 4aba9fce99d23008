from __future__ import annotations

import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tesora import session as ss
from tesora.operators import prefix as px


class Unset:
    """A session without any checkpoint folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "local[4]"
        getCheckpointDir = staticmethod(lambda: None)


def test_staging_needs_a_named_folder_on_every_master():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ss.shared_folder(Unset(), "x")


def test_written_tables_lie_below_the_checkpoint_folder(spark):
    path = ss.shared_folder(spark, "purpose")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and "/purpose/" in path
    assert path != ss.shared_folder(spark, "purpose")
    df = ss.materialize(spark.range(5), "numbers")
    assert df.count() == 5 and "/numbers/" in df.inputFiles()[0]


def test_no_machine_local_folder_in_the_package():
    package = Path(ss.__file__).parent
    assert not [p for p in package.rglob("*.py") if "tempfile" in p.read_text()]


def test_the_package_can_be_sent_to_workers(spark, tmp_path):
    ss.ship(spark, str(tmp_path / "sent"))
    with zipfile.ZipFile(tmp_path / "sent.zip") as archive:
        assert "tesora/session.py" in archive.namelist()
    code = f"import sys; sys.path.insert(0, {str(tmp_path / 'sent.zip')!r}); import tesora.functions.scalar as s; print(s.__file__)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, check=True).stdout
    assert "sent.zip" in out


def test_series_are_cut_into_even_pieces(spark):
    # nearly all rows of one series fall on one day
    rows = spark.range(4000).select(F.lit("a").alias("k"), F.when(F.col("id") < 3900, F.col("id") / 86400).otherwise(F.col("id")).alias("t"))
    cut = px.cut_series(rows.repartition(6), ["k"], "t", pieces=10)
    sizes = [r["count"] for r in cut.groupBy("piece").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 2 * 4000 / 8
    ends = cut.groupBy("piece").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("piece").collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(ends, ends[1:]))
