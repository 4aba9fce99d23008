"""Session settings the operators rely on, and the shared folder for written state."""

from __future__ import annotations

import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tesora", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # call-site capture costs several gateway calls per column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_base(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder, on every master.

    It is the setting ``spark.checkpoint.dir``, or what ``setCheckpointDir``
    named; without either, operators that write are refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{base.rstrip('/')}/tesora"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for one written table below the staging base."""
    return f"{staging_base(spark)}/{purpose}/{uuid.uuid4().hex}"


def clear_staging(spark: SparkSession) -> None:
    """Remove every table staged below this session's base, once nothing reads them any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging_base(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    """How many pieces a large ordered pass is cut into; it grows with the partitions the session asks for."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate table to the shared folder, at once, and read it back.

    Several branches of a plan then start from one small table instead of each
    scanning the source again; its size is known to the optimizer and it
    survives lost executors.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession, archive: str) -> None:
    """Zip this package to ``archive`` (a path of the driver, without ``.zip``) and send it to every executor.

    Needed where the cluster's workers lack the package and the job was not
    started with ``--py-files``.
    """
    package = Path(__file__).resolve().parent
    spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))
