"""Cutting lineage with tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and all executors are threads of this
    machine is a temporary folder taken and recorded in the session; on a
    cluster a missing setting raises, as each machine would write to itself.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Survives the loss of executors: what later stages read is a file, not a
    block held by one of them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpusloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def keep(spark: SparkSession, path: str) -> None:
    """Remember a folder that is needed until the application ends (``release`` removes it earlier)."""
    _written.append((spark, path))


def release() -> None:
    """Remove what was written so far, for sessions that live long; frames made of it can't be read any more."""
    _remove()
    _written.clear()


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone
            pass


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is.

    Give it a materialised frame: the count is then a read of Parquet footers.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
