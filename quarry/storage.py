"""Tables written to storage that all executors share: where lineage ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, as in tests, local mode gets a folder of its own; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read again."""
    at = f"{shared_dir(df.sparkSession)}/quarry-{uuid.uuid4().hex}.parquet"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """df, marked for broadcast if it has at most `most_rows` rows; else the join is left to shuffle. df must be cheap to count."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def ship(spark: SparkSession) -> None:
    """Gives executors this package, for a session whose workers don't have the repository on their path."""
    import shutil
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_quarry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # it is in an archive already
        return
    base = Path(tempfile.mkdtemp(prefix="quarry-"))  # the driver serves the archive to the executors, which keep a copy
    shutil.copytree(root, base / "in" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{base}/quarry", "zip", base / "in"))
    context._quarry_shipped = True
