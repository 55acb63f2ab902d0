"""Storage shared by all executors, and sizes taken from the plan."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.storage import shared_dir, written

__all__ = ["dropped", "shards_for", "shared_dir", "swept", "table_bytes", "written"]


def dropped(df: DataFrame) -> None:
    """Deletes the files of a written() table that nothing reads any more."""
    spark = df.sparkSession
    if files := df.inputFiles():
        at = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def swept(spark: SparkSession, seconds: float = 2.0) -> None:
    """Has the driver's JVM find out which shuffles nothing refers to any more, and waits for executors to drop their files: the next pass then doesn't add to the last one's."""
    gc.collect()  # Python's handles of the JVM's objects refer to each other
    spark._jvm.System.gc()
    time.sleep(seconds)


def table_bytes(df: DataFrame, text: str = "text") -> int:
    """About the bytes of df's files where its plan only reads, cuts and filters them, for which no job runs; else the bytes of its texts, summed up."""
    plan = df._jdf.queryExecution().optimizedPlan()
    seen = plan.toString()
    if "Relation [" in seen and not any(x in seen for x in ("Join", "Aggregate", "LogicalRDD", "MapIn", "Window", "Generate", "Union", "Flat")):
        return int(str(plan.stats().sizeInBytes()))
    return df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def shards_for(df: DataFrame, shard_bytes: int, text: str = "text") -> int:
    """So many shards that each stands for about shard_bytes of df."""
    return max(1, -(-table_bytes(df, text) // shard_bytes))
