"""Resumable copies: ranges of a table by ordinal, with a ledger, or a stream with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.names import canonical


def manifest(df: DataFrame, start: int, ordinal: str = "ordinal") -> DataFrame:
    """What is left of a manifest of which `start` entries are done."""
    return df.filter(F.col(ordinal) >= start)


LEDGER = "lane string, processed long, plan string"
PLAN = ("schema", "plan_digest", "source_identity", "destination_identity")


def plan_text(plan: Mapping[str, str] | None) -> str:
    """A plan's identity in canonical form; of one that isn't whole an error, of none an empty text."""
    if plan is None:
        return ""
    if set(plan) != set(PLAN) or not all(isinstance(v, str) and v for v in plan.values()):
        raise ValueError(f"a plan's identity has {', '.join(PLAN)}, each a text")
    return canonical(dict(plan))


def _ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER).json(ledger)


def lanes_done(spark: SparkSession, ledger: str, plan: Mapping[str, str] | None = None) -> dict[str, int]:
    """How many entries of each lane are done. What was begun with a plan goes on with that one only, and what was begun without needs `bound` first."""
    rows = _ledger(spark, ledger)
    if rows is None:
        return {}
    lanes = rows.groupBy("lane").agg(F.max("processed").alias("n"), F.collect_set("plan").alias("plans")).collect()
    mine = plan_text(plan)
    for lane in lanes:
        for theirs in lane.plans:
            if theirs and not mine:
                raise ValueError("going on with a plan's copy requires the plan")
            if mine and not theirs:
                raise ValueError("a copy that was begun without a plan must be bound to one first")
            if theirs != mine:
                raise ValueError("the plan isn't the one that the copy was begun with")
    return {r.lane: r.n for r in lanes}


def bound(spark: SparkSession, ledger: str, plan: Mapping[str, str], to: str) -> None:
    """The ledger of a copy that was begun without a plan, written to another place as one of this plan; nothing of the plan is inferred."""
    rows = _ledger(spark, ledger)
    if rows is None or rows.filter("plan <> ''").limit(1).count():
        raise ValueError("there is no such ledger without a plan")
    rows.groupBy("lane").agg(F.max("processed").alias("processed")).select("lane", "processed", F.lit(plan_text(plan)).alias("plan")).write.json(to)


def copy(df: DataFrame, to: str, ledger: str, lane: str, batch_size: int = 1_000_000, ordinal: str = "ordinal", on_batch: Callable[[str, int], None] | None = None, plan: Mapping[str, str] | None = None) -> int:
    """Copies rows in ranges of `ordinal` (0, 1, ...); a range is done when the ledger says so. A range that was cut off is written again over itself,
    so an interrupted copy goes on without a repeat. Returns the number of rows done. plan: what the copy is bound to (see `lanes_done`)."""
    spark, mine = df.sparkSession, plan_text(plan)
    total, done = 0 if (last := df.agg(F.max(ordinal)).first()[0]) is None else last + 1, lanes_done(spark, ledger, plan).get(lane, 0)
    while done < total:
        end = min(done + batch_size, total)
        df.filter((F.col(ordinal) >= done) & (F.col(ordinal) < end)).write.mode("overwrite").parquet(f"{to}/batch={done:020d}")
        done = end
        spark.createDataFrame([(lane, done, mine)], LEDGER).coalesce(1).write.mode("append").json(ledger)
        if on_batch:
            on_batch(lane, done)
    return done


def copy_all(tables: Sequence[tuple[str, DataFrame]], to: str, ledger: str, **options) -> dict[str, int]:
    """Copies of several collections in turn; a name that comes twice is refused before anything is written."""
    names = [name for name, _ in tables]
    if len(set(names)) < len(names):
        raise ValueError("a collection is named twice")
    return {name: copy(df, f"{to}/{name}", ledger, f"collection:{name}", **options) for name, df in tables}


def stream_copy(spark: SparkSession, source: str, schema: str, to: str, checkpoint: str, key: str | None = None, verify: Callable[[DataFrame, int], None] | None = None):
    """A stream of files to Parquet that takes what is there and ends. A batch has its own folder by its number, so a repeat after a fault replaces itself;
    with a key, rows whose key an earlier batch brought are dropped."""
    rows = spark.readStream.schema(schema).parquet(source)
    if key:
        rows = rows.dropDuplicates([key])

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/batch={number:020d}")
        if verify:
            verify(batch, number)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unexpired(leases: DataFrame, now: object) -> DataFrame:
    """The lease of the highest generation of each key that has not run out."""
    rest = [c for c in leases.columns if c != "key"]
    return leases.filter(F.col("expires_at") > F.lit(now)).groupBy("key").agg(F.max_by(F.struct(*rest), "generation").alias("l")).select("key", "l.*")


def expired(leases: DataFrame, now: object, limit: int) -> DataFrame:
    """What to clear away, oldest first."""
    return leases.filter(F.col("expires_at") <= F.lit(now)).orderBy("expires_at", "key").limit(limit)
