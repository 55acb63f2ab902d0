"""A log of mutations, the state it stands for, and atomic batches over it."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import canonical

MOST_CONDITIONS, MOST_OPERATIONS, MOST_BYTES = 128, 128, 1 << 20


def latest(log: DataFrame, key: Sequence[str] | str = "key", sequence: str = "seq", deleted: str | None = None) -> DataFrame:
    """The current row of each key, with `ordinal`, the sequence of its first put since it last didn't exist. One shuffle, no sort."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in log.columns if c not in keys]
    last = F.max_by(F.struct(*rest), sequence).alias("r")
    if deleted is None:
        return log.groupBy(*keys).agg(last, F.min(sequence).alias("ordinal")).select(*keys, "r.*", "ordinal")
    # a put after a deletion takes a new place
    dead = F.max(F.when(F.col(deleted), F.col(sequence))).alias("dead")
    puts = F.array_sort(F.collect_list(F.when(~F.col(deleted), F.col(sequence)))).alias("puts")
    state = log.groupBy(*keys).agg(last, dead, puts).filter(~F.col(f"r.{deleted}"))
    return state.select(*keys, "r.*", F.element_at(F.filter("puts", lambda p: p > F.coalesce(F.col("dead"), F.lit(-1))), 1).alias("ordinal"))


def first_requests(requests: DataFrame, key: str = "idempotency_key", sequence: str = "seq") -> DataFrame:
    """The first request of each idempotency key; repeats are its replays."""
    rest = [c for c in requests.columns if c != key]
    return requests.groupBy(key).agg(F.min_by(F.struct(*rest), sequence).alias("r"), F.count("*").alias("attempts")).select(key, "r.*", "attempts")


def repeated_targets(batch: DataFrame, target: Sequence[str]) -> DataFrame:
    """Targets that a batch names more than once, for which it is refused."""
    return batch.groupBy(*target).agg(F.count("*").alias("n")).filter("n > 1")


def inserted(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return new.join(existing.select(key), key, "left_anti").select(*new.columns)


@dataclass(frozen=True)
class Condition:
    """kind: missing, present, or version (then it must be that one)."""

    key: str
    kind: str
    version: str | None = None


@dataclass(frozen=True)
class Operation:
    """kind: set or delete."""

    key: str
    kind: str
    value: object = None


class AtomicStore:
    """Keys and values in a log of files below a folder. A batch is decided on the driver against its keys' current rows, and is one file of the
    log, so it is there whole or not at all. One writer at a time: two that write the same sequence collide on the file's name."""

    SCHEMA = "seq long, key string, value string, version string, deleted boolean, idempotency_key string, request string"

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(path)

    def log(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).json(f"{self.folder}/log")

    def state(self) -> DataFrame:
        return latest(self.log().filter("key is not null"), "key", "seq", "deleted").select("key", "value", "version", "ordinal")

    def mutate(self, conditions: Sequence[Condition], operations: Sequence[Operation], idempotency_key: str | None = None) -> dict[str, object]:
        """outcome: committed, replayed, conflict (with the first key, in code-point order, whose condition fails) or idempotency-conflict."""
        if len(conditions) > MOST_CONDITIONS or len(operations) > MOST_OPERATIONS:
            raise ValueError("too many conditions or operations")
        for several in (conditions, operations):
            if len({x.key for x in several}) < len(several):
                raise ValueError("a target is named twice")
        request = canonical({"conditions": [[c.key, c.kind, c.version] for c in sorted(conditions, key=lambda c: c.key)], "operations": [[o.key, o.kind, o.value] for o in operations]})
        if len(request.encode()) > MOST_BYTES:
            raise ValueError("the request is too large")
        log = self.log()
        if idempotency_key is not None:
            before = log.filter(F.col("idempotency_key") == idempotency_key).select("request", "seq").limit(1).collect()
            if before:
                return {"outcome": "replayed" if before[0].request == request else "idempotency-conflict", "seq": before[0].seq}
        asked = sorted({c.key for c in conditions})
        now = {r.key: r.version for r in self.state().filter(F.col("key").isin(*asked)).select("key", "version").collect()} if asked else {}
        for c in sorted(conditions, key=lambda c: c.key):
            held = c.key in now if c.kind == "present" else c.key not in now if c.kind == "missing" else now.get(c.key) == c.version
            if not held:
                return {"outcome": "conflict", "key": c.key}
        seq = (log.agg(F.max("seq")).first()[0] or 0) + 1
        rows = [{"seq": seq, "key": o.key, "value": None if o.kind == "delete" else canonical(o.value), "version": f"v{seq}", "deleted": o.kind == "delete", "idempotency_key": idempotency_key, "request": request} for o in operations]
        rows = rows or [{"seq": seq, "idempotency_key": idempotency_key, "request": request}]
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log/{seq:020d}.json")
        temporary = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/.{seq:020d}-{time.time_ns()}.json")
        out = self.files.create(temporary, False)
        out.write(bytearray("\n".join(map(canonical, rows)).encode()))
        out.close()
        if not self.files.rename(temporary, path):
            self.files.delete(temporary, False)
            return {"outcome": "conflict", "key": None}
        return {"outcome": "committed", "seq": seq, "version": f"v{seq}"}
