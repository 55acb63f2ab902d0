"""Bitemporal statements: heads, histories, lenses, and admission."""

from __future__ import annotations

import datetime
import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.names import canonical
from quarry.functions.temporal import is_terminal, may_change, stored_status

KEY = ("world_id", "branch_id", "statement_id")


def heads(revisions: DataFrame, key: Sequence[str] = KEY, revision: str = "revision") -> DataFrame:
    """The latest revision of each statement; one shuffle, with partial maxima before it."""
    rest = [c for c in revisions.columns if c not in key]
    latest = revisions.groupBy(*key).agg(F.max_by(F.struct(*rest), revision).alias("r"))
    return latest.select(*key, "r.*").select(*revisions.columns)


def history(revisions: DataFrame, key: Sequence[str] = KEY, revision: str = "revision", status: str = "status") -> DataFrame:
    """All revisions with the status before each."""
    return revisions.withColumn("previous_status", F.lag(status).over(W.partitionBy(*key).orderBy(revision)))


def as_known_at(revisions: DataFrame, at: object, key: Sequence[str] = KEY, recorded: str = "recorded_at") -> DataFrame:
    """The heads as they were: the latest revisions recorded by then."""
    return heads(revisions.filter(F.col(recorded) <= F.lit(at)), key)


@dataclass(frozen=True)
class Lens:
    world_id: str
    branch_id: str
    context_kind: str | None = None
    actor_instance_id: str | None = None
    statuses: Sequence[str] = field(default_factory=tuple)
    modalities: Sequence[str] = field(default_factory=tuple)
    valid_at: str | None = None
    recorded_from: object = None
    recorded_to: object = None
    source_ids: Sequence[str] = field(default_factory=tuple)
    limit: int = 100
    #: Apply source_ids before the limit; by default it is applied to what the limit left.
    strict: bool = False


def lens(revisions: DataFrame, query: Lens) -> DataFrame:
    """Heads that meet the lens, latest recorded first, then by id. A validity holds at both of its ends."""
    now = heads(revisions.filter((F.col("world_id") == query.world_id) & (F.col("branch_id") == query.branch_id)))
    for name in ("context_kind", "actor_instance_id"):
        if getattr(query, name):
            now = now.filter(F.col(name) == getattr(query, name))
    for name, values in (("status", query.statuses), ("modality", query.modalities)):
        if values:
            now = now.filter(F.col(name).isin(*values))
    if query.valid_at:
        at = F.lit(f"instant:{query.valid_at}")
        now = now.filter((F.col("valid_from_key") <= at) & (F.col("valid_to_key") >= at))
    if query.recorded_from is not None:
        now = now.filter(F.col("recorded_at") >= F.lit(query.recorded_from))
    if query.recorded_to is not None:
        now = now.filter(F.col("recorded_at") <= F.lit(query.recorded_to))
    wanted = F.exists("source_ids", lambda s: s.isin(*query.source_ids)) if query.source_ids else None
    if wanted is not None and query.strict:
        now = now.filter(wanted)
    now = now.orderBy(F.desc("recorded_at"), "statement_id").limit(max(0, query.limit))
    return now.filter(wanted).orderBy(F.desc("recorded_at"), "statement_id") if wanted is not None and not query.strict else now


def admit(heads_: DataFrame, requests: DataFrame, receipts: DataFrame | None = None) -> DataFrame:
    """What becomes of requests, one for each statement: outcome, reason, revision and status, in this order of checks: the same idempotency key
    with another fingerprint is a conflict and with the same one a replay; a terminal head is closed; admitting needs no head, revising
    and retracting need one at the expected revision; a status must be allowed; superseding needs a reference.

    requests: statement_id, operation (admit, revise, retract), idempotency_key, fingerprint, expected_revision, decided_status, source,
    model_involved, superseded_by. heads_: statement_id, revision, status. receipts: idempotency_key, fingerprint.
    """
    h = heads_.select("statement_id", F.col("revision").alias("__revision"), F.col("status").alias("__status"))
    rows = requests.join(h, "statement_id", "left")
    if receipts is not None:
        rows = rows.join(receipts.select("idempotency_key", F.col("fingerprint").alias("__fingerprint")), "idempotency_key", "left")
    else:
        rows = rows.withColumn("__fingerprint", F.lit(None).cast("string"))
    op, head = F.col("operation"), F.col("__revision").isNotNull()
    status = F.when(op == "retract", "retracted").otherwise(stored_status(F.col("source"), F.col("model_involved"), F.col("decided_status")))
    reason = (
        F.when(F.col("__fingerprint") != F.col("fingerprint"), "idempotency-conflict")
        .when(F.col("__fingerprint").isNotNull(), "replay")
        .when(head & is_terminal(F.col("__status")), "terminal-head")
        .when((op == "admit") & head, "head-exists")
        .when((op != "admit") & ~head, "missing-head")
        .when((op != "admit") & (F.col("__revision") != F.coalesce(F.col("expected_revision"), F.lit(-1))), "expected-revision-mismatch")
        .when((op == "admit") & is_terminal(status), "terminal-admission")
        .when((op == "revise") & ~may_change(F.col("__status"), status), "invalid-transition")
        .when((op == "revise") & (status == "superseded") & F.col("superseded_by").isNull(), "superseded-requires-reference")
    )
    done = reason.isNull()
    return rows.select(
        *requests.columns,
        F.when(done, "committed").when(reason == "replay", "replayed").otherwise("refused").alias("outcome"),
        F.when(reason != "replay", reason).alias("reason"),
        F.when(done, F.coalesce(F.col("__revision"), F.lit(0)) + 1).alias("revision"),
        F.when(done, status).alias("status"),
    )


class Backfills:
    """Cursors of backfills that can be gone on with, in a folder: each change is a line of its own, and the last one counts."""

    SCHEMA = "seq long, backfill_id string, source_name string, status string, cursor string, updated_at string"
    STATUSES = ("running", "completed", "failed")

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def begin(self, backfill_id: str, source_name: str, cursor: object = None) -> dict[str, object]:
        return self.update(backfill_id, source_name, "running", cursor)

    def update(self, backfill_id: str, source_name: str, status: str, cursor: object = None) -> dict[str, object]:
        if status not in self.STATUSES:
            raise ValueError(f"a status is one of {', '.join(self.STATUSES)}")
        now = datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        row = (time.time_ns(), backfill_id, source_name, status, None if cursor is None else canonical(cursor), now)
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").json(self.folder)
        return self.get(backfill_id)

    def states(self) -> DataFrame:
        """The last state of each backfill."""
        rest = [c.split()[0] for c in self.SCHEMA.split(", ") if not c.startswith("backfill_id")]
        return self.spark.read.schema(self.SCHEMA).json(self.folder).groupBy("backfill_id").agg(F.max_by(F.struct(*rest), "seq").alias("s")).select("backfill_id", "s.source_name", "s.status", "s.cursor", "s.updated_at")

    def get(self, backfill_id: str) -> dict[str, object] | None:
        rows = self.states().filter(F.col("backfill_id") == backfill_id).collect()
        return None if not rows else rows[0].asDict() | {"cursor": None if rows[0].cursor is None else json.loads(rows[0].cursor)}
