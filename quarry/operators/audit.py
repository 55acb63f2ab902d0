"""Artifacts: queries, pages, integrity findings, repairs and verification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import cycle_edges

REPAIRS = {
    "object-without-record": "delete-unreferenced-object",
    "record-without-object": "delete-record-without-object",
    "size-mismatch": "reverify-imported-object",
    "digest-mismatch": "reverify-imported-object",
    "lineage-missing-source": "remove-invalid-lineage-edge",
    "lineage-missing-result": "remove-invalid-lineage-edge",
    "lineage-cycle": "remove-invalid-lineage-edge",
}
_EQUAL = {"media_type": "media_type", "kind": "kind", "producer_system": "producer.system", "producer_job_id": "producer.job_id", "producer_attempt_id": "producer.attempt_id", "producer_output_slot": "producer.output_slot"}


def query_predicate(query: Mapping[str, object]) -> Column:
    """All of: equalities, media_type_prefix, and created_after / created_before, neither of which includes its end."""
    out = F.lit(True)
    for name, value in query.items():
        if value is None:
            continue
        if name in _EQUAL:
            out = out & (F.col(_EQUAL[name]) == F.lit(value))
        elif name == "media_type_prefix":
            out = out & F.startswith("media_type", F.lit(value))
        elif name == "created_after":
            out = out & (F.col("created_at") > F.lit(value))
        elif name == "created_before":
            out = out & (F.col("created_at") < F.lit(value))
        else:
            raise ValueError(f"unknown condition {name!r}")
    return out


def page(df: DataFrame, limit: int = 50, after: tuple[object, object] | None = None, created: str = "created_at", id_: str = "id") -> DataFrame:
    """Newest first, then by id downwards; `after` is the (created, id) of the last row of the page before. 1 to 500 rows, found without an offset."""
    if after is not None:
        df = df.filter((F.col(created) < F.lit(after[0])) | ((F.col(created) == F.lit(after[0])) & (F.col(id_) < F.lit(after[1]))))
    return df.orderBy(F.desc(created), F.desc(id_)).limit(min(max(limit, 1), 500))


def cursor_page(df: DataFrame, limit: int = 50, cursor: str | None = None, created: str = "created_at", id_: str = "id") -> tuple[list, str | None]:
    """The rows of a page (500 at most) and the cursor of the next one, None on the last. A cursor is `created:id` of a row that df holds; another is refused."""
    after = None
    if cursor:
        name = F.concat_ws(":", F.col(created).cast("string"), F.col(id_).cast("string"))
        held = df.filter(name == F.lit(cursor)).select(created, id_).limit(1).collect()
        if not held:
            raise ValueError("invalid artifact cursor")
        after = (held[0][0], held[0][1])
    most = min(max(limit, 1), 500)
    if after is not None:
        df = df.filter((F.col(created) < F.lit(after[0])) | ((F.col(created) == F.lit(after[0])) & (F.col(id_) < F.lit(after[1]))))
    rows = df.withColumn("__cursor", F.concat_ws(":", F.col(created).cast("string"), F.col(id_).cast("string"))).orderBy(F.desc(created), F.desc(id_)).limit(most + 1).collect()
    kept = rows[:most]
    return [{k: v for k, v in r.asDict().items() if k != "__cursor"} for r in kept], kept[-1]["__cursor"] if len(rows) > most else None


def valid(findings: DataFrame, severity: str = "severity") -> DataFrame:
    """One row, ok: whether nothing found is an error."""
    return findings.agg(F.coalesce(F.every(F.coalesce(F.col(severity) != "error", F.lit(True))), F.lit(True)).alias("ok"))


def by_object(records: DataFrame) -> DataFrame:
    """object_key, n, ids (sorted) of the records that share an object."""
    return records.groupBy("object_key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


def repaired(records: DataFrame, objects: DataFrame, edges: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """records, objects and edges after the actions, and their receipts: action_id, outcome (`applied`, or `stale` where what was found no
    longer holds, and nothing is done). Reverified records take the size and digest of their objects; none is lost by it."""
    from quarry.storage import written

    now = object_findings(records, objects).union(lineage_findings(records, edges)).dropDuplicates()
    receipts = written(actions.join(now.withColumn("__held", F.lit(True)), ["code", "subject"], "left").select("action_id", "operation", "code", "subject", F.when(F.col("__held"), "applied").otherwise("stale").alias("outcome")))
    done = lambda operation: receipts.filter((F.col("operation") == operation) & (F.col("outcome") == "applied")).select(F.col("subject").alias("__subject")).distinct()
    named = lambda df, c: df.withColumn("__subject", F.col(c).cast("string"))
    objects_ = named(objects, "object_key").join(done("delete-unreferenced-object"), "__subject", "left_anti").select(*objects.columns)
    kept = named(records, "id").join(done("delete-record-without-object"), "__subject", "left_anti")
    fresh = kept.join(done("reverify-imported-object").withColumn("__again", F.lit(True)), "__subject", "left").join(objects.select("object_key", F.col("size").alias("__size"), F.col("digest").alias("__digest")), "object_key", "left")
    records_ = fresh.withColumns({"size": F.when(F.col("__again"), F.col("__size")).otherwise(F.col("size")), "digest": F.when(F.col("__again"), F.col("__digest")).otherwise(F.col("digest"))}).select(*records.columns)
    edges_ = named(edges, "id").join(done("remove-invalid-lineage-edge"), "__subject", "left_anti").select(*edges.columns)
    return records_, objects_, edges_, receipts.select("action_id", "outcome")


def object_findings(records: DataFrame, objects: DataFrame) -> DataFrame:
    """code, subject: records (id, object_key, size, digest) against objects (object_key, size, digest)."""
    o = objects.select("object_key", F.col("size").alias("__size"), F.col("digest").alias("__digest"), F.lit(True).alias("__there"))
    both = records.select("object_key", "id", "size", "digest").join(o, "object_key", "full_outer")
    codes = F.filter(
        F.array(
            F.when(F.col("id").isNull(), "object-without-record"),
            F.when(F.col("id").isNotNull() & F.col("__there").isNull(), "record-without-object"),
            F.when(F.col("id").isNotNull() & F.col("__there") & ~F.col("size").eqNullSafe(F.col("__size")), "size-mismatch"),
            F.when(F.col("id").isNotNull() & F.col("__there") & ~F.col("digest").eqNullSafe(F.col("__digest")), "digest-mismatch"),
        ),
        lambda c: c.isNotNull(),
    )
    found = both.select(F.explode(codes).alias("code"), "id", "object_key")
    return found.select("code", F.coalesce(F.col("id").cast("string"), F.col("object_key").cast("string")).alias("subject"))


def lineage_findings(records: DataFrame, edges: DataFrame, cycles: bool = True) -> DataFrame:
    """code, subject: edges (id, from, to) whose ends are no records, and those on or between cycles."""
    ids = records.select("id")
    missing = lambda side, code: edges.join(ids.select(F.col("id").alias(side)), side, "left_anti").select(F.lit(code).alias("code"), F.col("id").cast("string").alias("subject"))
    out = missing("from", "lineage-missing-source").union(missing("to", "lineage-missing-result"))
    if cycles:
        out = out.union(cycle_edges(edges).select(F.lit("lineage-cycle").alias("code"), F.col("id").cast("string").alias("subject")))
    return out


def audit(records: DataFrame, objects: DataFrame, edges: DataFrame) -> DataFrame:
    return object_findings(records, objects).union(lineage_findings(records, edges)).orderBy("code", "subject")


def repairs(findings: DataFrame, audit_id: str = "") -> DataFrame:
    """action_id, operation, code, subject: one action for each finding, named by a digest of what it does."""
    operation = F.create_map(*[F.lit(x) for pair in REPAIRS.items() for x in pair])[F.col("code")]
    rows = findings.select(operation.alias("operation"), "code", "subject").dropDuplicates()
    return rows.select(F.sha2(F.concat_ws("\u0000", F.lit(audit_id), "operation", "code", "subject"), 256).alias("action_id"), "operation", "code", "subject").orderBy("action_id")


def verify(records: DataFrame, objects: DataFrame) -> DataFrame:
    """id, sha256, ok: the digest of each record's bytes (objects: object_key, content) against the record's."""
    both = records.select("id", "object_key", "digest").join(objects.select("object_key", F.sha2(F.col("content").cast("binary"), 256).alias("sha256")), "object_key", "left")
    return both.select("id", "sha256", F.coalesce(F.col("sha256") == F.col("digest"), F.lit(False)).alias("ok"))


def assembled(chunks: DataFrame, key: str = "object_key", index: str = "chunk", content: str = "content") -> DataFrame:
    """key, n_chunks, size, content: chunks put together in order."""
    joined = F.aggregate(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(content).cast("binary").alias("c")))), F.lit("").cast("binary"), lambda s, x: F.concat(s, x["c"]))
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.sum(F.octet_length(F.col(content))).alias("size"), joined.alias("content"))


def parity(expected: DataFrame, actual: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """One row for each field that differs (nulls are equal to each other), and a row `missing` for each record that isn't there."""
    e = expected.select(on, F.struct(*fields).alias("__e"))
    a = actual.select(on, F.struct(*fields).alias("__a"))
    both = e.join(a, on, "left")
    text = lambda c: c.cast("string")
    each = F.array(*[F.struct(F.lit(f).alias("field"), text(F.col(f"__e.{f}")).alias("expected"), text(F.col(f"__a.{f}")).alias("actual")) for f in fields])
    gone = F.array(F.struct(F.lit("missing").alias("field"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual")))
    issues = F.when(F.col("__a").isNull(), gone).otherwise(F.filter(each, lambda x: ~x["expected"].eqNullSafe(x["actual"])))
    return both.select(on, F.explode(issues).alias("i")).select(on, "i.field", "i.expected", "i.actual")


def latencies(df: DataFrame, value: str, by: str | None = None, digits: int = 3) -> DataFrame:
    """median, p95, p99 (nearest rank) and maximum."""
    rank = lambda p: F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})"), digits)
    sums = [rank(0.5).alias("median"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.round(F.max(value), digits).alias("max"), F.count("*").alias("n")]
    return df.groupBy(by).agg(*sums) if by else df.agg(*sums)


def merged(parts: DataFrame, by: str, sums: Sequence[str] = (), most: Sequence[str] = ()) -> DataFrame:
    """Workers' reports put together: sums of some numbers, maxima of others."""
    return parts.groupBy(by).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in most])
