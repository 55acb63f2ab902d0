"""Layered documents: base and patches, provenance, references between documents, validation."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.names import canonical, dot_string, ref_matches

MOST_DEPTH = 32


def is_patch(doc: object) -> bool:
    return isinstance(doc, dict) and isinstance(doc.get("$patch"), str)


def merge(existing: object, incoming: object, strategy: str | Callable[[object, object], object] = "replace") -> object:
    """replace takes the incoming value; array-replace puts its keys over the existing ones; deep does so at every level."""
    if callable(strategy):
        return strategy(existing, incoming)
    if strategy == "replace" or not (isinstance(existing, dict) and isinstance(incoming, dict)):
        return incoming
    if strategy == "array-replace":
        return existing | incoming
    if strategy != "deep":
        raise ValueError(f"unknown strategy {strategy!r}")
    return existing | {k: merge(existing[k], v, "deep") if k in existing else v for k, v in incoming.items()}


def fold(layers: list[tuple[int, str, object]], strategy: str | Callable = "deep") -> tuple[object, list[tuple[str, str]], str | None]:
    """Value, provenance (path, kind) and error of one document's layers (priority, path, document), lowest priority first.

    The highest layer that is no patch is the base. What is below it is replaced (or, if a patch, shadowed); patches above it of a higher
    priority are merged in turn, others are shadowed.
    """
    base = next((k for k in range(len(layers) - 1, -1, -1) if not is_patch(layers[k][2])), None)
    if base is None:
        return None, [], "patch-without-base"
    value, steps = layers[base][2], [(path, "shadowed" if is_patch(doc) else "replace") for _, path, doc in layers[:base]]
    steps.append((layers[base][1], "base"))
    for priority, path, doc in layers[base + 1 :]:
        if priority <= layers[base][0]:
            steps.append((path, "shadowed"))
            continue
        value = merge(value, {k: v for k, v in doc.items() if k != "$patch"}, strategy)
        steps.append((path, "patch"))
    return value, steps, None


def layered(layers: DataFrame, strategy: str | Callable = "deep") -> DataFrame:
    """ref, value (JSON), provenance (array of path and kind), error of each document. layers: ref, priority, ord, path, doc (JSON). Rows go by in the
    order of documents; a task holds the layers of one at a time."""

    def one(ref: object, rows: list[tuple]) -> tuple:
        try:
            if any(p is None for p, _, _ in rows):
                raise ValueError("a layer without priority")
            value, steps, error = fold([(int(p), path, json.loads(d)) for p, path, d in rows], strategy)
            text = None if error else canonical(value)
        except ValueError as bad:
            text, steps, error = None, [], f"parse: {bad}"[:200]
        return ref, text, [{"path": p, "kind": k} for p, k in steps], error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []  # one document's layers; they may go on in the next batch
        done: list[tuple] = []
        for batch in batches:
            for ref, *layer in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if rows and ref != at:
                    done.append(one(at, rows))
                    rows = []
                at = ref
                rows.append(tuple(layer))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(one(at, rows), kinds, strict=True)], names)

    names = ["ref", "value", "provenance", "error"]
    kinds = [pa.string(), pa.string(), pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string())])), pa.string()]
    # sorted, the layers of a document follow each other: no call for each document
    rows = layers.select(F.col("ref").cast("string"), "priority", "ord", F.col("path").cast("string"), F.col("doc").cast("string")).repartition("ref").sortWithinPartitions("ref", "priority", "ord")
    return rows.select("ref", "priority", "path", "doc").mapInArrow(run, "ref string, value string, provenance array<struct<path string, kind string>>, error string")


def layered_columns(base: DataFrame, patches: DataFrame, on: str, priority: str = "priority") -> DataFrame:
    """The same for flat tables, without leaving the JVM: patches (on, priority, any of base's columns; null leaves a column alone) over base."""
    fields = [c for c in patches.columns if c not in (on, priority)]
    top = patches.groupBy(on).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(priority))).alias(f"__{c}") for c in fields], F.count("*").alias("n_patches"))
    joined = base.join(top, on, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns], F.coalesce("n_patches", F.lit(0)).alias("n_patches"))


def walk(value: object, path: tuple[str, ...] = (), bare: bool = True, depth: int = 0) -> Iterator[tuple[str, tuple[str, ...]]]:
    """References in a document, {"$ref": ...} or (bare) canonical strings, with their field paths, at most 32 levels down."""
    if depth > MOST_DEPTH or value is None:
        return
    if isinstance(value, str):
        if bare and ref_matches(value):
            yield value, path
    elif isinstance(value, list):
        for k, child in enumerate(value):
            yield from walk(child, (*path, str(k)), bare, depth + 1)
    elif isinstance(value, dict):
        if isinstance(value.get("$ref"), str):
            yield value["$ref"], path
        else:
            for key, child in value.items():
                yield from walk(child, (*path, key), bare, depth + 1)


def references(documents: DataFrame, bare: bool = True) -> DataFrame:
    """from, to, field_path: one row for each reference of a document (ref, value JSON) and place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(ref, to, list(path)) for ref, value in zip(pdf.ref, pdf.value, strict=True) if value is not None for to, path in dict.fromkeys(walk(json.loads(value), (), bare))]
            yield pd.DataFrame(rows, columns=["from", "to", "field_path"])

    return documents.select("ref", "value").mapInPandas(run, "`from` string, `to` string, field_path array<string>")


def reference_graph(documents: DataFrame, bare: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (ref, resolved) and edges."""
    edges = references(documents, bare)
    known = documents.select("ref").distinct().withColumn("resolved", F.lit(True))
    missing = edges.select(F.col("to").alias("ref")).distinct().join(known, "ref", "left_anti").withColumn("resolved", F.lit(False))
    return known.unionByName(missing), edges


def to_dot(nodes: DataFrame, edges: DataFrame) -> str:
    """The graph as text. It is for small graphs: it goes through the driver."""
    lines = ["digraph fixtures {"]
    lines += [f"  {dot_string(n.ref)} [label={dot_string(n.ref)}, style={'solid' if n.resolved else 'dashed'}];" for n in nodes.orderBy("ref").toLocalIterator()]
    for e in edges.orderBy("from", "to", "field_path").toLocalIterator():
        label = ".".join(e.field_path)
        lines.append(f"  {dot_string(e['from'])} -> {dot_string(e['to'])}" + (f" [label={dot_string(label)}]" if label else "") + ";")
    return "\n".join([*lines, "}"])


def validate(layers: DataFrame, check: Callable[[object], list[str]] | None = None, strategy: str | Callable = "deep", bare: bool = False) -> DataFrame:
    """ref, severity, code, message of everything wrong: layers that don't fold, documents that fail the check, references to nothing."""
    from quarry.storage import written

    loaded = written(layered(layers, strategy))  # read three times, folded once

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(ref, "error", "schema", m) for ref, value in zip(pdf.ref, pdf.value, strict=True) for m in check(json.loads(value))]
            yield pd.DataFrame(rows, columns=["ref", "severity", "code", "message"])

    own = loaded.filter("error is not null").select("ref", F.lit("error").alias("severity"), F.substring_index("error", ":", 1).alias("code"), F.col("error").alias("message"))
    if check:
        own = own.union(loaded.filter("error is null").select("ref", "value").mapInPandas(run, "ref string, severity string, code string, message string"))
    good = loaded.filter("error is null")
    dangling = references(good, bare).join(loaded.select(F.col("ref").alias("to")), "to", "left_anti")
    lost = dangling.select(F.col("from").alias("ref"), F.lit("error").alias("severity"), F.lit("missing-reference").alias("code"), F.concat(F.lit("no fixture "), F.col("to"), F.lit(" at "), F.array_join("field_path", ".")).alias("message"))
    return written(own.union(lost)).orderBy("ref", "code", "message")


def duplicate_paths(files: DataFrame) -> DataFrame:
    """source, path, n of files that a source holds more than once."""
    return files.groupBy("source", "path").agg(F.count("*").alias("n")).filter("n > 1")


def material_order(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """ref, level: documents by the longest chain of references below them, so that each level needs only those before it; null where a cycle is in the way."""
    from quarry.storage import written

    left = written(documents.select("ref").distinct())
    needs = written(edges.select("from", "to").distinct().join(left.select(F.col("ref").alias("to")), "to", "left_semi"))
    done, level = None, 0
    while True:
        ready = written(left.join(needs.select(F.col("from").alias("ref")), "ref", "left_anti").withColumn("level", F.lit(level)))
        if ready.limit(1).count() == 0:
            rest = left.withColumn("level", F.lit(None).cast("int"))
            return rest if done is None else done.unionByName(rest)
        done = ready if done is None else done.unionByName(ready)
        left = written(left.join(ready, "ref", "left_anti"))
        needs = written(needs.join(ready.select(F.col("ref").alias("to")), "to", "left_anti"))
        level += 1


def numbered(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("ord", F.row_number().over(W.partitionBy("ref").orderBy(by)))


def seeded(existing: DataFrame, layers: DataFrame, check: Callable[[object], list[str]] | None = None, strategy: str | Callable = "deep") -> DataFrame:
    """existing (ref, value) with the documents that it doesn't hold yet. All are validated before: if anything is wrong, nothing is put in."""
    wrong = validate(layers, check, strategy).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0].ref}: {wrong[0].message}")
    return existing.unionByName(layered(layers, strategy).select("ref", "value").join(existing.select("ref"), "ref", "left_anti"))


def resolved(documents: DataFrame, ref: str) -> object:
    """The value of one document; an error where there is none or it didn't fold."""
    rows = documents.filter(F.col("ref") == ref).limit(1).collect()
    if not rows:
        raise KeyError(ref)
    if "error" in documents.columns and rows[0].error:
        raise ValueError(rows[0].error)
    return json.loads(rows[0].value)
