"""Neighbours, bounded traversal, reachability and cycles over an edge table (id, from, to, type, anything else)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.collections import predicate
from quarry.storage import small, written


def policy(edges: DataFrame, types: Sequence[str] | None = None, where: Mapping[str, object] | None = None) -> DataFrame:
    """Edges of the types (all, if none are named) that meet the conditions."""
    if types:
        edges = edges.filter(F.col("type").isin(*types))
    return edges.filter(predicate(edges, where)) if where else edges


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """at, next, id: edges as they are walked."""
    out = edges.select(F.col("from").alias("at"), F.col("to").alias("next"), "id")
    back = edges.select(F.col("to").alias("at"), F.col("from").alias("next"), "id")
    if direction == "out":
        return out
    if direction == "in":
        return back
    if direction == "both":
        return out.union(back)
    raise ValueError("direction is out, in or both")


def neighbors(edges: DataFrame, node: object, direction: str = "out", types: Sequence[str] | None = None, where: Mapping[str, object] | None = None) -> DataFrame:
    """The edges of one node, whole; a loop comes once."""
    held = policy(edges, types, {k: v for k, v in (where or {}).items() if k not in ("from", "to")})
    hit = {"out": F.col("from") == node, "in": F.col("to") == node, "both": (F.col("from") == node) | (F.col("to") == node)}[direction]
    return held.filter(hit).dropDuplicates(["id"])


def distances(edges: DataFrame, starts: DataFrame, depth: float, direction: str = "out") -> DataFrame:
    """node, dist: hops from the starts (node), at most `depth`. A pass for each hop joins the last frontier with the edges; what was
    reached before is dropped, so cycles end. The edges are written once, by the node they are walked from."""
    hops = 0 if math.isnan(depth) or depth <= 0 or math.isinf(depth) else math.ceil(depth)
    seen = written(starts.select("node").distinct().withColumn("dist", F.lit(0)))
    if not hops:
        return seen
    walk = written(oriented(edges, direction).select("at", "next").distinct())
    frontier = seen
    for hop in range(1, hops + 1):
        reached = walk.join(small(frontier.select(F.col("node").alias("at"))), "at", "left_semi").select(F.col("next").alias("node")).distinct()
        frontier = written(reached.join(seen, "node", "left_anti").withColumn("dist", F.lit(hop)))
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
    return seen


def traverse(edges: DataFrame, start: object, depth: float, direction: str = "out", types: Sequence[str] | None = None, where: Mapping[str, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, dist) within depth of the start, without it, and the edges walked, whole: those whose near end is less than depth away,
    also back to nodes seen before. A depth of 0 or less, or one that isn't finite, gives nothing; a broken one counts as the next whole."""
    held = policy(edges, types, where)
    starts = edges.sparkSession.createDataFrame([(start,)], f"node {dict(edges.dtypes)['from']}")
    found = distances(held, starts, depth, direction)
    hops = 0 if math.isnan(depth) or math.isinf(depth) else max(0, math.ceil(depth))
    near = found.filter(F.col("dist") < hops)
    ids = oriented(held, direction).join(near, F.col("at") == F.col("node"), "left_semi").select("id").distinct()
    return found.filter("dist > 0").orderBy("node"), held.join(ids, "id", "left_semi").dropDuplicates(["id"]).orderBy("id")


def reachable(edges: DataFrame, starts: DataFrame, direction: str = "out") -> DataFrame:
    """node, dist of all that can be reached, however far."""
    return distances(edges, starts, float(1 << 40), direction)


def reaches(edges: DataFrame, source: object, target: object) -> bool:
    """Whether an edge from target to source would close a cycle."""
    starts = edges.sparkSession.createDataFrame([(source,)], f"node {dict(edges.dtypes)['from']}")
    return reachable(edges, starts).filter(F.col("node") == F.lit(target)).limit(1).count() > 0


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges between nodes that lie on cycles or between cycles: what is left when ends are peeled off until none is left."""
    left = written(edges)
    while True:
        sources = left.select(F.col("from").alias("to")).distinct()
        targets = left.select(F.col("to").alias("from")).distinct()
        kept = written(left.join(sources, "to", "left_semi").join(targets, "from", "left_semi").select(*edges.columns))
        if kept.count() == left.count():
            return kept
        left = kept
