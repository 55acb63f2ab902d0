"""Nearest neighbours of a set of queries among all vectors, by a block matrix join.

Vectors are normalised. Each tile of queries and rows is first multiplied in int8 (one scale a vector), which gives all its cosines with a
bound of their error, from the length of what quantisation left out. A query keeps a heap of its k best; pairs whose upper bound doesn't
reach its floor (the k-th best so far, or the k-th best lower bound of the tile) are dropped, the others are computed again in float64 and
merged into the heap. The result is exact: the k nearest by float64 cosine (rounded to 12 digits), ties by id.

The queries are packed into blocks, which are written to the shared folder, and taken in groups of at most `group_bytes` (matrix and heaps
together), whatever their number. A group goes to every task; the rows stream by where they are read, a chunk at a time, and aren't
shuffled (but where their files give fewer tasks than there are cores). What leaves a task is a heap's entries. So that a task needn't
send k of them for each query, one row in SEEDED (by hash) is searched first: the k-th best of those is where a query's floor starts. That
changes nothing in the result, as those rows are searched again with all others. Heaps meet in a window of the query's rows, cut to k
before the shuffle as well.

Vectors that are null, empty, or hold a null or non-finite number, or are all zero have no direction: they are left out, as are rows with a
null id. Neighbours have the query's number of dimensions; vectors of another number have neighbours of their own. Rows with the query's
id aren't its neighbours. A repeated row is a query, and a neighbour, of its own. Extra columns are ignored. No queries or no rows give no
rows; fewer than k rows of other ids give all there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.shared import dropped, written

#: Neighbours, queries of a block, rows of a chunk, bytes of a group of queries, and one row in so many that sets the floors.
K, BLOCK, CHUNK, GROUP_BYTES, SEEDED = 10, 2048, 4096, 48 << 20, 64
#: Rows that a task of the first, small search gets.
SEED_ROWS = 1 << 18
TILE = 512
SCHEMA = "vec_id long, neighbor_id long, rank int, cosine double"
FOUND = "query long, vec_id long, neighbor_id long, cosine double"
BLOCKS = "block long, n int, ids binary, x binary"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Integers of up to 127, scales, lengths of what they stand for and of what they leave out."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def normalised(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


class Queries:
    """A group of queries of one number of dimensions, with their int8 forms and floors."""

    def __init__(self, names: np.ndarray, ids: np.ndarray, x: np.ndarray, floors: np.ndarray):
        self.names, self.ids, self.x, self.floors = names, ids, x, floors


class Heaps:
    """The k best of each query of a group so far, by cosine, then by id."""

    def __init__(self, group: Queries, k: int):
        self.group, self.k = group, k
        self.q = quantised(group.x)
        n = len(group.ids)
        self.best, self.who = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, y: np.ndarray) -> None:
        qa, sa, na, ra = self.q
        qb, sb, nb, rb = quantised(y)
        kind = np.float32 if y.shape[1] * 127 * 127 < 1 << 24 else np.float64  # where products of int8 add up exactly
        right = np.ascontiguousarray(qb.astype(kind).T)
        for lo in range(0, len(self.group.ids), TILE):
            rows = slice(lo, lo + TILE)
            near = (qa[rows].astype(kind) @ right) * (sa[rows, None] * sb[None, :])
            # |xy - x'y'| <= |x - x'| |y'| + |x| |y - y'|, and |x| = 1; some more for rounding
            bound = ra[rows, None] * nb[None, :] + rb[None, :] + 1e-6
            near[self.group.ids[rows, None] == ids[None, :]] = -np.inf
            floor = np.maximum(self.best[rows, -1], self.group.floors[rows])
            if near.shape[1] > self.k:
                floor = np.maximum(floor, np.partition(near - bound, -self.k, axis=1)[:, -self.k])
            i, j = np.nonzero(near + bound >= floor[:, None])
            keep = np.isfinite(near[i, j])
            i, j = i[keep] + lo, j[keep]
            if len(i):
                self._merge(i, ids[j], np.round(np.einsum("nd,nd->n", self.group.x[i], y[j]), 12))

    def _merge(self, i: np.ndarray, ids: np.ndarray, cosines: np.ndarray) -> None:
        who = np.unique(i)
        query = np.concatenate((np.repeat(who, self.k), i))
        ids = np.concatenate((self.who[who].ravel(), ids))
        cosines = np.concatenate((self.best[who].ravel(), cosines))
        order = np.lexsort((ids, -cosines, query))
        query = query[order]
        first = np.searchsorted(query, who)
        take = order[(first[:, None] + np.arange(self.k)).ravel()]  # each has k at least: those of its heap
        self.best[who], self.who[who] = cosines[take].reshape(-1, self.k), ids[take].reshape(-1, self.k)

    def rows(self) -> pa.RecordBatch:
        i, j = np.nonzero(np.isfinite(self.best) & (self.best >= self.group.floors[:, None]))
        return pa.RecordBatch.from_arrays([pa.array(self.group.names[i]), pa.array(self.group.ids[i]), pa.array(self.who[i, j]), pa.array(self.best[i, j])], ["query", "vec_id", "neighbor_id", "cosine"])


def _blocks(size: int):
    """Normalised queries in blocks, which are numbered by task and turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part.num_rows], pa.int32()), pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([normalised(part.column(1)).tobytes()], pa.binary())], ["block", "n", "ids", "x"])

    return run


def _search(group: Queries, k: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(group.value, k)
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                heaps.add(part.column(0).to_numpy(), normalised(part.column(1)))
        out = heaps.rows()
        for at in range(0, out.num_rows, 1 << 16):
            yield out.slice(at, 1 << 16)

    return run


def _spread(df: DataFrame) -> DataFrame:
    """df, in as many partitions as there are cores at least."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _directed(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(
        "vec_id is not null and v is not null and size(v) > 0 and forall(v, e -> e is not null and not isnan(e) and abs(e) < double('infinity')) and exists(v, e -> e != 0)"
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbor_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, block: int = BLOCK, group_bytes: int = GROUP_BYTES, chunk: int = CHUNK) -> DataFrame:
    """vec_id, neighbor_id, rank and cosine of the k nearest vectors of every query (of every vector, if no queries are given)."""
    spark = vectors.sparkSession
    good, asked = _directed(vectors), _directed(vectors if queries is None else queries)
    out = spark.createDataFrame([], SCHEMA)
    for d, n in asked.groupBy(F.size("v").alias("d")).agg(F.count("*")).orderBy("d").collect():
        mine = good.filter(F.size("v") == d)
        seeds = mine.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(SEEDED)) == 0)
        seeds = written(seeds.repartition(max(1, seeds.count() // SEED_ROWS)))
        held = written(asked.filter(F.size("v") == d).repartition(-(-n // block)).mapInArrow(_blocks(block), BLOCKS))
        found, groups, size = None, [[]], 0
        for number, rows in held.select("block", "n").orderBy("block").collect():  # a row for each block
            size += rows * (8 * d + d + 24 * k)
            if groups[-1] and size > group_bytes:
                groups, size = [*groups, []], rows * (8 * d + d + 24 * k)
            groups[-1].append(number)
        for numbers in groups:
            parts = held.filter(F.col("block").isin(numbers)).orderBy("block").collect()  # bounded by group_bytes
            names = np.concatenate([(np.int64(p.block) << 16) + np.arange(p.n) for p in parts])
            ids, x = (np.concatenate([np.frombuffer(bytes(p[c]), t) for p in parts]) for c, t in (("ids", np.int64), ("x", np.float64)))
            group = Queries(names, ids, x.reshape(len(ids), d), np.full(len(ids), -np.inf))
            first = spark.sparkContext.broadcast(group)
            floors = _best(seeds.mapInArrow(_search(first, k, chunk), FOUND), k).filter(F.col("rank") == k).select("query", "cosine").toArrow()  # one number a query
            at = np.searchsorted(names, floors.column(0).to_numpy())
            group.floors[at] = floors.column(1).to_numpy()
            part = written(_spread(mine).mapInArrow(_search(spark.sparkContext.broadcast(group), k, chunk), FOUND))
            found = part if found is None else found.union(part)
            first.destroy()
        dropped(held)
        dropped(seeds)
        out = out.union(_best(found, k).select("vec_id", "neighbor_id", "rank", F.round("cosine", 6).alias("cosine")))
    return out
