"""Passages that repeat, found by fixed-block anchors.

Words are maximal runs of bytes above 32, taken as they are (case and punctuation count; how words are spaced doesn't). Reference blocks
are the non-overlapping runs of `block` words at multiples of `block` in each document; every rolling window of `block` words of every
document probes them. As `words >= 2 * block - 1`, a repeat of `words` words holds a whole block of either occurrence, so each of its
occurrences has a hit. Around hits all windows of `words` words are then compared exactly (64-bit hashes), and those that occur more than
once are extended: overlapping or touching ones join to a maximal span. A word is in a span if and only if some run of `words` words
that holds it occurs at two or more places of the table, be it in one document or in several.

Windows travel as sorted hashes with their places, packed by shard of the hash into binary rows (some 7 bytes a word). What repeats among
the texts of one pack is known to repeat there and then: its places go their own way, spread over all tasks, and one window stands for them
in the shard. So a passage that a third of all documents hold brings each shard one window a pack, no pair of documents is ever
listed, and no task gets all of a passage's places. Hits of a shard need only that shard. The shards grow with the table.

A null or empty text, and one of fewer than `words` words, has no span. Texts may be of any length, and repeat within themselves. There are no
ties: a word is in a span or isn't. Rows with a null doc_id are left out. A repeated row is one more
occurrence of its passages, and its spans are given once. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import vec
from quarry.llm.shared import shards_for, written

U = np.uint64
WORDS, BLOCK = 50, 25
#: Bytes of files for each shard, and text bytes gathered for one packed row of each shard.
SHARD_BYTES, PACK_BYTES = 12 << 20, 48 << 20

BLOB = "shard int, blob binary"
PLACES = "doc_id long, text_hash long, places binary"


def windows(part: pa.RecordBatch, column: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Hash, row and first word (in its row) of each window of `width` words; the last value is for spans()."""
    data, offsets = vec.text_bytes(part.column(column))
    starts, ends, rows = vec.word_spans(data, offsets, vec.SPACED)
    begins = vec.row_starts(rows, part.num_rows)
    whole = np.zeros(len(rows), bool)
    if len(rows) >= width:
        whole[: len(rows) - width + 1] = rows[: len(rows) - width + 1] == rows[width - 1 :]
    at = np.flatnonzero(whole)
    hashes = vec.span_hashes(vec.prefix(vec.word_hashes(data, starts, ends)), at, at + width) if len(at) else np.zeros(0, U)
    return hashes, rows[at], at - begins[rows[at]], (data, offsets, starts, ends, begins)


class Packer:
    """Gathers windows and gives a packed row for each shard: sorted hashes, rows, places, with marks of anchors and of what stands for several
    windows of this pack, and the rows' names. The places of what repeats in the pack are packed for a shard below 0."""

    def __init__(self, shards: int, bits: int):
        from pyspark import TaskContext

        self.shards, self.bits, self.held, self.names, self.rows, self.size = shards, bits, [], [], 0, 0
        self.own = -1 - TaskContext.get().partitionId() % max(1, shards)

    def add(self, names: np.ndarray, hashes: np.ndarray, rows: np.ndarray, places: np.ndarray, anchor: np.ndarray) -> None:
        self.held.append((hashes >> U(64 - self.bits), (rows + self.rows).astype(np.uint32), places.astype(np.uint32) << np.uint32(1) | anchor.astype(np.uint32)))
        self.names.append(names)
        self.rows += len(names)
        self.size += len(hashes)

    def _packed(self, shard: int, names: np.ndarray, gaps: np.ndarray, rows: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        # rows are named again, so that a pack carries only its own
        used, row = np.unique(rows, return_inverse=True)
        blob = vec.pack(gaps, row.astype(np.uint32), places, names[used, 0], names[used, 1])
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], ["shard", "blob"])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            hashes, rows, places = (np.concatenate(x) for x in zip(*self.held, strict=True))
            names = np.concatenate(self.names)
            self.held = []
            order = np.argsort(hashes)
            hashes = hashes[order]
            first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            sizes = np.diff(np.append(first, len(hashes)))
            anchored = np.bitwise_or.reduceat(places[order], first) & np.uint32(1)
            again = order[np.repeat(sizes > 1, sizes)]
            if len(again):
                yield self._packed(self.own, names, np.zeros(0, U), rows[again], places[again] >> np.uint32(1))
            order, hashes = order[first], hashes[first]
            marks = (places[order] >> np.uint32(1)) << np.uint32(2) | (sizes > 1).astype(np.uint32) << np.uint32(1) | anchored
            # a shard is a range of hashes
            edges = [(k << self.bits) // self.shards for k in range(1, self.shards)]
            cuts = [0, *np.searchsorted(hashes, np.array(edges, U)).tolist(), len(hashes)]
            for k in range(self.shards):
                own = slice(cuts[k], cuts[k + 1])
                if cuts[k] < cuts[k + 1]:
                    yield self._packed(k, names, np.diff(hashes[own], prepend=U(0)), rows[order[own]], marks[own])
        self.held, self.names, self.rows, self.size = [], [], 0, 0


def _names(part: pa.RecordBatch) -> np.ndarray:
    return np.stack([part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1)


def _probe(block: int, shards: int):
    """Every window of `block` words; those at multiples of `block` are reference blocks. 48 bits of hash: what they let through by chance is dropped by the second pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, taken = Packer(shards, 48), 0
        for batch in batches:
            for part in vec.slices(batch, "text"):
                hashes, rows, places, (data, *_) = windows(part, 2, block)
                packer.add(_names(part), hashes, rows, places, places % block == 0)
                taken += len(data)
                if taken > PACK_BYTES:
                    taken = 0
                    yield from packer.flush()
        yield from packer.flush()

    return run


def near_hits(hits: np.ndarray, places: np.ndarray, reach: int) -> np.ndarray:
    """For each place whether a hit lies in [place, place + reach]; hits are sorted."""
    return np.searchsorted(hits, places) < np.searchsorted(hits, places + reach, side="right")


def _around(words: int, block: int, shards: int):
    """All windows of `words` words that hold a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, taken = Packer(shards, 64), 0
        for batch in batches:
            for part in vec.slices(batch, "text"):
                hashes, rows, places, (data, *_) = windows(part, 2, words)
                keep = []
                begins = vec.row_starts(rows, part.num_rows)
                for r, found in enumerate(part.column(3).to_pylist()):
                    hits = np.sort(np.concatenate([vec.unpack(x)[0] for x in found])).astype(np.int64)
                    keep.append(near_hits(hits, places[begins[r] : begins[r + 1]], words - block))
                keep = np.concatenate(keep)
                packer.add(_names(part), hashes[keep], rows[keep], places[keep], np.ones(int(keep.sum()), bool))
                taken += len(data)
                if taken > PACK_BYTES:
                    taken = 0
                    yield from packer.flush()
        yield from packer.flush()

    return run


def _match(table: pa.Table) -> pa.Table:
    """The places of a shard's windows whose hash occurs more than once, at an anchor at least once; a shard below 0 has its places already."""
    hashes, rows, places, names, n = [], [], [], [], 0
    for blob in table.column("blob").to_pylist():
        gaps, row, place, a, b = vec.unpack(blob)
        hashes.append(np.cumsum(gaps))
        rows.append(row.astype(np.int64) + n)
        places.append(place)
        names.append(np.stack((a, b), 1))
        n += len(a)
    hashes, rows, places, names = (np.concatenate(x) for x in (hashes, rows, places, names))
    if table.column("shard")[0].as_py() >= 0:
        order = np.argsort(hashes)
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        sizes = np.diff(np.append(first, len(hashes)))
        del hashes
        # of most hashes there is one window: only the others are looked at. One that stands for several of its pack has had those told
        # already, but for others' sake it counts, and as one more it does no harm
        marks = np.bitwise_or.reduceat(places[order], first)
        keep = order[np.repeat((sizes > 1) & (marks & 1 > 0), sizes)]
        rows, places = rows[keep], places[keep] >> 2
    order = np.lexsort((places, rows))
    rows, places = rows[order], places[order]
    used, cuts = np.unique(rows, return_index=True)
    blobs = [vec.pack(x) for x in np.split(places, cuts[1:])] if len(used) else []
    return pa.table({"doc_id": pa.array(names[used, 0], pa.int64()), "text_hash": pa.array(names[used, 1], pa.int64()), "places": pa.array(blobs, pa.binary())})


def _spans(words: int):
    """Places of repeated windows, joined to spans; offsets count characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch, "text"):
                data, offsets = vec.text_bytes(part.column(2))
                starts, ends, rows = vec.word_spans(data, offsets, vec.SPACED)
                begins, chars = vec.row_starts(rows, part.num_rows), vec.char_index(data)
                out = [[] for _ in range(5)]
                for r, found in enumerate(part.column(3).to_pylist()):
                    at = np.unique(np.concatenate([vec.unpack(x)[0] for x in found])).astype(np.int64)
                    cut = np.flatnonzero(np.diff(at) > words) + 1
                    first, last = at[np.concatenate(([0], cut))], at[np.concatenate((cut - 1, [len(at) - 1]))] + words
                    out[0].append(np.full(len(first), part.column(0)[r].as_py()))
                    out[1].append(chars[starts[begins[r] + first]] - chars[offsets[r]])
                    out[2].append(chars[ends[begins[r] + last - 1]] - chars[offsets[r]])
                    out[3].append(first)
                    out[4].append(last)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["doc_id", "start", "end", "first_word", "end_word"])

    return run


def _with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    found = places.groupBy("doc_id", "text_hash").agg(F.collect_list("places").alias("found"))
    return docs.join(found, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "found")


def repeated_spans(docs: DataFrame, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, start, end (characters, end excluded), first_word, end_word of every maximal span of repeated runs of `words` words."""
    if words < 2 * block - 1:
        raise ValueError("a repeat must hold a whole block: words >= 2 * block - 1")
    shards = shards_for(docs, SHARD_BYTES)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    named = named.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    probed = named.mapInArrow(_probe(block, shards), BLOB)
    hits = written(probed.groupBy("shard").applyInArrow(_match, PLACES))
    again = _with_places(named, hits).mapInArrow(_around(words, block, shards), BLOB)
    repeats = written(again.groupBy("shard").applyInArrow(_match, PLACES))
    return _with_places(named, repeats).dropDuplicates(["doc_id", "text_hash"]).mapInArrow(_spans(words), "doc_id long, start long, end long, first_word long, end_word long")
