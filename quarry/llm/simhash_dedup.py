"""Near-duplicate groups by SimHash: every pair within the threshold is found.

A document's fingerprint has 192 bits: each bit is the majority over its distinct words (folded case, letters and digits) of a hash bit.
Two documents are near copies when at most `most` bits differ. The different fingerprints are dealt into groups of GROUP at most, and
each two groups meet in one task. There the bits are cut into blocks of at most 24 (the larger the groups, the wider), and of each block
some radius (4 at most) is searched, such that the radii and the number of blocks together exceed `most`: by the pigeonhole principle two
fingerprints within the threshold are within its radius in some block, so none is missed. Those that are near in a block are compared
whole, 0.4 to 2.5 % of all pairs; of what is near a spanning forest is kept. Work in tasks grows with the square of the number of different
fingerprints, and what is sent to them with their number times that of groups.

anchors() is a search that meets only most near pairs, through code words of the perfect Hamming(31, 26) code; nothing here relies on it.

Equal fingerprints are one entry of the search. Groups are the connected components of the near pairs.

A bit that half of the words have is 0. Texts may be of any length: the words' votes are summed in pieces. Of a group the least doc_id is kept.
In a crowd (many rows of like keys, of which a sample is near) those near to the first one are joined to it in one comparison, so near
copies cost their number, not its square; what a block has joined isn't compared again in the next.

Null or empty texts, and those without a letter or digit, belong to no group. Rows with a null doc_id are left out: they can't be
named. A repeated row is a copy of its document and counts in the group's size. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import vec
from quarry.llm.shared import written

BITS, BLOCKS = 192, 18
#: Different fingerprints of a group at most, and, where there are more in all, about how many at least.
GROUP, FEW = 1 << 19, 1 << 15
#: Pairs compared at a time, pairs from which two groups are searched by blocks, and pairs that are a crowd.
TILE, MANY, CROWD = 1 << 16, 1 << 22, 1 << 22
#: Bits of a block at most; pairs checked at a time (arrays of 128 KB and more come fresh from the system, which is slow), pairs of two keys
#: that are compared as a tile, and edges held before they are thinned out.
WIDEST, PAIRS, LARGE, EDGES = 24, 1 << 13, 1 << 12, 1 << 20
#: What the calls for a mask take, in steps of 7 ns.
CALLS = 8_000
#: Bits of a word's hash that make its feature; the rest of a key holds the row.
FEATURE = 44
MOST = 32
U = np.uint64
SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], U)

#: The bits of each block after the first six.
ORDERS = np.concatenate([np.random.default_rng(k).permutation(BITS).reshape(6, 32)[:, :31] for k in range(1, BLOCKS // 6)])

_place = np.arange(1, 32)
#: Bits of a block that count for each bit of the syndrome.
_PARITY = [U(sum(1 << (int(p) - 1) for p in _place if p >> k & 1)) for k in range(5)]
#: By syndrome, what to flip to get the code words within 2; the syndrome 0 has only itself.
_FLIPS = np.zeros((32, 16), U)
for _s in range(1, 32):
    _pairs = [(i, i ^ _s) for i in range(1, 32) if i < (i ^ _s)]
    _FLIPS[_s] = [1 << (_s - 1), *((1 << (i - 1)) | (1 << (j - 1)) for i, j in _pairs)]


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Three 64-bit words a row, and its number of distinct words."""
    data, offsets = vec.text_bytes(column)
    n = len(column)
    data = vec.folded(data)
    starts, ends, rows = vec.word_spans(data, offsets, vec.ALNUM)
    out, counts = np.zeros((n, 3), U), np.zeros(n, np.int64)
    if not len(starts):
        return out, counts
    if n >= 1 << (64 - FEATURE):
        raise ValueError(f"{n} rows in a slice")
    shift = U(FEATURE)
    keys = np.sort(rows.astype(U) << shift | vec.word_hashes(data, starts, ends) >> U(64 - FEATURE))
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    owner = (keys >> shift).astype(np.int64)
    counts = np.bincount(owner, minlength=n)
    feature = keys & ((U(1) << shift) - U(1))
    have = np.flatnonzero(counts)
    first = np.concatenate(([0], np.cumsum(counts[have])))[:-1]
    # lanes of 8 bits hold the sums of 255 words at most
    pieces = -(-counts[have] // 255)
    piece_of = np.repeat(np.arange(len(have)), pieces)
    nth = np.arange(len(piece_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = first[piece_of] + 255 * nth
    firsts = np.cumsum(pieces) - pieces
    ones = np.empty((len(have), BITS), np.int64)
    for word in range(3):
        bytes_ = vec.mix(feature, word + 1).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            lanes = np.add.reduceat(SPREAD[bytes_[:, k]], cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
            ones[:, 64 * word + 8 * k : 64 * word + 8 * k + 8] = np.add.reduceat(lanes, firsts, axis=0)
    bits = 2 * ones > counts[have][:, None]
    out[have] = np.packbits(bits, axis=1, bitorder="little").view(U)
    return out, counts


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in vec.slices(batch, "text"):
            f, counts = fingerprints(part.column(1))
            keep = np.flatnonzero(counts)
            ids = part.column(0).take(pa.array(keep))
            f = f[keep].view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(3))], ["doc_id", "f0", "f1", "f2"])


def block_bits(f: np.ndarray, block: int) -> np.ndarray:
    """The 31 bits of a block of each fingerprint."""
    if block < 6:
        return f[:, block // 2] >> U(32 * (block % 2)) & U(0x7FFFFFFF)
    x = np.zeros(len(f), U)
    for k, bit in enumerate(ORDERS[block - 6].tolist()):
        x |= (f[:, bit // 64] >> U(bit % 64) & U(1)) << U(k)
    return x


def anchors(f: np.ndarray, blocks: range = range(BLOCKS)) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint the anchors within reach, as its row and the anchor's key (block and code word)."""
    who, keys = [], []
    for block in blocks:
        x = block_bits(f, block)
        s = np.zeros(len(x), np.int64)
        for k, parity in enumerate(_PARITY):
            s |= (np.bitwise_count(x & parity).astype(np.int64) & 1) << k
        words = x[:, None] ^ _FLIPS[s]
        use = np.ones(words.shape, bool)
        use[s == 0, 1:] = False
        who.append(np.nonzero(use)[0])
        keys.append(words[use] | U(block << 31))
    return np.concatenate(who), np.concatenate(keys)


def task_of(a: np.ndarray, b: np.ndarray, groups: int) -> np.ndarray:
    """The number of the task where two groups meet."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    return low * groups - low * (low - 1) // 2 + high - low


def _replicate(groups: int):
    """Each fingerprint for every task of its group; second: it is of the higher of two groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
                f = np.stack(cols[1:], 1).view(U)
                own = (vec.mix(f[:, 0] ^ vec.mix(f[:, 1] ^ vec.mix(f[:, 2]))) % U(groups)).astype(np.int64)
                for other in range(groups):
                    yield pa.RecordBatch.from_arrays([pa.array(task_of(own, np.full(len(own), other), groups).astype(np.int32)), pa.array(own > other), *(pa.array(c) for c in cols)], ["task", "second", "doc_id", "f0", "f1", "f2"])

    return run


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def forest(ids: np.ndarray, f: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges that connect what near pairs connect among an anchor's members: every pair is compared, until its members are joined."""
    left, edges = np.arange(len(ids)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = distance(f[left], f[at]) <= most
            edges += [(int(ids[at]), int(ids[x])) for x in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return edges


def plan(most: int) -> list[tuple[np.ndarray, int]]:
    """Blocks as their bits, each with its radius: bits are in one block at most, and pairs within `most` are within the radius of some block."""
    most = min(most, BITS)
    blocks = (most + 2) // 2
    order, width = np.random.default_rng(0).permutation(BITS), BITS / blocks
    cuts = [round(k * width) for k in range(blocks + 1)]
    return [(order[a:b][:12], int(k < most + 1 - blocks)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n nodes, edges from the least of each component to its others."""
    lead = np.arange(n)
    while len(a):
        x, y = lead[a], lead[b]
        on = x != y
        a, b, x, y = a[on], b[on], x[on], y[on]
        np.minimum.at(lead, np.maximum(x, y), np.minimum(x, y))
        while ((up := lead[lead]) != lead).any():
            lead = up
    node = np.flatnonzero(lead != np.arange(n))
    return lead[node], node


def keys_at_once(width: int, other: float) -> int:
    """So many keys of a block are met with a mask at a time that some PAIRS of them find a key of the other side."""
    return int(min(1 << 18, max(PAIRS, PAIRS * (1 << width) / max(other, 1))))


def wide(most: int, one: int, two: int) -> list[tuple[np.ndarray, int]]:
    """Blocks as of plan(), fewer and wider, with radii such as cost least for so many rows of two groups."""
    most = min(most, BITS)
    order, best = np.random.default_rng(0).permutation(BITS), None
    for blocks in range(-(-(most + 1) // 5), min(most + 1, BITS) + 1):
        base, more = divmod(most + 1 - blocks, blocks)
        cuts = [round(k * BITS / blocks) for k in range(blocks + 1)]
        found = [(order[a:b][:WIDEST], base + int(k < more)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        cost = 0.0
        for bits, radius in found:
            ball = sum(comb(len(bits), r) for r in range(radius + 1))
            # steps of about 7 ns: a mask for each key, the calls for a mask, 3 for a pair that meets (twice as many do as of uniform bits), the tables
            cost += ball * (one + CALLS * max(1.0, one / keys_at_once(len(bits), two))) + 3 * min(1.0, 2 * ball / (1 << len(bits))) * one * two + (1 << len(bits))
        if best is None or cost < best[0]:
            best = cost, found
    return best[1]


def masks(width: int, radius: int) -> list[int]:
    """What to flip to get all keys within the radius."""
    return [sum(1 << b for b in c) for r in range(min(radius, width) + 1) for c in combinations(range(width), r)]


def _keys(f: np.ndarray, bits: np.ndarray) -> np.ndarray:
    key = np.zeros(f.shape[1], np.int32)
    for k, bit in enumerate(bits.tolist()):
        key |= (f[bit // 64] >> U(bit % 64) & U(1)).astype(np.int32) << np.int32(k)
    return key


def _tile(f: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Adds edges that connect what near pairs of rows a and b connect. f: the three words of all rows, each contiguous."""

    def joined(rows: np.ndarray) -> None:
        if e := forest(rows, np.ascontiguousarray(f[:, rows].T), most):
            found.append(tuple(np.array(e).T))

    if len(a) * len(b) > CROWD and (distance(f[:, a[:: -(-len(a) // 64)]].T[:, None], f[:, b[:: -(-len(b) // 64)]].T) <= most).mean() > 0.25:
        # rows that are near to the first are joined to it at once; the others are told apart by all pairs
        return joined(np.unique(np.concatenate((a, b))))
    hits, held = [], 0
    width = min(len(b), TILE)
    step = max(1, TILE // width)
    for lo in range(0, len(b), width):
        part = b[lo : lo + width]
        fb = f[:, part]
        for at in range(0, len(a), step):
            fa = f[:, a[at : at + step]]
            d = np.bitwise_count(fa[0, :, None] ^ fb[0])
            d += np.bitwise_count(fa[1, :, None] ^ fb[1])
            hit = np.flatnonzero(d <= most)
            if len(hit):
                i, j = np.divmod(hit, len(part))
                near = d.ravel()[hit].astype(np.int64) + np.bitwise_count(fa[2, i] ^ fb[2, j]) <= most
                hits.append((a[i[near] + at], part[j[near]]))
                held += len(hits[-1][0])
                if held > EDGES:
                    hits = [spanning(*(np.concatenate(x) for x in zip(*hits, strict=True)), f.shape[1])]
                    held = len(hits[0][0])
    found += hits


def _near(f: np.ndarray, one: np.ndarray, two: np.ndarray, most: int, bits: np.ndarray, radius: int, lead: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what pairs connect that are near and within the radius in a block, where `lead` doesn't have them together already.

    The rows of both sides are sorted by their keys. Each key of the first is met, under each mask, with the other side's rows of the key that
    it makes: neighbouring keys make neighbouring ones, so memory is read almost in order. Few keys are taken at a time, which keeps what is computed in caches."""
    own = one is two
    ka, kb = _keys(f[:, one], bits), _keys(f[:, two], bits)
    oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    ka, rows_a, rows_b = ka[oa], one[oa], two[ob]
    a0, a1, a2 = (w[rows_a] for w in f)
    b0, b1, b2 = (w[rows_b] for w in f)
    first = np.flatnonzero(np.concatenate(([True], ka[1:] != ka[:-1])))
    u, na = ka[first], np.diff(np.append(first, len(ka)))
    kb = kb[ob]
    first_b = np.flatnonzero(np.concatenate(([True], kb[1:] != kb[:-1])))
    nb = np.diff(np.append(first_b, len(kb)))
    some, place = np.zeros(1 << len(bits), bool), np.zeros(1 << len(bits), np.int32)
    some[kb[first_b]], place[kb[first_b]] = True, np.arange(len(first_b))
    found, held = [], 0

    def told() -> None:
        nonlocal found, held
        held = sum(len(x[0]) for x in found)
        if held > EDGES:
            found = [spanning(*(np.concatenate(x) for x in zip(*found, strict=True)), f.shape[1])]

    def checked(i: np.ndarray, j: np.ndarray) -> None:
        d = np.bitwise_count(a0.take(i) ^ b0.take(j))
        d += np.bitwise_count(a1.take(i) ^ b1.take(j))
        hit = np.flatnonzero(d <= most)
        if len(hit):
            i, j = i[hit], j[hit]
            near = d[hit].astype(np.int64) + np.bitwise_count(a2[i] ^ b2[j]) <= most
            if near.any():
                found.append((rows_a[i[near]], rows_b[j[near]]))

    def crowd(a: np.ndarray, b: np.ndarray) -> None:
        # pairs that earlier blocks have joined needn't be compared again
        la, lb = lead[a], lead[b]
        labels, sizes = np.unique(la, return_counts=True)
        common = labels[sizes.argmax()]
        ina, inb = la == common, lb == common
        if inb.any():
            if not ina.all():
                _tile(f, a[~ina], b, most, found)
            if not inb.all():
                _tile(f, a[ina], b[~inb], most, found)
        else:
            _tile(f, a, b, most, found)

    flips = [np.int32(m) for m in masks(len(bits), radius)]
    step = keys_at_once(len(bits), len(first_b))
    for at in range(0, len(u), step):
        v, vn, vf = u[at : at + step], na[at : at + step], first[at : at + step]
        to, flags = np.empty_like(v), np.empty(len(v), bool)
        for m in flips:
            np.bitwise_xor(v, m, out=to)
            hit = np.flatnonzero(some.take(to, out=flags, mode="clip"))
            if own and m:
                hit = hit[to[hit] > v[hit]]
            if not len(hit):
                continue
            at_b = place.take(to[hit])
            lo, n = first_b.take(at_b), nb.take(at_b)
            i, n_i = vf[hit], vn[hit]
            pairs = n * n_i
            if pairs.max() == 1:
                checked(i, lo)
                continue
            large = np.flatnonzero(pairs > LARGE)
            for x in large.tolist():
                crowd(rows_a[i[x] : i[x] + n_i[x]], rows_b[lo[x] : lo[x] + n[x]])
            if len(large):
                keep = pairs <= LARGE
                i, n_i, lo, n, pairs = i[keep], n_i[keep], lo[keep], n[keep], pairs[keep]
            # each row of the first side, then each of the second for it, some at a time
            row = np.repeat(np.arange(len(i)), n_i)
            i = i[row] + np.arange(len(row)) - (np.cumsum(n_i) - n_i)[row]
            lo, n = lo[row], n[row]
            ends = np.cumsum(n)
            begin = lo - ends + n
            start = 0
            while start < len(n):
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
                which = np.repeat(np.arange(start, stop), n[start:stop])
                checked(i.take(which), begin.take(which) + np.arange(before, ends[stop - 1]))
                start = stop
        told()
    return found


def meet(f: np.ndarray, second: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges, as two rows each, that connect what near pairs of the two groups connect; where nothing is second, of the first with itself."""
    f = np.ascontiguousarray(f.T)
    one, two = np.flatnonzero(~second), np.flatnonzero(second)
    if not len(two):
        two = one
    none = np.zeros(0, np.int64)
    found = [(none, none)]
    n = f.shape[1]
    if len(one) * len(two) <= MANY:
        if len(one) and len(two):
            _tile(f, one, two, most, found)
    elif len(one):
        for bits, radius in wide(most, len(one), len(two)):
            node, lead = found[-1][1], np.arange(n)
            lead[node] = found[-1][0]
            found += _near(f, one, two, most, bits, radius, lead)
            found = [spanning(*(np.concatenate(x) for x in zip(*found, strict=True)), n)]
    return spanning(*(np.concatenate(x) for x in zip(*found, strict=True)), n)


def _compare(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6)] for batch in batches if batch.num_rows]
        if held:
            second, ids, *f = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = meet(np.stack(f, 1).view(U), second.astype(bool), most)
            a, b = ids[a], ids[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of the edges (a, b). Each round takes the least label among neighbours and then
    the label's own label, so the rounds grow with the logarithm of a component's width; each is written to the shared folder."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")))
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        told = labels.join(heard, labels.node == heard.a).select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(told.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label")))
        if new.filter("label != old").limit(1).count() == 0:
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_pairs(prints: DataFrame, most: int = MOST) -> DataFrame:
    """Edges (a, b), a <= b, whose components are those of all near pairs. prints: doc_id, f0, f1, f2, distinct fingerprints; cheap to count."""
    n = prints.count()
    groups = max(1, -(-n // GROUP), min(8, -(-n // FEW)))
    sent = prints.mapInArrow(_replicate(groups), "task int, second boolean, doc_id long, f0 long, f1 long, f2 long")
    return sent.repartitionById(groups * (groups + 1) // 2, F.col("task")).mapInArrow(_compare(most), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, most: int = MOST) -> DataFrame:
    """One row for each member of a group of two or more: doc_id, group_id (the least doc_id of the group), group_size (its rows) and
    kept (true for the one document to keep)."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    prints = written(named.mapInArrow(_prints, "doc_id long, f0 long, f1 long, f2 long"))
    same = written(prints.groupBy("f0", "f1", "f2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    # a doc_id on rows of unlike texts joins their fingerprints: it is one node
    several = prints.select("doc_id", "f0", "f1", "f2").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    split = prints.join(several, "doc_id", "left_semi").join(same.select("f0", "f1", "f2", F.col("doc_id").alias("b")), ["f0", "f1", "f2"]).select(F.col("doc_id").alias("a"), "b").filter("a != b")
    labels = components(written(near_pairs(same.select("doc_id", "f0", "f1", "f2"), most).union(split)))
    lead = same.join(labels, same.doc_id == labels.node, "left").select("f0", "f1", "f2", F.coalesce("label", "doc_id").alias("group_id"), "copies")
    sizes = lead.groupBy("group_id").agg(F.sum("copies").alias("group_size")).filter("group_size > 1")
    members = lead.join(sizes, "group_id").select("f0", "f1", "f2", "group_id", "group_size")
    return prints.join(members, ["f0", "f1", "f2"]).groupBy("doc_id").agg(F.min("group_id").alias("group_id"), F.max("group_size").alias("group_size")).withColumn("kept", F.col("doc_id") == F.col("group_id"))
