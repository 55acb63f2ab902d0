"""Benchmark passages in documents, by q-gram lemma filtering.

Texts are compared in folded case with runs of anything but letters and digits as one space. A passage matches an item when some stretch of
the document is within floor(rate * length) edits (characters) of the whole item. By the q-gram lemma such a stretch shares at least
length - q + 1 - q * edits of the item's q-grams, all on diagonals that differ by no more than the edits. So: every q-gram of a document
is looked up among the items' (a table of bits first); hits are counted in diagonal bands of width 2 * edits that overlap by half, so
that some band holds any `edits + 1` neighbouring diagonals; bands that reach the bound are verified by banded alignment, and the best
end of each is reported with its edits. All bands are tried, so the result is exact.

Items too short for q-grams of that length to bound their edits take shorter ones: the longest that leave a bound of one. An item of fewer
than q characters allows no edits (where rate * q < 1) and is one gram itself; it must stand between separators, as short words would
otherwise be found inside others. An item without a letter or digit, null or empty is left out. Null and empty documents have no match.
Documents may be of any length and as repetitive as they like: a gram's places in an item are kept as runs, and what a text's gram hits is
an interval of bands. Of overlapping passages of an item the one with the fewest edits is given, of equal ones the first. Rows with a null
doc_id or item_id are left out. A repeated document row repeats its matches; repeated items are one. Extra columns are ignored. Empty
tables give no rows.

The items' q-grams go to every task. They are split into parts of at most `part_chars` characters, each a pass of its own over the
documents, so what a task holds is bounded whatever the benchmark's size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import vec

U = np.uint64
Q, RATE, PART_CHARS = 12, 0.05, 8 << 20
TABLE_BITS = 22
SCHEMA = "doc_id long, item_id long, start long, end long, edits int"


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters as codes (runs of separators are one space, left out at a row's ends), the characters' first bytes, the last bytes' ends and each row's first character."""
    data = vec.folded(data)
    _, stops, rows = vec.word_spans(data, offsets, vec.ALNUM)
    keep = vec.ALNUM[data] & ((data & 0xC0) != 0x80)
    gaps = stops[:-1][rows[1:] == rows[:-1]]
    keep[gaps] = True
    data[gaps] = 32
    at = np.flatnonzero(keep)
    codes, ends = data[at].astype(np.uint32), at + 1
    wide = np.flatnonzero(codes >= 0xC0)
    if len(wide):
        padded = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.uint32)
        on = np.ones(len(wide), bool)
        for k in (1, 2, 3):
            more = padded[at[wide] + k]
            on &= (more & 0xC0) == 0x80
            codes[wide] = np.where(on, codes[wide] << np.uint32(8) | more, codes[wide])
            ends[wide] += on
    return codes, at, ends, np.searchsorted(at, offsets)


def normal_text(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return normal(raw, np.array([0, len(raw)]))[0]


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """The hash of the q-gram at each character; too few characters give none."""
    if len(codes) < q:
        return np.zeros(0, U)
    sums = vec.prefix(codes.astype(U) * U(0x9E3779B97F4A7C15) + U(1))
    return vec.rolling(sums, q)


def gram_length(n: int, q: int, rate: float) -> int:
    """The length of q-grams for an item of n characters: q, or less where its edits would leave no shared one for sure."""
    edits = int(rate * n)
    return max(1, min(q, n // (edits + 1)))  # n - x + 1 - x * edits >= 1


class Items:
    """The q-grams of items that use the same q: a bit table, and sorted hashes with their item and runs of places."""

    def __init__(self, texts: list[tuple[int, np.ndarray]], q: int, rate: float, apart: bool = False):
        self.q, self.apart, self.ids, self.codes = q, apart, [i for i, _ in texts], [c for _, c in texts]
        self.lengths = np.array([len(c) for c in self.codes])
        self.edits = (rate * self.lengths).astype(int)
        self.least = self.lengths - q + 1 - q * self.edits
        #: No match has fewer hits than this within `reach` characters.
        self.fewest, self.reach = int(self.least.min()), int((self.lengths + self.edits).max())
        grams = [gram_hashes(c, q) for c in self.codes]
        sizes = np.array([len(g) for g in grams])
        h, owner = np.concatenate(grams), np.repeat(np.arange(len(grams)), sizes)
        place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((place, owner, h))
        h, owner, place = h[order], owner[order], place[order]
        # places of a gram in an item that are no further apart than a band is wide hit all bands between them: they are one run
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]) | (place[1:] - place[:-1] > np.maximum(1, self.edits[owner[1:]]))
        first = np.flatnonzero(fresh)
        self.hashes, self.owner, self.low, self.high = h[first], owner[first], place[first], place[np.append(first[1:], len(h)) - 1]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(h >> U(64 - TABLE_BITS)).astype(np.int64)] = True


def by_gram_length(texts: list[tuple[int, str]], q: int, rate: float) -> list[Items]:
    """The different items, by the length of their q-grams."""
    held: dict[tuple[int, bool], dict[tuple[int, bytes], np.ndarray]] = {}
    for item, text in texts:
        codes = normal_text(text)
        if len(codes):
            held.setdefault((gram_length(len(codes), q, rate), len(codes) < q), {})[item, codes.tobytes()] = codes
    return [Items([(item, codes) for (item, _), codes in some.items()], size, rate, apart) for (size, apart), some in sorted(held.items())]


def align(item: np.ndarray, texts: np.ndarray, lengths: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of texts (padded): the least edits between item and a stretch of it whose diagonals (text place - item place) lie in
    [low, low + width), with the stretch's start and end; of several, the one on the first diagonal."""
    m, far = len(item), 1 << 20
    diagonals = low[:, None] + np.arange(width)
    most, last = lengths[:, None], max(0, texts.shape[1] - 1)
    cost = np.where((diagonals >= 0) & (diagonals <= most), 0, far)
    start = diagonals.copy()
    steps = np.arange(width)
    edge = np.full((len(low), 1), far)
    for i in range(1, m + 1):
        at = diagonals + i  # characters of text used
        ok = (at >= 1) & (at <= most)
        same = np.where(ok, np.take_along_axis(texts, np.clip(at - 1, 0, last), 1) != item[i - 1], far)
        best, origin = cost + same, start
        drop = np.concatenate((cost[:, 1:], edge), 1) + 1  # a character of the item is left out
        use = (drop < best) & (at >= 0) & (at <= most)
        best, origin = np.where(use, drop, best), np.where(use, np.concatenate((start[:, 1:], edge), 1), origin)
        # characters of text put in, from the left: a running minimum
        run = best - steps
        least = np.minimum.accumulate(run, 1)
        which = np.maximum.accumulate(np.where(run == least, steps, 0), 1)
        fill = least + steps
        use = (fill < best) & ok
        cost, start = np.where(use, fill, best), np.where(use, np.take_along_axis(origin, which, 1), origin)
        cost = np.where((at >= 0) & (at <= most), cost, far)
    k, row = cost.argmin(1), np.arange(len(low))
    return cost[row, k], start[row, k], diagonals[row, k] + m


def find(text: np.ndarray, item: np.ndarray) -> int:
    """The first place where text holds item, or -1."""
    raw, want, at = text.tobytes(), item.tobytes(), -1
    while (at := raw.find(want, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return -1


def candidates(items: Items, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, item and first diagonal of the bands that reach their bound."""
    none = (np.zeros(0, np.int64),) * 3
    grams = gram_hashes(codes, items.q)
    if not len(grams) or not len(items.hashes):
        return none
    at = np.flatnonzero(items.table[(grams >> U(64 - TABLE_BITS)).astype(np.int64)])
    left = np.searchsorted(items.hashes, grams[at])
    at = at[items.hashes[np.minimum(left, len(items.hashes) - 1)] == grams[at]]
    row = np.searchsorted(begins, at, side="right") - 1
    whole = at + items.q <= begins[row + 1]
    at, row = at[whole], row[whole]
    if len(at) < max(1, items.fewest):
        return none
    # only where enough hits stand within reach of each other: every hit of a match is in such a run
    k = items.fewest - 1
    dense = at[k:] - at[: len(at) - k] <= items.reach
    cover = np.zeros(len(at) + 1, np.int64)
    cover[: len(dense)] += dense
    cover[k + 1 : k + 1 + len(dense)] -= dense
    keep = np.cumsum(cover)[:-1] > 0
    at, row = at[keep], row[keep]
    left = np.searchsorted(items.hashes, grams[at])
    times = np.searchsorted(items.hashes, grams[at], side="right") - left
    hit = np.repeat(np.arange(len(at)), times)
    post = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(left, times)
    item, row = items.owner[post], row[hit]
    text_at = at[hit] - begins[row] + (1 << 40)
    step = np.maximum(1, items.edits[item])
    # band k covers the diagonals of steps k and k + 1; a gram of the text adds 1 to each band from `first` to `last`, where its runs say the
    # same band twice 2 (more candidates, none lost)
    first, last = (text_at - items.high[post]) // step - 1, (text_at - items.low[post]) // step
    del text_at, post, hit
    pair = row * np.int64(len(items.ids)) + item
    pair, band, change = np.concatenate((pair, pair)), np.concatenate((first, last + 1)), np.repeat(np.array([1, -1], np.int8), len(pair))
    order = np.lexsort((band, pair))
    pair, band, count = pair[order], band[order], np.cumsum(change[order])
    if not len(pair):
        return none
    # counts hold from an event to the next one of another band
    last = np.flatnonzero(np.append((pair[1:] != pair[:-1]) | (band[1:] != band[:-1]), True))
    pair, band, count = pair[last], band[last], count[last]
    enough = np.flatnonzero(count >= items.least[pair % len(items.ids)])
    wide = band[enough + 1] - band[enough]  # a count above 0 is never a pair's last
    which = np.repeat(enough, wide)
    band = band[which] + np.arange(len(which)) - np.repeat(np.cumsum(wide) - wide, wide)
    row, item = pair[which] // len(items.ids), pair[which] % len(items.ids)
    return row, item, band * np.maximum(1, items.edits[item]) - (1 << 40)


def verified(items: Items, codes: np.ndarray, row: np.ndarray, item: np.ndarray, low: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Row, item, start, end (characters of the normal text) and edits of the bands' best alignments within budget; of overlapping ones the best."""
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    left: dict[int, list[tuple[int, int, np.ndarray, int]]] = {}
    for r, k, d in zip(row.tolist(), item.tolist(), low.tolist(), strict=True):
        text, edits, want = codes[begins[r] : begins[r + 1]], int(items.edits[k]), items.codes[k]
        base = max(0, d - edits - 1)
        window = text[base : d + 3 * edits + 2 + len(want)]
        if (at := find(window, want)) >= 0:  # nothing is better than no edits
            found.setdefault((r, k), []).append((0, base + at, base + at + len(want)))
        else:
            left.setdefault(k, []).append((r, base, window, d - edits - base))
    for k, several in left.items():
        edits = int(items.edits[k])
        for n in range(0, len(several), 256):
            some = several[n : n + 256]
            lengths = np.array([len(x[2]) for x in some])
            texts = np.zeros((len(some), max(1, lengths.max())), np.uint32)
            for j, x in enumerate(some):
                texts[j, : len(x[2])] = x[2]
            for (r, base, *_), cost, start, end in zip(some, *(x.tolist() for x in align(items.codes[k], texts, lengths, np.array([x[3] for x in some]), 4 * edits + 2)), strict=True):
                if cost <= edits:
                    found.setdefault((r, k), []).append((cost, base + start, base + end))
    out = []

    def apart(r: int, start: int, end: int) -> bool:
        a, b = begins[r] + start, begins[r] + end
        return (a == begins[r] or codes[a - 1] == 32) and (b == begins[r + 1] or codes[b] == 32)

    for (r, k), several in sorted(found.items()):
        if items.apart:
            several = [m for m in several if apart(r, *m[1:])]
        starts: list[int] = []
        ends: list[int] = []
        for cost, start, end in sorted(set(several)):
            n = bisect.bisect_left(starts, end)  # those taken don't overlap, so only the last that begins before the end can
            if not n or ends[n - 1] <= start:
                starts.insert(n, start)
                ends.insert(n, end)
                out.append((r, k, start, end, cost))
    return out


def _search(sets: list[Items]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch, "text"):
                data, offsets = vec.text_bytes(part.column(1))
                codes, at, ends, begins = normal(data, offsets)
                matches = [(r, items.ids[k], *rest) for items in sets for r, k, *rest in verified(items, codes, *candidates(items, codes, begins), begins)]
                if not matches:
                    continue
                chars, ids = vec.char_index(data), part.column(0).to_pylist()
                rows = [(ids[r], k, int(chars[at[begins[r] + s]] - chars[offsets[r]]), int(chars[ends[begins[r] + e - 1]] - chars[offsets[r]]), c) for r, k, s, e, c in matches]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n == 4 else pa.int64()) for n, x in enumerate(zip(*rows, strict=True))], ["doc_id", "item_id", "start", "end", "edits"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, item_id, start, end (characters of the document, end excluded) and edits of every passage of the benchmark."""
    spark = docs.sparkSession
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    out, part, size = None, [], 0

    def passed(part: list[tuple[int, str]]) -> DataFrame:
        return named.mapInArrow(_search(by_gram_length(part, q, rate)), SCHEMA)

    for item_id, text in items.toLocalIterator():
        if part and size + len(text) > part_chars:
            out = passed(part) if out is None else out.union(passed(part))
            part, size = [], 0
        part.append((item_id, text))
        size += len(text)
    if part:
        out = passed(part) if out is None else out.union(passed(part))
    return spark.createDataFrame([], SCHEMA) if out is None else out
