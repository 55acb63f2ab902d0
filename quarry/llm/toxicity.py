"""Toxic documents by a counterfactual-regularised linear classifier.

Features of a document are its distinct words (folded case) and the words' first five letters, hashed, each with the value
1 + ln(occurrences). A logistic regression with an L1
penalty is fitted to labelled documents by accelerated proximal gradient. For the counterfactual part, identity terms are swapped in
labelled sentences: in every sentence of a labelled document that holds terms each of them gives way to SWAPS others in turn, and the first
sentence of each other document gets a word replaced by terms, put in and swapped. The squared change of score between a sentence and its
swapped form is part of the loss, so that naming a group doesn't move the score, whatever the labels say of it. As the model is linear, a
pair counts by the difference of its features alone: equal differences are one row with their number as weight, however many sentences there are.

The classifier is fitted on at most `rows` labelled rows (those with the smallest hash of doc_id; a documented bound, the same at every
size) and then scores every document whole. A document is toxic when its probability is at least `threshold`.

Texts of any length are scored whole. A probability equal to the threshold is toxic. Null or empty texts have no features; they are never toxic, nor are texts none of whose features has a weight. Rows with a null doc_id can't be named: they are left out of the query's result,
and a stage keeps them or drops them by their text like any other. Repeated rows are scored each. Labels that are null, or of documents
that aren't there, are skipped; a document labelled more than once is toxic if any label says so. Without labels of both kinds nothing
is toxic. Extra columns are ignored (a stage keeps them). An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import vec
from quarry.llm.shared import written

U = np.uint64
HASH_BITS = 20
ROWS, THRESHOLD = 6_000, 0.4
#: Weight of the L1 penalty, of the counterfactual penalty, and steps of the fit.
SPARSE, FAIR, STEPS = 0.001, 1.0, 250
#: Other terms that each term gives way to.
SWAPS = 5
IDENTITY = (
    "women men girls boys muslim christian jewish hindu buddhist atheist black white asian latino african european arab gay lesbian "
    "straight bisexual transgender immigrant refugee disabled deaf blind old young poor rich "
    "frauen männer juden christen muslime ausländer femmes hommes juifs chrétiens musulmans étrangers mujeres hombres judíos cristianos musulmanes extranjeros"
).split()


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of each distinct feature of each row, sorted."""
    data, offsets = vec.text_bytes(column)
    data = vec.folded(data)
    starts, ends, rows = vec.word_spans(data, offsets, vec.ALNUM)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    sums = vec.prefix(vec.TABLE[data])
    whole = vec.span_hashes(sums, starts, ends)
    # the first five characters; a character that is cut in two is left out
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    stem = np.searchsorted(lead, lead[starts] + 5, side="right") - 1
    long = stem < ends
    stem_hash = vec.mix(vec.span_hashes(sums, starts[long], np.minimum(stem, ends)[long]), 7)
    drop = U(64 - HASH_BITS)
    keys = np.concatenate((rows << HASH_BITS | (whole >> drop).astype(np.int64), rows[long] << HASH_BITS | (stem_hash >> drop).astype(np.int64)))
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    values = 1 + np.log(np.diff(np.append(first, len(keys))))
    keys = keys[first]
    return keys >> HASH_BITS, keys & ((1 << HASH_BITS) - 1), values


TERMS = frozenset(IDENTITY)
_SENTENCE = re.compile(r"[^.\n!?]+")
_BARE = ".,;:!?\"'()[]"


def sentences(text: str) -> list[str]:
    """The sentences that hold an identity term, or else the first one."""
    first, held = "", []
    for m in _SENTENCE.finditer(text):
        s = m.group().strip()
        if s and not first:
            first = s
        if any(w.strip(_BARE).lower() in TERMS for w in s.split()):
            held.append(s)
    return held or ([first] if first else [])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in vec.slices(batch, "text"):
            rows, feats, values = features(part.column(0))
            cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
            blobs = [vec.pack(feats[a:b].astype(np.int32), values[a:b].astype(np.float32)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            changes = [differences(list(swaps(sentences(t)))) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(blobs, pa.binary()), pa.array([vec.pack(*c) for c in changes], pa.binary())], ["toxic", "features", "changes"])


def swaps(said: list[str]) -> Iterator[tuple[str, str]]:
    """Sentences and their forms with an identity term swapped or put in; which terms depends on the sentence alone."""
    for sentence in said:
        words = sentence.split()
        seed = zlib.crc32(sentence.encode())
        others = lambda k, seed=seed: (IDENTITY[(seed + 7 * k + n * (1 + seed % 53)) % len(IDENTITY)] for n in range(SWAPS))
        held = [k for k, w in enumerate(words) if w.strip(_BARE).lower() in TERMS]
        for k in held:
            yield from ((sentence, " ".join([*words[:k], t, *words[k + 1 :]])) for t in others(k) if t != words[k].strip(_BARE).lower())
        if not held and words:
            k = seed % len(words)
            a, b, *_ = others(k)
            here = [" ".join([*words[:k], t, *words[k + 1 :]]) for t in (a, b)]
            yield here[0], here[1]
            yield " ".join([*words[:k], *words[k + 1 :]]), here[0]


def differences(pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, feature and value of what the second text of each pair lacks (above 0) or has more (below 0) than the first."""
    if not pairs:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
    (ra, fa, va), (rb, fb, vb) = (features(pa.array([p[k] for p in pairs], pa.string())) for k in (0, 1))
    key = np.concatenate((ra << HASH_BITS | fa, rb << HASH_BITS | fb))
    key, at = np.unique(key, return_inverse=True)
    value = np.bincount(at, np.concatenate((va, -vb)))
    on = np.abs(value) > 1e-9
    return (key[on] >> HASH_BITS).astype(np.int32), (key[on] & ((1 << HASH_BITS) - 1)).astype(np.int32), value[on].astype(np.float32)


def counted(changes: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row, feature and value of the different differences, each value times the root of how often the difference comes, and how many there are in all."""
    times: Counter[tuple[bytes, bytes]] = Counter()
    for rows, feats, values in changes:
        cuts = np.flatnonzero(np.diff(rows, prepend=-1)) if len(rows) else []
        for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
            times[feats[a:b].tobytes(), values[a:b].tobytes()] += 1
    rows, feats, values = [], [], []
    for n, ((f, v), k) in enumerate(sorted(times.items())):
        feats.append(np.frombuffer(f, np.int32))
        values.append(np.frombuffer(v, np.float32) * np.sqrt(k))
        rows.append(np.full(len(feats[-1]), n))
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return join(rows, np.int64), join(feats, np.int64), join(values, float), sum(times.values())


class Sparse:
    """A sparse matrix by row."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n: int, width: int, values: np.ndarray, weight: int | None = None):
        self.rows, self.cols, self.n, self.width, self.values = rows, cols, n, width, values
        self.weight = max(1, n if weight is None else weight)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.cols], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, self.values * r[self.rows], self.width)


def fit(x: Sparse, y: np.ndarray, pairs: Sparse, sparse: float = SPARSE, fair: float = FAIR, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias. Classes weigh the same in the loss, as toxic ones are few."""
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, bias = np.zeros(x.width), 0.0
    # a bound of the curvature, by the power method
    v = np.random.default_rng(1).random(x.width)
    for _ in range(12):
        u = 0.25 * x.back(weight * x.dot(v)) + (2 * fair / pairs.weight) * pairs.back(pairs.dot(v))
        top = np.linalg.norm(u) / max(1e-12, np.linalg.norm(v))
        v = u / max(1e-12, np.linalg.norm(u))
    rate = 1 / (1.2 * top + 0.25)
    look, look_bias, t = w, bias, 1.0
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-np.clip(x.dot(look) + look_bias, -40, 40))) - y)
        grad = x.back(error) + (2 * fair / pairs.weight) * pairs.back(pairs.dot(look))
        new = look - rate * grad
        new = np.sign(new) * np.maximum(0, np.abs(new) - rate * sparse)
        new_bias, t_new = look_bias - rate * error.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return w, float(bias)


class Model:
    """Sparse weights by feature."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, bias: float):
        self.places, self.weights, self.bias = places, weights, bias

    def scores(self, column: pa.Array) -> np.ndarray:
        table = np.zeros(1 << HASH_BITS)
        table[self.places] = self.weights
        rows, feats, values = features(column)
        total = np.bincount(rows, values * table[feats], len(column))
        out = 1 / (1 + np.exp(-np.clip(total + self.bias, -40, 40)))
        out[np.bincount(rows, np.abs(table[feats]), len(column)) == 0] = 0.0
        return out


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Fitted on at most `rows` labelled documents."""
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    said = said.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    few = F.broadcast(written(said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null and text != ''")
    sample = texts.join(few, "doc_id").select("text", "toxic").mapInArrow(_featured, "toxic int, features binary, changes binary")
    got = sample.toArrow()
    y = got.column("toxic").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(0, np.int64), np.zeros(0), -40.0)
    blobs = got.column("features").to_pylist()
    rows_, changed, amounts, pairs = counted(vec.unpack(c) for c in got.column("changes").to_pylist())
    order = sorted(range(len(y)), key=lambda k: (blobs[k], y[k]))  # the fit doesn't depend on the order in which rows arrive
    y, held = y[order], [vec.unpack(blobs[k]) for k in order]
    feats, values = [f for f, _ in held], np.concatenate([v for _, v in held]).astype(float)
    cols = np.concatenate([*feats, changed]).astype(np.int64)
    used, dense = np.unique(cols, return_inverse=True)
    n = sum(map(len, feats))
    x = Sparse(np.repeat(np.arange(len(y)), [len(f) for f in feats]), dense[:n], len(y), len(used), values)
    change = Sparse(rows_, dense[n:], int(rows_.max(initial=-1)) + 1, len(used), amounts, pairs)
    w, bias = fit(x, y, change)
    on = np.flatnonzero(w)
    return Model(used[on], w[on], bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column toxicity, the probability that a text is toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(texts):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["text"])
        return pd.Series(np.concatenate([held.value.scores(p.column(0)) for p in vec.slices(batch, "text")] or [np.zeros(0)]))

    return docs.withColumn("toxicity", toxicity(F.col("text").cast("string")))


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS) -> DataFrame:
    """doc_id and toxicity of the toxic documents."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch, "text"):
                p = held.value.scores(part.column(1))
                on = np.flatnonzero(p >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(on)), pa.array(p[on])], ["doc_id", "toxicity"])

    return named.filter("doc_id is not null").mapInArrow(run, "doc_id long, toxicity double")
