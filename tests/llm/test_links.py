"""Near pairs of fingerprints against all pairs."""

import numpy as np
import pytest
from plain import groups

from quarry.llm import simhash_dedup

BITS, MOST = simhash_dedup.BITS, simhash_dedup.MOST


def apart(rng, x, bits):
    """A copy of each fingerprint of which so many bits differ."""
    flips = np.argsort(rng.random((len(x), BITS)), axis=1) < bits
    return x ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)


def random(rng, n):
    return rng.integers(0, 2**64, (n, 3), dtype=np.uint64)


def linked(ids, f, most):
    near = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(simhash_dedup.distance(f[:i], f[i]) <= most)]
    return groups(ids, near)


@pytest.mark.parametrize("many", [1, 1 << 22])
def test_no_link_at_the_threshold_is_left_out(spark, monkeypatch, many):
    # raising=False: the search before had no such sizes
    monkeypatch.setattr(simhash_dedup, "FEW", 500, raising=False)
    monkeypatch.setattr(simhash_dedup, "MANY", many, raising=False)
    rng = np.random.default_rng(7)
    x = random(rng, 1000)
    f = np.concatenate((x, apart(rng, x[:800], MOST), apart(rng, x[800:], MOST + 1)))
    rows = [(k, *(int(w) for w in row)) for k, row in enumerate(f.view(np.int64))]
    edges = simhash_dedup.near_pairs(spark.createDataFrame(rows, "doc_id long, f0 long, f1 long, f2 long").repartition(3)).collect()
    assert groups(range(2000), edges) == {k: k % 1000 for k in range(2000) if k % 1000 < 800}


@pytest.mark.parametrize("most", [0, 1, 2, 11, 31, MOST, 33, 100])
def test_every_pair_within_the_threshold_is_near_in_a_block(most):
    plan = simhash_dedup.plan(most)
    bits = np.concatenate([b for b, _ in plan])
    assert len(set(bits.tolist())) == len(bits) and all(len(b) and r in (0, 1) for b, r in plan)
    assert sum(r + 1 for _, r in plan) > most


@pytest.mark.parametrize("crowd", [1, 50, 1 << 22])
@pytest.mark.parametrize("both", [False, True])
def test_crowds_and_chains(monkeypatch, crowd, both):
    """Many copies of few, chains of which only neighbours are near, and strangers."""
    monkeypatch.setattr(simhash_dedup, "MANY", 1)
    monkeypatch.setattr(simhash_dedup, "CROWD", crowd)
    monkeypatch.setattr(simhash_dedup, "TILE", 100)
    rng = np.random.default_rng(8)
    chain = [random(rng, 2)]
    for _ in range(30):
        chain.append(apart(rng, chain[-1], MOST))
    f = np.concatenate((apart(rng, np.repeat(random(rng, 3), 80, axis=0), 12), *chain, random(rng, 50)))
    f = f[rng.permutation(len(f))]
    second = rng.random(len(f)) < 0.5 if both else np.zeros(len(f), bool)
    edges = list(zip(*simhash_dedup.meet(f, second, MOST), strict=True))
    want = linked(list(range(len(f))), f, MOST)
    got = groups(range(len(f)), edges)
    if both:  # what is near on one side only may be joined, or not
        near = [(i, j) for i in np.flatnonzero(~second) for j in np.flatnonzero(second) if simhash_dedup.distance(f[i], f[j]) <= MOST]
        assert all(got[i] == got[j] for i, j in near) and all(want[i] == want[g] for i, g in got.items())
    else:
        assert got == want


def test_longest_contexts_are_bounded_by_those_before():
    """limits() never goes below the true longest context, and is it within a copy."""
    from quarry.llm import lm_scoring

    begin = np.array([0, 0, 0, 0, 0, 5, 5, 5, 5, 5])  # where each place's longest context begins
    place = np.arange(1, 11)
    high = np.array([2, 4, 4, 0, 0, 2, 3, 0, 0, 0])
    got = lm_scoring.limits(place, np.zeros(10, np.int64), np.zeros(10, np.uint32), high)
    assert (got > place - begin).all()
    assert got.tolist() == [2, 3, 4, 5, 6, 2, 3, 4, 5, 6]
    assert (lm_scoring.limits(place, np.zeros(10, np.int64), np.ones(10, np.uint32), high) == lm_scoring.NONE).all()  # representatives bound nothing
    second = lm_scoring.limits(np.array([4, 9]), np.array([0, 6]), np.zeros(2, np.uint32), np.array([3, 0]))
    assert second.tolist() == [3, lm_scoring.NONE]  # no bound across texts


def test_copies_take_few_passes(spark, monkeypatch):
    """A copy of 700 words: its bounds are known from where it begins, without doubling and halving for each word."""
    from plain import lm

    from quarry.llm import lm_scoring

    tables = []
    write = lm_scoring.written
    monkeypatch.setattr(lm_scoring, "written", lambda df: tables.append(1) or write(df))
    monkeypatch.setattr(lm_scoring, "swept", lambda spark: None)
    monkeypatch.setattr(lm_scoring, "SLICES", 1)
    rng = np.random.default_rng(3)
    copy = " ".join(f"w{k}" for k in rng.integers(0, 300, 700))
    rows = [(1, f"a b {copy} c"), (2, f"d {copy} e f"), (3, " ".join(f"w{k}" for k in rng.integers(0, 300, 100)))]
    got = {r.doc_id: r for r in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    for i, _, mean, context in lm(rows, lm_scoring.ALPHA):
        assert (got[i].log2_probability, got[i].context) == (pytest.approx(mean, abs=3e-6), pytest.approx(context, abs=2e-6))
    assert len(tables) <= 14


@pytest.mark.parametrize("most", [0, 1, 11, MOST, 100])
@pytest.mark.parametrize("rows", [2000, 30_000, 350_000, 1 << 19])
def test_wide_blocks_cover_every_pair_within_the_threshold(most, rows):
    plan = simhash_dedup.wide(most, rows, rows)
    bits = np.concatenate([b for b, _ in plan])
    assert len(set(bits.tolist())) == len(bits) and all(0 < len(b) <= simhash_dedup.WIDEST for b, _ in plan)
    assert sum(r + 1 for _, r in plan) > most
    assert len(simhash_dedup.masks(5, 2)) == len(set(simhash_dedup.masks(5, 2))) == 16


@pytest.mark.parametrize("both", [False, True])
def test_strangers_in_large_blocks_are_no_crowd(monkeypatch, both):
    """Bits in common make many keys alike: rows that aren't near each other are compared in tiles, not one by one."""
    monkeypatch.setattr(simhash_dedup, "MANY", 1)
    monkeypatch.setattr(simhash_dedup, "CROWD", 50)
    monkeypatch.setattr(simhash_dedup, "LARGE", 4, raising=False)
    monkeypatch.setattr(simhash_dedup, "PAIRS", 7, raising=False)
    monkeypatch.setattr(simhash_dedup, "EDGES", 20, raising=False)

    def forest(ids, f, most):
        raise AssertionError(f"a crowd of {len(ids)}")

    monkeypatch.setattr(simhash_dedup, "forest", forest)
    rng = np.random.default_rng(9)
    f = random(rng, 300) & np.packbits(rng.random((1, BITS)) < 0.5, axis=1, bitorder="little").view(np.uint64)
    f = np.concatenate((f, apart(rng, f[:40], MOST)))
    second = np.arange(len(f)) % 2 == 1 if both else np.zeros(len(f), bool)
    edges = list(zip(*simhash_dedup.meet(f, second, MOST), strict=True))
    near = [(i, j) for i in range(len(f)) for j in range(i) if (not both or second[i] != second[j]) and simhash_dedup.distance(f[i], f[j]) <= MOST]
    assert near and groups(range(len(f)), edges) == groups(range(len(f)), near)
