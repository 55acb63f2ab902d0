"""Where operators once did less than the whole job."""

import numpy as np
import pytest
from plain import lm

from quarry.llm import lm_scoring, simhash_dedup


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_lm_finds_the_longest_context(spark, monkeypatch):
    from test_llm_operators import corpus

    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", 1500)
    monkeypatch.setattr(lm_scoring, "swept", lambda spark: None)
    rows = [*corpus(1, 20, 12, 60), (200, "a " * 20), (201, "a " * 9 + "b " + "a " * 7), (202, "x y z a b"), (203, "x y z a c"), (204, "w y z a b")]
    got = {r.doc_id: r for r in lm_scoring.lm_scores(frame(spark, rows).repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, n, mean, context in lm(rows, lm_scoring.ALPHA):
        assert got[i].n_words == n
        assert (got[i].log2_probability, got[i].context) == (pytest.approx(mean, abs=3e-6), pytest.approx(context, abs=2e-6))


def test_lm_counts_words_for_the_empty_context(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "swept", lambda spark: None)
    rows = [(1, "the"), (2, "q1 the"), (3, "q2 the"), (4, "q3 new"), (5, "the")]
    got = {r.doc_id: r.log2_probability for r in lm_scoring.lm_scores(frame(spark, rows)).collect()}
    for i, _, mean, _ in lm(rows, lm_scoring.ALPHA):
        assert got[i] == pytest.approx(mean, abs=2e-6)
    assert got[2] > got[4] + 2  # a common word after an unknown one isn't an unknown word


@pytest.mark.parametrize("bits", [12, 16, 20, 24, 26, 28, 30, simhash_dedup.MOST])
def test_near_copies_meet_at_every_distance(bits):
    rng = np.random.default_rng(bits)
    n = 1500
    x = rng.integers(0, 2**64, (n, 3), dtype=np.uint64)
    flips = np.argsort(rng.random((n, simhash_dedup.BITS)), axis=1) < bits
    y = x ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    assert (simhash_dedup.distance(x, y) == bits).all()
    sent = [{(int(w), int(k)) for w, k in zip(*simhash_dedup.anchors(f), strict=True)} for f in (x, y)]
    met = len({w for w, _ in sent[0] & sent[1]}) / n
    print(bits, met)
    assert met >= 0.9
