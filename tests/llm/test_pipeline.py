"""The pipeline, stage by stage and row by row, against plain Python on a small table."""

import hashlib
import math
import random
import re

import pyarrow as pa
import pytest
from plain import edit, groups

import corpus_pipeline
from quarry.llm import decontaminate, mixing, pii, simhash_dedup, toxicity


def word(r):
    return "".join(r.choice("abcdefghiklmnoprstuv") for _ in range(r.randint(3, 8)))


def fixture():
    r = random.Random(6)
    words, insults = [word(r) for _ in range(400)], ["zzkrumpf", "qqvextor", "wwhatrix"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, say(25)) for k in range(4)]
    docs, labels = [], []
    for i in range(150):
        text, kind = say(r.randint(30, 60)), r.random()
        if kind < 0.25:
            text += " " + " ".join(r.choice(insults) for _ in range(3))
        elif kind < 0.45 and docs:
            old = r.choice(docs)[1].split()
            if r.random() < 0.5:
                old[r.randrange(len(old))] = "changed"
            text = " ".join(old)
        elif kind < 0.6:
            text = f"{text} {r.choice(items)[1]} {say(3)}"
        elif kind < 0.7:
            text += f" mail {word(r)}.{word(r)}@{word(r)}.com or 10.1.{r.randint(1, 250)}.7"
        docs.append((i, text, r.choice(["en", "de"]), r.choice(["web", "web", "web", "books"]), len(text)))
        if i % 2:
            labels.append((i, 1, int(any(x in text for x in insults))))
    docs += [(200, None, "en", "web", None), (201, "", None, "web", 0), docs[3], docs[7]]
    return docs, labels, items


def rake(cells, keep):
    """Weight and probability by cell, in plain loops."""
    total, x = sum(cells.values()), dict(cells)
    goals = []
    for k, name in enumerate(mixing.CELL):
        own = {}
        for c, m in cells.items():
            own[c[k]] = own.get(c[k], 0) + m
        tempered = {v: (m / total) ** mixing.TEMPER[name] for v, m in own.items()}
        goals.append({v: s / sum(tempered.values()) * total for v, s in tempered.items()})
    for _ in range(mixing.ROUNDS):
        for k in range(3):
            have = {}
            for c, m in x.items():
                have[c[k]] = have.get(c[k], 0) + m
            x = {c: m * goals[k][c[k]] / have[c[k]] for c, m in x.items()}
    weight, full = {c: x[c] / cells[c] for c in cells}, set()
    while True:
        c_ = (keep * total - sum(cells[c] for c in full)) / sum(cells[c] * weight[c] for c in cells if c not in full)
        more = {c for c in cells if c not in full and c_ * weight[c] >= 1}
        if not more:
            break
        full |= more
    return {c: (round(weight[c], 6), 1.0 if c in full else c_ * weight[c]) for c in cells}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    docs, labels, items = fixture()
    at = f"file://{tmp_path_factory.mktemp('pipeline')}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, items


def test_rows_of_every_stage(spark, small):
    at, docs, items = small
    # 1: whole texts by the model that the stage trains
    model = toxicity.train(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    p = model.scores(pa.array([d[1] for d in docs], pa.string()))
    kept = [d for d, x in zip(docs, p, strict=True) if x < toxicity.THRESHOLD]
    assert {d[0] for d in docs} - {d[0] for d in kept} == {d[0] for d in docs if d[1] and re.search("zzkrumpf|qqvextor|wwhatrix", d[1])}
    stages = [sorted(kept, key=str)]
    # 2: every pair of fingerprints
    f, counts = simhash_dedup.fingerprints(pa.array([d[1] for d in kept], pa.string()))
    edges = [(kept[i][0], kept[j][0]) for i in range(len(kept)) for j in range(i) if counts[i] and counts[j] and simhash_dedup.distance(f[i], f[j]) <= simhash_dedup.MOST]
    lead = groups([d[0] for d in kept], edges)
    once, out = set(), []
    for d in kept:
        twice = any(a == b == d[0] for a, b in edges)
        if lead.get(d[0], d[0]) == d[0] and not ((d[0] in lead or twice) and d[0] in once):
            once.add(d[0])
            out.append(d)
    kept = out
    stages.append(sorted(kept, key=str))
    # 3: full alignment with every item
    codes = lambda t: decontaminate.normal_text(t or "").tolist()
    kept = [d for d in kept if not any(d[1] and edit(codes(t), codes(d[1])) <= int(decontaminate.RATE * len(codes(t))) for _, t in items)]
    stages.append(sorted(kept, key=str))
    # 4: text by text
    found = {d: pii.found(pii.train(), d[1] or "") for d in kept}
    assert sum(len(x) for x in found.values()) > 4
    kept = [(d[0], None if d[1] is None else pii.redact(d[1], found[d]), *d[2:4], d[4] if d[1] is None else len(pii.redact(d[1], found[d]))) for d in kept]
    stages.append(sorted(kept, key=str))
    # 5: plain loops
    topic = lambda t: next((name for name, needles in mixing.TOPICS if t and any(n in t for n in needles)), "prose")
    tokens = lambda t: max(1, math.ceil(len((t or "").encode()) / mixing.BYTES_PER_TOKEN))
    cell = lambda d: (d[3] or "unknown", d[2] or "unknown", topic(d[1]))
    cells = {}
    for d in kept:
        cells[cell(d)] = cells.get(cell(d), 0) + tokens(d[1])
    raked = rake(cells, mixing.KEEP)
    u = lambda d: int(hashlib.md5(str(d[0]).encode()).hexdigest()[:8], 16) / 2**32
    stages.append(sorted(((*d, topic(d[1]), tokens(d[1]), raked[cell(d)][0], round(raked[cell(d)][1], 6)) for d in kept if u(d) < raked[cell(d)][1]), key=str))
    assert all(len(a) > len(b) for a, b in zip(stages, stages[1:], strict=False) if a is not stages[2]) and len(stages[4]) > 10
    # the pipeline
    now = spark.read.parquet(f"{at}/documents.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for (name, stage), want in zip(corpus_pipeline.STAGES, stages, strict=True):
        now = stage(spark, now, at)
        got = sorted((tuple(r) for r in now.select(*columns, *(["topic", "n_tokens", "weight", "probability"] if name == "mixing" else [])).collect()), key=str)
        assert [str(x) for x in got] == [str(x) for x in want], name
    whole = corpus_pipeline.run(spark, at).select(*columns, "topic", "n_tokens", "weight", "probability").collect()
    assert sorted((str(tuple(r)) for r in whole)) == sorted(str(x) for x in stages[4])


def test_of_repeated_rows_the_same_one_stays(spark, small):
    text = "one two three four five six seven eight nine ten"
    rows = spark.createDataFrame([(1, text, "b"), (1, text, "a"), (1, text + " eleven", "c"), (2, text, "d")], "doc_id long, text string, source string")
    got = {tuple(corpus_pipeline.near_duplicates_stage(spark, rows.repartition(n), small[0]).collect()) for n in (1, 2, 4)}
    assert len(got) == 1 and [r.doc_id for r in next(iter(got))] == [1]
