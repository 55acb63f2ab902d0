"""Mixing sources to target weights by iterative proportional fitting.

A document's tokens are its UTF-8 bytes over `bytes_per_token`, rounded up, at least 1. Tokens are added up by cell (source, language,
topic). The targets of each marginal are its own shares raised to a power below 1 (its temper: the smaller, the closer to equal shares), or
given shares; values that aren't named share what is left in proportion, and given shares are scaled to add up to 1 where no value is left
unnamed or they exceed it. A share of 0 gives weight 0: none of those documents are taken. Shares that are negative or not numbers, that
name a marginal or a value that isn't there, or leave nothing at all, are errors. Raking multiplies the cells' masses until they meet each
marginal's target in turn, for a fixed number of rounds. A cell's weight is its raked mass over its mass. Documents are then sampled by
calibrated probabilities min(1, c * weight), with c such that the expected tokens are `keep` of all tokens. Whether a document is taken
depends on a hash of its doc_id only, so the sample is the same on every run and in every partitioning.

Tokens come from a column n_tokens (that of `token_counts`, say) if `counted` names it, else from the bytes. The topic is a column of that name, or else the first rule whose strings the text holds ("prose" if none does).

Null source, language or topic count as the value "unknown". A null or empty text has one token. A null doc_id is hashed by the text. Repeated
rows are documents of their own in the counts, and are taken or left together. Texts may be of any length: only their bytes are counted and
their topic's strings looked for. Equal weights are no tie: each document is taken or left by itself. Columns named like the result's (topic, n_tokens, weight,
probability) are replaced; other extra columns are left out of the query and kept by the stage. An empty table gives no rows.

Cells are few (values of source times languages times topics); up to `most_cells` are raked on the driver, more of them by window sums
over the table of cells. Either way the documents are read twice and shuffled only as cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shared import dropped, written

TOPICS: tuple[tuple[str, tuple[str, ...]], ...] = (("legal", ("icense", "opyright")), ("tabular", (" | ",)), ("contact", ("@", "+1 (")), ("shout", ("!!", "###", "***")))
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.5}
KEEP, ROUNDS, BYTES_PER_TOKEN, MOST_CELLS = 0.5, 50, 4, 200_000
CELL = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, needles in reversed(TOPICS):
        held = F.lit(False)
        for needle in needles:
            held = held | F.contains(text, F.lit(needle))
        out = F.when(held, name).otherwise(out)
    return F.when(text.isNull(), "prose").otherwise(out)


def celled(docs: DataFrame, counted: str | None = None) -> DataFrame:
    text = F.col("text").cast("string")
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    topic = value("topic") if "topic" in docs.columns else topic_of(text)
    return docs.withColumns(
        {
            "topic": topic,
            "n_tokens": F.greatest(F.lit(1), F.coalesce(F.col(counted) if counted else F.ceil(F.octet_length(text) / F.lit(float(BYTES_PER_TOKEN))), F.lit(1))).cast("long"),
            "__source": value("source"),
            "__lang": value("lang"),
            "__u": F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), text, F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)),
        }
    )


def shares_of(own: np.ndarray, values: list[str], given: dict[str, float] | None, name: str) -> np.ndarray:
    """The target shares of a marginal's values: own ones, but for those that are given."""
    share = own / own.sum()
    if given:
        if unknown := sorted(set(given) - set(values)):
            raise ValueError(f"no document has the {name} {unknown[0]!r}")
        if not all(np.isfinite(v) and v >= 0 for v in given.values()):
            raise ValueError(f"shares of {name} must be numbers from 0")
        told = np.array([given.get(v, np.nan) for v in values], float)
        rest = np.isnan(told)
        left = max(0.0, 1 - told[~rest].sum())
        share = np.where(rest, share * (left / share[rest].sum() if rest.any() else 0), told)
        if not share.sum() > 0:
            raise ValueError(f"the shares of {name} leave nothing")
        share = share / share.sum()
    return share


def _known(targets: dict[str, dict[str, float]]) -> None:
    if unknown := sorted(set(targets) - set(CELL)):
        raise ValueError(f"no marginal {unknown[0]!r}")


def rake(cells: list[tuple[str, str, str, float]], temper: dict[str, float], targets: dict[str, dict[str, float]], keep: float, rounds: int) -> list[tuple[float, float]]:
    """Weight and probability of each cell."""
    _known(targets)
    mass = np.array([c[3] for c in cells], float)
    x, total, goals = mass.copy(), mass.sum(), []
    for k, name in enumerate(CELL):
        values, of = np.unique(np.array([c[k] for c in cells], object), return_inverse=True)
        here = np.bincount(of, mass)
        goals.append((of, shares_of((here / total) ** temper[name], values.tolist(), targets.get(name), name) * total))
    for _ in range(rounds):
        for of, goal in goals:
            have = np.bincount(of, x)
            x = x * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[of]  # a value without mass left keeps none
    weight = x / mass
    if not weight.any():
        raise ValueError("no cell meets the targets: those of one marginal leave nothing of another's")
    budget, full, c = keep * total, weight == 0, 0.0
    while not full.all():
        c = (budget - mass[full & (weight > 0)].sum()) / (mass * weight)[~full].sum()
        more = ~full & (c * weight >= 1)
        if not more.any():
            break
        full |= more
    return [(float(w), 0.0 if w == 0 else 1.0 if f else float(min(1.0, c * w))) for w, f in zip(weight, full, strict=True)]


def rake_table(cells: DataFrame, temper: dict[str, float], targets: dict[str, dict[str, float]], keep: float, rounds: int) -> DataFrame:
    """rake() for any number of cells, as window sums. The values with given shares come to the driver with their own, no others."""
    _known(targets)
    total = cells.agg(F.sum("mass")).first()[0]
    x = cells.withColumn("x", F.col("mass"))
    for name in CELL:
        shares = cells.groupBy(name).agg(F.sum("mass").alias("m")).withColumn("s", F.pow(F.col("m") / total, temper[name]))
        given = targets.get(name) or {}
        whole, named = shares.agg(F.sum("s"), F.sum(F.when(F.col(name).isin(list(given)), F.col("s")))).first() if given else (shares.agg(F.sum("s")).first()[0], None)
        share = F.col("s") / whole
        if given:
            own = {r[0]: r[1] for r in shares.filter(F.col(name).isin(list(given))).select(name, "s").collect()}
            others = whole - (named or 0.0)
            rest = [("", others)] if shares.filter(~F.col(name).isin(list(given))).limit(1).count() else []  # all others as one value
            told = shares_of(np.array([*own.values(), *(s for _, s in rest)]), [*((v,) for v in own), *rest], {(v,): g for v, g in given.items()}, name)
            for (value, _), goal in zip(own.items(), told, strict=False):
                share = F.when(F.col(name) == value, F.lit(float(goal))).otherwise(share)
            if rest:
                share = F.when(F.col(name).isin(list(given)), share).otherwise(F.col("s") / others * float(told[-1]))
        x = x.join(shares.select(name, (share * total).alias(f"goal_{name}")), name)
    held = None
    for k in range(rounds):
        for name in CELL:
            have = F.sum("x").over(W.partitionBy(name))
            x = x.withColumn("x", F.when(have > 0, F.col("x") * F.col(f"goal_{name}") / have).otherwise(0.0))
        if k % 5 == 4:
            before, held = held, written(x)
            if before is not None:
                dropped(before)
            x = held
    x = written(x.select(*CELL, "mass", (F.col("x") / F.col("mass")).alias("weight")))
    if total and not x.filter("weight > 0").limit(1).count():
        raise ValueError("no cell meets the targets: those of one marginal leave nothing of another's")
    c, last = 0.0, -1
    while True:
        full = (F.col("weight") * c >= 1) if last >= 0 else F.lit(False)
        n, done, rest = x.filter("weight > 0").agg(F.sum(full.cast("long")), F.sum(F.when(full, F.col("mass")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("mass") * F.col("weight")))).first()
        if n == last or not rest:
            break
        last, c = n, (keep * total - done) / rest
    return x.select(*CELL, "weight", F.least(F.lit(1.0), F.col("weight") * c).alias("probability"))


def mixed(docs: DataFrame, keep: float = KEEP, temper: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, most_cells: int = MOST_CELLS, counted: str | None = None) -> DataFrame:
    """The sampled rows of docs with topic, n_tokens, weight and probability (rounded to 6 digits). targets: shares by marginal and value; counted: a column with the documents' tokens."""
    spark, temper = docs.sparkSession, TEMPER | (temper or {})
    marked = celled(docs, counted)
    cells = written(marked.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("topic").alias("topic")).agg(F.sum("n_tokens").cast("double").alias("mass")))
    schema = "__source string, __lang string, topic string, weight double, probability double"
    if cells.count() <= most_cells:
        rows = sorted(tuple(r) for r in cells.collect())
        raked = spark.createDataFrame([(*c[:3], *wp) for c, wp in zip(rows, rake(rows, temper, targets or {}, keep, rounds) if rows else [], strict=True)], schema)
        raked = F.broadcast(raked)
    else:
        raked = rake_table(cells, temper, targets or {}, keep, rounds).toDF("__source", "__lang", "topic", "weight", "probability")
    taken = marked.drop("weight", "probability").join(raked, ["__source", "__lang", "topic"]).filter("__u < probability")
    return taken.withColumns({"weight": F.round("weight", 6), "probability": F.round("probability", 6)}).drop("__source", "__lang", "__u")


def sampled(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight and probability of the sampled documents."""
    few = docs.select("doc_id", "text", "source", "lang", *(["topic"] if "topic" in docs.columns else []))
    return mixed(few, keep).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability")


def _sql() -> str:
    case = " ".join(f"WHEN {' OR '.join(f"contains(text, '{n}')" for n in needles)} THEN '{name}'" for name, needles in TOPICS)
    step, inner = "it", ""
    for name in CELL:
        inner = f"(SELECT k, source, lang, topic, mass, goal_source, goal_lang, goal_topic, x * goal_{name} / sum(x) OVER (PARTITION BY {name}) AS x FROM {step})"
        step = inner
    goals = ", ".join(f"goal_{n} AS (SELECT {n}, pow(sum(mass) / (SELECT sum(mass) FROM cells), {TEMPER[n]}) AS s FROM cells GROUP BY {n})" for n in CELL)
    joins = " ".join(f"JOIN goal_{n} g_{n} ON g_{n}.{n} = cells.{n}" for n in CELL)
    masses = ", ".join(f"g_{n}.s / (SELECT sum(s) FROM goal_{n}) * (SELECT sum(mass) FROM cells) AS goal_{n}" for n in CELL)
    return f"""
WITH RECURSIVE marked AS (
  SELECT doc_id, source, lang, coalesce(source, 'unknown') AS s, coalesce(lang, 'unknown') AS l, CASE {case} ELSE 'prose' END AS topic,
         greatest(1, coalesce(ceil(strlen(text) / {BYTES_PER_TOKEN}.0), 1))::BIGINT AS n_tokens,
         CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM documents),
cells AS (SELECT s AS source, l AS lang, topic, sum(n_tokens)::DOUBLE AS mass FROM marked GROUP BY ALL),
{goals},
start AS (SELECT 0 AS k, cells.source, cells.lang, cells.topic, mass, {masses}, mass AS x FROM cells {joins}),
it AS (
  SELECT k, source, lang, topic, mass, goal_source, goal_lang, goal_topic, x FROM start
  UNION ALL
  SELECT k + 1, source, lang, topic, mass, goal_source, goal_lang, goal_topic, x FROM {inner} WHERE k < {ROUNDS}),
raked AS (SELECT source, lang, topic, mass, x / mass AS weight FROM it WHERE k = {ROUNDS}),
filled AS (
  SELECT weight, sum(mass) OVER w AS above, sum(mass * weight) OVER w AS above_weighted, (SELECT sum(mass) FROM raked) AS total, (SELECT sum(mass * weight) FROM raked) AS all_weighted
  FROM raked WINDOW w AS (ORDER BY weight DESC)),
options AS (
  SELECT {KEEP} * (SELECT sum(mass) FROM raked) / (SELECT sum(mass * weight) FROM raked) AS c, NULL::DOUBLE AS last, (SELECT max(weight) FROM raked) AS next
  UNION ALL
  SELECT ({KEEP} * total - above) / nullif(all_weighted - above_weighted, 0), weight, (SELECT max(weight) FROM raked r WHERE r.weight < filled.weight) FROM filled),
chosen AS (SELECT max_by(c, coalesce(last, 1e300)) AS c FROM options WHERE c * next < 1)
SELECT doc_id, marked.source, marked.lang, marked.topic, n_tokens, round(weight, 6) AS weight, round(least(1.0, c * weight), 6) AS probability
FROM marked JOIN raked ON s = raked.source AND l = raked.lang AND marked.topic = raked.topic CROSS JOIN chosen
WHERE u < least(1.0, c * weight)
"""


SQL = _sql()
