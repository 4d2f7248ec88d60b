"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Tokens are counted by (source, language, topic). The weights of these cells are raked until their sums over each
attribute agree with that attribute's target shares; then each cell gets the probability ``min(1, c * weight / tokens)``
with one c for all cells, so that the expected number of kept tokens is ``budget`` times all tokens. Each document is kept
if a hash of its id, as a number from 0 to 1, lies below its cell's probability: the same documents at any partitioning,
and after the loss of any executor.

Raking works on the cells, of which there are as many as combinations of attributes, not on documents. Up to ``MOST_CELLS``
are raked in the driver with numpy; more are raked by ``rake_cells`` in Spark, the same arithmetic.

Defined results: null attributes are a value of their own; documents without an id share one draw; null and empty texts have no tokens, belong to cells as any
other, and are kept by their cell's probability (0 for a cell without tokens); values without a target get their own share,
targets for absent values are left out, and the rest is scaled to 1; rows that repeat share their fate; an empty table
stays empty; other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, join_hot, materialize, text_of

AXES = ("source", "lang", "topic")
ROUNDS = 25
MOST_CELLS = 200_000
#: Targets where none are given: shares to this power, scaled to 1, which lifts what is rare.
TEMPER = 0.7
BUDGET = 0.5
SEED = "mix-1"
SPACE = r"[ \t\n\r]+"


def topic_of(text: Column) -> Column:
    """A coarse topic by the form of the text, in place of a topic column."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.rlike(r"[#%$&*]{3}"), "markup")
        .when(text == F.upper(text), "shout")
        .when(F.length(text) < 1000, "brief")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, SPACE), "")).cast("long")


def _target(sums: dict, given: dict | None) -> dict:
    """Target shares for the values that occur."""
    total = sum(sums.values())
    shares = {v: s / total for v, s in sums.items()}
    if given is None:
        shares = {v: s**TEMPER for v, s in shares.items()}
    else:
        shares = {v: given.get(v, s) for v, s in shares.items()}
    whole = sum(shares.values())
    return {v: s / whole for v, s in shares.items()}


def rake(cells: list[tuple], targets: dict[str, dict] | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """cells (source, lang, topic, tokens): weights that sum to 1 and whose marginals agree with the targets."""
    tokens = np.array([c[-1] for c in cells], float)
    weight = tokens / tokens.sum()
    axes = []
    for k, axis in enumerate(AXES):
        values = sorted({c[k] for c in cells}, key=str)
        at = {v: i for i, v in enumerate(values)}
        index = np.array([at[c[k]] for c in cells])
        share = _target(dict(zip(values, np.bincount(index, tokens), strict=True)), (targets or {}).get(axis))
        axes.append((index, np.array([share[v] for v in values])))
    for _ in range(rounds):
        for index, share in axes:
            now = np.bincount(index, weight, len(share))
            weight = weight * np.divide(share, now, out=np.zeros_like(share), where=now > 0)[index]
    return weight


def calibrate(weight: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, c * weight / tokens) whose expected tokens are budget times all, c found by filling cells up."""
    ratio = np.divide(weight, tokens, out=np.zeros_like(weight), where=tokens > 0)
    order = np.argsort(-ratio, kind="stable")
    want = budget * tokens.sum()
    full = np.concatenate([[0.0], np.cumsum(tokens[order])])
    rest = np.concatenate([np.cumsum(weight[order][::-1])[::-1], [0.0]])
    c = 0.0
    for k in range(len(order)):  # with the k first cells full
        c = (want - full[k]) / rest[k] if rest[k] > 0 else np.inf
        if c * ratio[order[k]] <= 1:
            break
    return np.minimum(1.0, np.where(ratio > 0, c * ratio, 0.0))


def deviation(cells: list[tuple], weight: np.ndarray, targets: dict[str, dict] | None = None) -> float:
    """How far the marginals of raked weights are from their targets at most: what is left after the rounds."""
    tokens, most = np.array([c[-1] for c in cells], float), 0.0
    for k, axis in enumerate(AXES):
        values = sorted({c[k] for c in cells}, key=str)
        at = {v: i for i, v in enumerate(values)}
        index = np.array([at[c[k]] for c in cells])
        share = _target(dict(zip(values, np.bincount(index, tokens), strict=True)), (targets or {}).get(axis))
        most = max(most, float(np.abs(np.bincount(index, weight, len(values)) - [share[v] for v in values]).max()))
    return most


def rake_cells(cells: DataFrame, targets: dict[str, dict] | None, rounds: int) -> DataFrame:
    """``rake`` for more cells than the driver should hold: add weight.

    A weight is the cell's token share times one factor an axis. The cells are read and never rewritten; each step sums them
    by one axis and writes that axis's factors, so the plan stays as small in the last step as in the first.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return cells.withColumn("weight", F.lit(0.0))
    n_cells = cells.count()
    key = lambda axis: F.coalesce(F.concat(F.lit("="), F.col(axis)), F.lit(""))  # noqa: E731  # null is a value
    factors, few = {}, {}
    for axis in AXES:
        own = cells.groupBy(key(axis).alias("_v"), axis).agg((F.sum("tokens") / F.lit(total)).alias("share"))
        given = (targets or {}).get(axis)
        if given is None:
            own = own.withColumn("share", F.pow("share", F.lit(TEMPER)))
        elif given:
            known = [F.lit(x) for v, t in given.items() if v is not None for x in (v, float(t))]
            aim = F.create_map(*known)[F.col(axis)] if known else F.lit(None).cast("double")
            aim = F.when(F.col(axis).isNull(), F.lit(given.get(None)).cast("double")).otherwise(aim)
            own = own.withColumn("share", F.coalesce(aim, F.col("share")))
        whole = own.agg(F.sum("share")).first()[0]
        factors[axis] = materialize(own.select("_v", (F.col("share") / F.lit(whole)).alias("share"), F.lit(1.0).alias("factor")), "factors")
        few[axis] = factors[axis].limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def weighed() -> DataFrame:
        out = cells.withColumn("weight", F.col("tokens") / F.lit(total))
        for axis in AXES:
            left, right = out.withColumn("_v", key(axis)), factors[axis].select("_v", "factor")
            out = left.join(F.broadcast(right), "_v") if few[axis] else join_hot(left, right, ["_v"], n_cells, F.xxhash64(*AXES), "inner")
            out = out.withColumn("weight", F.col("weight") * F.col("factor")).drop("_v", "factor")
        return out

    for _ in range(rounds):
        for axis in AXES:
            now = weighed().groupBy(key(axis).alias("_v")).agg(F.sum("weight").alias("now"))
            factor = F.when(F.col("now") > 0, F.col("factor") * F.col("share") / F.col("now")).otherwise(F.lit(0.0))
            factors[axis] = materialize(factors[axis].join(now, "_v").select("_v", "share", factor.alias("factor")), "factors")
    return materialize(weighed(), "raked")


def probabilities(docs: DataFrame, targets: dict | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """docs (source, lang, topic, tokens): one row a cell with its weight and probability."""
    spark = docs.sparkSession
    cells = docs.groupBy(*AXES).agg(F.sum("tokens").alias("tokens"))
    schema = "source string, lang string, topic string, tokens long, weight double, probability double"
    rows = [tuple(r) for r in cells.limit(MOST_CELLS + 1).collect()]
    if len(rows) > MOST_CELLS:
        cells = rake_cells(materialize(cells, "cells"), targets, rounds)
        # the same c from sums: of the cells that it fills their tokens, of the others their weights, until it fills no more cells
        total, weight = cells.agg(F.sum("tokens"), F.sum("weight")).first()
        c = budget * total / weight if weight else 0.0
        while True:
            full = F.lit(c) * F.col("weight") >= F.col("tokens")
            filled, rest = cells.where("tokens > 0").agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
            if not rest:
                break
            now = (budget * total - filled) / rest
            if now <= c:
                break
            c = now
        return cells.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(c) * F.col("weight") / F.col("tokens"))).otherwise(F.lit(0.0)))
    rows.sort(key=str)
    if not rows or not sum(r[-1] for r in rows):
        return spark.createDataFrame([(*r, 0.0, 0.0) for r in rows], schema)
    weight = rake(rows, targets, rounds)
    p = calibrate(weight, np.array([r[-1] for r in rows], float), budget)
    return spark.createDataFrame([(*r, float(w), float(q)) for r, w, q in zip(rows, weight, p, strict=True)], schema)


def draw(seed: str = SEED) -> Column:
    """A number from 0 to 1 by the document's id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def mix_sources(docs: DataFrame, targets: dict | None = None, budget: float = BUDGET, topic: Column | None = None, rounds: int = ROUNDS, seed: str = SEED, out: tuple[str, str, str] = ("mix_topic", "mix_tokens", "probability")) -> DataFrame:
    """The sampled documents with all their columns, and by the names in ``out`` topic, tokens and probability (its inverse is the document's weight in estimates)."""
    topic = topic_of(text_of()) if topic is None else topic
    s, l, t, p, own, tokens = fresh(docs.columns, "_source", "_lang", "_cell", "_share", "_topic", "_tokens")
    rows = docs.withColumn(own, topic).withColumn(tokens, tokens_of(text_of()))
    cells = probabilities(rows.select("source", "lang", F.col(own).alias("topic"), F.col(tokens).alias("tokens")), targets, budget, rounds)
    cells = cells.select(F.col("source").alias(s), F.col("lang").alias(l), F.col("topic").alias(t), F.col("probability").alias(p))
    small = cells.limit(MOST_CELLS + 1).count() <= MOST_CELLS
    if small:
        same = F.col("source").eqNullSafe(F.col(s)) & F.col("lang").eqNullSafe(F.col(l)) & F.col(own).eqNullSafe(F.col(t))
        kept = rows.join(F.broadcast(cells), same).where(draw(seed) < F.col(p))
    else:  # a cell may hold a third of the texts
        (key,) = fresh([*rows.columns, s, l, t, p], "_key")
        cell = lambda *cols: F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(cols)]))  # noqa: E731  # leaves nulls out
        left, right = rows.withColumn(key, cell("source", "lang", own)), cells.select(cell(s, l, t).alias(key), p)
        kept = join_hot(left, right, [key], rows.count(), F.xxhash64("doc_id"), "inner").where(draw(seed) < F.col(p))
    return kept.select(*docs.columns, F.col(own).alias(out[0]), F.col(tokens).alias(out[1]), F.col(p).alias(out[2]))


def mix_report(docs: DataFrame) -> DataFrame:
    out = mix_sources(docs.select("doc_id", "text", "source", "lang"))
    return out.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("probability", 6).alias("probability"))


def mix_sql(rounds: int = ROUNDS) -> str:
    """The same in SQL: a raking step for each round and axis, then c as the only root among the numbers of full cells."""
    steps = []
    last = "w0"
    for k in range(rounds * len(AXES)):
        axis = AXES[k % len(AXES)]
        steps.append(f"w{k + 1} AS MATERIALIZED (SELECT a.source, a.lang, a.topic, a.tokens, a.weight * t.share / sum(a.weight) OVER (PARTITION BY a.{axis}) AS weight FROM {last} a JOIN t_{axis} t ON a.{axis} IS NOT DISTINCT FROM t.v)")
        last = f"w{k + 1}"
    shares = ", ".join(
        f"s_{a} AS (SELECT {a} AS v, power(sum(tokens) / (SELECT sum(tokens) FROM w0), {TEMPER}) AS share FROM w0 GROUP BY {a}), t_{a} AS MATERIALIZED (SELECT v, share / (SELECT sum(share) FROM s_{a}) AS share FROM s_{a})" for a in AXES
    )
    return rf"""
WITH d AS (SELECT doc_id, source, lang, CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN regexp_matches(coalesce(text, ''), '[#%$&*]{{3}}') THEN 'markup'
    WHEN coalesce(text, '') = upper(coalesce(text, '')) THEN 'shout' WHEN length(coalesce(text, '')) < 1000 THEN 'brief' ELSE 'prose' END AS topic,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '')) AS BIGINT) AS tokens FROM documents),
w0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens, CAST(sum(tokens) AS DOUBLE) / (SELECT sum(tokens) FROM d) AS weight FROM d GROUP BY ALL),
{shares}, {", ".join(steps)},
o AS (SELECT *, weight / tokens AS ratio, coalesce(sum(tokens) OVER (ORDER BY weight / tokens DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
    sum(weight) OVER (ORDER BY weight / tokens DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {last} WHERE tokens > 0),
c AS (SELECT max(({BUDGET} * (SELECT sum(tokens) FROM w0) - ahead) / rest) AS c FROM o WHERE ({BUDGET} * (SELECT sum(tokens) FROM w0) - ahead) / rest * ratio <= 1),
p AS (SELECT source, lang, topic, least(1.0, c * ratio) AS p FROM o, c)
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(p.p, 6) AS probability
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic = p.topic
WHERE CAST('0x' || substring(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < p.p
"""
