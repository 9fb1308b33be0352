"""Mixing to target weights by iterative proportional fitting. Spark expressions only.

Documents fall into cells of (source, language, topic). The cells' token weights
are raked: source, language and topic marginals are scaled to their targets in
turn, ``ROUNDS`` times. A cell of weight w and n tokens is drawn with probability
``min(1, rate * w / n)``, where the rate makes the expected tokens ``keep`` times
all tokens (cells that would exceed one are taken whole and the rest shares what
is left). A document is drawn if a hash of its doc_id, as a number in [0, 1), lies
below the probability, so the draw repeats and equal ids fall together.

Targets default to the tokens' own shares to the power ``TEMPER``, which lifts small
groups. Null source or language count as ''; a null text has no tokens and topic
``empty``; a cell without tokens keeps probability ``keep``. All columns stay; the
result columns topic, tokens, probability and drawn replace columns of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.runtime import checkpoint

DIMENSIONS = ("source", "lang", "topic")
ROUNDS, TEMPER, KEEP = 8, 0.8, 0.8
_SYMBOLS = "#*$%&|<>"
#: Cells beyond this number are joined by a shuffle instead of a broadcast.
BROADCAST_CELLS = 50_000

_TOPIC = f"""CASE
 WHEN text IS NULL OR text = '' THEN 'empty'
 WHEN 50 * (length(text) - length(translate(text, '{_SYMBOLS}', ''))) > length(text) THEN 'markup'
 WHEN length(text) < 500 THEN 'brief'
 WHEN length(text) < 100 * (length(text) - length(replace(text, chr(10), ''))) THEN 'list'
 WHEN length(text) < 4000 THEN 'article' ELSE 'long' END"""


def default_topic() -> Column:
    """A topic from the text's own form."""
    return F.expr(_TOPIC)


def _keyed(docs: DataFrame, topic: Column | None) -> DataFrame:
    tokens = F.coalesce(F.expr("(octet_length(text) + 3) div 4"), F.lit(0)).cast("long")
    return docs.withColumns({"topic": topic if topic is not None else default_topic(), "tokens": tokens}).withColumns(
        {"_source": F.coalesce("source", F.lit("")), "_lang": F.coalesce("lang", F.lit("")), "_topic": F.coalesce("topic", F.lit(""))}
    )


def rake(cells: DataFrame, rounds: int = ROUNDS, temper: float = TEMPER, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``cells`` (_source, _lang, _topic, n) with weight: shares whose marginals meet the targets.

    ``targets`` may give for a dimension a frame of (value, share); others are tempered.
    """
    rows = cells.withColumn("weight", F.col("n").cast("double"))
    for d in DIMENSIONS:
        own = Window.partitionBy(f"_{d}")
        if targets and d in targets:
            t = targets[d].select(F.col("value").alias(f"_{d}"), F.col("share").alias(f"t_{d}"))
            rows = rows.join(t, f"_{d}", "left").withColumn(f"t_{d}", F.coalesce(f"t_{d}", F.lit(0.0)))
        else:
            rows = rows.withColumn(f"t_{d}", F.pow(F.sum("n").over(own).cast("double"), F.lit(temper)))
    for _ in range(rounds):
        for d in DIMENSIONS:
            total = F.sum("weight").over(Window.partitionBy(f"_{d}"))
            rows = rows.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"t_{d}") / total).otherwise(0.0))
    return rows


def marginal_error(raked: DataFrame) -> float:
    """The largest relative distance of a marginal of ``rake``'s result from its target share; 0 without cells."""
    worst = 0.0
    for d in DIMENSIONS:
        sums = raked.groupBy(f"_{d}").agg(F.sum("weight").alias("w"), F.max(f"t_{d}").alias("t")).where("t > 0")
        whole = sums.agg(F.sum("w").alias("w"), F.sum("t").alias("t")).first()
        if whole["w"]:
            worst = max(worst, sums.agg(F.max(F.abs(F.col("w") / whole["w"] / (F.col("t") / whole["t"]) - 1)).alias("e")).first()["e"])
    return worst


def probabilities(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """``cells`` with n and weight, and probability: the draw of each cell.

    Cells that the rate would take more than whole are taken whole, and the rate is made anew
    for the others until no more are. Each step is one sum over the cells, and only its two
    numbers come to the driver; as a rule there are a few steps.
    """
    rows = checkpoint(cells.where("n > 0 AND weight > 0").withColumn("ratio", F.col("weight") / F.col("n")))
    whole = F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
    every = rows.agg(whole.alias("x")).first()["x"]
    full_n, full_w, rate = 0, 0.0, math.inf
    while full_n < every["n"]:
        rate = (keep * every["n"] - full_n) / (every["w"] - full_w) if every["w"] > full_w else math.inf
        now = rows.where(F.lit(rate) * F.col("ratio") > 1).agg(whole.alias("x")).first()["x"]
        if now["n"] == full_n:
            break
        full_n, full_w = now["n"], now["w"]
    return rows.withColumn("probability", F.least(F.lit(1.0), F.lit(rate) * F.col("ratio"))).select(*(f"_{d}" for d in DIMENSIONS), "probability")


def uniform(key: Column) -> Column:
    """A number in [0, 1) from a key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / 4294967296.0


def draw(docs: DataFrame, keep: float = KEEP, rounds: int = ROUNDS, temper: float = TEMPER, topic: Column | None = None, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``docs`` with topic, tokens, probability and drawn. Rows with one doc_id, or without an id and with one text, are drawn together."""
    rows = _keyed(docs, topic)
    keys = [f"_{d}" for d in DIMENSIONS]
    cells = rows.groupBy(*keys).agg(F.sum("tokens").alias("n"))
    cells = checkpoint(probabilities(rake(cells, rounds, temper, targets), keep))
    side = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    found = rows.join(side, keys, "left").withColumn("probability", F.coalesce("probability", F.lit(float(keep))))
    # a row without an id is drawn by its text, so not all of them stand or fall together
    drawn_by = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")))))
    return found.withColumn("drawn", uniform(drawn_by) < F.col("probability")).drop(*keys)


def sample(docs: DataFrame, keep: float = KEEP, topic: Column | None = None) -> DataFrame:
    """The drawn rows of ``docs``, with all its columns as they were."""
    rows = docs.select("doc_id", "text", "source", "lang", F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    return draw(rows, keep, topic=topic).where("drawn").select("_row.*")


def draw_sql() -> str:
    """The query of ``draw`` with defaults, for DuckDB."""
    steps = []
    last = "t"
    for i in range(ROUNDS):
        for d in DIMENSIONS:
            name = f"r{i}_{d}"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (weight * t_{d} / sum(weight) OVER (PARTITION BY _{d}) AS weight) FROM {last})")
            last = name
    topic = _TOPIC
    tempered = ", ".join(f"pow((sum(n) OVER (PARTITION BY _{d}))::DOUBLE, {TEMPER}) AS t_{d}" for d in DIMENSIONS)
    order = "ORDER BY ratio DESC, _source, _lang, _topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
WITH k AS (SELECT doc_id, source, lang, {topic} AS topic, coalesce((strlen(text) + 3) // 4, 0)::BIGINT AS tokens FROM documents),
c AS (SELECT coalesce(source, '') AS _source, coalesce(lang, '') AS _lang, topic AS _topic, sum(tokens)::BIGINT AS n FROM k GROUP BY ALL),
t AS MATERIALIZED (SELECT *, n::DOUBLE AS weight, {tempered} FROM c WHERE n > 0),
{", ".join(steps)},
a AS (SELECT *, weight / n AS ratio FROM {last}),
b AS (SELECT *, coalesce(sum(n) OVER ({order}), 0) AS full_n, coalesce(sum(weight) OVER ({order}), 0) AS full_w, sum(n) OVER () AS all_n, sum(weight) OVER () AS all_w FROM a),
e AS (SELECT *, ({KEEP} * all_n - full_n) / (all_w - full_w) AS rate FROM b),
f AS (SELECT max_by(rate, ratio) AS rate FROM e WHERE rate > 0 AND rate * ratio <= 1),
p AS (SELECT _source, _lang, _topic, least(1.0, f.rate * ratio) AS probability FROM e, f)
SELECT doc_id, source, lang, topic, tokens, round(coalesce(probability, {KEEP}), 9) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 < coalesce(probability, {KEEP}) AS drawn
FROM k LEFT JOIN p ON coalesce(source, '') = _source AND coalesce(lang, '') = _lang AND topic = _topic
"""
