"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token weights are raked to the
target shares of each margin in turn until all hold; a cell's documents are then sampled with the
probability that gives the cell its weight, scaled to the wanted total and never above 1 (what
saturated cells cannot give goes to the others in proportion). Whether a document is taken is a
hash of its id against that probability, so the choice is the same on every run and cluster.

The topic is a column that the caller names, from whatever labels or model there are. Without one it
is a fixed rule over the text, which tells a few kinds of text apart but knows no subjects.

Null sources, languages and topics are values of their own. A document without tokens (a null, empty
or blank text) is always kept, as it weighs nothing. Rows that repeat an id share its fate. An empty
table gives an empty result. The operator's columns (topic, n_tokens, probability, token_weight)
replace columns of those names. Targets that contradict each other cannot all be met: then there is
a warning with the largest difference of a share that is left.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

MARGINS = ("source", "lang", "topic")
#: Target shares are shares of tokens to this power, made to sum to 1.
EVENNESS = 0.5
#: Part of all tokens that the sample shall hold.
KEEP = 0.5
ROUNDS_AT_ONCE, MOST_ROUNDS, CLOSE = 6, 60, 1e-10
#: So many cells at most are joined by broadcast and raked in one partition, which saves exchanges;
#: more are raked by the values of a margin, and no task holds them all.
FEW_CELLS = 100_000

#: Fixed rule: the topic of a text is the first whose pattern it holds, else prose.
TOPICS = {"legal": "license|rights reserved|copyright", "contact": "@|[+][0-9]", "noise": "[*][*][*]|[$][$][$]|###", "figures": "[0-9]"}


def topic_of(text: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("prose")
    for topic, pattern in reversed(TOPICS.items()):
        out = F.when(lower.rlike(pattern), F.lit(topic)).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Runs of signs other than blanks and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")), F.lit(0)).cast("long")


def _share(margin: str, targets: dict | None) -> Column:
    if targets and margin in targets:
        given = F.lit(0.0)
        for value, share in targets[margin].items():
            given = F.when(F.col(margin).eqNullSafe(F.lit(value)), F.lit(float(share))).otherwise(given)
        return given
    return F.pow(F.sum("tokens").over(Window.partitionBy(margin)), F.lit(EVENNESS))


def raked(cells: DataFrame, targets: dict | None = None) -> DataFrame:
    """cells (MARGINS, tokens) with a column weight whose margins have the target shares."""
    few = cells.count() <= FEW_CELLS
    gathered = lambda df: df.coalesce(1) if few else df
    now = gathered(cells)
    for m in MARGINS:
        now = now.withColumns({f"share_{m}": _share(m, targets), f"part_{m}": 1 / F.count("*").over(Window.partitionBy(m))})
    now = stored(now, "shares")
    # a share per value: the sum over values is the sum over cells of share / (cells of the value)
    whole = now.agg(*[F.sum(F.col(f"share_{m}") * F.col(f"part_{m}")).alias(m) for m in MARGINS]).first()
    now = gathered(now).select(*MARGINS, "tokens", *[(F.col(f"share_{m}") / F.lit(whole[m])).alias(f"share_{m}") for m in MARGINS], F.col("tokens").cast("double").alias("weight"))
    rounds, left = 0, None
    while rounds < MOST_ROUNDS and (left is None or left >= CLOSE):
        for _ in range(ROUNDS_AT_ONCE):
            for m in MARGINS:
                total = F.sum("weight").over(Window.partitionBy(m))
                now = now.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"share_{m}") / total).otherwise(F.lit(0.0)))
        rounds += ROUNDS_AT_ONCE
        now = gathered(stored(now, "raking"))
        seen = now
        for m in MARGINS:
            seen = seen.withColumn(f"got_{m}", F.sum("weight").over(Window.partitionBy(m)))
        left = max([x or 0.0 for x in seen.agg(*[F.max(F.abs(F.col(f"got_{m}") - F.col(f"share_{m}"))) for m in MARGINS]).first()])
    if left >= CLOSE:
        warnings.warn(f"shares are still off by up to {left:.1e} after {rounds} rounds", stacklevel=2)
    return now


def probabilities(cells: DataFrame, keep: float = KEEP) -> DataFrame:
    """cells (tokens, weight) with the probability that gives keep of all tokens, by weight. The
    scale rises as cells reach probability 1, until no other cell does."""
    full = lambda scale: F.lit(scale) * F.col("weight") >= F.col("tokens") * (1 - 1e-12)
    scale, n_full = 0.0, -1
    while True:
        given = F.when(full(scale), F.col("tokens"))
        row = cells.filter("tokens > 0").agg(F.sum("tokens").alias("all"), F.count(given).alias("n"), F.coalesce(F.sum(given), F.lit(0)).alias("given"), F.sum(F.when(~full(scale), F.col("weight"))).alias("left")).first()
        if not row["left"]:  # every cell gives all it has
            return cells.withColumn("probability", F.lit(1.0))
        if row["n"] == n_full:
            break
        scale, n_full = (keep * row["all"] - row["given"]) / row["left"], row["n"]
    return cells.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(scale) * F.col("weight") / F.col("tokens"))).otherwise(F.lit(1.0)))


def lot(doc_id: Column) -> Column:
    """A number from 0 to 1 that depends on the id only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mixing:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(16**12)


def mixed(docs: DataFrame, keep: float = KEEP, targets: dict | None = None, topic: Column | None = None) -> DataFrame:
    """The sampled rows of docs, with topic, n_tokens, probability and token_weight (1 / probability).
    targets gives shares by margin and value, topic the topic of each row (by default topic_of)."""
    kinds = {"topic": topic_of(F.col("text")) if topic is None else topic, "n_tokens": token_count(F.col("text"))}
    own = docs.withColumns(kinds).drop("probability", "token_weight")
    cells = stored(own.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    chances = stored(probabilities(raked(cells, targets), keep).select(*[F.col(m).alias(f"cell_{m}") for m in MARGINS], F.col("probability").alias("cell_probability")), "chances")
    side = F.broadcast(chances) if chances.count() <= FEW_CELLS else chances
    same = [F.col(m).eqNullSafe(F.col(f"cell_{m}")) for m in MARGINS]
    joined = own.join(side, same[0] & same[1] & same[2]).withColumn("probability", F.when(F.col("n_tokens") == 0, F.lit(1.0)).otherwise(F.col("cell_probability")))
    return joined.drop("cell_probability", *[f"cell_{m}" for m in MARGINS]).filter(lot(F.col("doc_id")) < F.col("probability")).withColumn("token_weight", 1 / F.col("probability"))
