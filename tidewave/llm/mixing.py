"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  The cells' token
weights are raked until the sums over each margin meet its targets, and documents are
sampled with probabilities that make the expected tokens of a cell proportional to its weight.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm.store import cut

MARGINS = ("source", "lang", "topic")
#: A margin's target shares are its token shares to this power, made to sum to 1: smaller evens out more.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.7}
#: Share of all tokens to keep, the greatest error of a margin's share, rounds at most, and rounds in one plan.
KEEP, TOLERANCE, MOST_ROUNDS, AT_ONCE = 0.8, 1e-6, 48, 6
#: Up to so many cells are raked in one task, without a shuffle; more are raked the same way in many.
ONE_TASK = 50_000
NONE = "\x00none"


def topic(text: Column, n_tokens: Column) -> Column:
    """A coarse kind of text that every document has: table, code, brief, long or prose."""
    return F.when(text.contains(" | "), "table").when(text.rlike(r'[{};]|= "'), "code").when(n_tokens < 100, "brief").when(n_tokens > 1500, "long").otherwise("prose")


def _marked(docs: DataFrame) -> DataFrame:
    """``docs`` with the margins (null as a value of its own), tokens and a uniform number, a hash of id and text, in columns that begin with _mix_."""
    text = F.coalesce("text", F.lit(""))
    clean = F.trim(F.regexp_replace(text, r"[\x09-\x0D]", " "))
    n = F.when(clean == "", 0).otherwise(F.size(F.split(clean, " +"))).cast("long")
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(4)), 11) / F.lit(float(2**53))
    rows = docs.withColumns({"_mix_source": F.coalesce("source", F.lit(NONE)), "_mix_lang": F.coalesce("lang", F.lit(NONE)), "_mix_tokens": n, "_mix_u": uniform})
    return rows.withColumn("_mix_topic", topic(text, F.col("_mix_tokens")))


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``cells`` (margins, tokens) with a column weight whose sums over each margin are its targets (value, share).

    Raking starts from the tokens, so a cell without tokens keeps none; a target for a value without tokens can't be met and its share goes to the
    others.  It ends at an error of TOLERANCE in every margin, or with a warning after MOST_ROUNDS rounds (margins that contradict each other have no answer).
    """
    now = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    for m, t in targets.items():
        now = now.join(t.select(F.col("value").alias(m), F.col("share").alias(f"t_{m}")), m)
    now = cut(now)
    few = now.limit(ONE_TASK + 1).count() <= ONE_TASK
    for _ in range(MOST_ROUNDS // AT_ONCE):
        now = now.coalesce(1) if few else now
        for _ in range(AT_ONCE):
            for m in targets:
                now = now.withColumn("weight", F.col("weight") * F.col(f"t_{m}") / F.sum("weight").over(Window.partitionBy(m)))
        now = cut(now)
        # shares of what is there: values without tokens leave theirs to the others
        total = now.agg(F.sum("weight")).head()[0] or 1.0
        worst = 0.0
        for m in targets:
            sums = now.groupBy(m).agg((F.sum("weight") / total).alias("w"), F.first(f"t_{m}").alias("t"))
            whole = sums.agg(F.sum("t")).head()[0] or 1.0
            worst = max(worst, sums.agg(F.max(F.abs(F.col("w") - F.col("t") / whole))).head()[0] or 0.0)
        if worst <= TOLERANCE:
            break
    else:
        warnings.warn(f"raking ended after {MOST_ROUNDS} rounds with an error of {worst:.2g} of a margin's share", stacklevel=2)
    return now.select(*targets, "tokens", "weight")


def tempered(cells: DataFrame, powers: dict[str, float]) -> dict[str, DataFrame]:
    """Targets of each margin: its token shares to a power, made to sum to 1."""
    out = {}
    for m, p in powers.items():
        sums = cells.where("tokens > 0").groupBy(F.col(m).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(p)).alias("x"))
        total = sums.agg(F.sum("x")).head()[0] or 1.0
        out[m] = sums.select("value", (F.col("x") / total).alias("share"))
    return out


def calibrate(cells: DataFrame, keep: float) -> DataFrame:
    """``cells`` with a probability: min(1, s * weight / tokens), s such that ``keep`` of all tokens are expected.

    s is bracketed by sums over a grid of 64 values, three times over: only those sums reach the driver.
    """
    rate = F.col("weight") / F.col("tokens")
    total, low, high = cells.agg(F.sum("tokens"), F.min(rate), F.max(rate)).head()
    if not total:
        return cells.withColumn("probability", F.lit(0.0))
    low, high = keep / high * 0.5, 1.000001 / low
    for _ in range(4):
        grid = [low * (high / low) ** (i / 63) for i in range(64)]
        sums = cells.agg(*(F.sum(F.least(F.col("tokens").cast("double"), F.col("weight") * s)).alias(f"s{i}") for i, s in enumerate(grid))).head()
        above = next((i for i, v in enumerate(sums) if v >= keep * total), 63)
        low, high = grid[max(above - 1, 0)], grid[above]
    return cells.withColumn("probability", F.least(F.lit(1.0), rate * high))


def _decided(docs: DataFrame, powers: dict[str, float] | None, keep: float, targets: dict[str, DataFrame] | None) -> DataFrame:
    """_marked(docs) with _mix_weight, _mix_p and _mix_selected."""
    rows = _marked(docs)
    cells = cut(rows.groupBy(*(F.col(f"_mix_{m}").alias(m) for m in MARGINS)).agg(F.sum("_mix_tokens").alias("tokens")))
    raked = calibrate(rake(cells, targets or tempered(cells, powers or POWERS)), keep)
    raked = raked.select(*(F.col(m).alias(f"_mix_{m}") for m in MARGINS), F.col("weight").alias("_mix_weight"), F.col("probability").alias("_p"))
    out = rows.join(raked, [f"_mix_{m}" for m in MARGINS], "left")
    p = F.when(F.col("_mix_tokens") == 0, 1.0).otherwise(F.coalesce("_p", F.lit(0.0)))
    return out.withColumn("_mix_p", p).withColumn("_mix_selected", F.col("_mix_u") < F.col("_mix_p"))


def mix(docs: DataFrame, powers: dict[str, float] | None = None, keep: float = KEEP, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, source): doc_id, source, lang, topic, n_tokens, weight, probability, selected.

    ``targets`` gives each margin's (value, share); without them shares are tempered by ``powers``.  A null source or language is
    a value of its own (and null in the result).  A text without words has no weight and probability 1: it takes no tokens.
    Equal rows share one uniform number and so one decision; it depends on the row and the cell's probability alone.
    """
    out = _decided(docs.select("doc_id", "text", "source", "lang"), powers, keep, targets)
    return out.select(
        "doc_id", "source", "lang", F.col("_mix_topic").alias("topic"), F.col("_mix_tokens").alias("n_tokens"),
        F.coalesce("_mix_weight", F.lit(0.0)).alias("weight"), F.col("_mix_p").alias("probability"), F.col("_mix_selected").alias("selected"),
    )


def keep_mixed(docs: DataFrame) -> DataFrame:
    """The selected documents, with their own columns."""
    return _decided(docs, None, KEEP, None).where("_mix_selected").select(*docs.columns)


def op4(docs: DataFrame) -> DataFrame:
    """Every document with its cell's weight, its probability and whether it is selected."""
    return mix(docs)
