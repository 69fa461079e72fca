"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Rows are numbered 0..n-1 in a fixed order.  A Feistel network permutes the
smallest grid ``a x b`` with at least n places; a number that leaves 0..n-1 walks on until it is back.
The position gives shard and slot, so both are computable from number, n and key alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash ranges in which rows are numbered side by side; their counts, this many numbers, reach the driver.
RANGES = 4096
ROUNDS = 4
SEED = 20240917
SHARDS = 24


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _once(x: Column, n: int, seed: int) -> Column:
    a, b = grid(n)
    left, right = F.floor(x / F.lit(b)).cast("long"), F.pmod(x, F.lit(b))
    # integer division by way of pmod: x / b in double would lose digits beyond 2^53
    left = ((x - right).cast("decimal(20,0)") / F.lit(b)).cast("long")
    state = F.struct(left.alias("l"), right.alias("r"))
    rounds = F.array(*(F.lit(seed * 31 + i) for i in range(ROUNDS)))

    def turn(s: Column, key: Column) -> Column:
        low = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], key), F.lit(a)), F.lit(a))
        return F.struct(low.alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(low, key, F.lit(1)), F.lit(b)), F.lit(b)).alias("r"))

    return F.aggregate(rounds, state, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def permute(x: Column, n: int, seed: int = SEED) -> Column:
    """Position 0..n-1 of row number ``x``; a bijection for each n and seed."""
    a, b = grid(n)
    # a walk meets each of the a * b - n outer places once at most; beyond 64 steps none is left in practice, and that is checked
    steps = min(a * b - n, 64)
    inside = _once(x.cast("long"), n, seed)
    if steps:
        inside = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), inside, lambda y, _: F.when(y < n, y).otherwise(_once(y, n, seed)))
    return F.when(inside < n, inside).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with a column row_number 0..n-1, and n.  The order is that of a hash of the columns ``order``, then theirs.

    Rows that agree in all of these are interchangeable.  Only the counts of RANGES ranges of the hash reach the driver.
    """
    hashed = rows.withColumn("_h", F.xxhash64(*order)).withColumn("_range", F.shiftrightunsigned("_h", 52).cast("int"))
    counts = sorted(hashed.groupBy("_range").count().collect())
    offsets, at = [], 0
    for r, n in counts:
        offsets.append((r, at))
        at += n
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame(offsets, "_range int, _offset long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_h", *order)) - 1
    out = hashed.withColumn("_place", place).join(table, "_range", "left")
    return out.withColumn("row_number", F.col("_place") + F.col("_offset")).drop("_h", "_range", "_place", "_offset"), at


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number, position.

    Law ``rows``: counts of shards differ by one at most; slots have no gaps.  A null text has size 8 and the checksum of no
    bytes, 0.  A null doc_id is numbered like any other.  Equal rows get places of their own.  An empty table gives no rows.
    """
    raw = F.col("text").cast("binary")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"))
    out, n = numbered(rows, ["doc_id", "text_crc32", "size"])
    out = out.withColumn("position", permute(F.col("row_number"), n, seed))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        ((F.col("position") - F.pmod("position", F.lit(shards))) / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number", "position",
    )


def op7(docs: DataFrame) -> DataFrame:
    """All documents in shards 0 to 23."""
    return shard(docs)
