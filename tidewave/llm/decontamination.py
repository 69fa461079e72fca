"""Benchmark decontamination by SimHash over item-sized windows.

A window of a document as long as a benchmark item is compared with the item.
Windows that share no shingle with any item have similarity 0 and are skipped: the others start
where a shared shingle puts the item's start.  Their SimHash fingerprints meet those of the items of their size in an index
of RADIUS + 1 bit blocks, of which two fingerprints within RADIUS bits share at least one.  Pairs
within the radius are verified by the exact similarity of their weighted shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.llm.store import cut

K = 5
SIMILARITY = 0.8
RADIUS = 21
#: Items' shingles up to this number are broadcast (about 50 MB); more are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000
#: Slots of the filter that tells which documents are read again; at most so many numbers are broadcast.
SLOTS = 1 << 20


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order; empty if there are fewer."""
    n = F.size(w)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), k (words of a shingle), hs (its shingles in order); items without words are no items."""
    rows = benchmark.select("item_id", words(F.col("text")).alias("w")).where("item_id is not null").distinct().withColumn("n", F.size("w")).where("n > 0")
    rows = rows.withColumn("k", F.least(F.lit(K), F.col("n")))
    h = F.when(F.col("k") == K, shingles(F.col("w"), K))
    for k in range(1, K):
        h = h.when(F.col("k") == k, shingles(F.col("w"), k))
    return rows.withColumn("hs", h).select("item_id", "n", "k", "hs")


def _fingerprint(rows: DataFrame, key: list[str]) -> DataFrame:
    """SimHash of the rows (key, h, w) of each key: bit b is set if shingles with bit b weigh more than the others."""
    bit = lambda b: F.sum(F.when(F.shiftright("h", b).bitwiseAND(F.lit(1)) == 1, F.col("w")).otherwise(-F.col("w")))
    sums = rows.groupBy(*key).agg(*(bit(b).alias(f"b{b}") for b in range(64)))
    out = F.lit(0).cast("long")
    for b in range(64):
        out = out.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return sums.select(*key, out.alias("simhash"))


def _blocks(simhash: Column) -> Column:
    """The RADIUS + 1 blocks of a fingerprint, as (number, bits)."""
    edges = [round(i * 64 / (RADIUS + 1)) for i in range(RADIUS + 2)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(simhash, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (doc_id, item_id) with rid (a hash of doc_id and text), start (first word of the best window), hamming, similarity.

    A window has as many words as the item, or all the document's if those are fewer.  Shingles have five words, or all of an
    item with fewer.  A shingle weighs ln(1 + items / items that hold it), one that no item holds as much as one of a single item.
    A pair has one row, its most similar window, the first of equals.  A null or empty text is in no pair; repeated rows give one.
    """
    spark = docs.sparkSession
    items = cut(_items(benchmark))
    sizes = items.agg(F.count("*"), F.sum(F.size("hs"))).head()
    n_items, n_shingles = sizes[0], sizes[1] or 0
    lengths = [r.k for r in items.select("k").distinct().collect()]  # five numbers at most
    of_items = items.select("item_id", "n", "k", F.posexplode("hs").alias("p", "h"))
    weights = of_items.select("item_id", "h").distinct().groupBy("h").agg(F.log(1 + n_items / F.count("*")).alias("w"))
    heaviest = F.log(F.lit(1.0 + n_items))
    small = n_shingles <= BROADCAST_SHINGLES
    hint = F.broadcast if small else (lambda x: x)
    # the index has RADIUS + 1 rows an item
    index_hint = F.broadcast if n_items * (RADIUS + 1) <= BROADCAST_SHINGLES else (lambda x: x)
    rows = docs.select("doc_id", "text").where("text is not null").withColumn("rid", F.xxhash64("doc_id", "text"))
    seen = rows.select("rid", words(F.col("text")).alias("ws"))
    found = None
    for k in lengths:
        mine = of_items.where(F.col("k") == k).select("item_id", "n", "p", "h")
        hits = seen.select("rid", F.size("ws").alias("len"), F.posexplode(shingles(F.col("ws"), k)).alias("pos", "h")).join(hint(mine), "h")
        # the window starts where this shingle puts the item's start, moved to lie within the text
        start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("p"), F.col("len") - F.col("n")))
        hits = hits.select("rid", F.lit(k).alias("k"), "n", start.alias("start")).distinct()
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        kind = {"doc_id": docs.schema["doc_id"].dataType, "item_id": benchmark.schema["item_id"].dataType}
        names = ", ".join(f"{n} {t.simpleString()}" for n, t in kind.items())
        return spark.createDataFrame([], f"{names}, rid long, start int, hamming int, similarity double")
    windows = cut(found)
    slot = F.pmod("rid", F.lit(SLOTS))
    some = F.broadcast(windows.select(slot.alias("slot")).distinct())  # SLOTS numbers at most
    texts = rows.withColumn("slot", slot).join(some, "slot", "left_semi").select("rid", "doc_id", "text").dropDuplicates(["rid"])
    cuts = texts.join(windows, "rid").withColumn("ws", F.slice(words(F.col("text")), F.col("start") + 1, F.col("n")))
    h = F.when(F.col("k") == K, shingles(F.col("ws"), K))
    for k in range(1, K):
        h = h.when(F.col("k") == k, shingles(F.col("ws"), k))
    parts = cuts.select("rid", "doc_id", "n", "k", "start", F.explode(F.array_distinct(h)).alias("h"))
    parts = cut(parts.join(hint(weights), "h", "left").withColumn("w", F.coalesce("w", heaviest)))
    key = ["rid", "doc_id", "n", "k", "start"]
    prints = _fingerprint(parts, key)
    item_parts = of_items.select("item_id", "n", "k", "h").distinct().join(weights, "h")
    item_prints = _fingerprint(item_parts, ["item_id", "n", "k"]).withColumnRenamed("simhash", "item_hash")
    left = prints.select(*key, "simhash", F.explode(_blocks(F.col("simhash"))).alias("x")).select(*key, "simhash", "x.*")
    right = item_prints.select("item_id", "n", "k", "item_hash", F.explode(_blocks(F.col("item_hash"))).alias("x")).select("item_id", "n", "k", "item_hash", "x.*")
    hamming = F.bit_count(F.col("simhash").bitwiseXOR(F.col("item_hash"))).cast("int")
    pairs = left.join(index_hint(right), ["n", "k", "block", "bits"]).select(*key, "item_id", hamming.alias("hamming")).where(F.col("hamming") <= RADIUS).distinct()
    pairs = cut(pairs)
    total = parts.groupBy(*key).agg(F.sum("w").alias("total"))
    item_total = item_parts.groupBy("item_id").agg(F.sum("w").alias("item_total"))
    both = parts.select(*key, "h", "w").join(hint(item_parts.select("item_id", "h")), "h").groupBy(*key, "item_id").agg(F.sum("w").alias("shared"))
    verified = pairs.join(both.withColumnsRenamed({c: f"_{c}" for c in [*key, "item_id"]}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*key, "item_id"]])
    verified = verified.select(*key, "item_id", "hamming", "shared")
    verified = verified.join(total.withColumnsRenamed({c: f"_{c}" for c in key}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]).select(*key, "item_id", "hamming", "shared", "total")
    verified = verified.join(hint(item_total), "item_id").withColumn("similarity", F.col("shared") / (F.col("total") + F.col("item_total") - F.col("shared")))
    best = verified.where(F.col("similarity") >= similarity - 1e-9).groupBy("rid", "doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "hamming")).alias("x"))
    return best.select("doc_id", "item_id", "rid", (-F.col("x.s")).cast("int").alias("start"), F.col("x.hamming").alias("hamming"), F.col("x.similarity").alias("similarity"))


def op8(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return contaminated(docs, benchmark).select("doc_id", "item_id", "start", "hamming", "similarity")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    bad = contaminated(docs, benchmark).select(F.col("rid").alias("_rid")).distinct()
    keyed = docs.withColumn("_rid", F.when(F.col("text").isNotNull(), F.xxhash64("doc_id", "text")))
    return keyed.join(bad, "_rid", "left_anti").select(*docs.columns)
