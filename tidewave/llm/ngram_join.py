"""N-gram Jaccard join over count vectors in an R-tree.

The distinct five-word shingles of a text are dealt by hash into groups.  Two
sets with Jaccard similarity of at least 0.8 and at most ``U`` elements each
differ in at most ``2U/9`` elements, so with more groups than that some groups
hold the same elements in both.  Texts meet where such a group agrees.  There
the counts of each set over 256 hash groups are points of a packed R-tree: the
sum of coordinate minima bounds an overlap from above, for boxes as for points,
and pairs that survive the bound are verified on the shingles themselves.

Equal sets are one node.  A first round links each text to the centre with which it
shares most groups; then only groups whose texts are still in different components
are joined, in blocks, and a block returns a spanning set of its links.  Hence
copies never expand into all their pairs, and no link between different
components is lost.  The largest thing a task holds is two blocks of BLOCK sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm.store import components, cut
from tidewave.llm.textkernel import U64, fingerprint, mix, text_sets

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Hash groups of a count vector, the coordinates of the R-tree's points.
DIMENSIONS = 256
#: Sets in a block of the in-memory join, and points in a leaf of the tree.
BLOCK, LEAF = 512, 16
#: Bits of the bitmap that tells which texts to shingle again (a fixed 4 MB, whatever the input).
BITMAP_BITS = 1 << 25


def _classes() -> np.ndarray:
    out = [5]
    while out[-1] < 2**40:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return np.array(out)


CLASSES = _classes()


def block_keys(h: np.ndarray) -> np.ndarray:
    """Keys of a sorted set; two sets that link share at least one (see the module's text)."""
    n = len(h)
    if not n:
        return h
    c = int(np.searchsorted(CLASSES, n))
    most = n * 5 // 4
    element = mix(h ^ U64(0xA0761D6478BD642F))
    out = []
    for k in (c, c + 1) if most > CLASSES[c] else (c,):
        upper = int(CLASSES[k])
        groups = (3 * upper + 9) // 10 + 1
        # the set is sorted, and the group grows with the hash: groups are runs
        g = ((h >> U64(32)) * U64(groups)) >> U64(32)
        start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        size = np.diff(np.append(start, n))
        key = mix(np.add.reduceat(element, start) + g[start] * U64(0xE7037ED1A0B428DB) + U64((k * 0x8EBC6AF09C88C6E3) % 2**64))
        differ = (n + min(upper, most)) // 9
        pairs = size >= 2
        if pairs.sum() > differ:
            out.append(key[pairs])
            continue
        out.append(key)
        if len(key) <= differ:  # too few groups are filled: the prefix of the set in hash order
            prefix = n - (n * PERCENT + 99) // 100 + 1
            out.append(mix(h[:prefix] + U64(0x589965CC75374CC3)))
    return np.concatenate(out)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _id(column: pa.Array) -> list:
    return column.to_pylist()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for at, sets in text_sets(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64())],
                ["doc_id", "n_shingles", "fp"],
            )


def _postings(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in text_sets(batch.column(0)):
                seen, keys, owners = set(), [], []
                for s in sets:
                    fp = fingerprint(s)
                    if len(s) and fp not in seen:
                        seen.add(fp)
                        keys.append(k := block_keys(s))
                        owners.append(np.full(len(k), fp, U64))
                if not keys:
                    continue
                k, o = np.concatenate(keys), np.concatenate(owners)
                bucket = (k >> U64(20)) % U64(buckets)
                order = np.argsort(bucket, kind="stable")
                pairs = np.stack([k[order], o[order]], 1)
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1).astype(U64))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)), pa.array([pairs[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary())],
                    ["bucket", "pairs"],
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task's buckets, the keys that several sets share: (key, centre, fp)."""
    parts = [np.frombuffer(x, U64).reshape(-1, 2) for batch in batches for x in batch.column(1).to_pylist()]
    if not parts:
        return
    p = np.concatenate(parts)
    del parts
    p = p[np.argsort(p[:, 0], kind="stable")]
    new = np.concatenate(([True], p[1:, 0] != p[:-1, 0]))
    run = np.flatnonzero(new)
    several = np.repeat(np.diff(np.append(run, len(p))) > 1, np.diff(np.append(run, len(p))))
    p = p[several]
    if not len(p):
        return
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    p = p[np.concatenate(([True], (p[1:] != p[:-1]).any(1)))]
    run = np.flatnonzero(np.concatenate(([True], p[1:, 0] != p[:-1, 0])))
    length = np.diff(np.append(run, len(p)))
    centre = np.repeat(p[run, 1], length)
    keep = np.repeat(length > 1, length)
    p, centre = p[keep], centre[keep]
    for at in range(0, len(p), 100_000):
        s = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(p[s, 0].view(np.int64)), pa.array(centre[s].view(np.int64)), pa.array(p[s, 1].view(np.int64))], ["key", "centre", "fp"])


def _bits(x: np.ndarray) -> np.ndarray:
    return (mix(x) % U64(BITMAP_BITS)).astype(np.int64)


def _wanted_bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    for batch in batches:
        at = _bits(batch.column(0).to_numpy(zero_copy_only=False).astype(U64))
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    piece = np.flatnonzero(bits.reshape(-1, 4096).any(1))
    yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array([bits[i * 4096 : (i + 1) * 4096].tobytes() for i in piece], pa.binary())], ["piece", "bits"])


def _merge_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merged: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            merged[i] = merged.get(i, 0) | np.frombuffer(b, np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(merged), pa.int32()), pa.array([m.tobytes() for m in merged.values()], pa.binary())], ["piece", "bits"])


def _wanted(fps: DataFrame) -> np.ndarray:
    """The bitmap of a column of fingerprints; 4 MB at most reach the driver."""
    parts = fps.mapInArrow(_wanted_bitmap, "piece int, bits binary").repartition(8, "piece").mapInArrow(_merge_bits, "piece int, bits binary")
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in parts.collect():
        bits[row.piece * 4096 : (row.piece + 1) * 4096] |= np.frombuffer(row.bits, np.uint8)
    return bits


def _sets(wanted):
    """(fp, set) of the texts whose fingerprint is in the bitmap, each once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            for _, sets in text_sets(batch.column(0)):
                found = {}
                for s in sets:
                    fp = fingerprint(s)
                    at = int(_bits(np.array([fp], U64))[0])
                    if len(s) and bits[at >> 3] >> (at & 7) & 1:
                        found.setdefault(fp, s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["fp", "elements"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, x, y = (c.to_pylist() for c in batch.columns)
        ok = [linked(np.frombuffer(p, U64), np.frombuffer(q, U64)) for p, q in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, z in zip(a, ok, strict=True) if z], pa.int64()), pa.array([i for i, z in zip(b, ok, strict=True) if z], pa.int64())], ["a", "b"])


class CountTree:
    """A packed R-tree over count vectors: leaves of LEAF points sorted by total, boxes by their upper corners."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        counts = np.stack([np.bincount((s >> U64(56)).astype(np.int64), minlength=DIMENSIONS) for s in sets]).astype(np.int32)
        total = counts.sum(1)
        lead = counts.argmax(1)
        self.order = np.lexsort((lead, total))
        self.points, self.total = counts[self.order], total[self.order]
        at = np.arange(0, len(sets), LEAF)
        self.starts, self.ends = at, np.append(at[1:], len(sets))
        self.upper = np.maximum.reduceat(self.points, at, axis=0)
        self.low, self.high = self.total[at], self.total[self.ends - 1]

    def candidates(self, other: CountTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (into the two lists of sets) whose overlap bound admits a link."""
        for i in range(len(self.starts)):
            near = np.flatnonzero((100 * other.high >= PERCENT * self.low[i]) & (100 * self.high[i] >= PERCENT * other.low))
            bound = np.minimum(other.upper[near], self.upper[i]).sum(1)
            # overlap o of sizes m, n links only if (100 + PERCENT) o >= PERCENT (m + n)
            near = near[(100 + PERCENT) * bound >= PERCENT * (self.low[i] + other.low[near])]
            if not len(near):
                continue
            rows = np.concatenate([np.arange(other.starts[j], other.ends[j]) for j in near])
            points, total = other.points[rows], other.total[rows]
            for p in range(self.starts[i], self.ends[i]):
                over = np.minimum(points, self.points[p]).sum(1)
                hit = rows[(100 + PERCENT) * over >= PERCENT * (total + self.total[p])]
                if len(hit):
                    yield np.full(len(hit), self.order[p]), other.order[hit]


def join_blocks(left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links between (id, component, set) of two blocks that join different components: a spanning set of them."""
    if not left or not right:
        return []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    one = left is right
    tree = CountTree([x[2] for x in left])
    comp, comp_right = np.array([x[1] for x in left]), np.array([x[1] for x in right])
    out = []
    for i, j in tree.candidates(tree if one else CountTree([x[2] for x in right])):
        apart = comp[i] != comp_right[j]
        i, j = i[apart], j[apart]
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            x, y = left[p], right[q]
            if (one and q <= p) or x[0] == y[0]:
                continue
            c, d = find(x[1]), find(y[1])
            if c != d and linked(x[2], y[2]):
                root[max(c, d)] = min(c, d)
                out.append((x[0], y[0]))
    return out


def _join_group(table: pa.Table) -> pa.Table:
    rows: dict[bool, list] = {False: [], True: []}
    for side, fp, comp, elements in zip(*(table.column(c).to_pylist() for c in ("side", "fp", "comp", "elements")), strict=True):
        rows[side].append((fp, comp, np.frombuffer(elements, U64)))
    left = rows[False]
    found = join_blocks(left, rows[True] if rows[True] else left)
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def _tiled(members: DataFrame) -> DataFrame:
    """Members of each centre's group in pairs (i, j) of blocks of about BLOCK sets, each pair a task of its own.

    A component of at least BLOCK members has blocks of its own, which are not paired with each other;
    smaller ones share blocks.
    """
    sizes = members.groupBy("centre", "comp").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < BLOCK).groupBy("centre").agg(F.sum("n").alias("total"))
    own = F.concat(F.col("comp"), F.lit("/"), F.pmod(F.xxhash64("fp", F.lit(7)), F.ceil(F.col("n") / BLOCK)))
    shared = F.concat(F.lit("s/"), F.pmod(F.xxhash64("comp", F.lit(7)), F.ceil(F.col("total") / BLOCK)))
    big = F.col("n") >= BLOCK
    placed = cut(members.join(sizes, ["centre", "comp"]).join(small, "centre", "left").select("centre", "fp", "comp", F.when(big, own).otherwise(shared).alias("block"), F.when(big, F.col("comp")).alias("owner")))
    blocks = placed.select("centre", "block", "owner").distinct()
    x, y = blocks.select("centre", F.col("block").alias("i"), F.col("owner").alias("p")), blocks.select("centre", F.col("block").alias("j"), F.col("owner").alias("q"))
    tiles = x.join(y, "centre").where("i <= j and (p is null or q is null or p <> q)").select("centre", "i", "j")
    left = tiles.join(placed.select("centre", F.col("block").alias("i"), "fp", "comp"), ["centre", "i"]).withColumn("side", F.lit(False))
    right = tiles.where("i <> j").join(placed.select("centre", F.col("block").alias("j"), "fp", "comp"), ["centre", "j"]).withColumn("side", F.lit(True))
    return left.unionByName(right)


def similar_classes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, set_id (equal sets share it, null if empty), component_id.

    Texts link when 100 * intersection >= PERCENT * union of their sets; component_id is the smallest doc_id
    reachable.  A null or wordless text has no set, links with nothing and is its own component.  A null doc_id
    is carried, and counts only if its whole component has no other (then component_id is null).  Repeated
    rows stay.  Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    signed = cut(docs.mapInArrow(_sign, "doc_id long, n_shingles long, fp long"))
    text = docs.select("text")
    shared = cut(
        text.mapInArrow(_postings(4 * parts), "bucket int, pairs binary")
        .repartition(parts, "bucket")
        .mapInArrow(_shared, "key long, centre long, fp long")
    )
    # the centre with which a set shares most groups
    stars = cut(shared.where("fp <> centre").groupBy("centre", "fp").agg(F.count("*").alias("w")))
    best = stars.groupBy("fp").agg(F.max(F.struct("w", "centre")).alias("x")).select(F.col("x.centre").alias("a"), F.col("fp").alias("b"))
    wanted = spark.sparkContext.broadcast(_wanted(shared.select("fp").distinct()))
    sets = cut(text.mapInArrow(_sets(wanted), "fp long, elements binary").groupBy("fp").agg(F.first("elements").alias("elements")))
    left, right = sets.select(F.col("fp").alias("a"), F.col("elements").alias("x")), sets.select(F.col("fp").alias("b"), F.col("elements").alias("y"))
    links = cut(best.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"))
    first = cut(shared.select(F.col("fp").alias("node")).distinct().join(components(links), "node", "left").select(F.col("node").alias("fp"), F.coalesce("root", "node").alias("comp")))
    # keys with texts of several components; a pair that shares a key shares its centre, so keys of a centre are joined as one group
    comp = lambda c: first.select(F.col("fp").alias(c), F.col("comp").alias(f"comp_{c}"))
    open_stars = stars.join(comp("centre"), "centre").join(comp("fp"), "fp").where("comp_centre <> comp_fp").select("centre", "fp")
    open_keys = shared.join(open_stars, ["centre", "fp"], "left_semi").select("key").distinct()
    members = cut(shared.join(open_keys, "key", "left_semi").select("centre", "fp").distinct().join(first, "fp"))
    rows = _tiled(members).join(sets, "fp")
    more = rows.groupBy("centre", "i", "j").applyInArrow(_join_group, "a long, b long")
    found = components(cut(links.unionByName(more)))
    named = signed.withColumn("set_id", F.when(F.col("n_shingles") > 0, F.col("fp")))
    nodes = named.where("set_id is not null").groupBy(F.col("set_id").alias("node")).agg(F.min("doc_id").alias("low"))
    roots = nodes.join(found, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    least = roots.groupBy("root").agg(F.min("low").alias("component"))
    of_set = roots.join(least, "root").select(F.col("node").alias("set_id"), "component")
    return named.join(of_set, "set_id", "left").select("doc_id", "n_shingles", "set_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def op1(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return similar_classes(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those whose component has a smaller doc_id; rows that repeat a doc_id leave one row.

    A row with a null doc_id goes only if its component has a document with an id.
    """
    classes = similar_classes(docs).select("doc_id", "component_id").distinct()
    gone = classes.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates()
