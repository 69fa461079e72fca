"""Approximate nearest neighbours by cross-polytope hashing.

A vector is padded to a power of two, rotated by three rounds of random signs and a fast Hadamard transform, and hashed to the
signed axis that it is nearest to.  HASHES such hashes, each of a rotation of its own, name a bucket of a table.  A query's
alignment with a bucket is the sum of its coordinates on the bucket's axes.  In each of TABLES tables a query probes the buckets
whose alignment reaches a threshold, and only vectors in probed buckets are scored, by inner products in double precision.

The threshold is fitted: SAMPLE queries are answered exactly by one scan of all vectors, and it is set so that TARGET of their
neighbours lie in a probed bucket of some table.  So recall holds for any data and size, and the work follows the data: vectors
with close neighbours need few probes.  Where norms differ, vectors take one more coordinate which makes them equal (queries take 0),
so that the angle to a query orders vectors as the inner product does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm.store import cut

#: Tables, and hashes that name a bucket of one.
TABLES, HASHES = 2, 3
#: Queries that the threshold is fitted on, and the share of their neighbours to reach.
SAMPLE, TARGET = 256, 0.95
#: Vectors and queries that one group of a task holds; more are split.
POINTS, QUERIES = 32_768, 8192
#: Queries whose alignments are compared with a cell's buckets at once.
ROWS = 1024
SEED = 71


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, scaled to be orthogonal."""
    n, d = x.shape
    x = x.copy()
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, number: int) -> np.ndarray:
    """The rows as unit vectors under pseudo-rotation ``number``."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    rng = np.random.default_rng((SEED, number, d))
    out = np.zeros((len(x), d))
    out[:, : x.shape[1]] = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    for _ in range(3):
        out = hadamard(out * rng.choice([-1.0, 1.0], d))
    return out


def buckets(x: np.ndarray, table: int, top: float | None = None) -> np.ndarray:
    """Rows x HASHES signed axes: axis, or d + axis for the negative one; ``top`` is the greatest norm if norms differ."""
    if top:
        x = np.concatenate((x, np.sqrt(np.maximum(top * top - np.square(x).sum(1), 0))[:, None]), 1)
    out = np.empty((len(x), HASHES), np.int64)
    for h in range(HASHES):
        r = rotate(x, table * HASHES + h)
        at = np.abs(r).argmax(1)
        out[:, h] = at + r.shape[1] * (r[np.arange(len(r)), at] < 0)
    return out


def alignments(q: np.ndarray, table: int, top: float | None = None) -> np.ndarray:
    """HASHES x rows x signed axes: each query's coordinate on every axis of a table's rotations."""
    if top:
        q = np.concatenate((q, np.zeros((len(q), 1))), 1)
    r = [rotate(q, table * HASHES + h) for h in range(HASHES)]
    return np.stack([np.concatenate((x, -x), 1) for x in r])


def exact(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision; einsum without BLAS keeps one order of sums."""
    return np.einsum("id,id->i", q, p, optimize=False)


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(owner: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's ``k`` greatest scores, in order of owner and score."""
    order = np.lexsort((-score, owner))
    o = owner[order]
    first = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1]))) if len(o) else np.zeros(0, np.int64)
    rank = np.arange(len(o)) - np.repeat(first, np.diff(np.append(first, len(o))))
    return order[rank < k]


def _scan(sample, k: int, top: float | None):
    """Of a task's vectors, the k best of each sampled query: (query, score, reach), reach the greatest alignment of a table with the vector's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q = sample.value
        hold = None
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                p = _vectors(part.column(1))
                s = q @ p.T
                s[keys[:, None] == part.column(0).to_numpy()[None, :]] = -np.inf
                at = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                i, j = np.repeat(np.arange(len(q)), at.shape[1]), at.ravel()
                found = (i, s[i, j], p[j])
                hold = found if hold is None else tuple(np.concatenate(x) for x in zip(hold, found, strict=True))
                best = _best(hold[0], hold[1], k)
                hold = tuple(x[best] for x in hold)
        if hold is not None:
            i, s, p = (x[np.isfinite(hold[1])] for x in hold)
            reach = np.full(len(i), -np.inf)
            for t in range(TABLES):
                b, a = buckets(p, t, top), alignments(q, t, top)
                reach = np.maximum(reach, sum(a[h, i, b[:, h]] for h in range(HASHES)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(s), pa.array(reach)], ["query", "score", "reach"])

    return run


def _place(top: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1))
            for t in range(TABLES):
                b = buckets(x, t, top).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * HASHES), pa.array(b.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(x), t, np.int32)), pa.array(b[:, 0]), lists], ["key", "vec", "tab", "cell", "bucket"])

    return run


def _ask(cells, sides: int, threshold: float, top: float | None):
    """A query for every group and part that holds a cell with a bucket it may probe; ``cells`` has (grp, split) of each (tab, cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                some = batch.slice(a, ROWS)
                x = _vectors(some.column(1))
                for t in range(TABLES):
                    align = alignments(x, t, top)
                    able = align[0] + sum(align[h].max(1) for h in range(1, HASHES))[:, None] >= threshold
                    route: dict[tuple[int, int], np.ndarray] = {}
                    for (tab, cell), (grp, split) in cells.items():
                        for part in range(split if tab == t else 0):
                            route[grp, part] = route.get((grp, part), False) | able[:, cell]
                    for (grp, part), who in route.items():
                        at = pa.array(np.flatnonzero(who))
                        n = len(at)
                        if n:
                            keys = some.column(0).take(at)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, v, np.int32)) for v in (t, grp, part)] + [pa.array((keys.to_numpy() % sides).astype(np.int32)), keys, some.column(1).take(at)], ["tab", "grp", "part", "side", "key", "vec"]
                            )

    return run


def _rank(k: int, threshold: float, top: float | None):
    """The k best vectors of a group among those in buckets that a query probes, for each query; ties at the k-th place all stay."""

    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        q_out, p_out, s_out = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if queries.num_rows and points.num_rows:
            q, p = _vectors(queries.column("vec")), _vectors(points.column("vec"))
            align = alignments(q, points.column("tab")[0].as_py(), top)
            b = points.column("bucket").combine_chunks().flatten().to_numpy().reshape(-1, HASHES)
            order = np.lexsort(b.T[::-1])
            b, p, p_key = b[order], p[order], points.column("key").to_numpy()[order]
            first = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]).any(1))))
            last, codes = np.append(first[1:], len(b)), b[first]
            kth = np.full(len(q), -np.inf)
            held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            cells = np.flatnonzero(np.concatenate(([True], codes[1:, 0] != codes[:-1, 0])))
            for c, d in zip(cells, np.append(cells[1:], len(codes)), strict=True):
                mine = codes[c:d]
                near = align[0][:, mine[0, 0]]
                rest = sum(align[h].max(1) for h in range(1, HASHES))
                able = np.flatnonzero(near + rest >= threshold)
                for a in range(0, len(able), ROWS):
                    some = able[a : a + ROWS]
                    hit = sum((align[h][some][:, mine[:, h]] for h in range(1, HASHES)), start=np.zeros((len(some), len(mine)))) + near[some][:, None] >= threshold
                    got = [held]
                    for m in np.flatnonzero(hit.any(0)):
                        who = some[hit[:, m]]
                        f, t = first[c + m], last[c + m]
                        s = q[who] @ p[f:t].T
                        i, j = np.nonzero(s >= kth[who][:, None])
                        if len(i):
                            got.append((who[i], f + j, s[i, j]))
                    if len(got) > 1:
                        held = tuple(np.concatenate(x) for x in zip(*got, strict=True))
                        best = _best(held[0], held[2], k)
                        o, s = held[0][best], held[2][best]
                        full = np.flatnonzero(np.bincount(o, minlength=len(q)) >= k)
                        # the last of an owner's k is its k-th; a rounding's width below it is kept, as BLAS sums in any order
                        end = np.searchsorted(o, full, "right") - 1
                        kth[full] = s[end] - 1e-9 * (1 + np.abs(s[end]))
                        keep = held[2] >= kth[held[0]]
                        held = tuple(x[keep] for x in held)
            i, j, _ = held
            q_out, p_out, s_out = queries.column("key").to_numpy()[i], p_key[j], exact(q[i], p[j])
        return pa.table({"query": pa.array(q_out, pa.int64()), "key": pa.array(p_out, pa.int64()), "score": pa.array(s_out, pa.float64())})

    return run


def _fit(points: DataFrame, queries: DataFrame, k: int, top: float | None) -> float:
    """The threshold at which TARGET of the true neighbours of SAMPLE queries are in a probed bucket."""
    chosen = queries.orderBy(F.xxhash64("vec"), "key").limit(SAMPLE).collect()  # SAMPLE vectors
    if not chosen:
        return np.inf
    sample = points.sparkSession.sparkContext.broadcast((np.array([r.key for r in chosen], np.int64), np.array([r.vec for r in chosen], np.float64)))
    found = points.select("key", "vec").mapInArrow(_scan(sample, k, top), "query long, score double, reach double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("r") <= k)
    reach = [r.reach for r in best.select("reach").collect()]  # k of each sampled query
    return float(np.quantile(reach, 1 - TARGET, method="lower")) if reach else -np.inf


def _groups(sizes: list[tuple[int, int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """(grp, split) of each (tab, cell) of the rows (tab, cell, n): cells that fit into POINTS share a group, a larger one has groups' worth of parts."""
    out, grp, room, now = {}, -1, 0, None
    for tab, cell, n in sorted(sizes):
        if tab != now or n > room:
            grp, room, now = 0 if tab != now else grp + 1, POINTS, tab
        room -= n
        out[tab, cell] = grp, max(1, -(-n // POINTS))
    return out


class Index:
    """Vectors of one length, a table with columns key and vec, in buckets; ``threshold`` is fitted on the ``asked`` keys."""

    def __init__(self, classes: DataFrame, asked: DataFrame, k: int) -> None:
        norms = classes.agg(F.min(norm(F.col("vec"))), F.max(norm(F.col("vec")))).head()
        self.top = norms[1] if norms[1] and norms[0] < 0.999 * norms[1] else None
        self.classes, self.k = classes, k
        self.points = cut(classes.select("key", "vec").mapInArrow(_place(self.top), "key long, vec array<double>, tab int, cell int, bucket array<int>"))
        # twice as many cells a table as a padded vector has coordinates
        self.cells = _groups([(r.tab, r.cell, r.n) for r in self.points.groupBy("tab", "cell").agg(F.count("*").alias("n")).collect()])
        self.threshold = _fit(classes, self._queries(asked), k, self.top)

    def _queries(self, asked: DataFrame) -> DataFrame:
        return self.classes.join(asked, "key", "left_semi").select("key", "vec")

    def find(self, asked: DataFrame, threshold: float) -> DataFrame:
        """(query, key, score): the k + 1 best found of each asked key, and more."""
        queries = cut(self._queries(asked))
        sides = max(1, -(-queries.count() // QUERIES))
        known = F.broadcast(queries.sparkSession.createDataFrame([(*a, *b) for a, b in self.cells.items()], "tab int, cell int, grp int, split int"))
        part = F.pmod(F.xxhash64("key", F.lit(3)), F.col("split")).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))
        placed = self.points.join(known, ["tab", "cell"]).select("tab", "grp", part.alias("part"), each.alias("side"), "key", "vec", "bucket")
        sent = queries.mapInArrow(_ask(self.cells, sides, threshold, self.top), "tab int, grp int, part int, side int, key long, vec array<double>")
        by = ["tab", "grp", "part", "side"]
        return sent.groupBy(*by).cogroup(placed.groupBy(*by)).applyInArrow(_rank(self.k + 1, threshold, self.top), "query long, key long, score double").distinct()


def norm(vec):
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))


def search(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """The ``k`` vectors of largest inner product found for each query: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; other columns are not read.  ``is_query`` is a condition on vec_id.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id.
    A query is compared with every other row, also with other rows of equal vectors; rows that repeat an id and
    vector count once.  Ties go to the smaller vec_id.  Fewer candidates give fewer rows.  Equal vectors are
    searched once: only the k + 1 least ids of one can be in any answer.  Vectors of unlike length have no inner
    product: each length is searched for itself.
    """
    e = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    # 128 bits tell equal vectors; -0.0 is 0.0
    plain = F.transform(e.cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.where(ok).select("vec_id", plain.alias("vec")).withColumns({"h": F.xxhash64("vec"), "g": F.xxhash64(F.lit(7), "vec")})
    rows = cut(rows.dropDuplicates(["vec_id", "h", "g"]))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = first.groupBy("h", "g").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vec").alias("vec"), F.first(F.size("vec")).alias("dim"))
    # numbers that the written table fixes
    classes = cut(classes.withColumn("key", F.monotonically_increasing_id()))
    asked = cut(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "h", "g").join(classes.select("h", "g", F.col("key").alias("query")), ["h", "g"]).select("query_id", "query"))
    out = None
    for (dim,) in sorted(classes.select("dim").distinct().collect()):
        mine = classes.where(F.col("dim") == dim)
        here = asked.join(mine.select(F.col("key").alias("query")), "query", "left_semi")
        index = Index(mine, here.select(F.col("query").alias("key")).distinct(), k)
        found = cut(_answers(index.find(here.select(F.col("query").alias("key")).distinct(), index.threshold), here, mine, k))
        # the few queries whose buckets hold fewer vectors than they may have look in all
        short = cut(here.join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id", "query"))
        if short.head(1):
            again = _answers(index.find(short.select(F.col("query").alias("key")).distinct(), -np.inf), short, mine, k)
            found = found.join(short.select("query_id"), "query_id", "left_anti").unionByName(again)
        out = found if out is None else out.unionByName(found)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _answers(near: DataFrame, asked: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """The k best rows of each asked (query_id, query), from classes found near its own."""
    # a vector's ids are needed only as far as the answer reaches
    near = near.withColumn("place", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("place") <= k + 1)
    near = near.join(classes.select("key", "ids"), "key").select("query", "score", F.explode("ids").alias("vec_id"))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    lists = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    out = asked.join(lists, "query").withColumn("found", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    return out.select("query_id", F.posexplode("found").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op5(vectors: DataFrame) -> DataFrame:
    """20 nearest of each row whose vec_id is divisible by 20."""
    return search(vectors, F.col("vec_id") % 20 == 0, 20)
