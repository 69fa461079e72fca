"""A hierarchical Pitman-Yor language model.

Each of the KNOWN most frequent words has a restaurant of its own, for the tokens that follow it; rarer words share CLASSES restaurants by hash,
and the starts of texts have one.  All share the unigram restaurant as parent, whose base gives unseen words, taken as one type, half the
mass and spreads the rest evenly.  A customer of a context restaurant is a token of the training texts; each of its tables sends a customer to the parent.

Seating is sampled by Gibbs: given the rest, all customers of a word in a restaurant leave and are seated anew.  For groups of up to
SMALL customers the number of their tables is drawn from its exact distribution (generalised Stirling numbers); larger ones come one after the other, in
parties of a sixteenth of those seated.  Sums over restaurants are renewed between rounds, as tasks sample side by side.  The predictive probability
of a token is averaged over samples.

Every quantity of a word, in all restaurants, is computed where the word's counts are: postings are shuffled once by word for counts and once for
scores.  Across words only the restaurants' totals matter: KNOWN + CLASSES + 1 customers and tables, some MB however large the input, which are broadcast.
Words of at least one in HEAD_SHARE tokens (HEADS at most) are dealt by word and context, as their own totals are broadcast too, and
what follows one of them is scored without a shuffle if it is one, too: so neither a word nor a pair of words makes a hot task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm.langid import held_out
from tidewave.llm.store import cut
from tidewave.llm.textkernel import U64, frugal, mix, text_slices, words

#: Words with a restaurant of their own, at most, and restaurants that the others share.
KNOWN, CLASSES = 1 << 20, 1 << 16
#: Words whose totals are broadcast: those of at least one in HEAD_SHARE tokens, HEADS at most.
HEADS, HEAD_SHARE = 1024, 20_000
#: Groups whose tables are drawn from their exact distribution.
SMALL = 32
#: Rounds that settle the restaurants' totals, sweeps within a round, and samples that are averaged.
ROUNDS, SWEEPS, SAMPLES = 2, 2, 3
#: Contexts whose sums are one row, and tokens that a task holds before it sends them.
CHUNK, HELD = 4096, 400_000
SEED = 17
END, START = np.array([0xD6E8FEB86659FD93], U64), 0xA0761D6478BD642F
STRENGTH = 1.0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words, then its end), those of the tokens before, and first token of each text."""
    _, _, h, first = words(data, offsets)
    n = len(offsets) - 1
    starts = first + np.arange(n + 1)
    out = np.empty(len(h) + n, U64)
    end = starts[1:] - 1
    out[end] = END
    inner = np.ones(len(out), bool)
    inner[end] = False
    out[inner] = h
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[starts[:-1]] = START
    return out, before, starts


def place(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each hash in a sorted table, -1 for others."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


@dataclass
class Lexicon:
    """Sorted hashes of the head words and of the words with a restaurant of their own."""

    head: np.ndarray
    known: np.ndarray

    def __post_init__(self) -> None:
        self.own = place(self.head, self.known)

    @property
    def contexts(self) -> int:
        return len(self.known) + CLASSES + 1

    def context(self, h: np.ndarray) -> np.ndarray:
        """Number of the restaurant of each word before a token."""
        at = place(h, self.known)
        out = np.where(at >= 0, at, len(self.known) + (mix(h) % U64(CLASSES)).astype(np.int64))
        out[h == U64(START)] = self.contexts - 1
        return out

    def top(self) -> np.ndarray:
        """Contexts of which the head words' probabilities are broadcast: the head words and the start."""
        return np.append(self.own, self.contexts - 1)


def read(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray):
    """(hash, head place or -1, context, place of the context among the top ones or -1) of all tokens, and first token of each text."""
    h, before, starts = tokens(data, offsets)
    types, at = np.unique(h, return_inverse=True)
    head, context = place(types, lexicon.head), lexicon.context(types)
    c, t = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    # the token before is a type of the same texts, or the start
    c[1:], t[1:] = context[at[:-1]], head[at[:-1]]
    first = starts[:-1]
    c[first], t[first] = lexicon.contexts - 1, len(lexicon.head)
    return h, head[at], c, t, starts


@dataclass
class Totals:
    """What words share: customers and tables of each context, the root's customers and tables, and the head words' own."""

    tokens: int
    types: int
    customers: np.ndarray
    tables: np.ndarray
    root_customers: float
    root_tables: float
    head_customers: np.ndarray
    head_tables: np.ndarray
    d0: float
    d1: float

    @property
    def base(self) -> float:
        return 0.5 / self.types if self.types else 0.0

    def root(self, customers, tables, base=None):
        """Predictive probability of words in the root restaurant."""
        own = np.maximum(customers - self.d0 * tables, 0)
        return (own + (STRENGTH + self.d0 * self.root_tables) * (self.base if base is None else base)) / (STRENGTH + self.root_customers)

    def back(self, context) -> np.ndarray:
        """What a context leaves to the root."""
        return (STRENGTH + self.d1 * self.tables[context]) / (STRENGTH + self.customers[context])

    def unseen(self, context) -> np.ndarray:
        return self.back(context) * self.root(0.0, 0.0, 0.5 if self.types else 1.0)


def log_stirling(d: float, most: int = SMALL) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: weights of the ways to seat n customers at t tables with discount d."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for n in range(most):
        for t in range(n + 2):
            stay = out[n, t] + np.log(n - d * t) if n - d * t > 0 else -np.inf
            out[n + 1, t] = np.logaddexp(stay, out[n, t - 1] if t else -np.inf)
    return out


def seat(n: np.ndarray, d: float, others: np.ndarray, parent: np.ndarray, rng: np.random.Generator, stirling: np.ndarray) -> np.ndarray:
    """Tables of groups of ``n`` customers, seated anew in restaurants with ``others`` tables besides theirs; ``parent`` is the word's probability there."""
    tables = np.minimum(n, 1).astype(np.int64)
    parent = np.maximum(parent, 1e-300)
    for size in range(2, SMALL + 1):
        at = np.flatnonzero(n == size)
        if not len(at):
            continue
        t = np.arange(1, size + 1)
        steps = np.log(STRENGTH + d * (others[at, None] + np.arange(size))) + np.log(parent[at, None])
        weight = stirling[size, t] + np.cumsum(steps, 1) + rng.gumbel(size=(len(at), size))
        tables[at] = 1 + weight.argmax(1)
    live, seated = np.flatnonzero(n > SMALL), 1
    while len(live):
        party = max(1, seated // 16)
        new = (STRENGTH + d * (others[live] + tables[live])) * parent[live]
        p = new / (new + np.maximum(seated - d * tables[live], 1e-12))
        tables[live] += rng.binomial(np.minimum(party, n[live] - seated), np.clip(p, 0, 1))
        seated += party
        live = live[n[live] > seated]
    return tables


#: Counts of a word in a context.  ``word`` is its hash, or its place in the head.
POSTING = np.dtype([("word", "<u8"), ("context", "<u4"), ("n", "<u8")])


def merge(r: np.ndarray) -> np.ndarray:
    """Records summed by word and context, in that order."""
    r = r[np.lexsort((r["context"], r["word"]))]
    if not len(r):
        return r
    at = np.flatnonzero(np.concatenate(([True], (r["word"][1:] != r["word"][:-1]) | (r["context"][1:] != r["context"][:-1]))))
    out = r[at]
    out["n"] = np.add.reduceat(r["n"], at)
    return out


def pack(r: np.ndarray) -> bytes:
    """Columns one after the other, which the shuffle's compression suits."""
    return b"".join(np.ascontiguousarray(r[c]).tobytes() for c in r.dtype.names)


def unpack(raw: bytes, kind: np.dtype) -> np.ndarray:
    n, at = len(raw) // kind.itemsize, 0
    out = np.empty(n, kind)
    for c in kind.names:
        size = kind[c].itemsize * n
        out[c] = np.frombuffer(raw[at : at + size], kind[c])
        at += size
    return out


def _pieces(bucket: np.ndarray, kind: str, records: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    records = records[order]
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    if len(full):
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([kind] * len(full)), pa.array([pack(records[cuts[i] : cuts[i + 1]]) for i in full], pa.binary())], PIECE)


PIECE = ["bucket", "kind", "records"]
PIECES = "bucket int, kind string, records binary"


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list[bytes]]]]:
    """A task's pieces, sorted by bucket, one bucket at a time."""
    now, held = None, {}
    for batch in batches:
        for bucket, kind, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now:
                if held:
                    yield now, held
                now, held = bucket, {}
            held.setdefault(kind, []).append(records)
    if held:
        yield now, held


def _joined(parts: dict[str, list[bytes]], kind: str, dtype: np.dtype) -> np.ndarray:
    found = [unpack(x, dtype) for x in parts.pop(kind, [])]
    return np.concatenate(found) if found else np.zeros(0, dtype)


def exchange(pieces: DataFrame, parts: int) -> DataFrame:
    return pieces.repartition(parts, "bucket").sortWithinPartitions("bucket")


def _hash_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(16)) % U64(buckets)).astype(np.int64)


def _deal(head: np.ndarray, word: np.ndarray, context: np.ndarray, buckets: int) -> np.ndarray:
    """A tail word's bucket is its own; a head word's customers are dealt by context."""
    return np.where(head >= 0, _hash_bucket(mix(head.astype(U64) * U64(0x9E3779B97F4A7C15) + context.astype(U64)), buckets), _hash_bucket(word, buckets))


def _flags(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _spread(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.repeat(x, np.diff(starts))


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task: its training tokens (word 0) and those of every word, so that sums over tasks are exact."""
    held, counts, total = [], [], 0

    def fold() -> None:
        h, at = np.unique(np.concatenate(held), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        held[:], counts[:] = [h], [n]

    for batch in batches:
        out = _flags(batch.column(1))
        for a, b, data, offsets in text_slices(batch.column(0), 1_000_000):
            h, _, starts = tokens(data, offsets)
            h, n = np.unique(h[_spread(~out[a:b], starts)], return_counts=True)
            held.append(h)
            counts.append(n)
            total += int(n.sum())
            if sum(map(len, held)) > HELD:
                fold()
    if not total:
        return
    fold()
    word, n = np.append(held[0], U64(0)).view(np.int64), np.append(counts[0], total)
    for a in range(0, len(word), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(word[a : a + 100_000]), pa.array(n[a : a + 100_000])], ["word", "n"])


def _count(lexicon, buckets: int):
    """Training tokens counted by word and context: pieces of tail words ("t"), of head words ("h"), and of head words in top contexts ("p")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = lexicon.value
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> Iterator[pa.RecordBatch]:
            kinds, records = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
            kept.clear()
            for i, kind in enumerate("thp"):
                r = merge(records[kinds == i])
                bucket = r["context"].astype(np.int64) % buckets if kind == "p" else _deal(np.full(len(r), -1) if kind == "t" else r["word"].astype(np.int64), r["word"], r["context"], buckets)
                yield from _pieces(bucket, kind, r, buckets)

        for batch in batches:
            out = _flags(batch.column(1))
            for a, b, data, offsets in text_slices(batch.column(0), 1_000_000):
                h, head, c, top, starts = read(x, data, offsets)
                train = _spread(~out[a:b], starts)
                h, head, c, top = h[train], head[train], c[train], top[train]
                pair = (head >= 0) & (top >= 0)
                r = np.zeros(len(h), POSTING)
                r["word"], r["context"], r["n"] = np.where(head >= 0, head.astype(U64), h), np.where(pair, top, c), 1
                kept.append(((head >= 0).astype(np.int8) + pair, r))
            if sum(len(k[1]) for k in kept) > HELD:
                yield from send()
        if kept:
            yield from send()

    return run


#: A tail word: its hash, tokens, and contexts in which it has one customer only.
DISH = np.dtype([("word", "<u8"), ("count", "<u8"), ("single", "<u8")])


def _dishes(contexts: int, heads: int):
    """Merged counts: a row for each bucket of what is left to sample ("d"), sums by context of customers ("c") and types ("y"), of groups by head word ("g")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        customers, types = np.zeros(contexts), np.zeros(contexts)
        groups, stats = np.zeros(heads), np.zeros(4)  # stats: groups of one and of two customers, groups, tail words
        for bucket, parts in _by_bucket(batches):
            whole = []
            for kind in ("t", "h"):
                r = merge(_joined(parts, kind, POSTING))
                customers += np.bincount(r["context"], r["n"].astype(float), contexts)
                types += np.bincount(r["context"], minlength=contexts)
                one, two = r["n"] == 1, r["n"] == 2
                stats[:3] += one.sum(), two.sum(), len(r)
                first = _firsts(r["word"])
                dish = np.zeros(len(first), DISH)
                if len(r):
                    dish["word"], dish["count"], dish["single"] = r["word"][first], np.add.reduceat(r["n"], first), np.add.reduceat(one, first, dtype=np.uint64)
                stats[3] += len(first) if kind == "t" else 0
                groups += np.bincount(r["word"].astype(np.int64), minlength=len(groups)) if kind == "h" else 0
                whole += [pack(dish), pack(r[~one])]
            sizes = np.array([len(x) for x in whole], np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array(["d"]), pa.array([sizes + b"".join(whole)], pa.binary())], PIECE)
            if "p" in parts:
                r = merge(_joined(parts, "p", POSTING))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array(["p"]), pa.array([pack(r)], pa.binary())], PIECE)
        yield from _chunks("c", customers)
        yield from _chunks("y", types)
        yield from _chunks("g", groups)
        yield from _chunks("n", stats)

    return run


def _firsts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _chunks(kind: str, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums by context in rows of CHUNK; rows of zeros are left out."""
    found = [(a // CHUNK, x[a : a + CHUNK]) for a in range(0, len(x), CHUNK) if x[a : a + CHUNK].any()]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([kind] * len(found)), pa.array([zlib.compress(v.astype(float).tobytes(), 1) for _, v in found], pa.binary())], PIECE)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket and kind added up."""
    for bucket, parts in _by_bucket(batches):
        kinds = sorted(parts)
        sums = [zlib.compress(np.add.reduce([np.frombuffer(zlib.decompress(x)) for x in parts[k]]).tobytes(), 1) for k in kinds]
        yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(kinds), pa.int32()), pa.array(kinds), pa.array(sums, pa.binary())], PIECE)


def _sums(pieces: DataFrame, parts: int) -> dict[str, dict[int, np.ndarray]]:
    """Sums of small rows by kind and bucket: as many numbers as contexts and head words."""
    out: dict[str, dict[int, np.ndarray]] = {}
    for r in exchange(pieces, parts).mapInArrow(frugal(_add), PIECES).collect():
        out.setdefault(r.kind, {})[r.bucket] = np.frombuffer(zlib.decompress(r.records))
    return out


def _vector(found: dict[int, np.ndarray], size: int) -> np.ndarray:
    out = np.zeros(size)
    for i, v in found.items():
        out[i * CHUNK : i * CHUNK + len(v)] = v
    return out


class Seating:
    """Tables of words in context restaurants, by merged records of one kind; tail words' in the root, too."""

    def __init__(self, r: np.ndarray, totals: Totals, seed: int, single: np.ndarray | None = None, head: bool = False) -> None:
        """``r`` are groups of two customers and more if ``single`` gives each word's groups of one, else all groups; ``words`` are those of r, or of ``single``'s DISH rows."""
        self.t, self.head = totals, head
        self.rng = np.random.default_rng((SEED, seed))
        self.words = single["word"] if single is not None else r["word"][_firsts(r["word"])]
        self.at = np.searchsorted(self.words, r["word"])
        self.n, self.context = r["n"].astype(np.int64), r["context"].astype(np.int64)
        self.more = single["single"].astype(float) if single is not None else np.zeros(len(self.words))
        self.tables = np.minimum(self.n, 1)
        self.root_tables = np.ones(len(self.words), np.int64)
        self.s0, self.s1 = log_stirling(totals.d0), log_stirling(totals.d1)

    def customers(self) -> np.ndarray:
        """Customers of each word in the root, of these records."""
        return self.more + np.bincount(self.at, self.tables, len(self.words))

    def root(self) -> np.ndarray:
        """Each word's probability in the root; a head word's totals are shared."""
        if self.head:
            i = self.words.astype(np.int64)
            return self.t.root(self.t.head_customers[i], self.t.head_tables[i])
        return self.t.root(self.customers(), self.root_tables)

    def sweep(self) -> None:
        t = self.t
        others = np.maximum(t.tables[self.context] - self.tables, 0)
        self.tables = seat(self.n, t.d1, others, self.root()[self.at], self.rng, self.s1)
        if not self.head:
            n = self.customers().astype(np.int64)
            self.root_tables = seat(n, t.d0, np.maximum(t.root_tables - self.root_tables, 0), np.full(len(n), t.base), self.rng, self.s0)

    def averaged(self) -> tuple[np.ndarray, np.ndarray]:
        """The probabilities of each record's word in its context without the root's share, and of each word in the root, over SAMPLES samples."""
        for _ in range(SWEEPS):
            self.sweep()
        own, root = np.zeros(len(self.n)), np.zeros(len(self.words))
        for _ in range(SAMPLES):
            self.sweep()
            own += np.maximum(self.n - self.t.d1 * self.tables, 0) / (STRENGTH + self.t.customers[self.context]) / SAMPLES
            root += self.root() / SAMPLES
        return own, root


def _settle(totals, heads: int):
    """Tables after SWEEPS sweeps, beyond one for each group: sums by context ("x"), by head word ("hw"), and of the root ("n")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = totals.value
        extra, by_head, stats = np.zeros(len(t.tables)), np.zeros(heads), np.zeros(4)
        for bucket, records in ((b, r) for batch in batches for b, r in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            ends = 32 + np.concatenate(([0], np.cumsum(np.frombuffer(records[:32], np.int64))))
            whole = [records[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            for i, kind in enumerate(("t", "h")):
                dish, r = unpack(whole[2 * i], DISH), unpack(whole[2 * i + 1], POSTING)
                s = Seating(r, t, 2 * bucket + (kind == "h"), dish, kind == "h")
                for _ in range(SWEEPS):
                    s.sweep()
                extra += np.bincount(s.context, s.tables - 1, len(extra))
                up = s.customers()
                if kind == "h":
                    by_head += np.bincount(s.words.astype(np.int64), up, heads)
                else:
                    stats += up.sum(), s.root_tables.sum(), (up == 1).sum(), (up == 2).sum()
        yield from _chunks("x", extra)
        yield from _chunks("hw", by_head)
        yield from _chunks("n", stats)

    return run


TAIL = np.dtype([("word", "<u8"), ("context", "<u4"), ("row", "<u8")])
SUMS = np.dtype([("row", "<u8"), ("s", "<f8"), ("b", "<f8"), ("k", "<u8"), ("n", "<u8"), ("copies", "<u8")])


def _add_rows(x: np.ndarray) -> np.ndarray:
    rows, at = np.unique(x["row"], return_inverse=True)
    out = np.zeros(len(rows), x.dtype)
    out["row"] = rows
    for c in SUMS.names[1:]:
        out[c] = np.bincount(at, x[c], len(rows))
    return out


def _rows_out(kept: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    if kept:
        x = _add_rows(np.concatenate(kept))
        kept.clear()
        yield from _pieces(_hash_bucket(mix(x["row"]), buckets), "s", x, buckets)


def _postings(lexicon, pairs, counts, buckets: int):
    """Tokens to be scored with their word's counts, marked by the row's last bit if held out; and the sums by text ("s") of those scored here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, logp, logc = lexicon.value, pairs.value, counts.value
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        sums: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            head, r = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
            kept.clear()
            for kind, mine in (("t", ~head), ("h", head)):
                part = r[mine]
                part = part[np.lexsort((part["context"], part["word"]))]
                at = np.full(len(part), -1) if kind == "t" else part["word"].astype(np.int64)
                yield from _pieces(_deal(at, part["word"], part["context"], buckets), kind + "p", part, buckets)

        for batch in batches:
            held, key = _flags(batch.column(1)), batch.column(2).to_numpy().view(U64)
            for a, b, data, offsets in text_slices(batch.column(0), 1_000_000):
                h, head, c, top, starts = read(x, data, offsets)
                rows = key[a:b] >> U64(1) << U64(1) | held[a:b].astype(U64)
                here = (head >= 0) & (top >= 0)
                owner = np.repeat(np.arange(b - a), np.diff(starts))
                of, known = owner[here], logc[head[here]]
                out = np.zeros(b - a, SUMS)
                out["row"], out["n"], out["copies"] = rows, np.diff(starts), 1
                out["s"], out["b"], out["k"] = np.bincount(of, logp[top[here], head[here]], b - a), np.bincount(of, known, b - a), np.bincount(of, minlength=b - a)
                sums.append(out)
                rest = ~here
                r = np.zeros(int(rest.sum()), TAIL)
                r["word"], r["context"], r["row"] = np.where(head[rest] >= 0, head[rest].astype(U64), h[rest]), c[rest], rows[owner[rest]]
                kept.append((head[rest] >= 0, r))
            if sum(len(k[1]) for k in kept) > HELD:
                yield from send()
                yield from _rows_out(sums, buckets)
        if kept:
            yield from send()
        yield from _rows_out(sums, buckets)

    return run


def _scores(totals, counts, buckets: int):
    """Postings of a bucket scored; sums by text of these and of what was scored before are sent on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, logc = totals.value, counts.value
        sums: list[np.ndarray] = []
        for bucket, parts in _by_bucket(batches):
            sums += [unpack(x, SUMS) for x in parts.pop("s", [])]
            for kind in ("t", "h"):
                r = _joined(parts, f"{kind}p", TAIL)
                if not len(r):
                    continue
                r = r[np.lexsort((r["context"], r["word"]))]
                train = (r["row"] & U64(1)) == 0
                g = np.zeros(int(train.sum()), POSTING)
                g["word"], g["context"], g["n"] = r["word"][train], r["context"][train], 1
                g = merge(g)
                s = Seating(g, t, 2 * bucket + (kind == "h"), head=kind == "h")
                own, root = s.averaged()
                context = r["context"].astype(np.int64)
                if kind == "h":
                    i = r["word"].astype(np.int64)
                    known, b = np.ones(len(r), bool), logc[i]
                    p = t.back(context) * t.root(t.head_customers[i], t.head_tables[i])
                else:
                    at = place(r["word"], s.words)
                    known = at >= 0
                    c, p = np.zeros(len(r)), t.unseen(context)
                    c[known] = (np.add.reduceat(g["n"], _firsts(g["word"])) if len(g) else g["n"])[at[known]]
                    p[known] = t.back(context[known]) * root[at[known]]
                    b = np.log10(c + 0.5)
                # groups and postings are in one order: the posting's group is among those that have a training token
                group = np.cumsum(np.concatenate(([True], (r["word"][1:] != r["word"][:-1]) | (r["context"][1:] != r["context"][:-1])))) - 1
                has = np.zeros(group[-1] + 1, bool)
                has[group[train]] = True
                seen = has[group]
                p[seen] += own[(np.cumsum(has) - 1)[group[seen]]]
                out = np.zeros(len(r), SUMS)
                out["row"], out["s"], out["b"], out["k"] = r["row"], np.log10(p), b, known
                sums.append(_add_rows(out))
            # a text has one sum a task, unless there are more texts than a task may hold
            if sum(map(len, sums)) > HELD // 2:
                sums[:] = [_add_rows(np.concatenate(sums))]
                if len(sums[0]) > 2 * HELD:
                    yield from _rows_out(sums, buckets)
        yield from _rows_out(sums, buckets)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by text: (row, s, b, k, n, copies)."""
    for _, parts in _by_bucket(batches):
        x = _add_rows(_joined(parts, "s", SUMS))
        for a in range(0, len(x), 50_000):
            y = x[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(y[c].view(np.int64) if y[c].dtype == U64 else y[c]) for c in SUMS.names], list(SUMS.names))


def _discount(one: float, two: float) -> float:
    return float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one + two else 0.5


def score(docs: DataFrame, is_held_out) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The model learns from the rows that are not held out.  A null text is an empty one: its only token is the end.  Repeated
    rows are scored alike, and each counts where it is learned from.  With nothing to learn from, every token is unseen and the only type.
    A word is known by a 64-bit hash, a row by one of its id and text: some words of 10^10 would share theirs.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = 4 * parts
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), is_held_out.alias("held_out"), "doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"))
    counted = cut(rows.select("text", "held_out").mapInArrow(frugal(_frequent), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    n_tokens = int(counted.where("word = 0").agg(F.sum("n")).head()[0] or 0)
    # KNOWN words at most, the most frequent by exact counts
    frequent = counted.where("word <> 0").orderBy(F.desc("n"), "word").limit(KNOWN).toArrow()
    word, n = frequent["word"].to_numpy().view(U64), frequent["n"].to_numpy()
    lexicon = Lexicon(np.sort(word[:HEADS][n[:HEADS] * HEAD_SHARE >= n_tokens]), np.sort(word))
    shared = sc.broadcast(lexicon)
    size, heads = lexicon.contexts, len(lexicon.head)
    dishes = cut(exchange(rows.select("text", "held_out").mapInArrow(frugal(_count(shared, buckets)), PIECES), parts).mapInArrow(frugal(_dishes(size, heads)), PIECES))
    found = _sums(dishes.where("kind in ('c', 'y', 'g', 'n')"), parts)
    stats = found.get("n", {}).get(0, np.zeros(4))
    # head words in top contexts: HEADS x (HEADS + 1) groups at most, sampled here
    top = lexicon.top()
    pairs = [unpack(r.records, POSTING) for r in dishes.where("kind = 'p'").select("records").collect()]
    pairs = merge(np.concatenate(pairs)) if pairs else np.zeros(0, POSTING)
    pairs["context"] = top[pairs["context"].astype(np.int64)] if len(pairs) else pairs["context"]
    customers, types = _vector(found.get("c", {}), size), _vector(found.get("y", {}), size)
    customers += np.bincount(pairs["context"], pairs["n"].astype(float), size)
    types += np.bincount(pairs["context"], minlength=size)
    d1 = _discount(stats[0] + (pairs["n"] == 1).sum(), stats[1] + (pairs["n"] == 2).sum())
    groups = _vector(found.get("g", {}), heads) + np.bincount(pairs["word"].astype(np.int64), minlength=heads)
    totals = Totals(n_tokens, int(stats[3]) + heads, customers, types.copy(), stats[2] + len(pairs), stats[3] + heads, np.maximum(groups, 1), np.ones(heads), 0.5, d1)
    state = dishes.where("kind = 'd'")
    for turn in range(ROUNDS if n_tokens else 0):
        sent = sc.broadcast(totals)
        got = _sums(state.mapInArrow(frugal(_settle(sent, heads)), PIECES), parts)
        tail = got.get("n", {}).get(0, np.zeros(4))
        s = Seating(pairs, totals, 1_000_003 + turn, head=True)
        for _ in range(SWEEPS):
            s.sweep()
        tables = types + _vector(got.get("x", {}), size) + np.bincount(s.context, s.tables - 1, size)
        up = _vector(got.get("hw", {}), heads) + np.bincount(s.words[s.at].astype(np.int64), s.tables, heads)
        d0 = _discount(tail[2] + (up == 1).sum(), tail[3] + (up == 2).sum())
        under = seat(up.astype(np.int64), d0, np.full(heads, totals.root_tables), np.full(heads, totals.base), np.random.default_rng((SEED, turn)), log_stirling(d0))
        totals = Totals(n_tokens, totals.types, customers, tables, tail[0] + up.sum(), tail[1] + under.sum(), up, under.astype(float), d0, d1)
        sent.unpersist()
    sent = sc.broadcast(totals)
    logp, logc = np.zeros((heads + 1, heads), np.float32), np.zeros(heads)
    if heads:
        words_root = totals.root(totals.head_customers, totals.head_tables)
        p = totals.back(top)[:, None] * words_root[None, :]
        s = Seating(pairs, totals, 2_000_003, head=True)
        own, _ = s.averaged()
        line = np.full(size, -1)
        line[top] = np.arange(heads + 1)
        p[line[s.context], s.words[s.at].astype(np.int64)] += own
        logp = np.log10(p).astype(np.float32)
        of_head = dict(zip(word.tolist(), n.tolist(), strict=True))
        logc = np.log10(np.array([of_head[int(w)] for w in lexicon.head], float) + 0.5)
    tables_of = sc.broadcast(logp)
    counts = sc.broadcast(logc)
    postings = rows.select("text", "held_out", "row").mapInArrow(frugal(_postings(shared, tables_of, counts, buckets)), PIECES)
    scored = exchange(postings, parts).mapInArrow(frugal(_scores(sent, counts, buckets)), PIECES)
    sums = exchange(scored, parts).mapInArrow(frugal(_texts), "row long, s double, b double, k long, n long, copies long")
    mark = F.shiftleft(F.shiftrightunsigned("row", 1), 1).bitwiseOR(F.col("held_out").cast("long"))
    # equal rows were added up
    out = rows.select("doc_id", "held_out", mark.alias("row")).join(sums, "row").withColumn("n_tokens", (F.col("n") / F.col("copies")).cast("long"))
    base = F.col("b") / F.col("copies") - F.col("n_tokens") * F.log10(F.lit(n_tokens + 0.5 * (totals.types + 1)))
    total = F.col("s") / F.col("copies")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("k") / F.col("copies")).cast("long").alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )


def op9(docs: DataFrame) -> DataFrame:
    """One row per document, learning from those whose crc32(doc_id as text) mod 5 is not 1."""
    return score(docs, held_out(1))
