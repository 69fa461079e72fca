"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm.langid import held_out
from tidewave.llm.textkernel import U64, mix, text_slices, words

#: The bounded sample of labelled rows that is learned from.
SAMPLE_ROWS = 8000
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32
#: Words of the second person in the languages of the tables.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro"
#: Signs that stand for letters in disguised words.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
PREFIX_BYTES = 6
FEATURES = (
    "log_words", "lexicon_density", "lexicon_count", "lexicon_weight", "prefix_density", "prefix_weight",
    "near_second_person", "second_person", "capitals", "shouted", "exclaims", "questions", "marks", "digits", "disguised",
)

_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_SIGN = np.zeros(256, bool)
for _a, _b in DISGUISE.items():
    _PLAIN[ord(_a)] = ord(_b)
    _SIGN[ord(_a)] = True
_DROP = _MARK & ~_SIGN


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return np.diff(sums[offsets]).astype(float)


def _plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes without marks, signs turned into the letters that they stand for."""
    keep = ~_DROP[data]
    return _PLAIN[data[keep]], np.concatenate(([0], np.cumsum(keep)))[offsets]


def _prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), U64)
    for j in range(PREFIX_BYTES):
        inside = starts + j < ends
        byte = data[np.minimum(starts + j, max(len(data) - 1, 0))] if len(data) else np.zeros(0, np.uint8)
        byte = np.where((byte >= 65) & (byte < 91), byte + 32, byte)
        out = out * U64(0x9E3779B97F4A7C15) + np.where(inside, byte, 0).astype(U64) + U64(1)
    return mix(out)


def _hash_words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]))[2]


_YOU = np.sort(_hash_words(SECOND_PERSON))


def _in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


class Lexicon:
    """Words and word beginnings that occur in toxic texts far more often than in others, with log odds as weights."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.words, self.weights = counts["words"]
        self.prefixes, self.prefix_weights = counts["prefixes"]


def learn_lexicon(docs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> Lexicon:
    """From the distinct word and prefix hashes of each labelled text; two toxic texts at least must hold an entry."""
    out = {}
    bad, good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    for i, name in enumerate(("words", "prefixes")):
        t = [d[i] for d, y in zip(docs, toxic, strict=True) if y]
        c = [d[i] for d, y in zip(docs, toxic, strict=True) if not y]
        h, n = np.unique(np.concatenate(t) if t else np.zeros(0, U64), return_counts=True)
        h, n = h[n >= 2], n[n >= 2]
        g, m = np.unique(np.concatenate(c) if c else np.zeros(0, U64), return_counts=True)
        other = np.zeros(len(h))
        both = _in(h, g)
        other[both] = m[np.searchsorted(g, h[both])]
        odds = np.log((n + 0.1) / (bad + 0.2)) - np.log((other + 0.5) / (good + 1))
        # sure of itself: the odds' own spread counts against it
        sure = odds - 1.3 * np.sqrt(1 / n + 1 / (other + 0.5))
        keep = sure > 0.7
        out[name] = (h[keep], odds[keep])
    return Lexicon(out)


def hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    plain, off = _plain(data, offsets)
    starts, ends, h, first = words(plain, off)
    return h, _prefix_hashes(plain, starts, ends), first


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES per text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    h, p, first = hashes(data, offsets)
    count = np.maximum(np.diff(first), 1).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    owner = np.repeat(np.arange(n), np.diff(first))
    hit, pre = _in(h, lexicon.words), _in(p, lexicon.prefixes)
    weight = np.zeros(len(h))
    weight[hit] = lexicon.weights[np.searchsorted(lexicon.words, h[hit])]
    pre_weight = np.zeros(len(h))
    pre_weight[pre] = lexicon.prefix_weights[np.searchsorted(lexicon.prefixes, p[pre])]
    per = lambda x: np.bincount(owner, x, n)
    you = _in(h, _YOU)
    near = np.zeros(len(h), bool)
    for shift in range(1, 6):
        same = owner[shift:] == owner[:-shift]
        near[shift:] |= you[:-shift] & same
        near[:-shift] |= you[shift:] & same
    letters = np.maximum(_per_text(_ALPHA[data], offsets), 1)
    starts, ends, _, raw_first = words(data, offsets)
    sums = lambda flags: np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    of_word = lambda flags: (lambda s: s[ends] - s[starts])(sums(flags))
    alpha, sign, upper = of_word(_ALPHA[data]), of_word(_SIGN[data]), of_word(_UPPER[data])
    raw_owner = np.repeat(np.arange(n), np.diff(raw_first))
    raw_count = np.maximum(np.diff(raw_first), 1).astype(float)
    columns = (
        np.log1p(np.diff(first)), 100 * per(hit) / count, per(hit), per(weight), 100 * per(pre) / count, per(pre_weight) / np.sqrt(count),
        per(near & hit), 100 * per(you) / count, _per_text(_UPPER[data], offsets) / letters, np.bincount(raw_owner, (upper > 1) & (upper == alpha), n) / raw_count,
        100 * _per_text(data == 33, offsets) / size, 100 * _per_text(data == 63, offsets) / size, _per_text(_MARK[data], offsets) / size, _per_text(_DIGIT[data], offsets) / size,
        100 * np.bincount(raw_owner, (sign > 0) & (alpha > 1), n) / raw_count,
    )
    for i, c in enumerate(columns):
        out[:, i] = c
    return out


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, by histograms; every tree has all 2^DEPTH leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1]
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        self.base = float(np.log(rate / (1 - rate))) if 0 < rate < 1 else -6.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not len(y) or y.min() == y.max():
            return
        b = self._bins(x)
        score = np.full(len(y), self.base)
        width = BINS
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p) + 1e-6
            node = np.zeros(len(y), np.int64)
            splits, places = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, width, np.int64)
            for level in range(DEPTH):
                m, base = 2**level, 2**level - 1
                best = np.full(m, 1e-9)
                for f in range(x.shape[1]):
                    at = node * width + b[:, f]
                    gs = np.bincount(at, g, m * width).reshape(m, width).cumsum(1)
                    hs = np.bincount(at, h, m * width).reshape(m, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < 1.0) | (ht - hs < 1.0)] = 0
                    k = gain.argmax(1)
                    better = gain[np.arange(m), k] > best
                    best = np.where(better, gain[np.arange(m), k], best)
                    splits[base : base + m] = np.where(better, f, splits[base : base + m])
                    places[base : base + m] = np.where(better, k, places[base : base + m])
                node = node * 2 + (b[np.arange(len(y)), splits[base + node]] > places[base + node])
            leaf = RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + 1)
            score += leaf[node]
            self.trees.append((splits, places, leaf))

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1) if len(x) else np.zeros(x.shape, np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._bins(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for splits, places, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                base = 2**level - 1
                node = node * 2 + (b[rows, splits[base + node]] > places[base + node])
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block means over rising scores, as points to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([s, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            s2, v2, n2 = blocks.pop()
            s1, v1, n1 = blocks[-1]
            blocks[-1] = [(s1 * n1 + s2 * n2) / (n1 + n2), v1 + v2, n1 + n2]
    # one virtual row of each label keeps probabilities off 0 and 1
    return np.array([b[0] for b in blocks]), np.array([(b[1] + 0.02) / (b[2] + 0.04) for b in blocks])


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, texts: list[str | None], toxic: list[int]) -> None:
        y = np.array(toxic, bool)
        column = pa.array(texts, pa.large_string())
        parts, pieces = [], []
        for a, b, data, offsets in text_slices(column):
            h, p, first = hashes(data, offsets)
            parts += [(np.unique(h[i:j]), np.unique(p[i:j])) for i, j in zip(first[:-1], first[1:], strict=True)]
            pieces.append((a, b, data, offsets))
        fold = np.arange(len(y)) % 3
        x = np.zeros((len(y), len(FEATURES)))
        # features of a row come from a lexicon that has not seen the row
        for f in range(3):
            if not (fold == f).any():
                continue
            other = learn_lexicon([d for d, k in zip(parts, fold, strict=True) if k != f], y[fold != f])
            for a, b, data, offsets in pieces:
                rows = np.arange(a, b)
                mine = fold[a:b] == f
                x[rows[mine]] = features(data, offsets, other)[mine]
        raw = np.zeros(len(y))
        for f in range(3):
            raw[fold == f] = Boosted(x[fold != f], y[fold != f].astype(float)).score(x[fold == f])
        self.lexicon = learn_lexicon(parts, y) if len(y) else Lexicon({"words": (np.zeros(0, U64), np.zeros(0)), "prefixes": (np.zeros(0, U64), np.zeros(0))})
        self.trees = Boosted(x, y.astype(float))
        self.at, self.probability = isotonic(raw, y.astype(float)) if len(y) else (np.zeros(1), np.zeros(1))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.score(features(data, offsets, self.lexicon)), self.at, self.probability), 0, 1)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.predict(data, offsets) for _, _, data, offsets in text_slices(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "held_out", "score"])

    return run


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the documents' texts as labels.toxic marks them.

    At most SAMPLE_ROWS of the rows that are not held out are used, those least by a hash; a doc_id with several labels has the greatest.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.select("doc_id").where(~held_out(0)).distinct().join(marks, "doc_id").withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)))
    ids = ids.orderBy("h", "doc_id").limit(SAMPLE_ROWS)
    # SAMPLE_ROWS ids at most are broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").orderBy("h", "doc_id", "text").limit(SAMPLE_ROWS).select("text", "toxic").collect()
    return Model([r.text for r in sample], [int(r.toxic > 0) for r in sample])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.  Null and empty texts are scored like any other; repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", held_out(0).alias("held_out"), "text").mapInArrow(_scorer(shared), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return score(docs, learn(docs, labels))
