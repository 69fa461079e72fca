"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is
parsed greedily into the longest phrases that occur in the labelled text; the
language that needs the fewest phrases, each weighted by the bits that a pointer
into its text costs, wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm.textkernel import text_slices

#: The bounded sample that is learned from: rows per language, and characters taken of the middle of each row's text, 60 000 of a language together.
SAMPLE_ROWS, SAMPLE_CHARS = 160, 375
#: Parts that each language's texts are dealt to by their hash while the sample is chosen.
SALTS = 64
#: Texts are parsed in blocks of so many characters side by side; a phrase that crosses into a block is followed until the parses agree.
BLOCK_CHARS = 2048
#: Phrases of the winner may not be shorter than this on average; below it the text is in no learned language.
LEAST_PHRASE = 1.5
UNDETERMINED = "und"


def _fold(text: str) -> str:
    """Lower case; everything that is not a letter is one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class SuffixAutomaton:
    """Transitions of the suffix automaton of a text over codes 1..size-1; 0 in ``next`` means none, state 1 is the root."""

    def __init__(self, codes: list[int], size: int) -> None:
        step: list[dict[int, int]] = [{}, {}]
        link, length = [0, 0], [0, 0]
        last = 1
        for c in codes:
            cur = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p and c not in step[p]:
                step[p][c] = cur
                p = link[p]
            if not p:
                link[cur] = 1
            else:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(step)
                    step.append(dict(step[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next = np.zeros((len(step), size), np.int32)
        for s, out in enumerate(step):
            for c, t in out.items():
                self.next[s, c] = t


class Model:
    """Languages, the code of each character, and an automaton per language.

    Only the labelled texts are sent to workers, each of which builds the tables once: they are some hundred times as large.
    """

    def __init__(self, texts: dict[str, str]) -> None:
        self.texts = texts
        self.languages = sorted(texts)
        alphabet = sorted(set("".join(texts.values())) | {" "})
        self.size = len(alphabet) + 2  # 1: a letter that no language has
        self.code = np.ones(0x110000, np.uint16)
        for i, c in enumerate(alphabet):
            self.code[ord(c)] = i + 2
        self.space = int(self.code[32])
        tables, self.bits = [], []
        for name in self.languages:
            codes = [int(self.code[ord(c)]) for c in texts[name]]
            tables.append(SuffixAutomaton(codes, self.size).next)
            self.bits.append(float(np.log2(len(codes) + 2)))
        first = np.cumsum([0, *(len(t) for t in tables[:-1])]).astype(np.int32)
        self.roots = first + 1
        # one table of flat offsets for all; "no transition" stays 0
        self.table = np.concatenate([np.where(t > 0, t + f, 0) for t, f in zip(tables, first, strict=True)]).ravel().astype(np.int32) if tables else np.zeros(0, np.int32)

    def __reduce__(self):
        return _built, (tuple(sorted(self.texts.items())),)

    def phrases(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Phrases (texts x languages) of concatenated code sequences; ``starts`` has one entry more than texts.

        Each block is parsed as if a phrase began with it.  From the first character on which a phrase of that parse begins where one of the
        text's own does, the two are the same; up to it, the text's phrases are counted by following the one that crosses into the block.
        """
        k = len(self.languages)
        n = np.diff(starts)
        out = np.zeros((len(n), k), np.int64)
        parts = -(-n // BLOCK_CHARS)
        owner = np.repeat(np.arange(len(n)), parts)
        if not len(owner):
            return out
        first = np.cumsum(parts) - parts
        inner = np.arange(len(owner)) - np.repeat(first, parts)
        begin = starts[owner] + inner * BLOCK_CHARS
        length = np.minimum(BLOCK_CHARS, starts[owner + 1] - begin)
        order = np.argsort(-length, kind="stable")
        alive = np.searchsorted(-length[order], -np.arange(1, length.max() + 1), "right")
        state = np.repeat(self.roots[None, :], len(begin), 0)
        # whether a phrase of a block's own parse begins at a character, and its state after the block
        begins = np.zeros((len(codes), k), bool)
        at = begin[order]
        for t, m in enumerate(alive):
            state[:m], begins[at[:m] + t] = self._step(state[:m], codes[at[:m] + t])
        end = np.empty_like(state)
        end[order] = state
        before = np.zeros((len(codes) + 1, k), np.int64)
        np.cumsum(begins, axis=0, out=before[1:])
        count = before[begin + length] - before[begin]
        for j in range(1, int(parts.max())):
            block = first[parts > j] + j
            now = end[block - 1].copy()
            # open: the text's phrase goes on in this block and the parses have not met
            open_ = now != self.roots
            for t in range(int(length[block].max())):
                open_ &= (t < length[block])[:, None]
                rows = np.flatnonzero(open_.any(1))
                if not len(rows):
                    break
                place = begin[block[rows]] + t
                to, new = self._step(now[rows], codes[place])
                met = new & begins[place] & open_[rows]
                went = open_[rows] & ~met
                # own phrases that began before the parses met are none of the text's
                count[block[rows]] -= np.where(met, before[place] - before[begin[block[rows]]], 0)
                count[block[rows]] += new & went
                now[rows] = np.where(went, to, now[rows])
                open_[rows] = went
                done = went & (t + 1 == length[block[rows]])[:, None]
                if done.any():
                    # never met: all of the block's own phrases go, and the text's state is the one that was followed
                    whole = before[place + 1] - before[begin[block[rows]]]
                    count[block[rows]] -= np.where(done, whole, 0)
                    end[block[rows]] = np.where(done, now[rows], end[block[rows]])
        np.add.at(out, owner, count)
        return out

    def _step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after one character of each row, and whether a phrase begins with it; a letter that a language lacks is a phrase of its own."""
        c = codes.astype(np.int64)[:, None]
        to = self.table[state * self.size + c]
        stuck = to == 0
        again = self.table[self.roots * self.size + c]
        return np.where(stuck, np.where(again == 0, self.roots, again), to), stuck | (state == self.roots)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score in 0..1 and mean phrase length of every text."""
        names, scores, means = [], [], []
        for a, b, _, _ in text_slices(column):
            # character offsets after lower-casing, which may change a text's length
            each = [(x or "").lower() for x in column.slice(a, b - a).to_pylist()]
            points = np.frombuffer("".join(each).encode("utf-32-le", "replace"), np.uint32)
            starts = np.cumsum([0, *map(len, each)])
            letter = _letters(points)
            first = np.zeros(len(points) + 1, bool)
            first[starts] = True
            # keep letters, and the first of each run of others as a space, but none at a text's start
            keep = letter.copy()
            keep[1:] |= ~letter[1:] & letter[:-1] & ~first[1 : len(points)]
            codes = np.where(letter, self.code[np.minimum(points, 0x10FFFF)], self.space)[keep]
            kept = np.concatenate(([0], np.cumsum(keep)))
            lettered = np.concatenate(([0], np.cumsum(letter)))
            begin = kept[starts]
            n = np.diff(begin)
            has = np.diff(lettered[starts]) > 0
            cost = self.phrases(codes, begin) * np.array(self.bits)[None, :] if self.languages else np.zeros((b - a, 0))
            rate = cost / np.maximum(n, 1)[:, None]
            for i in range(b - a):
                if not has[i] or not self.languages:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    means.append(0.0)
                    continue
                best = int(np.argmin(rate[i]))
                # posterior over languages if every character carried its own code's bits, tempered to 50 characters
                weight = np.exp2(-50 * (rate[i] - rate[i, best]))
                names.append(self.languages[best])
                scores.append(float(1 / weight.sum()))
                means.append(float(n[i] * self.bits[best] / cost[i, best]))
        return names, np.array(scores), np.array(means)


@lru_cache(maxsize=2)
def _built(texts: tuple[tuple[str, str], ...]) -> Model:
    return Model(dict(texts))


_letter_table: list[np.ndarray] = []


def _letters(points: np.ndarray) -> np.ndarray:
    if not _letter_table:
        _letter_table.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letter_table[0][points]


def learn(rows: DataFrame) -> Model:
    """A model of the rows (text, lang) with a non-null lang, from a bounded sample of them.

    Of each language the SAMPLE_ROWS texts least by a hash of the text are used, a text that repeats once, and of each at most
    SAMPLE_CHARS characters of its middle.
    """
    x = rows.select("text", "lang").where("lang is not null and text is not null").withColumn("h", F.xxhash64("text", F.lit(11)))
    # only hashes are shuffled to choose the sample, first in SALTS parts of a language: the last step sees SAMPLE_ROWS of each part at most
    chosen = x.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(SALTS)))
    for by in (["lang", "part"], ["lang"]):
        chosen = chosen.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("r") <= SAMPLE_ROWS)
    # SAMPLE_ROWS hashes of each language: small enough to broadcast
    # four times the characters wanted, from the middle of the whole text: those that are no letters fall away
    size = 4 * SAMPLE_CHARS
    middle = F.col("text").substr(F.greatest(F.lit(1), F.floor((F.length("text") - size) / 2).cast("int") + 1), F.lit(size))
    x = x.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first(middle).alias("text"))
    pieces: dict[str, list[str]] = {}
    for row in x.select("lang", "h", "text").orderBy("lang", "h").collect():
        text = _fold(row.text)
        at = max(0, (len(text) - SAMPLE_CHARS) // 2)
        pieces.setdefault(row.lang, []).append(text[at : at + SAMPLE_CHARS])
    texts = {k: " ".join(v) for k, v in pieces.items()}
    return Model({k: v for k, v in texts.items() if v.strip()})


def _predictor(model, at: int, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, means = model.value.predict(batch.column(at))
            rest = [batch.column(i) for i in range(kept)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(means, pa.float64())], [*(f"c{i}" for i in range(len(rest))), "lang_pred", "score", "phrase_length"])

    return run


def held_out(remainder: int):
    """Whether crc32(doc_id as text) mod 5 is ``remainder``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5) == remainder


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs``, then lang_pred, score and phrase_length (mean phrase of the winner, in characters).

    A text that is null or has no letter is ``und`` with score 0.  Ties go to the language first by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)) + ", lang_pred string, score double, phrase_length double"
    given = [*keep, "text"] if "text" not in keep else keep
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(given)))
    out = rows.mapInArrow(_predictor(shared, given.index("text"), len(keep)), schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "phrase_length")


def op2(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, phrase_length."""
    model = learn(docs.where(~held_out(0)))
    marked = docs.select("doc_id", "text", held_out(0).alias("held_out"))
    return predict(marked, model, ["doc_id", "held_out"])


def keep_determined(docs: DataFrame) -> DataFrame:
    """The documents without those that are in no learned language: no letters, or phrases no longer than chance makes them."""
    model = learn(docs.where(~held_out(0)))
    clash = {"lang_pred", "score", "phrase_length"} & set(docs.columns)
    plain = docs.select(*(F.col(c).alias(f"own_{c}" if c in clash else c) for c in docs.columns))
    out = predict(plain, model, plain.columns).where((F.col("lang_pred") != UNDETERMINED) & (F.col("phrase_length") >= LEAST_PHRASE))
    return out.select(*(F.col(f"own_{c}" if c in clash else c).alias(c) for c in docs.columns))
