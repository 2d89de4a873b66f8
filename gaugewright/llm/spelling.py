"""Spelling variants: words that one edit parts, found by two-dimensional range reporting.

A word and an edit position leave a prefix and a suffix untouched. The words with the prefix are an interval of the words in their order,
those with the suffix an interval of the reversed words in theirs. A wavelet tree over the second rank of each word, in the order
of the first, reports the words in both intervals; of words of a set length these are the ones that differ there.

The words are dealt into cells by what stays whole while the edit lies in a range of positions: at first one half or the other. A cell
of too many words halves its range, and its words go on to two cells with more letters in common, down to a single position, where no
more words fit than there are letters. So no task holds many words, and no pair of words is left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import written

SHORTEST = 5
LEAST = 3
#: One run in so many loses a letter.
SLIPS = 97
#: A word's form is at least so many times as frequent.
RATIO = 2
#: Letters of the words of a cell, about, and of a task's share of cells.
BLOCK = 1 << 19
#: Different words that a task counts before it hands them on.
COUNTED = 200_000

#: In UTF-8, after A-Z are folded: a-z, and U+00C0 to U+00FF, which all begin with the byte C3.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def slipped(runs: list[bytes], key: str) -> list[bytes]:
    """The lower-cased runs of a document; where the crc32 of ``key:run`` is a multiple of SLIPS, the code point that it points to is gone."""
    start = crc32(f"{key}:".encode())
    out = runs
    for i, h in ((i, h) for i, run in enumerate(runs) if not (h := crc32(run, start)) % SLIPS):
        if out is runs:
            out = list(runs)
        word = runs[i].decode()
        at = h % len(word)
        out[i] = (word[:at] + word[at + 1 :]).encode()
    return out


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """``word`` and ``n`` of the words of ``shortest`` code points or more that occur ``least`` times or more. Null texts hold none; a null key is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def given() -> pa.RecordBatch:
            kept = [(w, n) for w, n in ((w.decode(), n) for w, n in counts.items()) if len(w) >= shortest]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                counts.update(slipped(_RUN.findall(t.translate(_FOLD)), k or ""))
                if len(counts) > COUNTED:
                    yield given()
        yield given()

    picked = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    return picked.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class WaveletTree:
    """Range reporting over a permutation: which values of a range lie at the places of an interval."""

    def __init__(self, values: np.ndarray) -> None:
        self.size, self.levels = len(values), []
        for bit in range(max(1, int(len(values) - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1
            ahead = np.concatenate([[0], np.cumsum(1 - ones)])  # zeros before each place
            self.levels.append((bit, ahead))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for each query's values in [low, high) at places in [left, right). All queries go down a level together;
        of a node's children only those go on that hold a place of the interval and a value of the range."""
        query, base = np.flatnonzero((left < right) & (low < high)), np.zeros(0, np.int64)
        left, right, base = left[query], right[query], np.zeros(len(query), np.int64)
        for bit, ahead in self.levels:
            zeros = ahead[-1]
            l0, r0 = ahead[left], ahead[right]
            query = np.concatenate([query, query])
            base = np.concatenate([base, base + (1 << bit)])
            left, right = np.concatenate([l0, left - l0 + zeros]), np.concatenate([r0, right - r0 + zeros])
            on = (left < right) & (base < high[query]) & (base + (1 << bit) > low[query])
            query, base, left, right = query[on], base[on], left[on], right[on]
        return query, base


def _common_ahead(letters: np.ndarray) -> np.ndarray:
    """Of sorted words: the length of the prefix that each shares with the one before it."""
    same = letters[1:] == letters[:-1]
    return np.concatenate([[0], np.cumprod(same, axis=1).sum(axis=1)])


class _Order:
    """Words in their order, with the interval of the indexed ones that begin like a word up to a depth."""

    def __init__(self, words: np.ndarray, indexed: np.ndarray) -> None:
        order = np.argsort(words, kind="stable")
        letters = words[order].view(np.uint32).reshape(len(words), -1)
        self.common = _common_ahead(letters)
        self.place = np.empty(len(words), np.int64)
        self.place[order] = np.arange(len(words))
        self.before = np.concatenate([[0], np.cumsum(indexed[order])])
        self.rank = self.before[self.place]  # of an indexed word, among these

    def interval(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate([[True], self.common[1:] < depth]))
        of = np.searchsorted(starts, self.place, "right") - 1
        ends = np.append(starts[1:], len(self.place))
        return self.before[starts[of]], self.before[ends[of]]


def near_words(words: np.ndarray, shorter: np.ndarray, length: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place, place) of ``words`` that one edit at a position in [``low``, ``high``) parts: replacements among the words of ``length`` letters,
    both ways, and insertions into those of one letter less (``shorter``), from the shorter to the longer one."""
    indexed = ~shorter
    n = int(indexed.sum())
    none = np.zeros(0, np.int64)
    if n == 0 or len(words) < 2:
        return none, none
    words = words.astype(f"U{length}")
    ahead = _Order(words, indexed)
    back = _Order(np.array([w[::-1] for w in words.tolist()], f"U{length}"), indexed)
    at = np.flatnonzero(indexed)
    by_ahead, by_back = np.empty(n, np.int64), np.empty(n, np.int64)
    by_ahead[ahead.rank[at]] = back.rank[at]
    by_back[back.rank[at]] = at
    tree = WaveletTree(by_ahead)
    letters = words.view(np.uint32).reshape(len(words), -1)
    found = [(none, none)]
    for i in range(low, high):
        left, right = ahead.interval(i)
        lowest, highest = back.interval(length - 1 - i)
        alone = indexed & ((right - left < 2) | (highest - lowest < 2))  # no other word than itself
        query, value = tree.report(left, np.where(alone, left, right), lowest, highest)
        other = by_back[value]
        # of equal letters in a row, one more can be put in at several positions: the first counts
        right_one = shorter[query] & ((letters[query, i - 1] != letters[other, i]) if i else True)
        kept = np.where(shorter[query], right_one, query != other)
        found.append((query[kept], other[kept]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


#: Of a cell, its key: what stays whole. Words of one letter less than the cell's length keep their end from a place one earlier on.
_CELL = "xxhash64(length, low, high, substr(word, 1, low), substr(word, IF(shorter, high, high + 1)))"


def _cells(words: DataFrame, block: int) -> DataFrame:
    """``words`` (word, n) in cells: ``length``, ``low``, ``high``, ``shorter``, ``cell``. Cells of more than ``block`` letters are halved until none is left."""
    size = F.length("word")
    each = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("shorter")).withColumn("length", size + F.col("shorter").cast("int"))
    halves = F.explode(F.expr("array(struct(0 AS low, length div 2 AS high), struct(length div 2 AS low, length AS high))"))
    fresh_cells = each.withColumn("r_", halves).select("word", "n", "shorter", F.col("length").cast("int"), F.col("r_.low").cast("int").alias("low"), F.col("r_.high").cast("int").alias("high"))
    fresh_cells = written(fresh_cells.withColumn("cell", F.expr(_CELL)), "cells")
    done = None
    while True:
        large = written(fresh_cells.where("high - low > 1").groupBy("cell").agg(F.sum("length").alias("size_")).where(F.col("size_") > block).select("cell"), "large")
        if large.isEmpty():
            return fresh_cells if done is None else done.unionByName(fresh_cells)
        small = fresh_cells.join(large, "cell", "left_anti").select(fresh_cells.columns)
        done = small if done is None else done.unionByName(small)
        middle = "(low + high) div 2"
        halves = F.explode(F.expr(f"IF(high - low > 1, array(struct(low AS low, CAST({middle} AS INT) AS high), struct(CAST({middle} AS INT) AS low, high AS high)), array(struct(low AS low, high AS high)))"))
        split = fresh_cells.join(large, "cell", "left_semi").withColumn("r_", halves).select("word", "n", "shorter", "length", "r_.low", "r_.high")
        fresh_cells = written(split.withColumn("cell", F.expr(_CELL)), "halved")


def near_counts(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (``minus`` its count, and ``word``) of the words of ``words`` (word, n; different ones) that have a near word. A
    task reports the count and the best of each of its words, never their pairs."""
    cells = _cells(words, block)
    # cells that share a hash are no harm: only words with both a prefix and a suffix in common are reported
    shares = max(1, -(-(cells.agg(F.sum("length")).first()[0] or 0) // block))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, code = np.unique(pdf["word"].to_numpy(object), return_inverse=True)
        n = np.zeros(len(names), np.int64)
        n[code] = pdf["n"].to_numpy()
        to, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for (length, low, high), part in pdf.assign(code=code).groupby(["length", "low", "high"], sort=False):
            mine, shorter = part["code"].to_numpy(), part["shorter"].to_numpy(bool)
            a, b = near_words(names[mine], shorter, int(length), int(low), int(high))
            insert = shorter[a]
            to += [mine[a], mine[b[insert]]]
            of += [mine[b], mine[a[insert]]]
        to, of = np.concatenate(to), np.concatenate(of)
        order = np.lexsort((of, -n[of], to))  # codes are in the order of the words
        each, first, count = np.unique(to[order], return_index=True, return_counts=True)
        best = of[order][first]
        return pd.DataFrame({"word": names[each], "n_near": count, "minus": -n[best], "best": names[best]}).astype({"n_near": "int64", "minus": "int64"})

    parts = cells.withColumn("share", F.pmod("cell", F.lit(shares))).groupBy("share").applyInPandas(run, "word string, n_near long, minus long, best string")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: where the forms (word, form) lead. Each round doubles the steps; a form is more frequent than its word, so none leads back."""
    reached = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = written(reached.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        reached = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return reached


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of the words of ``word_counts``.

    Near words differ by one inserted, deleted or replaced code point. A word's form is its near word of the largest count (of equal ones the
    first in code-point order), if that is ``ratio`` times its own or more; its root is the last one that forms lead to, the word
    itself without any. Repeated rows count as often as they occur; an empty table gives an empty one; other columns, whatever their
    names, are not read."""
    words = written(word_counts(docs, key, text), "counted")
    near = words.join(near_counts(words, block), "word", "left")
    fits = -F.col("best.minus") >= ratio * F.col("n")
    formed = written(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n")), "formed")
    found = roots(formed.where("form IS NOT NULL"))
    return formed.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
