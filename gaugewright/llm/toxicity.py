"""Toxicity by a linear classifier over character n-grams that naive Bayes scales.

A text is the set of its hashed n-grams of three to six characters, word by word with their borders. Each n-gram has a log-count ratio
(how much more often toxic texts hold it than others). The features are these ratios, and a ridge-penalised logistic
regression over the n-grams of the strongest evidence is fitted on labelled texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import labelled, per_class

#: Labelled texts of each class that the fit takes, about, whatever their lengths.
SAMPLE = 2000
#: Bytes that these hold, about.
SAMPLE_BYTES = 24 << 20
SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 18
#: N-grams that the regression sees, those of the largest evidence; the others say nothing.
FEATURES = 2048
SMOOTHING = 0.5
RIDGE = 1.0
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - (BUCKETS.bit_length() - 1))
#: Characters of a text that are hashed at a time; neighbouring parts overlap by the longest n-gram.
PART = 1 << 18


def ngram_buckets(text: str | None) -> np.ndarray:
    """The different buckets of the whole lower-cased text's n-grams, in order. White space, however long, is one border;
    an n-gram holds a border at its ends at most."""
    words = " ".join((text or "").lower().split())
    seen = np.zeros(BUCKETS, bool)
    codes = np.frombuffer(f" {words} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) if words else np.zeros(0, np.uint64)
    for at in range(0, max(1, len(codes) - max(SIZES) + 1), PART):
        c = codes[at : at + PART + max(SIZES) - 1]
        border = np.concatenate([[0], np.cumsum(c == 32)])
        h = c
        for n in range(2, max(SIZES) + 1):
            if len(c) < n:
                break
            h = h[:-1] * np.uint64(1_000_003) + c[n - 1 :]
            if n in SIZES:
                inside = border[n - 1 : len(c)] == border[1 : len(c) - n + 2]
                seen[(((h + np.uint64(n)) * _MIX) >> _SHIFT)[inside].astype(np.int64)] = True
    return np.flatnonzero(seen)


@dataclass(frozen=True)
class Model:
    bias: float
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        table = np.zeros(BUCKETS)
        table[self.buckets] = self.weights
        return np.array([1 / (1 + np.exp(-np.clip(self.bias + table[ngram_buckets(t)].sum(), -30, 30))) for t in texts])


def log_count_ratios(held: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket: the log of its smoothed share among toxic texts over that among the others, and its evidence: the ratio
    times the root of the texts that hold it."""
    counts = np.zeros((2, BUCKETS))
    for y, ids in zip(toxic, held, strict=True):
        counts[int(y), ids] += 1
    of = [(c + SMOOTHING) / (n + 2 * SMOOTHING) for c, n in ((counts[0], (toxic == 0).sum()), (counts[1], (toxic == 1).sum()))]
    ratio = np.log(of[1]) - np.log(of[0])
    return ratio, np.abs(ratio) * np.sqrt(counts.sum(axis=0))


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Newton's method, with a row's ``share`` as its weight; the last weight, the bias, has no penalty."""
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bent = share * np.maximum(p * (1 - p), 1e-6)
        curved = np.diag(penalty)
        for at in range(0, len(x), 256):  # by parts, which takes no second table
            part = x[at : at + 256]
            curved += (part * bent[at : at + 256, None]).T @ part
        step = np.linalg.solve(curved, x.T @ (share * (p - y)) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit(rows: DataFrame, key: str = "key", text: str = "text", label: str = "label", sample: int = SAMPLE) -> Model:
    """Learn from about ``sample`` rows of each label (1 toxic, 0 not), of any length (SAMPLE_BYTES bounds what they hold together).
    The classes weigh as they occur among all the rows.

    Rows that repeat key, text and label count once. Where a class has no row, the score is the share of toxic rows, kept within
    0.01 and 0.99, and 0.1 without any row: nothing then calls a text toxic."""
    measured = {"text_bytes", "text_hash"} <= set(rows.columns)
    size = F.col("text_bytes") if measured else F.octet_length(text)
    sign = F.col("text_hash") if measured else F.xxhash64(text)
    rows = rows.where(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(label).cast("int").alias("y"), F.coalesce(size, F.lit(0)).alias("b"), sign.alias("h"))
    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    chosen = per_class(rows, "y", sample, "k", "t", most_bytes=SAMPLE_BYTES, held="b", drawn_by="h")
    y = np.array([r.y for r in chosen], float)
    if len(set(y.tolist())) < 2:
        p = min(max(float(y.mean()), 0.01), 0.99) if len(y) else 0.1
        return Model(float(np.log(p / (1 - p))))
    held = [ngram_buckets(r.t).astype(np.int32) for r in chosen]
    ratio, evidence = log_count_ratios(held, y)
    top = np.sort(np.argsort(-evidence, kind="stable")[:FEATURES])
    place = np.full(BUCKETS, -1)
    place[top] = np.arange(len(top))
    x = np.zeros((len(y), len(top) + 1))
    x[:, -1] = 1
    for i, ids in enumerate(held):
        at = place[ids]
        x[i, at[at >= 0]] = ratio[top][at[at >= 0]]
    share = np.array([totals[int(v)] / (y == v).sum() for v in y])
    weights = _logistic(x, y, share / share.mean())
    return Model(float(weights[-1]), top, weights[:-1] * ratio[top])


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``into``, from 0 to 1, from the whole text; a null text, or one without an n-gram, gets the score of the bias.

    A column named ``into`` is replaced; all others pass as they are, repeated rows row by row. An empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()), dtype=float)

    return docs.withColumn(into, of(F.col(text).cast("string")))


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its key as text leaves 2 when divided by 4. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of ``sample.labelled`` that are not held out; a null text is one without n-grams."""
    return labelled(docs.where(~held_out(key)), labels, key, text, label)
