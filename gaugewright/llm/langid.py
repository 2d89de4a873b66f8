"""Language identification with error-correcting output codes.

Each language has a codeword. For each bit a binary classifier over hashed character n-grams predicts whether a text's language has
it. Decoding takes the codeword of the least loss, each bit weighted by how well its classifier does on texts that are left out
of its fit, and flags texts whose two nearest codewords lie close together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import per_class

#: Texts of each language that the fit takes, about, whatever their lengths; and of all languages together.
SAMPLE = 400
SAMPLE_ROWS = 4000
BUCKETS = 1 << 13
RIDGE = 0.3
#: A text is ambiguous if the second language has more than this share of the first one's weight.
AMBIGUOUS = 0.5
UNKNOWN = "und"


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of the one- to three-letter sequences of the whole lower-cased text, scaled to length 1."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    x = np.zeros(BUCKETS)
    h = c
    for n in (1, 2, 3):
        if len(c) >= n:
            if n > 1:
                h = h[:-1] * np.uint64(1_000_003) + c[n - 1 :]
            mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            x += np.bincount((mixed >> np.uint64(51)).astype(np.int64), minlength=BUCKETS)
    x = np.sqrt(x)
    return x / max(np.linalg.norm(x), 1e-9)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1: all splits of up to 7 languages; beyond, the random code of the largest least distance out of 50."""
    if k <= 7:
        splits = [s for s in range(1, 1 << k) if s & 1 and s != (1 << k) - 1]
        return np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(k)]).reshape(k, -1)
    rng = np.random.default_rng(seed)
    codes = [rng.choice([-1, 1], (k, 15 * int(np.ceil(np.log2(k))))) for _ in range(50)]
    return max(codes, key=lambda c: min((c[i] != c[j]).sum() for i in range(k) for j in range(i)))


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    codes: np.ndarray | None = None
    weights: np.ndarray | None = None  # buckets x bits
    trust: np.ndarray | None = None  # of each bit

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language, its share of the decoding's weight, and whether it is ambiguous."""
        names, shares, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not self.langs or not rows:
            return names, shares, unsure
        if len(self.langs) == 1:
            for i in rows:
                names[i], shares[i] = self.langs[0], 1.0
            return names, shares, unsure
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            margins = np.stack([ngram_counts(texts[i]) for i in part]) @ self.weights
            loss = np.log1p(np.exp(-np.clip(4 * margins[:, None, :] * self.codes[None], -30, 30))) @ self.trust
            share = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * self.codes.shape[1])
            share /= share.sum(axis=1, keepdims=True)
            best = loss.argmin(axis=1)
            top = np.sort(share, axis=1)
            shares[part], unsure[part] = top[:, -1], top[:, -2] > AMBIGUOUS * top[:, -1]
            for i, b in zip(part, best.tolist(), strict=True):
                names[i] = self.langs[b]
        return names, shares, unsure


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from about ``sample`` rows of each language, fewer where all languages together would pass SAMPLE_ROWS (the driver
    solves a system of that size). Ridge regression for each bit; a bit's weight is its accuracy over one half on
    each row when this row is left out of the fit, which the inverse gives without fitting again.

    Rows without a language, and texts without a letter, teach nothing; rows that repeat key, text and language count once. Without rows every text is ``und``; with one language
    it is the answer for all."""
    rows = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("y"))
    rows = [r for r in per_class(rows, "y", sample, "k", "t", most_rows=SAMPLE_ROWS) if any(map(str.isalpha, r.t))]
    langs = sorted({r.y for r in rows})
    if len(langs) < 2:
        return Model(langs)
    codes = codewords(len(langs))
    x = np.stack([ngram_counts(r.t) for r in rows])
    y = codes[[langs.index(r.y) for r in rows]].astype(float)
    inverse = np.linalg.inv(x @ x.T + RIDGE * np.eye(len(x)))
    dual = inverse @ y
    left_out = y - dual / np.diag(inverse)[:, None]
    trust = np.maximum((np.sign(left_out) == y).mean(axis=0) - 0.5, 0.01)
    return Model(langs, codes, x.T @ dual, trust / trust.sum())


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` of every row, from its whole text.

    A null text, or one without a letter, is ``und`` with score 0. Repeated rows and null keys pass row by row, an empty table
    gives an empty one, and other columns, whatever their names, are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, shares, unsure = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(shares), pa.array(unsure)], ["key", "lang_pred", "score", "ambiguous"])

    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, f"key {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("key", key)
