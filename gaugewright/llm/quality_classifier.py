"""Quality classification by compression.

Two zstandard dictionaries are trained, on good and on bad labelled texts. A text is compressed with each in blocks; if the good
dictionary serves it better, it looks like the good texts. The normalised difference of the compressed sizes and its length go
through a logistic calibration fitted on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import labelled, per_class

#: Labelled texts of each class that the fit takes, about, whatever their lengths.
SAMPLE = 1500
DICT_BYTES = 64_000
BLOCK_BYTES = 1_500
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scores(self, texts) -> np.ndarray:  # noqa: ANN001
        return 1 / (1 + np.exp(-np.clip(features(texts, self.good, self.bad) @ np.array(self.weights), -30, 30)))


def _compressor(words: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_AUTO)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def features(texts, good: bytes, bad: bytes) -> np.ndarray:  # noqa: ANN001
    """Of each text: (bad - good) / (bad + good) over its compressed blocks, the share of bytes that stay, and 1."""
    a, b = _compressor(good), _compressor(bad)
    out = np.zeros((len(texts), 3))
    for i, t in enumerate(texts):
        raw = t.encode() if t else b""
        g = w = 0
        for at in range(0, len(raw), BLOCK_BYTES):
            block = raw[at : at + BLOCK_BYTES]
            g += len(a.compress(block))
            w += len(b.compress(block))
        out[i] = (10 * (w - g) / (w + g), min(g, w) / len(raw), 1) if raw else (0, 0.5, 1)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method; both classes weigh as they are in the sample."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _dictionary(texts: list[str]) -> bytes:
    blocks = [raw[at : at + BLOCK_BYTES] for t in texts for raw in [t.encode()] for at in range(0, len(raw), BLOCK_BYTES)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few texts: their bytes are the dictionary
        return b"".join(blocks)[-DICT_BYTES:] or b" "


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from about ``sample`` rows of each label (1 good, 0 bad) with a text that is not empty, of any length
    (``sample.BYTES`` bounds what they hold together).

    Half of them make the dictionaries, half the calibration. Rows that repeat key, text and label count once. Where a class has no such row, the score is the share of
    good rows, or one half without any."""
    measured = {"text_bytes", "text_hash"} <= set(rows.columns)
    size = F.col("text_bytes") if measured else F.octet_length(text)
    sign = F.col("text_hash") if measured else F.xxhash64(text)
    rows = rows.where(F.col(label).isin(0, 1) & (size > 0)).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("int").alias("y"), size.alias("b"), sign.alias("h"))
    texts: dict[int, list[str]] = {0: [], 1: []}
    for r in per_class(rows, "y", sample, "k", "t", held="b", drawn_by="h"):
        texts[r.y].append(r.t)
    if min(len(texts[0]), len(texts[1])) < 2:
        n = len(texts[0]) + len(texts[1])
        p = min(max(len(texts[1]) / n if n else 0.5, 0.01), 0.99)
        return Model(b" ", b" ", (0.0, 0.0, float(np.log(p / (1 - p)))))
    good, bad = _dictionary(texts[1][::2]), _dictionary(texts[0][::2])
    held = texts[1][1::2] + texts[0][1::2]
    y = np.array([1.0] * len(texts[1][1::2]) + [0.0] * len(texts[0][1::2]))
    return Model(good, bad, tuple(_logistic(features(held, good, bad), y).tolist()))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``into``, from 0 to 1, from the whole text; a null or empty text has no size and gets the score of a difference of 0.

    A column named ``into`` is replaced; all others pass as they are, repeated rows row by row. An empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return docs.withColumn(into, of(F.col(text).cast("string")))


def held_out(key: str = "doc_id"):  # noqa: ANN201
    """Whether a row is kept from learning: crc32 of its key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``sample.labelled`` that have a text and are not held out."""
    return labelled(docs.where(~held_out(key)), labels, key, text, label).where("text_bytes > 0")
