"""Model calls as a Spark step: equal requests are made once, answered ones come from a cache table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ModelClient(Protocol):
    """Answers prompts; made anew in each task by a factory, so it need not be sent around."""

    def complete(self, prompts: list[str]) -> list[str]: ...


class EchoModel:
    """A deterministic stand-in: the reply is the last line of the prompt."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [p.rsplit("\n", 1)[-1] for p in prompts]


class HashEmbedding:
    """A deterministic stand-in: hashed letter triples as a unit vector."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        import numpy as np

        out = []
        for t in texts:
            v = np.zeros(self.size)
            t = f"  {t.lower()} "
            for i in range(len(t) - 2):
                h = zlib.crc32(t[i : i + 3].encode())
                v[h % self.size] += 1 if h >> 31 else -1
            out.append((v / max(np.linalg.norm(v), 1e-9)).tolist())
        return out


def with_request_hash(requests: DataFrame, prompt: str = "prompt", model: str = "") -> DataFrame:
    return requests.withColumn("request_hash", F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), F.col(prompt).alias("prompt"))).cast("binary"), 256))


def answer(requests: DataFrame, factory: Callable[[], ModelClient], cache: DataFrame | None = None, prompt: str = "prompt", model: str = "", retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """(requests with ``reply`` and ``error``, new cache rows). ``cache`` has request_hash and reply.

    Each different prompt goes to the model once, and only if the cache lacks it. A batch that fails is tried again and then becomes
    errors, never a failed job. Write the new rows before use, else a later read calls the model again."""
    keyed = with_request_hash(requests, prompt, model)
    distinct = keyed.select("request_hash", F.col(prompt).alias("prompt")).dropDuplicates(["request_hash"])
    if cache is not None:
        distinct = distinct.join(cache.select("request_hash"), "request_hash", "left_anti")

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in frames:
            replies, error = [None] * len(pdf), None
            for _ in range(retries + 1):
                try:
                    replies, error = client.complete(pdf["prompt"].tolist()), None
                    break
                except Exception as e:  # noqa: BLE001 - any failure of the service is a row's error
                    error = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"request_hash": pdf["request_hash"], "reply": replies, "error": error})

    return keyed, distinct.mapInPandas(call, "request_hash string, reply string, error string")


def with_replies(keyed: DataFrame, answers: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    known = answers if cache is None else answers.unionByName(cache.select("request_hash", "reply", F.lit(None).cast("string").alias("error")))
    return keyed.join(known, "request_hash", "left")


def embedded(df: DataFrame, text: str, factory: Callable[[], HashEmbedding] = HashEmbedding, into: str = "embedding") -> DataFrame:
    """``df`` with the vector of a text; a blank text counts as a single space."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = factory()
        for texts in batches:
            yield pd.Series(client.embed([t if t and t.strip() else " " for t in texts]))

    return df.withColumn(into, of(F.col(text)))
