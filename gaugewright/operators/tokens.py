"""Token counts and token windows by a public tokenizer, whose file's path is a parameter."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def _tokenizer(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_count(text: Column, path: str) -> Column:
    """The tokens of a text; 0 for null."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        encoded = _tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
        return pd.Series([len(e.ids) for e in encoded], dtype="int64")

    return of(text)


def token_windows(df: DataFrame, path: str, size: int, overlap: int = 0, text: str = "text") -> DataFrame:
    """``df`` with ``pos`` and ``chunk`` of ``splitters.TokenWindows``."""
    from .splitters import table_function

    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    cut = table_function("token_windows")(F.col(text).outer(), F.lit(path), F.lit(size), F.lit(overlap))
    return df.lateralJoin(cut)
