"""Dense vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nan


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """NaN for a vector of length 0."""
    length = norm(a) * norm(b)
    return F.when(length == 0, nan()).otherwise(dot(a, b) / length)


def semantic_similarity(a: Column, b: Column, threshold: float | None = None) -> Column:
    """The cosine, or with a threshold whether it is reached as 1.0 or 0.0. A threshold of 0 counts as none."""
    score = cosine(a, b)
    return (score >= threshold).cast("double") if threshold else score


def answer_relevancy(question: Column, generated: Column, noncommittal: Column, empty: float = float("nan")) -> Column:
    """The mean cosine of the generated questions' vectors with the question's, or 0 if all are noncommittal."""
    total = F.aggregate(generated, F.lit(0.0), lambda s, g: s + cosine(question, g))
    mean = total / F.size(generated)
    return F.when(F.size(generated) == 0, F.lit(empty)).otherwise(mean * (~F.forall(noncommittal, lambda x: x == 1)).cast("double"))
