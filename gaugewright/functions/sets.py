"""Set, rank and rate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nan


def _share(hits: Column, of: Column) -> Column:
    return F.when(F.coalesce(of, F.lit(0)) == 0, nan()).otherwise(hits / of)


def id_precision(retrieved: Column, reference: Column) -> Column:
    """The share of different retrieved ids that are reference ids; NaN without retrieved ids."""
    got = F.array_distinct(F.transform(F.coalesce(retrieved, F.array()), lambda x: x.cast("string")))
    want = F.transform(F.coalesce(reference, F.array()), lambda x: x.cast("string"))
    return _share(F.size(F.array_intersect(got, want)), F.size(got))


def id_recall(retrieved: Column, reference: Column) -> Column:
    """The share of different reference ids that were retrieved; NaN without reference ids."""
    return id_precision(reference, retrieved)


def jaccard(a: Column, b: Column) -> Column:
    """Common over all members; two empty sets score 0."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    """0 where precision or recall has no ground."""
    precision = F.when(tp + fp == 0, F.lit(0.0)).otherwise(tp / (tp + fp))
    recall = F.when(tp + fn == 0, F.lit(0.0)).otherwise(tp / (tp + fn))
    weighed = beta**2 * precision + recall
    return F.when(weighed == 0, F.lit(0.0)).otherwise((1 + beta**2) * precision * recall / weighed)


def average_precision(verdicts: Column) -> Column:
    """Of an array of 0 and 1 in rank order: the mean of the precision at each hit, over the hits plus 1e-10."""
    hits = F.transform(verdicts, lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(0.0).alias("total"), F.lit(0).alias("rank"))

    def step(acc: Column, v: Column) -> Column:
        seen, rank = acc["seen"] + v, acc["rank"] + 1
        return F.struct(seen.alias("seen"), (acc["total"] + v * seen / rank).alias("total"), rank.alias("rank"))

    return F.aggregate(hits, start, step, lambda acc: acc["total"] / (acc["seen"] + F.lit(1e-10)))


def entity_recall(reference: Column, found: Column, count_repeats: bool = False) -> Column:
    """Common entities over those of the reference plus 1e-8; with ``count_repeats`` repeated reference entities count each time."""
    base = F.size(reference) if count_repeats else F.size(F.array_distinct(reference))
    return F.size(F.array_intersect(reference, found)) / (base + F.lit(1e-8))
