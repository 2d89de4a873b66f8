"""Align a judge with people's labels, and pick the best of several prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import agreement, mse
from ..operators.pairs import nearest
from ..operators.sampling import top_k, train_test_split
from ..sources.shared import written


def few_shot_examples(queries: DataFrame, examples: DataFrame, k: int = 3, threshold: float = 0.0) -> DataFrame:
    """(query_id, example_id, similarity, rank): the k nearest examples of each query by cosine, at or above the threshold."""
    q = queries.select(F.col("query_id").alias("id"), F.col("embedding").alias("v"))
    e = examples.select(F.col("example_id").alias("id"), F.col("embedding").alias("v"))
    found = nearest(q, e, k).withColumnRenamed("row_id", "example_id").withColumn("_s", F.round("similarity", 12))
    return top_k(found, "query_id", "_s", k, "example_id", threshold).drop("_s")


def examples_with_fallback(queries: DataFrame, examples: DataFrame, k: int = 3, threshold: float = 0.7) -> DataFrame:
    """Like ``few_shot_examples``; a query without a vector, or without an example that is near enough, gets the k latest
    examples (those of the highest ids), with a null similarity."""
    found = few_shot_examples(queries.where("embedding is not null"), examples, k, threshold)
    rest = queries.select("query_id").join(found.select("query_id").distinct(), "query_id", "left_anti")
    last = examples.select("example_id").orderBy(F.desc("example_id")).limit(k).collect()  # k rows
    if not last:
        return found
    backup = F.array(*[F.struct(F.lit(r["example_id"]).alias("example_id"), F.lit(None).cast("double").alias("similarity"), F.lit(i).alias("rank")) for i, r in enumerate(last, 1)])
    return found.unionByName(rest.select("query_id", F.inline(backup)))


def align(annotated: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame], key: str, gold: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Split, score the test part with examples from the train part (``score(test, train)`` adds ``pred``), and give agreement and kappa."""
    train, test = train_test_split(annotated, test_size, key, seed)
    return agreement(score(test, train), gold, "pred")


def align_numeric(annotated: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame], key: str, gold: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """The same for numbers: Pearson correlation and mean squared error of ``pred`` and ``gold``."""
    train, test = train_test_split(annotated, test_size, key, seed)
    return score(test, train).agg(F.corr(gold, "pred").alias("pearson"), mse(F.col(gold), F.col("pred")).alias("mse"))


def optimised(seeds: list[str], losses: Callable[[list[str]], DataFrame], rewrite: Callable[[str, str | None], str], rounds: int = 3, higher_is_better: bool = True, least: int = 10) -> tuple[str, float]:
    """A genetic search for an instruction: (the best, its value). ``losses`` scores candidates over the annotated rows: (candidate, row,
    value), one Spark job a round. The better half stays; each survivor is rewritten alone (mutation) and with the survivor whose
    results differ most from its own (crossover)."""
    pool = list(dict.fromkeys(seeds))
    for turn in range(rounds + 1):
        table = written(losses(pool), "losses")
        if turn == 0 and table.select("row").distinct().count() < least:
            raise ValueError(f"{least} annotated rows or more are needed")
        means = {r["candidate"]: r["value"] for r in table.groupBy("candidate").agg(F.avg("value").alias("value")).collect()}  # one row per candidate
        order = sorted(means, key=lambda c: (-means[c] if higher_is_better else means[c], c))
        if turn == rounds:
            return order[0], means[order[0]]
        kept = order[: max(1, len(order) // 2)]
        results = table.where(F.col("candidate").isin(kept)).groupBy("candidate").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: (x["value"] > 0).cast("int")).alias("results"))
        partners = {r["candidate"]: r["partner"] for r in farthest_partners(results).collect()} if len(kept) > 1 else {}
        pool = list(dict.fromkeys([*kept, *(rewrite(c, None) for c in kept), *(rewrite(c, partners.get(c)) for c in kept if c in partners)]))
    raise AssertionError


def best_candidate(losses: DataFrame, higher_is_better: bool) -> DataFrame:
    """(candidate, value) of the best mean; of equals the smaller name. The direction is explicit: accuracy rises, squared error falls."""
    means = losses.groupBy("candidate").agg(F.avg("value").alias("value"))
    sign = F.col("value") if higher_is_better else -F.col("value")
    return means.orderBy(F.desc(sign), "candidate").limit(1)


def farthest_partners(vectors: DataFrame) -> DataFrame:
    """(candidate, partner): for crossover, the other candidate whose 0/1 results differ in most places; of equals the smaller name."""
    other = vectors.select(F.col("candidate").alias("partner"), F.col("results").alias("_r"))
    differing = F.size(F.filter(F.zip_with("results", "_r", lambda a, b: a != b), lambda d: d))
    pairs = vectors.join(other, F.col("candidate") != F.col("partner")).withColumn("distance", differing)
    return top_k(pairs, "candidate", "distance", 1, "partner").select("candidate", "partner", "distance")
