"""Samples, splits, batches and top-k, all reproducible: rows are ordered by a hash of their key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


#: Rows that one task ranks, about.
RANKED_TOGETHER = 50_000


def shuffled(key: str, seed: int = 42) -> Column:
    """A fixed random order of keys, the same in SQL: md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows; more than there are is an error."""
    if n > df.count():
        raise ValueError(f"{n} rows are asked for, the table has fewer")
    return df.orderBy(shuffled(key, seed), key).limit(n)


def per_group(df: DataFrame, group: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows of each group. Each partition first keeps its own n rows of a group, so a large group does not meet whole."""
    order = [shuffled(key, seed), F.col(key)]
    parts = df.withColumn("_part", F.spark_partition_id())
    local = parts.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))).where(F.col("_r") <= n)
    return local.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r", "_part")


def stratified_sample(df: DataFrame, n: int, group: str, key: str, seed: int = 42) -> DataFrame:
    """Per class its share of ``n``, rounded half to even and capped at the class; then random rows up to ``n``. Rounding may pass ``n``. The
    classes' sizes are a table that the rows are joined with, however many classes there are."""
    counts = written(df.groupBy(F.col(group).alias("_class")).agg(F.count("*").alias("_n")), "classes")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    if n > total:
        raise ValueError(f"{n} rows are asked for, the table has {total}")
    quota = counts.select("_class", F.least(F.col("_n"), F.bround(F.lit(n) * F.col("_n") / F.lit(total)).cast("long")).alias("_take"))
    taken = quota.agg(F.sum("_take")).first()[0] or 0
    ranked = global_rank(df, shuffled(key, seed), key, group)
    ranked = ranked.join(quota, F.col(group).eqNullSafe(F.col("_class"))).drop("_class")
    chosen = ranked.where("_rank < _take")
    if taken < n:
        rest = ranked.where("_rank >= _take").orderBy(shuffled(key, seed), key).limit(n - taken)
        chosen = chosen.unionByName(rest)
    return chosen.drop("_rank", "_take")


def global_rank(df: DataFrame, order: Column, key: str, by: str | None = None) -> DataFrame:
    """``df`` with ``_rank`` from 0 in the order of a hex hash, over all rows or within each ``by``. Rows are ranked within a bucket of
    the hash's first digits, as many as keep a bucket at RANKED_TOGETHER rows, about; the buckets' sizes before it are added."""
    digits, n = 2, df.count() // RANKED_TOGETHER
    while 16**digits < n:
        digits += 1
    group = F.col(by) if by else F.lit(0)
    keyed = df.withColumns({"_order": order, "_by": group}).withColumn("_bucket", F.substring("_order", 1, digits))
    before = Window.partitionBy("_by").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("_by", "_bucket").agg(F.count("*").alias("_n"))
    sizes = sizes.select(F.col("_by").alias("_by2"), F.col("_bucket").alias("_bucket2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_by", "_bucket").orderBy("_order", key)) - 1
    ranked = keyed.withColumn("_in", within).join(sizes, (F.col("_bucket") == F.col("_bucket2")) & F.col("_by").eqNullSafe(F.col("_by2")))
    return ranked.withColumn("_rank", (F.col("_in") + F.col("_before")).cast("long")).drop("_order", "_by", "_bucket", "_by2", "_bucket2", "_before", "_in")


def class_shares(df: DataFrame, label: str) -> DataFrame:
    """``label``, ``n`` and ``share``: how many rows each class has, null as one of them, and its part of all."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("n") / F.col("_all")).alias("share"))


def train_test_split(df: DataFrame, test_size: float, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The first int(n * (1 - test_size)) rows of the shuffled table, and the others."""
    ranked = global_rank(df, shuffled(key, seed), key)
    cut = int(df.count() * (1 - test_size))
    return ranked.where(F.col("_rank") < cut).drop("_rank"), ranked.where(F.col("_rank") >= cut).drop("_rank")


def batches(df: DataFrame, size: int, key: str, seed: int = 42, drop_last: bool = False) -> DataFrame:
    """``df`` with ``batch``: shuffled rows in runs of ``size``."""
    ranked = global_rank(df, shuffled(key, seed), key).withColumn("batch", F.floor(F.col("_rank") / size))
    if drop_last:
        ranked = ranked.where(F.col("batch") < df.count() // size)
    return ranked.drop("_rank")


def stratified_batches(df: DataFrame, n_batches: int, group: str, key: str, seed: int = 42) -> DataFrame:
    """``df`` with ``batch``: each class dealt round robin, so every batch has its share."""
    ranked = global_rank(df, shuffled(key, seed), key, group)
    return ranked.withColumn("batch", F.pmod("_rank", F.lit(n_batches))).drop("_rank")


def proportional_batches(df: DataFrame, size: int, group: str, key: str, seed: int = 42, drop_last: bool = False, refill: bool = False) -> DataFrame:
    """``df`` with ``batch``: shuffled rows in runs of ``size``, every run with each class's share of the table, to within one row.
    A last run of fewer rows is left out with ``drop_last``; with ``refill`` the first rows fill it, and stand twice.

    Row r of a class of n rows stands at (2 r + 1) / (2 n) of the way (to 18 places), of equals the smaller class first. These stands are spread
    evenly, so rows are ranked within equal stretches of the way, of RANKED_TOGETHER rows about, and the stretches' sizes are added."""
    counts = written(df.groupBy(F.col(group).alias("_class")).agg(F.count("*").alias("_n")), "classes")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    ranked = global_rank(df, shuffled(key, seed), key, group).join(counts, F.col(group).eqNullSafe(F.col("_class"))).drop("_class")
    stands = F.expr("((2 * _rank + 1) * CAST(1000000000000000000 AS DECIMAL(19, 0))) div CAST(2 * _n AS DECIMAL(18, 0))")
    stretch = F.call_function("div", F.col("_stands"), F.lit(10**18 // max(1, total // RANKED_TOGETHER) + 1))
    placed = ranked.withColumn("_stands", stands).withColumn("_stretch", stretch)
    sizes = placed.groupBy("_stretch").agg(F.count("*").alias("_k"))
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row for each stretch
    sizes = sizes.select("_stretch", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_stretch").orderBy("_stands", group, "_rank")) - 1
    placed = placed.withColumn("_in", within).join(sizes, "_stretch")
    dealt = placed.withColumn("_place", F.col("_in") + F.col("_before")).withColumn("batch", F.floor(F.col("_place") / size))
    dealt = dealt.drop("_stands", "_stretch", "_in", "_before", "_n")
    last = total // size
    if drop_last:
        dealt = dealt.where(F.col("batch") < last)
    elif refill and 0 < total % size and total >= size:
        dealt = dealt.unionByName(dealt.where(F.col("_place") < size - total % size).withColumn("batch", F.lit(last).cast("long")))
    return dealt.drop("_rank", "_place")


def top_k(scored: DataFrame, group: str, score: str, k: int, tie: str, least: float | None = None) -> DataFrame:
    """The k rows of the highest score per group with ``rank``; ties to the smaller ``tie``; only scores of ``least`` or more."""
    if least is not None:
        scored = scored.where(F.col(score) >= least)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def keep_first(df: DataFrame, by: str, order: str) -> DataFrame:
    """Of rows with equal ``by`` the one of the least ``order``. The minima are partial aggregates; a hot value is not sorted."""
    least = df.groupBy(by).agg(F.min(order).alias("_least")).withColumnRenamed(by, "_by")
    return df.join(least, F.col(by).eqNullSafe(F.col("_by")) & (F.col(order) == F.col("_least"))).drop("_by", "_least")
