"""Summaries, comparisons and agreement. Each is one or two partial aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

NAN = float("nan")


def nan_mean(c: Column | str) -> Column:
    """The mean without nulls and NaN; NaN if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.avg(F.when(~F.isnan(c), c)), F.lit(NAN))


def summary(scores: DataFrame, metrics: list[str], by: list[str] | None = None, rollup: bool = False) -> DataFrame:
    """The NaN-mean of each metric, overall, by slices, or by slices and overall in one pass."""
    means = [nan_mean(m).alias(m) for m in metrics]
    if not by:
        return scores.agg(*means)
    return (scores.rollup(*by) if rollup else scores.groupBy(*by)).agg(*means)


def baseline_gate(current: DataFrame, baseline: DataFrame, key: str, value: str, tolerance: float = 0.01) -> DataFrame:
    """Per key: current, baseline, delta, and whether it passes: better, or within the tolerance. A key without baseline has none of the last two."""
    a = current.select(key, F.col(value).alias("current"))
    b = baseline.select(F.col(key).alias("_key"), F.col(value).alias("baseline"))
    delta = F.col("current") - F.col("baseline")
    return a.join(b, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "current", "baseline", delta.alias("delta"), ((delta > 0) | (F.abs(delta) < tolerance)).alias("passed"))


def category_delta(current: DataFrame, baseline: DataFrame, category: str) -> DataFrame:
    """Counts per category on both sides and their difference; a category that a side lacks counts 0."""
    a = current.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("current"))
    b = baseline.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("_category")).agg(F.count("*").alias("baseline"))
    both = a.join(b, F.col(category) == F.col("_category"), "full_outer")
    both = both.select(F.coalesce(category, "_category").alias(category), F.coalesce("current", F.lit(0)).alias("current"), F.coalesce("baseline", F.lit(0)).alias("baseline"))
    return both.withColumn("delta", F.col("current") - F.col("baseline"))


def majority_vote(votes: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """The commonest value per key; of equals the one seen first."""
    counted = votes.groupBy(key, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counted.groupBy(key).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col("first"))).alias(value))


def token_usage(usage: DataFrame) -> DataFrame:
    return usage.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per priced model; the output price defaults to the input price."""
    p = prices.select(F.col("model").alias("_model"), "input_price", F.coalesce("output_price", "input_price").alias("output_price"))
    total = F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")
    return token_usage(usage).join(p, F.col("model") == F.col("_model")).select("model", "input_tokens", "output_tokens", total.alias("cost"))


# Where providers keep token counts and model names in their replies.
USAGE_PATHS = {
    "openai": (("token_usage.prompt_tokens",), ("token_usage.completion_tokens",), ("model_name",)),
    "anthropic": (("usage.input_tokens",), ("usage.output_tokens",), ("model",)),
    "bedrock": (("usage.prompt_tokens",), ("usage.completion_tokens",), ("model_id",)),
    "azure": (("token_usage.prompt_tokens", "usage.input_tokens"), ("token_usage.completion_tokens", "usage.output_tokens"), ("model_name",)),
}


def parsed_usage(reply: Column, provider: str) -> Column:
    """struct(input_tokens, output_tokens, model) of a provider's reply in JSON, which is parsed once, as a VARIANT; a missing count is 0, a
    missing model empty, as is all of a reply that is null or no JSON."""
    taken, given, name = USAGE_PATHS[provider]

    def found(v: Column, paths: tuple[str, ...], kind: str, default: Column) -> Column:
        return F.coalesce(*[F.try_variant_get(v, f"$.{p}", kind) for p in paths], default)

    def usage(v: Column) -> Column:
        zero = F.lit(0).cast("long")
        return F.struct(found(v, taken, "long", zero).alias("input_tokens"), found(v, given, "long", zero).alias("output_tokens"), found(v, name, "string", F.lit("")).alias("model"))

    return F.get(F.transform(F.array(F.try_parse_json(reply)), usage), F.lit(0))


def mse(pred: Column, actual: Column, reduction: str = "mean") -> Column:
    squared = F.pow(pred - actual, F.lit(2))
    return F.avg(squared) if reduction == "mean" else F.sum(squared)


def binary_scores(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """accuracy, precision, recall and f1 of labels 0 and 1; 0 without ground."""
    g, p = F.col(gold) == 1, F.col(pred) == 1
    n = lambda c: F.sum(c.cast("long"))
    counts = df.agg(n(g & p).alias("tp"), n(~g & p).alias("fp"), n(g & ~p).alias("fn"), F.avg((F.col(gold) == F.col(pred)).cast("double")).alias("accuracy"))
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("accuracy", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def agreement(df: DataFrame, gold: str, pred: str, weights: str | None = None) -> DataFrame:
    """agreement rate and Cohen's kappa (unweighted, or ``quadratic`` for numeric ranks) from the confusion counts."""
    cells = df.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").cast("double").alias("n"))
    n, g, p = F.col("n"), F.col("g"), F.col("p")
    if weights is None:
        sums = cells.agg(F.sum("n").alias("total"), F.sum(F.when(g != p, n).otherwise(0.0)).alias("off"), F.sum(F.when(g == p, n).otherwise(0.0)).alias("same"))
        sides = cells.select(g.alias("label"), n.alias("a"), F.lit(0.0).alias("b")).union(cells.select(p, F.lit(0.0), n))
        agreed = sides.groupBy("label").agg((F.sum("a") * F.sum("b")).alias("ab")).agg(F.coalesce(F.sum("ab"), F.lit(0.0)).alias("ab"))
        one = sums.join(agreed, F.lit(True)).withColumn("chance", F.col("total") * F.col("total") - F.col("ab"))  # two rows of one row each
    else:  # the sum over all pairs of (g - p) squared, from moments
        moments = {"total": n, "off": F.pow(g - p, F.lit(2)) * n, "same": F.when(g == p, n).otherwise(0.0), "g1": g * n, "g2": g * g * n, "p1": p * n, "p2": p * p * n}
        one = cells.agg(*[F.sum(c.cast("double")).alias(k) for k, c in moments.items()])
        one = one.withColumn("chance", F.col("g2") * F.col("total") - 2 * F.col("g1") * F.col("p1") + F.col("p2") * F.col("total"))
    kappa = F.when(F.col("chance") == 0, F.lit(1.0)).otherwise(1 - F.col("off") * F.col("total") / F.col("chance"))
    return one.select((F.col("same") / F.col("total")).alias("agreement"), kappa.alias("kappa"))


def length_histogram(df: DataFrame, n_tokens: Column) -> DataFrame:
    """Shares of short (up to 100 tokens), middle (to 500) and long texts."""
    n = n_tokens
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return df.agg(share(n <= 100).alias("short"), share((n > 100) & (n <= 500)).alias("middle"), share(n > 500).alias("long"))


def frequent_items(items: DataFrame, item: str, share: float = 0.05) -> DataFrame:
    """The commonest ``share`` of the different items (one at least) with their counts; of equals the smaller item.

    The cutoff is a count: items above it are kept without ranking, and of those at it the smallest, by one sort with a limit."""
    counts = written(items.groupBy(item).agg(F.count("*").alias("n")), "counts")
    sizes = counts.groupBy("n").agg(F.count("*").alias("k"))  # one row for each different count
    ranked = sizes.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("most", F.greatest(F.lit(1), F.floor(F.sum("k").over(Window.partitionBy()) * share)))
    cut = ranked.where("before < most").orderBy("n").first()
    if cut is None:
        return counts.limit(0)
    if cut["before"] + cut["k"] <= cut["most"]:
        return counts.where(F.col("n") >= cut["n"])
    at = counts.where(F.col("n") == cut["n"]).orderBy(item).limit(cut["most"] - cut["before"])
    return counts.where(F.col("n") > cut["n"]).union(at)


def mean_rank_agreement(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """The mean over rows of the quadratic kappa of two rank arrays."""
    pairs = F.arrays_zip(F.col(gold).alias("g"), F.col(pred).alias("p"))
    n = F.size(gold)
    sq = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    off = sq(F.transform(pairs, lambda z: F.pow(z["g"] - z["p"], F.lit(2)).cast("double")))
    chance = sq(F.flatten(F.transform(F.col(gold), lambda g: F.transform(F.col(pred), lambda p: F.pow(g - p, F.lit(2)).cast("double")))))
    return df.select(F.when(chance == 0, F.lit(1.0)).otherwise(1 - off * n / chance).alias("k")).agg(F.avg("k").alias("kappa"))


def compare_experiments(tables: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """One row per id with each experiment's value. Repeated ids or different sets of ids are an error."""
    long = reduce(DataFrame.unionByName, [df.select(F.col(key), F.col(value).alias("v"), F.lit(name).alias("experiment")) for name, df in tables.items()])
    wide = long.groupBy(key).agg(F.count("*").alias("n"), *[F.count(F.when(F.col("experiment") == name, 1)).alias(f"n {name}") for name in tables], *[F.max(F.when(F.col("experiment") == name, F.col("v"))).alias(name) for name in tables])
    odd = reduce(lambda a, b: a | b, [F.col(f"`n {name}`") != 1 for name in tables])
    checked = F.when(odd, F.raise_error(F.concat(F.lit("an id is repeated or missing in an experiment: "), F.col(key).cast("string"))).cast("string"))
    return wide.withColumn("_checked", checked).where("_checked is null").select(key, *tables)


def named_with_mode(name: str, mode: str | None) -> str:
    """The key of a score in a result: ``name``, with its mode if it has one."""
    return f"{name}(mode={mode})" if mode else name


def validation_summary(checks: DataFrame, ok: str = "valid", reason: str = "error") -> DataFrame:
    """Of checked queries: how many, how many are valid, their share, and the kinds of the others' reasons (what stands before the first colon)
    with their counts. The messages themselves, of which there may be as many as rows, are counted by ``error_kinds`` alone."""
    reasons = error_kinds(checks, ok, reason)
    listed = reasons.agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("k"), F.col("kind").alias("reason")))).alias("reasons"))  # one row for each kind
    totals = checks.agg(F.count("*").alias("total"), F.count(F.when(F.col(ok), 1)).alias("valid"))
    return totals.join(listed, F.lit(True)).select("total", "valid", F.when(F.col("total") > 0, F.col("valid") / F.col("total")).alias("share"), "reasons")


def validation_slices(checks: DataFrame, by: str, ok: str = "valid", seconds: str = "seconds") -> DataFrame:
    """Total, valid, their share and the mean of the known times of each value of ``by``, and of all with null for it.
    An empty table has none of them."""
    held = checks.rollup(by).agg(F.count("*").alias("total"), F.count(F.when(F.col(ok), 1)).alias("valid"), F.avg(seconds).alias("seconds"), F.grouping(by).alias("all_"))
    return held.select(by, (F.col("all_") == 1).alias("overall"), "total", "valid", (F.col("valid") / F.col("total")).alias("share"), "seconds")


def error_kinds(checks: DataFrame, ok: str = "valid", reason: str = "error") -> DataFrame:
    """(kind, n): the invalid rows by what their reason says before its first colon."""
    return checks.where(~F.col(ok)).groupBy(F.substring_index(reason, ":", 1).alias("kind")).agg(F.count("*").alias("n"))


def label_set_scores(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Of rows with sets of labels (arrays): whether they are equal, and the F1 of each; order and repeats do not count."""
    tp = F.size(F.array_intersect(gold, pred))
    a, b = F.size(F.array_distinct(gold)), F.size(F.array_distinct(pred))
    return df.withColumns({"exact": ((tp == a) & (tp == b)).cast("double"), "f1": F.when(a + b == 0, F.lit(1.0)).otherwise(2 * tp / (a + b))})


def labels_match(prediction: Column, expected: Column) -> Column:
    """1 if the ``labels`` of a prediction in JSON are the expected ones (a list with ``;``), whatever their order; blanks around and empty parts do
    not count. 0 for what is no JSON or has no labels."""
    told = F.from_json(prediction, "labels array<string>")["labels"]
    clean = lambda a: F.array_sort(F.array_distinct(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")))
    return F.coalesce((clean(told) == clean(F.split(expected, ";"))).cast("double"), F.lit(0.0))


def field_match(prediction: Column, field: str, expected: Column) -> Column:
    """1 if a field of a prediction in JSON is the expected text, else 0."""
    return F.coalesce((F.try_variant_get(F.try_parse_json(prediction), f"$.{field}", "string") == expected).cast("double"), F.lit(0.0))
