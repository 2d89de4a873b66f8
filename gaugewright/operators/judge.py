"""Reducers of judge metrics: verdict tables in long form become one score per row. Each is one grouping by row, or two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")


def supported_share(verdicts: DataFrame, row: str = "row_id", verdict: str = "verdict") -> DataFrame:
    """Faithfulness and context recall: the share of statements with verdict 1. A row without statements is not in the table: NaN after the left join."""
    return verdicts.groupBy(row).agg(F.avg(F.col(verdict).cast("double")).alias("score"))


def context_precision(verdicts: DataFrame, row: str = "row_id", position: str = "ctx_pos", verdict: str = "verdict") -> DataFrame:
    """Average precision by rank: the sum of the precision at each useful context over their number plus 1e-10."""
    w = Window.partitionBy(row).orderBy(position)
    at = verdicts.withColumn("_seen", F.sum(verdict).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rank", F.row_number().over(w))
    return at.groupBy(row).agg((F.sum(F.col(verdict) * F.col("_seen") / F.col("_rank")) / (F.sum(verdict) + F.lit(1e-10))).alias("score"))


def answer_correctness(classes: DataFrame, similarity: DataFrame, weights: tuple[float, float] = (0.75, 0.25), beta: float = 1.0, row: str = "row_id") -> DataFrame:
    """The weighed mean of the F-score of statements classed TP, FP and FN, and the answer's similarity."""
    n = lambda c: F.count(F.when(F.col("class") == c, 1))
    counts = classes.groupBy(row).agg(n("TP").alias("tp"), n("FP").alias("fp"), n("FN").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f = F.when(tp == 0, F.lit(0.0)).otherwise((1 + beta**2) * tp / ((1 + beta**2) * tp + beta**2 * fn + fp))
    score = (weights[0] * f + weights[1] * F.coalesce("similarity", F.lit(0.0))) / sum(weights)
    return counts.join(similarity.select(row, "similarity"), row, "left").select(row, score.alias("score"))


def factual_correctness(claims: DataFrame, mode: str = "f1", beta: float = 1.0, row: str = "row_id") -> DataFrame:
    """Claims of the response (direction ``response``: supported 1 is TP, else FP) and of the reference (unsupported is FN), to two places."""
    n = lambda c: F.count(F.when(c, 1))
    own, other = F.col("direction") == "response", F.col("direction") == "reference"
    counts = claims.groupBy(row).agg(n(own & (F.col("verdict") == 1)).alias("tp"), n(own & (F.col("verdict") == 0)).alias("fp"), n(other & (F.col("verdict") == 0)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    eps = F.lit(1e-8)
    p, r = tp / (tp + fp + eps), tp / (tp + fn + eps)
    f = F.when(p + r == 0, F.lit(0.0)).otherwise((1 + beta**2) * p * r / (beta**2 * p + r))
    return counts.select(row, F.bround({"precision": p, "recall": r, "f1": f}[mode], 2).alias("score"))


def noise_sensitivity(verdicts: DataFrame, correct: DataFrame, mode: str = "relevant", row: str = "row_id") -> DataFrame:
    """The share of wrong answer statements that relevant (or only irrelevant) contexts support.

    ``verdicts``: row, ctx_pos, stmt_pos, side (``answer`` or ``reference``), verdict; ``correct``: row, stmt_pos, correct."""
    relevant = verdicts.where("side = 'reference'").groupBy(row, "ctx_pos").agg(F.max("verdict").alias("relevant"))
    answer = verdicts.where("side = 'answer'").join(relevant, [row, "ctx_pos"], "left")
    by = answer.groupBy(row, "stmt_pos").agg(
        F.max(F.when(F.col("relevant") == 1, F.col("verdict")).otherwise(0)).alias("by_relevant"),
        F.max(F.when(F.coalesce("relevant", F.lit(0)) == 0, F.col("verdict")).otherwise(0)).alias("by_other"),
    )
    both = correct.join(by, [row, "stmt_pos"], "left").fillna(0, ["by_relevant", "by_other"])
    hit = (F.col("by_relevant") == 1) if mode == "relevant" else (F.col("by_other") == 1) & (F.col("by_relevant") == 0)
    return both.groupBy(row).agg(F.avg((hit & (F.col("correct") == 0)).cast("double")).alias("score"))


def summary_score(qa: Column, conciseness: Column, length_penalty: bool = True, coeff: float = 0.5, compat: str = "v2") -> Column:
    """The share of answered questions weighed with conciseness. Without a penalty ``legacy`` still scales the first part."""
    if not 0 <= coeff <= 1:
        raise ValueError("coeff must lie between 0 and 1")
    if length_penalty:
        return qa * (1 - coeff) + conciseness * coeff
    return qa * (1 - coeff) if compat == "legacy" else qa


def dual_judge(ratings: DataFrame, scale: float, row: str = "row_id") -> DataFrame:
    """The mean of two judges' ratings over ``scale``; if one is NaN the other; NaN if both are."""
    r = F.col("rating")
    return ratings.groupBy(row).agg(F.coalesce(F.avg(F.when(~F.isnan(r), r / scale)), F.lit(NAN)).alias("score"))


def context_relevance_shortcut(user_input: Column, context: Column) -> Column:
    """0.0 where no judge is needed: blank, equal, or the context lies within the input; else null."""
    blank = (F.trim(user_input) == "") | (F.trim(context) == "")
    return F.when(blank | (user_input == context) | F.contains(user_input, context), F.lit(0.0))


def groundedness_shortcut(response: Column, context: Column, compat: str = "v2") -> Column:
    """0.0 for blanks; with ``legacy`` 1.0 where the response equals or lies within the context; else null."""
    out = F.when((F.trim(response) == "") | (F.trim(context) == ""), F.lit(0.0))
    return out.when((response == context) | F.contains(context, response), F.lit(1.0)) if compat == "legacy" else out


def topic_adherence(topics: DataFrame, mode: str = "f1", row: str = "row_id") -> DataFrame:
    """``topics``: row, answered, in_reference (booleans). Answered in reference is TP, answered outside FP, refused in reference FN."""
    n = lambda c: F.count(F.when(c, 1))
    a, i = F.col("answered"), F.col("in_reference")
    counts = topics.groupBy(row).agg(n(a & i).alias("tp"), n(a & ~i).alias("fp"), n(~a & i).alias("fn"))
    eps = F.lit(1e-10)
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + eps), F.col("tp") / (F.col("tp") + F.col("fn") + eps)
    return counts.select(row, {"precision": p, "recall": r, "f1": 2 * p * r / (p + r + eps)}[mode].alias("score"))


def best_context_similarity(left: Column, right: Column, similarity) -> Column:  # noqa: ANN001
    """For each of ``left`` its best similarity with any of ``right``; both are arrays of a row."""
    return F.transform(left, lambda x: F.coalesce(F.array_max(F.transform(right, lambda y: similarity(x, y))), F.lit(0.0)))


def non_llm_context_recall(retrieved: Column, reference: Column, similarity, threshold: float = 0.5) -> Column:  # noqa: ANN001
    """The share of reference contexts with a retrieved one above (not at) the threshold; NaN without references."""
    best = best_context_similarity(reference, retrieved, similarity)
    return F.when(F.size(reference) == 0, F.lit(NAN)).otherwise(F.size(F.filter(best, lambda s: s > threshold)) / F.size(reference))


def non_llm_context_verdicts(retrieved: Column, reference: Column, similarity, threshold: float = 0.5) -> Column:  # noqa: ANN001
    """1 for each retrieved context with a reference one at or above the threshold; feed it to average_precision."""
    return F.transform(best_context_similarity(retrieved, reference, similarity), lambda s: (s >= threshold).cast("int"))
