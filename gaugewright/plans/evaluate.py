"""Evaluate rows with metrics, run experiments, compare with a baseline."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ngram, sets, text, vector
from ..operators import judge, tools
from ..operators.aggregate import nan_mean
from ..operators.schema import kind_of, parse_requirements, to_current_names
from ..sources import records
from .judge_metrics import JUDGED
from .judging import Judge


@dataclass(frozen=True)
class Metric:
    """``score``: a column of the row's columns (fused with the other metrics into one projection), or ``transform``:
    from rows with ``row_id`` to row_id and score, or ``judged``: the same with a judge and the key's name. ``domain``: allowed values, or (low, high)."""

    name: str
    requires: list[str]
    score: Callable[[], Column] | None = None
    transform: Callable[[DataFrame], DataFrame] | None = None
    kinds: tuple[str, ...] = ("single",)
    domain: tuple | list | None = None
    judged: Callable[[DataFrame, Judge, str], DataFrame] | None = None  # asks a model


def _c(name: str) -> Column:
    return F.col(name)


def _similarity_metric(measure: str) -> Metric:
    return Metric(f"{measure}_similarity", ["reference", "response"], lambda: text.string_similarity(_c("reference"), _c("response"), measure))


METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        Metric("exact_match", ["reference", "response"], lambda: text.exact_match(_c("reference"), _c("response"))),
        Metric("string_present", ["reference", "response"], lambda: text.string_present(_c("reference"), _c("response"))),
        *map(_similarity_metric, text.SIMILARITIES),
        Metric("bleu_score", ["reference", "response"], lambda: ngram.bleu_score(_c("reference"), _c("response"))),
        Metric("chrf_score", ["reference", "response"], lambda: ngram.chrf_score(_c("reference"), _c("response"))),
        Metric("rouge_score", ["reference", "response"], lambda: ngram.rouge_score(_c("reference"), _c("response"))),
        Metric("data_compare_score", ["reference", "response"], lambda: records.compared_csv(_c("reference"), _c("response"))),
        Metric("id_based_context_precision", ["retrieved_context_ids", "reference_context_ids"], lambda: sets.id_precision(_c("retrieved_context_ids"), _c("reference_context_ids"))),
        Metric("id_based_context_recall", ["retrieved_context_ids", "reference_context_ids"], lambda: sets.id_recall(_c("retrieved_context_ids"), _c("reference_context_ids"))),
        Metric("non_llm_context_recall", ["retrieved_contexts", "reference_contexts"], lambda: judge.non_llm_context_recall(_c("retrieved_contexts"), _c("reference_contexts"), text.levenshtein_similarity)),
        Metric("non_llm_context_precision_with_reference", ["retrieved_contexts", "reference_contexts"], lambda: sets.average_precision(judge.non_llm_context_verdicts(_c("retrieved_contexts"), _c("reference_contexts"), text.levenshtein_similarity))),
        Metric("semantic_similarity", ["reference_embedding", "response_embedding"], lambda: vector.semantic_similarity(_c("reference_embedding"), _c("response_embedding"))),
        Metric("tool_call_accuracy", ["user_input", "reference_tool_calls"], lambda: tools.tool_call_accuracy(tools.predicted_calls(_c("user_input")), _c("reference_tool_calls")), kinds=("multi",)),
        Metric("tool_call_f1", ["user_input", "reference_tool_calls"], lambda: tools.tool_call_f1(tools.predicted_calls(_c("user_input")), _c("reference_tool_calls")), kinds=("multi",)),
    )
}


METRICS |= {name: Metric(name, requires, kinds=kinds, judged=judged) for name, (requires, judged, kinds) in JUDGED.items()}


def validate(df: DataFrame, metrics: list[Metric]) -> None:
    """Fail before any job runs: missing columns, or a kind that a metric does not score."""
    kind = kind_of(df)
    for m in metrics:
        missing = [c for c in parse_requirements(m.requires)[0] if c not in df.columns]
        if missing:
            raise ValueError(f"{m.name} needs the columns {', '.join(missing)}")
        if "user_input" in df.columns and kind not in m.kinds and "user_input" in m.requires:
            raise ValueError(f"{m.name} does not score {kind}-turn rows")


@dataclass(frozen=True)
class Result:
    scores: DataFrame  # the rows with one column per metric
    metrics: list[str]
    key: str = "row_id"
    extra: dict = field(default_factory=dict)

    def summary(self, by: list[str] | None = None) -> DataFrame:
        means = [nan_mean(m).alias(m) for m in self.metrics]
        return self.scores.rollup(*by).agg(*means) if by else self.scores.agg(*means)

    def long(self) -> DataFrame:
        """(row_id, metric, score)."""
        return self.scores.select(self.key, *self.metrics).unpivot([self.key], self.metrics, "metric", "score")


def evaluate(df: DataFrame, metrics: list[str | Metric], key: str = "row_id", judge: Judge | None = None) -> Result:
    """Score each row with each metric. ``key`` must tell rows apart. Column metrics become one projection; the others are joined by
    key. ``judge`` asks the model for the metrics that need one; a row that it has no answer for is NaN."""
    df = to_current_names(df)
    chosen = [METRICS[m] if isinstance(m, str) else m for m in metrics]
    validate(df, chosen)
    if lost := [m.name for m in chosen if m.judged and judge is None]:
        raise ValueError(f"a judge is needed for {', '.join(lost)}")
    scored = df.select("*", *[m.score().alias(m.name) for m in chosen if m.score])
    for m in chosen:
        if m.transform or m.judged:
            made = m.transform(df) if m.transform else m.judged(df, judge, key)
            part = made.select(F.col(key).alias("_key"), F.col("score").alias(m.name))
            scored = scored.join(part, F.col(key) == F.col("_key"), "left").drop("_key").withColumn(m.name, F.coalesce(m.name, text.nan()))
    return Result(scored, [m.name for m in chosen], key)


def in_domain(value: Column, domain: tuple | list) -> Column:
    """Whether a value is one of a list, or lies within (low, high)."""
    if isinstance(domain, tuple) and len(domain) == 2:
        return value.between(*domain)
    return value.isin(*domain)


def checked(value: Column, domain: tuple | list) -> Column:
    """struct(value, reason): a value outside the domain is null with a reason."""
    good = F.coalesce(in_domain(value, domain), F.lit(False))
    return F.struct(F.when(good, value).alias("value"), F.when(~good, F.concat(F.lit("outside the domain: "), F.coalesce(value.cast("string"), F.lit("null")))).alias("reason"))


def custom_metric(function: Callable[..., object], returns: str, domain: tuple | list | None = None) -> Callable[..., Column]:
    """A user's function of keyword arguments as a column struct(value, reason). An exception or a value outside the domain is a
    null value with the reason; nothing fails the job."""
    names = function.__code__.co_varnames[: function.__code__.co_argcount]

    def run(columns: list[pd.Series]) -> pd.DataFrame:
        values, reasons = [], []
        for row in zip(*columns, strict=True):
            try:
                v, reason = function(**dict(zip(names, row, strict=True))), None
                if domain is not None and not (domain[0] <= v <= domain[1] if isinstance(domain, tuple) else v in domain):
                    v, reason = None, f"outside the domain: {v!r}"
            except Exception as e:  # noqa: BLE001 - a user's function may raise anything
                v, reason = None, f"{type(e).__name__}: {e}"
            values.append(v)
            reasons.append(reason)
        return pd.DataFrame({"value": values, "reason": reasons})

    def build(**columns: Column) -> Column:
        unknown = [n for n in names if n not in columns]
        if unknown:
            raise TypeError(f"missing arguments: {', '.join(unknown)}")

        @F.pandas_udf(f"value {returns}, reason string")
        def of(*series: pd.Series) -> pd.DataFrame:
            return run(list(series))

        return of(*[columns[n] for n in names])

    return build


def run_experiment(df: DataFrame, function: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """Map a function over the rows. ``schema`` describes what it returns; a column ``error`` is added. A row whose result is None
    is dropped; one that raises stays, with its error and no values."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    result = function(row)
                except Exception as e:  # noqa: BLE001 - a user's function may raise anything
                    result = {"error": f"{type(e).__name__}: {e}"}
                if result is not None:
                    out.append({n: result.get(n) for n in [*names, "error"]})
            yield pd.DataFrame(out, columns=[*names, "error"])

    return df.mapInPandas(run, f"{schema}, error string")
