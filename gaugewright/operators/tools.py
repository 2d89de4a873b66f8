"""Tool-call metrics over arrays of struct<name, args map<string, string>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .schema import TOOL_CALL


def predicted_calls(messages: Column) -> Column:
    """The tool calls of all AI messages in order."""
    ai = F.filter(messages, lambda m: m["type"] == "ai")
    return F.flatten(F.transform(ai, lambda m: F.coalesce(m["tool_calls"], F.array().cast(f"array<{TOOL_CALL}>"))))


def _canonical(call: Column) -> Column:
    """Name and arguments in one comparable form."""
    args = F.array_sort(F.map_entries(F.coalesce(call["args"], F.create_map().cast("map<string,string>"))))
    return F.to_json(F.struct(call["name"].alias("name"), args.alias("args")))


def _in_order(calls: Column) -> Column:
    keyed = F.transform(calls, lambda c: F.struct(_canonical(c).alias("k"), c["name"].alias("name"), c["args"].alias("args")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)), lambda c: F.struct(c["name"].alias("name"), c["args"].alias("args")))


def tool_call_f1(predicted: Column, reference: Column) -> Column:
    """F1 of the sets of (name, arguments), to four places; 0 if both are empty."""
    got = F.array_distinct(F.transform(predicted, _canonical))
    want = F.array_distinct(F.transform(reference, _canonical))
    tp = F.size(F.array_intersect(got, want))
    both = F.size(got) + F.size(want)
    return F.when(both == 0, F.lit(0.0)).otherwise(F.bround(2 * tp / both, 4))


def _args_score(got: Column, want: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    got, want = F.coalesce(got, empty), F.coalesce(want, empty)
    hits = F.size(F.filter(F.map_entries(want), lambda e: F.map_contains_key(got, e["key"]) & F.element_at(got, e["key"]).eqNullSafe(e["value"])))
    return F.when((F.size(got) == 0) & (F.size(want) == 0), F.lit(1.0)).when(F.size(want) == 0, F.lit(0.0)).otherwise(hits / F.size(want))


def tool_call_accuracy(predicted: Column, reference: Column, strict_order: bool = True) -> Column:
    """Mean share of right reference arguments over positional pairs, if the sequences of names agree, else 0.

    Without ``strict_order`` both sides are sorted first. Two empty sides score 1, one empty side 0."""
    got, want = (predicted, reference) if strict_order else (_in_order(predicted), _in_order(reference))
    names = lambda calls: F.transform(calls, lambda c: c["name"])
    total = F.aggregate(F.zip_with(got, want, lambda g, w: _args_score(g["args"], w["args"])), F.lit(0.0), lambda s, x: s + x)
    aligned = names(got) == names(want)
    return F.when((F.size(predicted) == 0) & (F.size(reference) == 0), F.lit(1.0)).when(F.coalesce(aligned, F.lit(False)) & (F.size(reference) > 0), total / F.size(reference)).otherwise(F.lit(0.0))
