"""Sample schemas, kinds, renames, required columns, and row checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOOL_CALL = "struct<name: string, args: map<string, string>>"
MESSAGE = f"struct<type: string, content: string, metadata: string, tool_calls: array<{TOOL_CALL}>>"
SINGLE_TURN = (
    "user_input string, retrieved_contexts array<string>, reference_contexts array<string>, retrieved_context_ids array<string>, "
    "reference_context_ids array<string>, response string, multi_responses array<string>, reference string, "
    "rubrics map<string, string>, persona_name string, query_style string, query_length string"
)
MULTI_TURN = f"user_input array<{MESSAGE}>, reference string, reference_tool_calls array<{TOOL_CALL}>, rubrics map<string, string>, reference_topics array<string>"

# The older column names.
LEGACY_NAMES = {"question": "user_input", "contexts": "retrieved_contexts", "answer": "response", "ground_truth": "reference"}


def kind_of(df: DataFrame) -> str:
    """``multi`` if user_input is an array of messages, else ``single``."""
    if "user_input" in df.columns and isinstance(df.schema["user_input"].dataType, T.ArrayType):
        return "multi"
    return "single"


def to_current_names(df: DataFrame) -> DataFrame:
    """Older column names become the current ones, where they are there."""
    return df.withColumnsRenamed({k: v for k, v in LEGACY_NAMES.items() if k in df.columns})


def to_legacy_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({v: k for k, v in LEGACY_NAMES.items() if v in df.columns})


def rename(df: DataFrame, column_map: dict[str, str]) -> DataFrame:
    """``column_map`` goes from the standard name to the user's."""
    missing = [v for v in column_map.values() if v not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df.withColumnsRenamed({v: k for k, v in column_map.items()})


def parse_requirements(declared: list[str]) -> tuple[list[str], list[str]]:
    """(required, optional) of names that may end in ``:optional`` or ``:ignored``."""
    required = [c for c in declared if ":" not in c]
    optional = [c.partition(":")[0] for c in declared if c.endswith(":optional")]
    return required, optional


def project(df: DataFrame, declared: list[str], *keys: str) -> DataFrame:
    """The columns that a metric declares, so that the scan reads no others; all of them without a declaration."""
    if not declared:
        return df
    required, optional = parse_requirements(declared)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    return df.select(*dict.fromkeys([*keys, *required, *(c for c in optional if c in df.columns)]))


def valid_conversation(messages: Column) -> Column:
    """Whether each message has a known type, and each tool message comes after a tool message or an AI message with tool calls."""
    known = F.forall(messages, lambda m: m["type"].isin("human", "ai", "tool"))
    pairs = F.zip_with(F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0))), F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0))), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    follows = F.forall(pairs, lambda x: (x["m"]["type"] != "tool") | (x["p"]["type"] == "tool") | ((x["p"]["type"] == "ai") & (F.coalesce(F.size(x["p"]["tool_calls"]), F.lit(0)) > 0)))
    return known & follows & (F.coalesce(F.get(messages, F.lit(0))["type"], F.lit("")) != "tool")


def ai_seen_before(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", into: str = "ai_seen") -> DataFrame:
    """``turns`` with ``into``: whether a message of the assistant comes before in the conversation. Tool messages without it are at fault."""
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn(into, F.coalesce(F.max(F.coalesce(F.col(role).isin("assistant", "ai"), F.lit(False))).over(before), F.lit(False)))


def rendered_conversation(messages: Column) -> Column:
    """``Human: …``, ``AI: …`` with its tools, ``ToolOutput: …``, one per line."""

    def line(m: Column) -> Column:
        calls = F.transform(F.coalesce(m["tool_calls"], F.array().cast(f"array<{TOOL_CALL}>")), lambda c: F.concat(F.lit("  "), c["name"], F.lit(": "), F.coalesce(F.to_json(c["args"]), F.lit("{}"))))
        ai = F.when(F.size(calls) > 0, F.concat(F.lit("AI: "), m["content"], F.lit("\nTools:\n"), F.array_join(calls, "\n"))).otherwise(F.concat(F.lit("AI: "), m["content"]))
        return F.when(m["type"] == "human", F.concat(F.lit("Human: "), m["content"])).when(m["type"] == "tool", F.concat(F.lit("ToolOutput: "), m["content"])).otherwise(ai)

    return F.array_join(F.transform(messages, line), "\n")


def assemble_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Long rows become one row per conversation with its messages in order; system turns are dropped, other roles, null too, are an error.

    A conversation is one row by definition, so its turns meet in one place; they are gathered by a partial aggregate."""
    kinds = F.when(F.col(role) == "user", "human").when(F.col(role) == "assistant", "ai").when(F.col(role) == "tool", "tool").otherwise(F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(F.col(role), F.lit("null")))).cast("string"))
    rows = turns.where(~F.col(role).eqNullSafe("system")).select(conv, F.struct(F.col(turn).alias("turn"), kinds.alias("type"), F.col(text).alias("content")).alias("m"))
    gathered = rows.groupBy(conv).agg(F.array_sort(F.collect_list("m")).alias("ms"))
    none = F.lit(None)
    message = lambda m: F.struct(m["type"].alias("type"), m["content"].alias("content"), none.cast("string").alias("metadata"), none.cast(f"array<{TOOL_CALL}>").alias("tool_calls"))
    return gathered.select(conv, F.transform("ms", message).alias("user_input"))
