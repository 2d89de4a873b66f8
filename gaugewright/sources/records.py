"""Records of other systems as samples: flat projections, ordered groupings and small joins."""

from __future__ import annotations

import csv
from io import StringIO

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nan
from ..operators.schema import TOOL_CALL
from .shared import written


def zipped_rows(df: DataFrame, **arrays: str) -> DataFrame:
    """Parallel arrays as rows; arrays of different lengths are an error."""
    first = next(iter(arrays.values()))
    odd = F.lit(False)
    for c in arrays.values():
        odd = odd | (F.size(c) != F.size(first))
    zipped = F.when(odd, F.raise_error(F.lit("the arrays differ in length")).cast("string")).otherwise(F.lit(""))
    rows = df.withColumn("_ok", zipped).where("_ok = ''").select(F.posexplode(F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])).alias("pos", "r"))
    return rows.select("pos", *[F.col("r").getField(n).alias(n) for n in arrays])


def agent_messages(rows: DataFrame, conv: str, turn: str, role: str, content: str, calls: str | None = None) -> DataFrame:
    """Messages of an agent framework in long form as one conversation per row. System messages go, an unknown or null role
    is an error; tool arguments come as JSON."""
    kind = F.when(F.col(role).isin("human", "user"), "human").when(F.col(role).isin("ai", "assistant"), "ai").when(F.col(role) == "tool", "tool")
    kind = F.coalesce(kind, F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(F.col(role), F.lit("null")))).cast("string"))
    made = F.lit(None).cast(f"array<{TOOL_CALL}>")
    if calls is not None:
        parsed = F.from_json(F.col(calls), "array<struct<name: string, arguments: string>>")
        made = F.transform(parsed, lambda c: F.struct(c["name"].alias("name"), F.from_json(c["arguments"], "map<string,string>").alias("args")))
    message = F.struct(F.col(turn).alias("turn"), kind.alias("type"), F.col(content).alias("content"), F.lit(None).cast("string").alias("metadata"), made.alias("tool_calls"))
    ordered = rows.where(~F.col(role).eqNullSafe("system")).groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(F.col(turn), F.to_json(message).alias("m")))).alias("ms"))
    schema = f"array<struct<type: string, content: string, metadata: string, tool_calls: array<{TOOL_CALL}>>>"
    return ordered.select(conv, F.from_json(F.concat(F.lit("["), F.array_join("ms.m", ","), F.lit("]")), schema).alias("user_input"))


def deduplicated_events(events: DataFrame, conv: str, order: str, role: str, call_id: str) -> DataFrame:
    """Events of an agent without repeated tool calls and without user inputs that follow a tool message."""
    before = F.lag(role).over(Window.partitionBy(conv).orderBy(order))
    first = F.row_number().over(Window.partitionBy(conv, call_id).orderBy(order))
    kept = events.withColumn("_before", before).withColumn("_n", F.when(F.col(call_id).isNull(), 1).otherwise(first))
    return kept.where((F.col("_n") == 1) & ~((F.col(role) == "user") & (F.coalesce("_before", F.lit("")) == "tool"))).drop("_before", "_n")


def last_value(traces: DataFrame, conv: str, order: str, value: str) -> DataFrame:
    """The last non-null value of each trace."""
    return traces.where(F.col(value).isNotNull()).groupBy(conv).agg(F.max_by(value, order).alias(value))


def last_after(traces: DataFrame, conv: str, order: str, value: str, after: Column) -> DataFrame:
    """The last non-null value of each trace, if it comes later than the trace's last row of ``after`` (as a final answer comes later than
    the last call of the model); a trace without such a row keeps its last value."""
    calls = F.max(F.when(after, F.col(order)))
    last = traces.groupBy(conv).agg(F.max(F.when(F.col(value).isNotNull(), F.struct(order, value))).alias("_last"), calls.alias("_call"))
    return last.where(F.col("_last").isNotNull() & (F.col("_call").isNull() | (F.col(f"_last.{order}") > F.col("_call")))).select(conv, F.col(f"_last.{value}").alias(value))


SEARCH = "chunk_search_results array<struct<text: string>>, web_search_results array<struct<snippet: string>>"


def search_contexts(result: Column) -> Column:
    """The contexts of an aggregate search result in JSON: the texts of its chunks, then the snippets of its web pages, none of them empty; what
    graphs and whole documents found is left out. Null or no JSON: none."""
    parsed = F.from_json(result, SEARCH)
    none = F.array().cast("array<string>")
    found = F.concat(F.coalesce(parsed["chunk_search_results"]["text"], none), F.coalesce(parsed["web_search_results"]["snippet"], none))
    return F.coalesce(F.filter(found, lambda x: x.isNotNull() & (x != "")), none)


def paired_lookups(traces: DataFrame, conv: str, order: str, kind: str, value: str) -> DataFrame:
    """(conv, n, lookup, output): the nth lookup of a trace with its nth output."""
    n = F.row_number().over(Window.partitionBy(conv, kind).orderBy(order))
    ranked = traces.where(F.col(kind).isin("lookup", "output")).withColumn("n", n)
    return ranked.groupBy(conv, "n").agg(F.max(F.when(F.col(kind) == "lookup", F.col(value))).alias("lookup"), F.max(F.when(F.col(kind) == "output", F.col(value))).alias("output"))


def trace_tree(runs: DataFrame) -> DataFrame:
    """(run_id, root, depth) of runs with parents (run_id, parent_run_id): one join per level, until a level is empty. A run whose
    parents never reach a root is not in the table."""
    links = written(runs.select("run_id", "parent_run_id"), "runs")
    level = links.where(F.col("parent_run_id").isNull()).select("run_id", F.col("run_id").alias("root"), F.lit(0).alias("depth"))
    found, depth = level, 0
    while True:
        depth += 1
        parents = level.select(F.col("run_id").alias("parent_run_id"), "root")
        level = written(links.join(parents, "parent_run_id").select("run_id", "root", F.lit(depth).alias("depth")), "level")
        if not level.limit(1).count():
            return found
        found = found.union(level)


def normalised_sql(query: Column) -> Column:
    """Double quotes become single ones, white space one space, the current date a fixed one, two-digit years four-digit ones; all in lower case."""
    out = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(query, '"', "'"), r"\s+", " ")), "%y", "%Y")
    return F.lower(F.regexp_replace(F.regexp_replace(out, r"(?i)current_date\b(\(\))?", "'2022-06-01'"), r"(?i)'now'", "'2022-06-01'"))


def executed(spark, query: str) -> tuple[bool, DataFrame | str]:  # noqa: ANN001
    """(True, result) of a SELECT over the session's views, or (False, message)."""
    if not query.lstrip().lower().startswith(("select", "with")):
        return False, "only SELECT is allowed"
    try:
        df = spark.sql(query)
        df.limit(1).count()
        return True, df
    except Exception as e:  # noqa: BLE001 - any failure is the query's
        return False, str(e).split("\n")[0]


_NUMBERS = ("double", "float", "decimal", "int", "bigint", "smallint", "tinyint")


def same_result(a: DataFrame, b: DataFrame, tolerance: float = 1e-10, relative: float = 1e-10) -> bool:
    """Whether two results hold the same rows, repeats counted; names and order do not matter. Two numbers are the same if they lie within
    ``tolerance + relative * |b|`` of each other, NaN and null only if both are so; all other values if they are equal as text.

    Rows that agree in all that is no number meet; their numbers are swept in order, column by column, and a gap beyond the tolerances
    parts them. What then is together is matched in its order. So the rows of one answer that agree in their texts are sorted in
    one task, as many as there may be."""
    if len(a.columns) != len(b.columns):
        return False
    kinds = [[t for _, t in df.dtypes] for df in (a, b)]
    numeric = [i for i in range(len(a.columns)) if all(k[i].startswith(_NUMBERS) for k in kinds)]

    def side(df: DataFrame, name: str) -> DataFrame:
        df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        values = {f"v{i}": F.col(f"c{i}").cast("double") for i in numeric}
        finite = {k: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) for k, v in values.items()}
        exact = [F.when(finite[f"v{i}"], F.lit("#")).otherwise(values[f"v{i}"].cast("string")) if i in numeric else F.col(f"c{i}").cast("string") for i in range(len(df.columns))]
        text = F.to_json(F.struct(*[e.alias(f"e{i}") for i, e in enumerate(exact)]), {"ignoreNullFields": "false"})
        return df.select(F.sha2(text.cast("binary"), 256).alias("g"), *[F.when(finite[k], v).otherwise(0.0).alias(k) for k, v in values.items()], F.lit(name).alias("side"))

    both = written(side(a, "a").unionByName(side(b, "b")), "results")
    uneven = both.groupBy("g").agg(F.sum(F.when(F.col("side") == "a", 1).otherwise(-1)).alias("d")).where("d <> 0")
    if not uneven.isEmpty():
        return False
    together = ["g"]
    for i in numeric:
        w = Window.partitionBy(*together).orderBy(f"v{i}")
        last = F.lag(f"v{i}").over(w)
        parts = F.col(f"v{i}") - last > tolerance + relative * F.greatest(F.abs(last), F.abs(f"v{i}"))
        both = both.withColumn("_new", F.coalesce(parts, F.lit(False)).cast("int"))
        both = both.withColumn(f"k{i}", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
        together.append(f"k{i}")
    values = [f"v{i}" for i in numeric]
    place = F.row_number().over(Window.partitionBy(*together, "side").orderBy(*(values or [F.lit(0)])))
    ranked = written(both.withColumn("n", place), "ranked")
    x = ranked.where("side = 'a'").select(*together, "n", *values)
    y = ranked.where("side = 'b'").select(*together, "n", *[F.col(v).alias(f"w{v}") for v in values])
    pairs = x.join(y, [*together, "n"], "full_outer")
    near = F.lit(True)
    for v in values:
        near = near & (F.abs(F.col(v) - F.col(f"w{v}")) <= tolerance + relative * F.abs(f"w{v}"))
    alone = F.lit(False)
    for v in values:
        alone = alone | F.col(v).isNull() | F.col(f"w{v}").isNull()
    return pairs.where(alone | ~near).isEmpty()


def compared_tables(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """Precision, recall and F1 of rows of ``a`` (response) against ``b`` (reference), matched by position and equal in all columns."""
    columns = [c for c in b.columns if c != order]
    rank = lambda df: F.row_number().over(Window.orderBy(order))  # noqa: E731 - tables of one answer, small by nature
    x = a.withColumn("_n", rank(a)).select("_n", F.struct(*columns).alias("x"))
    y = b.withColumn("_n", rank(b)).select("_n", F.struct(*columns).alias("y"))
    both = x.join(y, "_n", "full_outer").agg(F.count("x").alias("nx"), F.count("y").alias("ny"), F.count(F.when(F.col("x").eqNullSafe(F.col("y")) & F.col("x").isNotNull(), 1)).alias("same"))
    share = lambda n: F.when(n == 0, F.lit(0.0)).otherwise(F.col("same") / n)
    p, r = share(F.col("nx")), share(F.col("ny"))
    return both.select(p.alias("precision"), r.alias("recall"), F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)).alias("f1"))


def _csv_columns(text: str) -> tuple[dict[str, list], int]:
    """The columns of a CSV text by lower-case name, and how many rows they have; empty and missing cells are None, numbers floats."""
    head, *body = [r for r in csv.reader(StringIO(text)) if r]
    if any(len(r) > len(head) for r in body):
        raise ValueError("a row has more cells than the head")

    def cell(r: list[str], i: int) -> float | str | None:
        raw = r[i] if i < len(r) else ""
        try:
            return float(raw)
        except ValueError:
            return raw or None

    return {name.strip().lower(): [cell(r, i) for r in body] for i, name in enumerate(head)}, len(body)


def _csv_score(reference: str | None, response: str | None, mode: str, metric: str) -> float | None:
    try:
        (want, n_want), (got, n_got) = _csv_columns(reference or ""), _csv_columns(response or "")
    except (ValueError, csv.Error):  # an empty text, too, has no head
        return None
    same = [[a == b for a, b in zip(want[c], got[c], strict=False)] for c in want if c in got]
    if mode == "rows":
        hits, of = sum(map(all, zip(*same, strict=True))), (n_got, n_want)
    else:
        hits, of = sum(map(all, same)), (len(got), len(want))
    if 0 in of:
        return None
    p, r = hits / of[0], hits / of[1]
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else None}[metric]


def compared_csv(reference: Column, response: Column, mode: str = "rows", metric: str = "f1") -> Column:
    """Precision, recall or F1 of a CSV text against another: of rows, matched by position and equal in all columns that both have,
    or of columns, equal in all rows that both have. NaN for what is no CSV, and for an F1 without any match."""
    if mode not in ("rows", "columns") or metric not in ("precision", "recall", "f1"):
        raise ValueError(f"unknown mode or metric: {mode}, {metric}")

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_csv_score(a, b, mode, metric) for a, b in zip(x, y, strict=True)], dtype="float64")

    return F.coalesce(of(reference, response), nan())
