"""Records of other systems, graph upkeep, contexts and checks as queries over the driver's tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregate, graph, schema, testset
from ..sources import records
from .evaluate import METRICS
from .queries import query, table


@query("""SELECT conv_id, count(*) AS messages, coalesce(string_agg('note:' || turn, ',' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS calls
FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def agent_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Each assistant turn calls one tool, whose arguments arrive as JSON within JSON."""
    turn = F.col("turn").cast("string")
    call = F.concat(F.lit('[{"name": "note", "arguments": "{\\"turn\\": \\"'), turn, F.lit('\\"}"}]'))
    rows = table(spark, d, "conversations").withColumn("calls", F.when(F.col("role") == "assistant", call))
    held = records.agent_messages(rows, "conv_id", "turn", "role", "text", "calls")
    calls = F.flatten(F.transform("user_input", lambda m: F.coalesce(m["tool_calls"], F.array().cast(f"array<{schema.TOOL_CALL}>"))))
    named = F.transform(calls, lambda c: F.concat(c["name"], F.lit(":"), c["args"]["turn"]))
    return held.select("conv_id", F.size("user_input").cast("long").alias("messages"), F.array_join(named, ",").alias("calls"))


@query("""WITH p AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'user' WHEN 'view' THEN 'tool' ELSE 'ai' END AS role,
CASE WHEN event_type = 'purchase' THEN event_id % 20 END AS call_id FROM events),
w AS (SELECT *, lag(role) OVER (PARTITION BY user_id ORDER BY event_id) AS b, row_number() OVER (PARTITION BY user_id, call_id ORDER BY event_id) AS n FROM p)
SELECT user_id, event_id, role FROM w WHERE (call_id IS NULL OR n = 1) AND NOT (role = 'user' AND coalesce(b, '') = 'tool')""")
def event_deduplication(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("event_type") == "click", "user").when(F.col("event_type") == "view", "tool").otherwise("ai")
    call = F.when(F.col("event_type") == "purchase", F.col("event_id") % 20)
    rows = table(spark, d, "events").select("user_id", "event_id", role.alias("role"), call.alias("call_id"))
    return records.deduplicated_events(rows, "user_id", "event_id", "role", "call_id").select("user_id", "event_id", "role")


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id")
def last_values(spark: SparkSession, d: str) -> DataFrame:
    return records.last_value(table(spark, d, "events"), "user_id", "event_id", "value")


@query("""SELECT 0 AS pos, o_orderkey AS id, o_orderstatus AS label FROM orders UNION ALL SELECT 1, o_custkey, o_orderpriority FROM orders""")
def zipped_arrays(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.array("o_orderkey", "o_custkey").alias("ids"), F.array("o_orderstatus", "o_orderpriority").alias("labels"))
    return records.zipped_rows(rows, id="ids", label="labels")


@query("""WITH RECURSIVE t AS (SELECT event_id AS run_id, event_id AS root, 0 AS depth FROM events WHERE event_id < 10
UNION ALL SELECT event_id, root, depth + 1 FROM events JOIN t ON event_id >= 10 AND event_id // 10 = run_id) SELECT * FROM t""")
def run_trees(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose parent is their id without its last digit."""
    parent = F.when(F.col("event_id") >= 10, F.floor(F.col("event_id") / 10))
    return records.trace_tree(table(spark, d, "events").select(F.col("event_id").alias("run_id"), parent.alias("parent_run_id")))


@query("""SELECT provider, 'm' || event_type AS model, CAST(sum(event_id % 11) AS BIGINT) AS input_tokens,
CAST(sum(CASE WHEN provider = 'azure' AND event_type = 'error' THEN 0 ELSE event_id % 5 END) AS BIGINT) AS output_tokens
FROM events, (VALUES ('azure'), ('bedrock'), ('openai')) AS p(provider) GROUP BY ALL""")
def usage_of_providers(spark: SparkSession, d: str) -> DataFrame:
    """Replies of three providers; one of them leaves a count out on errors."""
    events, model = table(spark, d, "events"), F.concat(F.lit("m"), "event_type")
    taken, given = F.col("event_id") % 11, F.col("event_id") % 5
    told = F.when(F.col("event_type") != "error", given)
    counts = {"openai": F.struct(taken.alias("prompt_tokens"), given.alias("completion_tokens")), "bedrock": F.struct(taken.alias("prompt_tokens"), given.alias("completion_tokens")), "azure": F.struct(taken.alias("input_tokens"), told.alias("output_tokens"))}
    names = {"openai": ("token_usage", "model_name"), "bedrock": ("usage", "model_id"), "azure": ("usage", "model_name")}
    parts = []
    for provider, (usage, name) in names.items():
        reply = F.to_json(F.struct(counts[provider].alias(usage), model.alias(name)))
        parts.append(events.select(F.lit(provider).alias("provider"), aggregate.parsed_usage(reply, provider).alias("u")))
    rows = reduce(DataFrame.union, parts).select("provider", "u.*")
    return rows.groupBy("provider", "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@query("""WITH r AS (SELECT [1, 2, 3] AS g, [p_size % 3 + 1, p_size % 5 + 1, 2] AS p FROM part),
k AS (SELECT list_sum(list_transform(list_zip(g, p), lambda z: power(z[1] - z[2], 2))) AS o,
list_sum(list_transform(g, lambda x: list_sum(list_transform(p, lambda y: power(x - y, 2))))) AS c FROM r)
SELECT round(avg(CASE WHEN c = 0 THEN 1 ELSE 1 - o * 3 / c END), 6) AS kappa FROM k""")
def rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, d, "part").select(F.array(*map(F.lit, (1, 2, 3))).alias("g"), F.array(size % 3 + 1, size % 5 + 1, F.lit(2)).alias("p"))
    return aggregate.mean_rank_agreement(rows, "g", "p").select(F.round("kappa", 6).alias("kappa"))


#: At the threshold or above; a reference counts as found only above it.
SIMILAR = "CAST(1 - levenshtein({0}, {1}) / greatest(length({0}), length({1})) >= 0.5 AS INT)"
ABOVE = SIMILAR.replace(">=", ">")


@query(f"""WITH v AS (SELECT p_partkey, greatest({SIMILAR.format("p_name", "p_name")}, {SIMILAR.format("p_name", "p_brand")}) AS a,
greatest({SIMILAR.format("p_type", "p_name")}, {SIMILAR.format("p_type", "p_brand")}) AS b,
greatest({ABOVE.format("p_brand", "p_name")}, {ABOVE.format("p_brand", "p_type")}) AS c FROM part)
SELECT p_partkey, round((a + c) / 2, 6) AS recall_, round((a + b * (a + b) / 2) / (a + b + 1e-10), 6) AS precision_ FROM v""")
def string_context_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.array("p_name", "p_type").alias("retrieved_contexts"), F.array("p_name", "p_brand").alias("reference_contexts"))
    recall, precision = METRICS["non_llm_context_recall"].score(), METRICS["non_llm_context_precision_with_reference"].score()
    return rows.select("p_partkey", F.round(recall, 6).alias("recall_"), F.round(precision, 6).alias("precision_"))


@query("""WITH n AS (SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, source) AS title FROM documents WHERE n_chars % 5 > 2 OR n_chars IS NULL OR doc_id % 3 = 0)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n a JOIN n b ON b.doc_id = a.doc_id + 1) AS edges, (SELECT count(DISTINCT title) FROM n) AS titles""")
def graph_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """Titles are filled where they are absent, then nodes of low scores go with their edges; every third node has no score."""
    docs = table(spark, d, "documents")
    nodes = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("title"), "source", (F.col("n_chars") % 5).alias("score"))
    edges = docs.select(F.col("doc_id").alias("id"), F.lit("next").alias("type"), F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"))
    full = graph.Graph(nodes, edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")).with_property("Title", F.col("source"))
    kept = full.drop_low_scores(full.nodes.where("id % 3 <> 0").select("id", "score"))
    counted = kept.nodes.agg(F.count("*").alias("nodes"), F.count_distinct("title").alias("titles"))
    return counted.join(kept.edges.agg(F.count("*").alias("edges")), F.lit(True))  # one row each


@query("""WITH x AS (SELECT DISTINCT s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'c' || s_suppkey ELSE 's' || s_suppkey END AS id FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY id) AS rn FROM x)
SELECT s_nationkey AS cluster_id, string_agg('<' || rn || '-hop>' || chr(10) || chr(10) || 'text of ' || id, '|' ORDER BY rn) AS contexts FROM r GROUP BY 1""")
def hop_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of a nation are its cluster; each second one has a chunk, which stands for it."""
    suppliers = table(spark, d, "supplier").select(F.col("s_nationkey").alias("cluster_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), "s_suppkey")
    children = suppliers.where("s_suppkey % 2 = 0").select(F.col("node_id").alias("root"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("id"))
    ids = suppliers.select(F.col("node_id").alias("id")).union(children.select("id"))
    nodes = ids.withColumn("page_content", F.concat(F.lit("text of "), "id"))
    held = testset.cluster_contexts(suppliers.select("cluster_id", "node_id"), children, nodes)
    return held.select("cluster_id", F.array_join("contexts", "|").alias("contexts"))


@query("""SELECT doc_id AS id, persona FROM documents JOIN (VALUES ('editor', ['en', 'src1']), ('student', ['fr', 'src2'])) AS p(persona, themes)
ON list_contains(themes, lower(lang)) OR list_contains(themes, lower(source))""")
def persona_matches(spark: SparkSession, d: str) -> DataFrame:
    personas = spark.createDataFrame([("editor", ["EN", "src1"]), ("student", ["Fr", "SRC2"])], "persona string, persona_themes array<string>")
    nodes = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("themes"))
    return testset.matching_personas(nodes, personas).select("id", "persona")


@query("""SELECT p_partkey, '{"name": {"of": "' || p_name || '"}, "sizes": [' || p_size || ']}' AS found FROM part""")
def json_replies(spark: SparkSession, d: str) -> DataFrame:
    """The JSON of a chatty reply: behind a fence, or bare."""
    body = F.concat(F.lit('{"name": {"of": "'), "p_name", F.lit('"}, "sizes": ['), F.col("p_size").cast("string"), F.lit("]}"))
    reply = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Here {it} is:\n```json\n"), body, F.lit("\n```\nDone."))).otherwise(F.concat(body, F.lit(" }")))
    return table(spark, d, "part").select("p_partkey", text.extracted_json(reply).alias("found"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END AS exact, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.5 END AS f1 FROM part""")
def label_sets(spark: SparkSession, d: str) -> DataFrame:
    """Labels in another order with a repeat are right; half of the rows have one wrong label."""
    other = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit("none"))
    rows = table(spark, d, "part").select("p_partkey", F.array("p_brand", "p_type").alias("g"), F.array("p_type", other, "p_type").alias("p"))
    return aggregate.label_set_scores(rows, "g", "p").select("p_partkey", "exact", "f1")


@query("""WITH r AS (SELECT 'kind ' || event_id % 3 AS reason, count(*) AS k FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS "valid", round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS "share",
(SELECT string_agg(reason || ': ' || k, ', ' ORDER BY k, reason) FROM r) AS reasons FROM events""")
def sql_check_summary(spark: SparkSession, d: str) -> DataFrame:
    reason = F.concat(F.lit("kind "), (F.col("event_id") % 3).cast("string"))
    checks = table(spark, d, "events").select((F.col("event_type") != "error").alias("valid"), F.when(F.col("event_type") == "error", reason).alias("error"))
    named = F.transform("reasons", lambda r: F.concat(r["reason"], F.lit(": "), r["k"].cast("string")))
    return aggregate.validation_summary(checks).select("total", "valid", F.round("share", 6).alias("share"), F.array_join(named, ", ").alias("reasons"))


@query("""SELECT n_nationkey, 'Say it.' || chr(10) || chr(10) || 'Example 1' || chr(10) || 'Input: a' || chr(10) || 'Output: b' || chr(10) || chr(10) || 'Input: {"name":"' || n_name || '"'
|| CASE WHEN n_regionkey > 1 THEN ',"region":' || n_regionkey ELSE '' END || '}' || chr(10) || 'Output: ' AS prompt FROM nation""")
def prompt_rendering(spark: SparkSession, d: str) -> DataFrame:
    region = F.when(F.col("n_regionkey") > 1, F.col("n_regionkey"))
    payload = F.struct(F.col("n_name").alias("name"), region.alias("region"))
    return table(spark, d, "nation").select("n_nationkey", text.rendered_prompt("Say it.", [("a", "b")], payload).alias("prompt"))
