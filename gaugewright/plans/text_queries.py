"""Queries of BLEU over streams, splitters in SQL, nested dates, message flags, class shares, walks and streams with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ngram
from ..operators import aggregate, graph, pairs, sampling, schema, splitters
from ..sources import records
from ..sources.catalog import FolderCatalog
from ..sources.shared import new_path, written
from ..streaming import stateful
from .prompts import Prompt
from .queries import query, table

#: The tokeniser's rules in SQL, one within the other.
_TOKENS = "{0}"
for _old, _new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
    _TOKENS = f"replace({_TOKENS}, '{_old}', '{_new}')"
_TOKENS = f"' ' || {_TOKENS} || ' '"
for _rule, _new in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
    _TOKENS = f"regexp_replace({_TOKENS}, '{_rule}', '{_new}', 'g')"
_TOKENS = f"list_filter(regexp_split_to_array({_TOKENS}, '\\s+'), lambda x: x <> '')"

BLEU_SQL = f"""WITH p AS (SELECT a.conv_id, a.turn, string_split(b.text, '. ')[1] AS hyp, string_split(a.text, '. ') AS refs
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
s AS (SELECT conv_id, turn, 0 AS ref, hyp AS t FROM p UNION ALL SELECT conv_id, turn, unnest(range(1, len(refs) + 1)), unnest(refs) FROM p),
w AS (SELECT conv_id, turn, ref, {_TOKENS.replace("{0}", "t")} AS ws FROM s),
h AS (SELECT conv_id, turn, len(ws) AS n FROM w WHERE ref = 0),
l AS (SELECT w.conv_id, w.turn, arg_min(len(ws), abs(len(ws) - h.n) * 1000000 + len(ws)) AS wanted FROM w JOIN h USING (conv_id, turn) WHERE ref > 0 GROUP BY ALL),
g AS (SELECT conv_id, turn, ref, k, array_to_string(ws[i:i + k - 1], ' ') AS gram, count(*) AS c
  FROM (SELECT conv_id, turn, ref, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS sizes(k)) GROUP BY ALL),
m AS (SELECT conv_id, turn, k, gram, max(c) AS c FROM g WHERE ref > 0 GROUP BY ALL),
x AS (SELECT g.conv_id, g.turn, g.k, sum(least(g.c, coalesce(m.c, 0))) AS hits FROM g LEFT JOIN m USING (conv_id, turn, k, gram) WHERE g.ref = 0 GROUP BY ALL),
o AS (SELECT h.conv_id, h.turn, h.n, sizes.k, h.n - sizes.k + 1 AS total, coalesce(x.hits, 0) AS hits
  FROM h CROSS JOIN (VALUES (1), (2), (3), (4)) AS sizes(k) LEFT JOIN x ON x.conv_id = h.conv_id AND x.turn = h.turn AND x.k = sizes.k),
z AS (SELECT *, sum(CAST(hits = 0 AS INT)) OVER (PARTITION BY conv_id, turn ORDER BY k) AS misses FROM o),
f AS (SELECT conv_id, turn, n, max(hits) AS most, min(total) AS least_total,
  avg(CASE WHEN total <= 0 THEN 0 WHEN hits > 0 THEN ln(hits / total) ELSE -ln(power(2, misses) * total) END) AS logs FROM z GROUP BY ALL)
SELECT f.conv_id, f.turn, round(CASE WHEN most = 0 OR least_total <= 0 THEN 0.0 ELSE exp(least(0.0, 1 - wanted / n) + logs) END, 6) AS bleu
FROM f JOIN l ON l.conv_id = f.conv_id AND l.turn = f.turn"""


@query(BLEU_SQL)
def bleu_of_streams(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as the reference, the next as the response."""
    turns = table(spark, d, "conversations")
    after = turns.select(F.col("conv_id").alias("_c"), (F.col("turn") - 1).alias("_t"), F.col("text").alias("response"))
    both = turns.join(after, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")))
    return both.select("conv_id", "turn", F.round(ngram.bleu_score(F.col("text"), F.col("response")), 6).alias("bleu"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws), 120)) AS cut_ FROM w)
SELECT doc_id, CAST(cut_ // 120 AS INTEGER) AS pos, md5(array_to_string(ws[cut_ + 1:cut_ + 120], ' ')) AS chunk_md5 FROM p""")
def windows_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """The table function as SQL calls it."""
    splitters.register_splitters(spark)
    docs = table(spark, d, "documents").select("doc_id", "text")
    return spark.sql("SELECT doc_id, pos, md5(CAST(chunk AS BINARY)) AS chunk_md5 FROM {docs}, LATERAL word_windows(text, 120)", docs=docs)


HEADLINES_SQL = """WITH t AS (SELECT doc_id, text, string_split(text, chr(10))[2] AS h, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents),
p AS (SELECT *, CASE WHEN n >= 50 AND h IS NOT NULL AND h <> '' THEN strpos(text, h) - 1 ELSE 0 END AS cut_ FROM t),
c AS (SELECT doc_id, text[:cut_] AS a, text[cut_ + 1:] AS b, cut_ FROM p),
k AS (SELECT *, len(list_filter(regexp_split_to_array(a, '\\s+'), lambda x: x <> '')) AS na, len(list_filter(regexp_split_to_array(b, '\\s+'), lambda x: x <> '')) AS nb FROM c),
e AS (SELECT doc_id, CASE WHEN cut_ = 0 THEN 1 WHEN na >= 50 OR nb >= 50 THEN 2 ELSE 1 END AS chunks FROM k)
SELECT doc_id, chunks FROM e"""


@query(HEADLINES_SQL)
def headline_counts(spark: SparkSession, d: str) -> DataFrame:
    """A document's second line as its headline: how many chunks of 50 words or more it makes, a last short one included."""
    docs = table(spark, d, "documents")
    heads = F.get(F.split("text", "\n"), F.lit(1))
    docs = docs.select("doc_id", "text", F.when(heads.isNotNull() & (heads != ""), F.array(heads)).alias("headlines"))
    return splitters.headline_chunks(docs, 50, 1_000_000, "doc_id").where("pos = 0 OR chunk <> ''").groupBy("doc_id").agg(F.count("*").cast("int").alias("chunks"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders)
SELECT o_orderkey, year(o_orderdate) AS placed_year, strftime(CAST(o_orderdate AS DATE) + 3, '%d/%m/%Y') AS shipped, strftime(CAST(o_orderdate AS DATE) + 1, '%d/%m/%Y') AS first_step, 2 AS steps,
strftime(CAST(o_orderdate AS DATE) + 7, '%d/%m/%Y') AS paid, 'date date date string' AS types, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderstatus = 'F' THEN '?' ELSE '' END AS note FROM o""")
def nested_dates(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as JSON lines with dates in a struct, an array of structs and a map; read again they are dates, but for a place where some are none."""
    day = F.col("o_orderdate").cast("date")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    step = lambda n: F.struct(F.lit(n).alias("n"), text(F.date_add(day, n)).alias("at"))
    rows = table(spark, d, "orders").select(
        "o_orderkey",
        F.struct(text(day).alias("placed"), F.struct(text(F.date_add(day, 3)).alias("at")).alias("shipped")).alias("times"),
        F.array(step(1), step(2)).alias("steps"),
        F.create_map(F.lit("paid"), text(F.date_add(day, 7))).alias("dates"),
        F.concat(text(day), F.when(F.col("o_orderstatus") == "F", F.lit("?")).otherwise(F.lit(""))).alias("note"),
    )
    catalog = FolderCatalog(spark, new_path(spark, "catalog"))
    catalog.save(rows, "orders")
    schema_ = "o_orderkey long, times struct<placed: string, shipped: struct<at: string>>, steps array<struct<n: int, at: string>>, dates map<string, string>, note string"
    back = catalog.load("orders", schema=schema_)
    shipped, first, paid = F.col("times.shipped.at"), F.get("steps", F.lit(0))["at"], F.col("dates")["paid"]
    shown = lambda c: F.date_format(c, "dd/MM/yyyy")
    return back.select(
        "o_orderkey",
        F.year("times.placed").cast("long").alias("placed_year"),
        shown(shipped).alias("shipped"),
        shown(first).alias("first_step"),
        F.size("steps").alias("steps"),
        shown(paid).alias("paid"),
        F.concat_ws(" ", F.typeof(shipped), F.typeof(first), F.typeof(paid), F.typeof("note")).alias("types"),
        "note",
    )


@query("""SELECT conv_id, turn, coalesce(bool_or(role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ai_seen FROM conversations""")
def earlier_ai_seen(spark: SparkSession, d: str) -> DataFrame:
    return schema.ai_seen_before(table(spark, d, "conversations")).select("conv_id", "turn", "ai_seen")


@query("SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 9) AS share FROM documents GROUP BY lang")
def class_shares(spark: SparkSession, d: str) -> DataFrame:
    return sampling.class_shares(table(spark, d, "documents"), "lang").select("lang", "n", F.round("share", 9).alias("share"))


@query()
def walked_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of paths of up to three edges; communities of more than 1000 paths are walked at random, which is the feature."""
    e = table(spark, d, "embeddings")
    edges = written(graph.similarity_edges(pairs.cosine_pairs(e, 0.4, "vec_id", "embedding"), "similar"), "similar")
    nodes = e.select(F.col("vec_id").cast("string").alias("id"), F.lit("document").alias("type"))
    return graph.indirect_clusters(graph.Graph(nodes, edges), 3)


@query("""WITH l AS (SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS at_ FROM events WHERE value IS NOT NULL GROUP BY 1),
c AS (SELECT user_id, max(event_id) AS call_ FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT l.user_id, l.value FROM l LEFT JOIN c ON l.user_id = c.user_id WHERE call_ IS NULL OR at_ > call_""")
def final_answers(spark: SparkSession, d: str) -> DataFrame:
    """Values that come later than a user's last click."""
    return records.last_after(table(spark, d, "events"), "user_id", "event_id", "value", F.col("event_type") == "click")


@query("""SELECT p_partkey, p_name || CASE WHEN p_size % 4 = 0 THEN '' ELSE '|' || p_brand END || '|' || p_type AS contexts FROM part""")
def search_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Search results in JSON: chunks, one of them at times empty, web pages, and what a graph found, which goes."""
    item = lambda name, c: F.struct(c.alias(name))
    second = F.when(F.col("p_size") % 4 == 0, F.lit("")).otherwise(F.col("p_brand"))
    found = F.struct(
        F.array(item("text", F.col("p_name")), item("text", second)).alias("chunk_search_results"),
        F.array(item("text", F.col("p_brand"))).alias("graph_search_results"),
        F.array(item("snippet", F.col("p_type")), item("snippet", F.lit(None).cast("string"))).alias("web_search_results"),
    )
    return table(spark, d, "part").select("p_partkey", F.array_join(records.search_contexts(F.to_json(found)), "|").alias("contexts"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_size % 3 = 0 THEN 0.0 ELSE 1.0 END AS labels, CASE WHEN p_size % 5 = 0 THEN 0.0 WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END AS priority FROM part""")
def label_matches(spark: SparkSession, d: str) -> DataFrame:
    """Predictions in JSON, some cut off, with labels in another order and at times one too few."""
    size = F.col("p_size")
    labels = F.when(size % 3 == 0, F.array("p_type")).otherwise(F.array("p_type", "p_brand", "p_type"))
    whole = F.to_json(F.struct(labels.alias("labels"), F.when(size % 2 == 0, F.lit("P1")).otherwise(F.lit("P2")).alias("priority")))
    told = F.when(size % 5 == 0, F.substring(whole, 1, 12)).otherwise(whole)
    return table(spark, d, "part").select(
        "p_partkey",
        aggregate.labels_match(told, F.concat(F.lit(" "), "p_brand", F.lit(" ; "), "p_type", F.lit(";"))).alias("labels"),
        aggregate.field_match(told, "priority", F.lit("P1")).alias("priority"),
    )


@query("""SELECT n_nationkey, 'Say it.' || chr(10) || 'Answer with one JSON object of these fields: word string'
|| CASE WHEN n_regionkey > 0 THEN chr(10) || chr(10) || 'Example 1' || chr(10) || 'Input: {"r":' || n_regionkey || '}' || chr(10) || 'Output: {"word":"w"}' ELSE '' END
|| chr(10) || chr(10) || 'Task: say' || chr(10) || 'Input: {"name":"' || n_name || '"}' || chr(10) || 'Output: ' AS prompt FROM nation""")
def prompts_with_own_examples(spark: SparkSession, d: str) -> DataFrame:
    """Each row brings its own examples, or none."""
    example = F.struct(F.to_json(F.struct(F.col("n_regionkey").alias("r"))).alias("input"), F.lit('{"word":"w"}').alias("output"))
    shown = F.when(F.col("n_regionkey") > 0, F.array(example))
    return table(spark, d, "nation").select("n_nationkey", Prompt("say", "Say it.", "word string").render_each(shown, name=F.col("n_name")).alias("prompt"))


@query("""WITH o AS (SELECT user_id, event_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),
s AS (SELECT *, sum(CASE WHEN b IS NULL OR ts - b >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, count(*) AS turns, string_agg(event_type, ',' ORDER BY event_id) AS roles, min(event_id) AS first_turn FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def conversations_with_state(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of turns: the conversations that are over, six hours after their last turn."""
    schema_ = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema_).parquet(f"{d}/events.parque[t]")  # a pattern: the table may be one file
    found = stateful.assembled_conversations(stream, "ts", "user_id", "event_id", "event_type", "event_type", "6 hours", "10 minutes")
    held = stateful.run_once(spark, found, "conversations")
    turns = F.col("turns")
    return held.select("user_id", F.size(turns).cast("long").alias("turns"), F.array_join(turns["role"], ",").alias("roles"), F.array_min(turns["turn"]).alias("first_turn"))
