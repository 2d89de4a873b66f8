"""Tables that are saved and read again, batches, scenarios, chunks, examples, custom scores and extracted properties as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector
from ..operators import aggregate, graph, retrieval, sampling, schema, testset
from ..sources import catalog, records
from ..sources.shared import new_path, spread
from ..streaming import continuous
from . import align, generate
from .evaluate import METRICS, custom_metric, run_experiment
from .judge_queries import JUDGE
from .queries import EMB, MD5, WORDS, geography, query, table


@query("SELECT p_partkey, p_name, p_size, p_brand, p_type FROM part")
def jsonl_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Parts saved as JSON lines and loaded again."""
    made = F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    store = catalog.registry["local/jsonl"](spark, new_path(spark, "catalog"))
    store.save(table(spark, d, "part").select("p_partkey", "p_name", "p_size", made.alias("made")), "parts")
    (name,) = store.names()
    loaded = store.load(name)
    return loaded.select("p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size"), F.col("made.brand").alias("p_brand"), F.col("made.type").alias("p_type"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5, lang FROM documents""")
def csv_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, with their line ends and quotes, saved as CSV and loaded again."""
    store = catalog.registry["local/csv"](spark, new_path(spark, "catalog"))
    store.save(table(spark, d, "documents").select("doc_id", "text", "lang"), "texts", "experiments")
    return store.load("texts", "experiments").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang")


@query("SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders")
def saved_graph(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "graph")
    geography(spark, d).save(path)
    return graph.Graph.load(spark, path).edges.select("src", "dst")


@query("SELECT p_partkey AS row_id, p_name AS user_input, p_brand AS response, p_type AS reference FROM part")
def renamed_columns(spark: SparkSession, d: str) -> DataFrame:
    """A user's names, and older ones, become the current ones; only what a metric declares stays."""
    rows = table(spark, d, "part").withColumnsRenamed({"p_name": "question", "p_brand": "mine", "p_type": "ground_truth"})
    mapped = schema.to_current_names(schema.rename(rows, {"row_id": "p_partkey", "response": "mine"}))
    return schema.project(mapped, ["user_input", "response", "reference:optional", "rubrics:optional"], "row_id")


@query("""WITH h AS (SELECT *, CAST(p_size % 3 = 0 AS INT) + CAST(p_size % 2 = 0 AS INT) AS k FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN -1.0 ELSE round(2 * k / 5, 6) END AS data_compare_score, round(k / 3, 6) AS row_precision, round(k / 2, 6) AS column_recall FROM h""")
def csv_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two rows as CSV against three; sizes decide which of the cells agree."""
    size, end = F.col("p_size"), F.lit("\n")
    reference = F.concat(F.lit("a,b\n"), size, F.lit(","), "p_brand", end, "p_partkey", F.lit(",x\n"))
    first = F.when(size % 3 == 0, size).otherwise(size + 1)
    response = F.concat(F.lit("A, b\n"), first, F.lit(","), "p_brand", end, "p_partkey", F.when(size % 2 == 0, F.lit(",x\n")).otherwise(F.lit(",y\n")), F.lit("7,z\n"))
    rows = spread(table(spark, d, "part").select("p_partkey", "p_size", "p_brand")).select("p_partkey", reference.alias("reference"), response.alias("response"))
    of = lambda mode, metric: F.round(records.compared_csv(F.col("reference"), F.col("response"), mode, metric), 6)
    score = F.nanvl(F.round(METRICS["data_compare_score"].score(), 6), F.lit(-1.0))
    return rows.select("p_partkey", score.alias("data_compare_score"), of("rows", "precision").alias("row_precision"), of("columns", "recall").alias("column_recall"))


#: Each row at its share of the way through its class; of equals the smaller class first.
PLACES = f"""r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {MD5}, doc_id) - 1 AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels),
p AS (SELECT doc_id, row_number() OVER (ORDER BY (2 * r + 1) / n, quality) - 1 AS p, count(*) OVER () AS total FROM r)"""


@query(f"WITH {PLACES} SELECT doc_id, p // 16 AS batch FROM p WHERE p // 16 < total // 16")
def proportional_batches(spark: SparkSession, d: str) -> DataFrame:
    return sampling.proportional_batches(table(spark, d, "labels"), 16, "quality", "doc_id", drop_last=True).select("doc_id", "batch")


@query(f"WITH {PLACES} SELECT doc_id, p // 16 AS batch FROM p UNION ALL SELECT doc_id, total // 16 FROM p WHERE total % 16 > 0 AND p < 16 - total % 16")
def refilled_batches(spark: SparkSession, d: str) -> DataFrame:
    return sampling.proportional_batches(table(spark, d, "labels"), 16, "quality", "doc_id", refill=True).select("doc_id", "batch")


@query(f"SELECT doc_id, quality FROM labels ORDER BY {MD5}, doc_id LIMIT 50")
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    """The feature is the sample."""
    return sampling.sample(table(spark, d, "labels"), 50, "doc_id").select("doc_id", "quality")


@query("""WITH m AS (SELECT doc_id AS id, persona, style, length, doc_id || '|' || persona || '|' || style || '|' || length AS k FROM documents
JOIN (VALUES ('editor', ['en', 'src1']), ('student', ['fr', 'src2'])) AS p(persona, themes) ON list_contains(themes, lower(lang)) OR list_contains(themes, lower(source)),
(VALUES ('MISSPELLED'), ('PERFECT_GRAMMAR'), ('POOR_GRAMMAR'), ('WEB_SEARCH_LIKE')) AS s(style), (VALUES ('LONG'), ('MEDIUM'), ('SHORT')) AS l(length))
SELECT id, persona, style, length FROM m ORDER BY md5('42:' || k), k LIMIT 300""")
def diverse_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """The feature is the sample: 300 scenarios of documents' languages and sources."""
    personas = spark.createDataFrame([("editor", ["EN", "src1"]), ("student", ["Fr", "SRC2"])], "persona string, persona_themes array<string>")
    combinations = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("combination"))
    return testset.diverse_scenarios(combinations, personas, 300).select("id", "persona", "style", "length")


CHUNKS = """c0 AS (SELECT doc_id, text AS t, unnest(range(0, greatest(0, length(text) - 101) + 1, 900)) AS a FROM documents WHERE length(text) > 0),
c1 AS (SELECT doc_id, a // 900 AS chunk, substring(t, a + 1, 1000) AS text FROM c0), c AS (SELECT text, min({d: doc_id, c: chunk}) AS f FROM c1 GROUP BY text),
docs AS (SELECT f.d * 1000 + f.c AS doc_id, text FROM c)"""
TERMS = "SELECT {0}, token, count(*) AS n FROM (SELECT {0}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM {1}) GROUP BY ALL"


@query(f"WITH {CHUNKS} SELECT doc_id // 1000 AS doc_id, CAST(doc_id % 1000 AS INTEGER) AS chunk, md5(text) AS text_md5 FROM docs")
def overlapping_chunks(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.chunked(table(spark, d, "documents")).select("doc_id", "chunk", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {CHUNKS}, d AS ({TERMS.format("doc_id", "docs")}), q AS ({TERMS.format("item_id", "benchmark")}), l AS (SELECT doc_id, sum(n) AS len FROM d GROUP BY 1), z AS (SELECT count(*) AS nn, avg(len) AS av FROM l),
f AS (SELECT token, count(*) AS df FROM d GROUP BY 1),
h AS (SELECT item_id, doc_id, sum(q.n * ln(1 + (nn - df + 0.5) / (df + 0.5)) * d.n * 2.5 / (d.n + 1.5 * (0.25 + 0.75 * len / av))) AS s FROM q JOIN d USING (token) JOIN f USING (token) JOIN l USING (doc_id), z GROUP BY ALL)
SELECT item_id, doc_id AS chunk_id, CAST(rk AS INTEGER) AS rank, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS rk FROM h) WHERE rk <= 3""")
def bm25_of_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = retrieval.chunked(table(spark, d, "documents")).select((F.col("doc_id") * 1000 + F.col("chunk")).alias("chunk_id"), "text")
    out = retrieval.bm25_top_k(chunks, table(spark, d, "benchmark"), 3, doc="chunk_id", query="item_id")
    return out.select("item_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


@query(f"""WITH {EMB}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS example_id, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON b.vec_id % 100 <> 0 WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, example_id) AS rk FROM s WHERE sim >= 0.35), f AS (SELECT * FROM r WHERE rk <= 4),
b AS (SELECT vec_id AS example_id, row_number() OVER (ORDER BY vec_id DESC) AS rk FROM e WHERE vec_id % 100 <> 0 QUALIFY rk <= 4)
SELECT query_id, example_id, round(sim, 6) AS similarity, CAST(rk AS INTEGER) AS rank FROM f
UNION ALL SELECT vec_id, b.example_id, NULL, CAST(b.rk AS INTEGER) FROM e, b WHERE vec_id % 100 = 0 AND vec_id NOT IN (SELECT query_id FROM f)""")
def examples_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    out = align.examples_with_fallback(queries, e.where("vec_id % 100 <> 0").select(F.col("vec_id").alias("example_id"), "embedding"), 4, 0.35)
    return out.select("query_id", "example_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""WITH {EMB} SELECT a.vec_id, CASE WHEN a.label % 2 = 1 THEN 0.0 ELSE round((list_cosine_similarity(a.v, b.v) + list_cosine_similarity(a.v, c.v)) / 2, 6) END AS score
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2""")
def answer_relevancy(spark: SparkSession, d: str) -> DataFrame:
    """The next two vectors are those of the questions that were made from an answer; odd labels are noncommittal."""
    e = table(spark, d, "embeddings")
    ahead = lambda n: e.select((F.col("vec_id") - n).alias(f"_{n}"), F.col("embedding").alias(f"v{n}"))
    rows = e.join(ahead(1), F.col("vec_id") == F.col("_1")).join(ahead(2), F.col("vec_id") == F.col("_2"))
    odd = F.col("label") % 2
    return rows.select("vec_id", F.round(vector.answer_relevancy(F.col("embedding"), F.array("v1", "v2"), F.array(odd, odd)), 6).alias("score"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 > 1 THEN round(1 / (p_size % 7), 6) END AS "value",
CASE p_size % 7 WHEN 0 THEN 'ZeroDivisionError: division by zero' WHEN 1 THEN 'outside the domain: 1.0' END AS reason FROM part""")
def custom_scores(spark: SparkSession, d: str) -> DataFrame:
    def inverse(size):  # noqa: ANN001, ANN202
        return 1 / (size % 7)

    score = custom_metric(inverse, "double", (0.0, 0.5))(size=F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", score.alias("s")).select("p_partkey", F.round("s.value", 6).alias("value"), "s.reason")


@query("""SELECT CASE WHEN p_size % 7 > 0 THEN p_partkey END AS p_partkey, CASE WHEN p_size % 7 > 0 THEN length(p_name) END AS letters, CASE WHEN p_size % 7 = 0 THEN 'ValueError: seven' END AS error
FROM part WHERE p_size % 5 > 0""")
def experiment_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of which some are left out and some fail."""

    def measure(row: dict) -> dict | None:
        if row["p_size"] % 5 == 0:
            return None
        if row["p_size"] % 7 == 0:
            raise ValueError("seven")
        return {"p_partkey": row["p_partkey"], "letters": len(row["p_name"])}

    return run_experiment(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), measure, "p_partkey long, letters long")


@query(f"""WITH {WORDS}, t AS (SELECT documents.doc_id, w, array_to_string(w, ' ') AS t FROM documents JOIN w ON documents.doc_id = w.doc_id WHERE trim(text) <> '')
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN len(w) > 0 THEN array_to_string(w[1:4], ' ') END AS title,
CASE WHEN len(w) > 0 THEN md5(array_to_string(list_filter(string_split(rtrim(t, '.'), '. '), lambda x: trim(x) <> '')[1:2], '. ')) END AS summary_md5 FROM t""")
def extracted_properties(spark: SparkSession, d: str) -> DataFrame:
    """Titles and summaries of documents by the stand-in judge."""
    nodes = generate.document_nodes(table(spark, d, "documents"))
    g = generate.transformed(nodes, [[generate.extract("title", JUDGE), generate.extract("summary", JUDGE)]])
    return g.nodes.select("id", "title", F.md5(F.col("summary").cast("binary")).alias("summary_md5"))


@query("""WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), s AS (SELECT *, sum(CASE WHEN b IS NULL OR ts - b > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", string_agg(event_id || ' ' || event_type, ',' ORDER BY event_id) AS turns FROM s GROUP BY user_id, k""")
def assembled_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = continuous.conversations(table(spark, d, "events"), "ts", "user_id", "event_id", "event_type", "props")
    said = F.transform("turns", lambda t: F.concat_ws(" ", t["turn"].cast("string"), t["role"]))
    return out.select("user_id", "start", "end", F.array_join(said, ",").alias("turns"))


CHECKED = "c AS (SELECT 'level ' || user_id % 3 AS level, event_type <> 'error' AS ok, 'kind ' || event_id % 3 || ': row ' || event_id AS error, CASE WHEN event_id % 4 > 0 THEN value END AS seconds FROM events)"


def checked_queries(spark: SparkSession, d: str) -> DataFrame:
    level, error = F.concat(F.lit("level "), F.col("user_id") % 3), F.concat(F.lit("kind "), F.col("event_id") % 3, F.lit(": row "), "event_id")
    return table(spark, d, "events").select(level.alias("level"), (F.col("event_type") != "error").alias("valid"), error.alias("error"), F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("seconds"))


@query(f"""WITH {CHECKED} SELECT level, grouping(level) = 1 AS overall, count(*) AS total, count(*) FILTER (WHERE ok) AS "valid", round(count(*) FILTER (WHERE ok) / count(*), 6) AS "share", round(avg(seconds), 6) AS seconds
FROM c GROUP BY ROLLUP (level)""")
def sql_checks_by_level(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate.validation_slices(checked_queries(spark, d), "level")
    return out.select("level", "overall", "total", "valid", F.round("share", 6).alias("share"), F.round("seconds", 6).alias("seconds"))


@query(f"WITH {CHECKED} SELECT string_split(error, ':')[1] AS kind, count(*) AS n FROM c WHERE NOT ok GROUP BY 1")
def sql_error_kinds(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.error_kinds(checked_queries(spark, d))


#: The last fifth of the shuffled labels.
TEST_PART = f"t AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {MD5}, doc_id) - 1 AS k FROM labels) WHERE k >= CAST(floor((SELECT count(*) FROM labels) * 0.8) AS BIGINT))"


@query(f"WITH {TEST_PART} SELECT round(corr(quality, toxic), 6) AS pearson, round(avg(power(quality - toxic, 2)), 6) AS mse FROM t")
def numeric_alignment_of_test_part(spark: SparkSession, d: str) -> DataFrame:
    out = align.align_numeric(table(spark, d, "labels"), lambda test, train: test.withColumn("pred", F.col("toxic")), "doc_id", "quality")
    return out.select(F.round("pearson", 6).alias("pearson"), F.round("mse", 6).alias("mse"))
