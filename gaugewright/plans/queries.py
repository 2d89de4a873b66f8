"""The operators as queries over the driver's tables, each over whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ngram, sets, text, vector
from ..operators import aggregate, graph, judge, pairs, retrieval, sampling, schema, splitters, testset, tools
from ..sources import records
from ..sources.shared import written
from ..streaming import continuous
from . import align, evaluate, model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adjacent_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text as a reference, the next one's as the response."""
    docs = table(spark, d, "documents")
    after = docs.select((F.col("doc_id") - 1).alias("_id"), F.col("text").alias("response"))
    return docs.select(F.col("doc_id").alias("row_id"), "lang", F.col("text").alias("reference")).join(after, F.col("row_id") == F.col("_id")).drop("_id")


ADJACENT = "adj AS (SELECT a.doc_id AS row_id, a.lang, a.text AS reference, b.text AS response FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


@query(f"""WITH {ADJACENT} SELECT lang, round(avg(CASE WHEN reference = response THEN 1.0 ELSE 0.0 END), 6) AS exact_match,
round(avg(CASE WHEN contains(response, reference) THEN 1.0 ELSE 0.0 END), 6) AS string_present,
round(avg(1 - least(length(response), length(reference)) / (length(reference) + 1e-10)), 6) AS conciseness FROM adj GROUP BY ROLLUP (lang)""")
def evaluate_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = adjacent_documents(spark, d)
    concise = evaluate.Metric("conciseness", ["reference", "response"], lambda: text.conciseness(F.col("response"), F.col("reference")))
    out = evaluate.evaluate(rows, ["exact_match", "string_present", concise]).summary(["lang"])
    return out.select("lang", *[F.round(c, 6).alias(c) for c in ("exact_match", "string_present", "conciseness")])


@query("""SELECT p_partkey, CASE WHEN p_name = p_type THEN 1.0 ELSE 0.0 END AS exact_match, CASE WHEN contains(p_name, lower(p_type)) THEN 1.0 ELSE 0.0 END AS string_present,
round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS levenshtein,
round(1 - (greatest(length(p_name), length(p_type)) - len(list_filter(range(1, least(length(p_name), length(p_type)) + 1), lambda i: p_name[i] = p_type[i]))) / greatest(length(p_name), length(p_type)), 6) AS hamming FROM part""")
def string_metrics(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, d, "part").select(
        "p_partkey",
        text.exact_match(a, b).alias("exact_match"),
        text.string_present(F.lower(b), a).alias("string_present"),
        F.round(text.levenshtein_similarity(a, b), 6).alias("levenshtein"),
        F.round(text.hamming_similarity(a, b), 6).alias("hamming"),
    )


@query("SELECT p_partkey, round(jaro_similarity(p_name, p_type || p_brand), 6) AS jaro, round(jaro_winkler_similarity(p_name, lower(p_type)), 6) AS jaro_winkler FROM part")
def jaro_metrics(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.round(text.jaro_similarity(a, F.concat("p_type", "p_brand")), 6).alias("jaro"), F.round(text.jaro_winkler_similarity(a, F.lower("p_type")), 6).alias("jaro_winkler"))


@query()
def ngram_metrics(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    after = turns.select(F.col("conv_id").alias("_c"), (F.col("turn") - 1).alias("_t"), F.col("text").alias("response"))
    rows = turns.join(after, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")))
    a, b = F.col("text"), F.col("response")
    return rows.select("conv_id", "turn", ngram.bleu_score(a, b).alias("bleu"), ngram.chrf_score(a, b).alias("chrf"), ngram.rouge_score(a, b).alias("rouge_l"), ngram.rouge_score(a, b, "rouge1").alias("rouge_1"))


ID_SETS = "sets AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS got, list(DISTINCT CASE WHEN l_quantity > 25 THEN l_partkey WHEN l_discount > 0.05 THEN l_partkey + 1 END) FILTER (WHERE l_quantity > 25 OR l_discount > 0.05) AS want FROM lineitem GROUP BY l_orderkey)"


def id_sets(spark: SparkSession, d: str) -> DataFrame:
    want = F.when(F.col("l_quantity") > 25, F.col("l_partkey")).when(F.col("l_discount") > 0.05, F.col("l_partkey") + 1)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("got"), F.collect_set(want).alias("want"))


@query(f"""WITH {ID_SETS} SELECT l_orderkey, round(len(list_intersect(got, want)) / len(got), 6) AS precision_, round(CASE WHEN want IS NULL THEN NULL ELSE len(list_intersect(got, want)) / len(want) END, 6) AS recall_ FROM (SELECT l_orderkey, got, want FROM sets WHERE want IS NOT NULL)
UNION ALL SELECT l_orderkey, 0.0, CAST(NULL AS DOUBLE) FROM sets WHERE want IS NULL""")
def id_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    p, r = sets.id_precision(F.col("got"), F.col("want")), sets.id_recall(F.col("got"), F.col("want"))
    return id_sets(spark, d).select("l_orderkey", F.round(p, 6).alias("precision_"), F.round(F.when(~F.isnan(r), r), 6).alias("recall_"))


@query(f"""WITH {ID_SETS} SELECT l_orderkey, round(CASE WHEN hits = 0 THEN 0.0 ELSE 5 * hits / (5 * hits + 4 * (n_want - hits) + (n_got - hits)) END, 6) AS f2 FROM (
SELECT l_orderkey, coalesce(len(list_intersect(got, want)), 0) AS hits, len(got) AS n_got, coalesce(len(want), 0) AS n_want FROM sets)""")
def f_beta_scores(spark: SparkSession, d: str) -> DataFrame:
    tp = F.size(F.array_intersect("got", "want"))
    return id_sets(spark, d).select("l_orderkey", F.round(sets.f_beta(tp, F.size("got") - tp, F.size("want") - tp, 2.0), 6).alias("f2"))


@query(f"WITH {ID_SETS} SELECT l_orderkey, round(coalesce(len(list_intersect(got, want)), 0) / (coalesce(len(want), 0) + 1e-8), 6) AS score FROM sets")
def entity_recall(spark: SparkSession, d: str) -> DataFrame:
    return id_sets(spark, d).select("l_orderkey", F.round(sets.entity_recall(F.col("want"), F.col("got")), 6).alias("score"))


ORDERED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)"


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as ranked contexts or statements of a row."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_linestatus")
    return lines.select(F.col("l_orderkey").alias("row_id"), F.row_number().over(w).alias("ctx_pos"), (F.col("l_discount") > 0.05).cast("int").alias("verdict"), "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_linestatus", "l_suppkey", "l_partkey")


AP_SQL = f"""WITH v AS (SELECT l_orderkey, {ORDERED} AS rk, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS rel FROM lineitem),
p AS (SELECT *, sum(rel) OVER (PARTITION BY l_orderkey ORDER BY rk) AS seen FROM v)
SELECT l_orderkey AS row_id, round(sum(rel * seen / rk) / (sum(rel) + 1e-10), 6) AS score FROM p GROUP BY l_orderkey"""


@query(AP_SQL)
def context_precision(spark: SparkSession, d: str) -> DataFrame:
    return judge.context_precision(verdicts(spark, d)).select("row_id", F.round("score", 6).alias("score"))


@query(AP_SQL)
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    rows = verdicts(spark, d).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("ctx_pos", "verdict"))).alias("v"))
    return rows.select("row_id", F.round(sets.average_precision(F.col("v.verdict")), 6).alias("score"))


@query("SELECT l_orderkey AS row_id, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS score FROM lineitem GROUP BY l_orderkey")
def faithfulness(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), (F.col("l_discount") > 0.05).cast("int").alias("verdict"))
    return judge.supported_share(rows).select("row_id", F.round("score", 6).alias("score"))


@query("""SELECT row_id, round(0.75 * CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fn + fp) END + 0.25 * coalesce(o_totalprice / 1000000, 0), 6) AS score FROM (
SELECT l_orderkey AS row_id, count(*) FILTER (WHERE l_returnflag = 'A') AS tp, count(*) FILTER (WHERE l_returnflag = 'N') AS fp, count(*) FILTER (WHERE l_returnflag = 'R') AS fn FROM lineitem GROUP BY l_orderkey)
LEFT JOIN orders ON row_id = o_orderkey""")
def answer_correctness(spark: SparkSession, d: str) -> DataFrame:
    names = F.when(F.col("l_returnflag") == "A", "TP").when(F.col("l_returnflag") == "N", "FP").when(F.col("l_returnflag") == "R", "FN")
    classes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), names.alias("class"))
    similarity = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 1000000).alias("similarity"))
    return judge.answer_correctness(classes, similarity).select("row_id", F.round("score", 6).alias("score"))


@query("""SELECT row_id, round(CASE WHEN p + r = 0 THEN 0.0 ELSE round_even(2 * p * r / (p + r), 2) END, 2) AS score FROM (
SELECT row_id, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r FROM (
SELECT l_orderkey AS row_id, count(*) FILTER (WHERE l_linestatus = 'O' AND l_discount > 0.05) AS tp, count(*) FILTER (WHERE l_linestatus = 'O' AND l_discount <= 0.05) AS fp, count(*) FILTER (WHERE l_linestatus <> 'O' AND l_discount <= 0.05) AS fn FROM lineitem GROUP BY l_orderkey))""")
def factual_correctness(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("l_linestatus") == "O", "response").otherwise("reference")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), side.alias("direction"), (F.col("l_discount") > 0.05).cast("int").alias("verdict"))
    return judge.factual_correctness(rows)


NOISE_SQL = """WITH v AS (SELECT l_orderkey AS row_id, l_suppkey % 3 AS ctx_pos, l_partkey % 4 AS stmt_pos, CASE WHEN l_linestatus = 'O' THEN 'answer' ELSE 'reference' END AS side, max(CASE WHEN l_discount > 0.03 THEN 1 ELSE 0 END) AS verdict FROM lineitem GROUP BY ALL),
c AS (SELECT l_orderkey AS row_id, l_partkey % 4 AS stmt_pos, max(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS correct FROM lineitem GROUP BY ALL),
rel AS (SELECT row_id, ctx_pos, max(verdict) AS relevant FROM v WHERE side = 'reference' GROUP BY ALL),
s AS (SELECT v.row_id, v.stmt_pos, max(CASE WHEN relevant = 1 THEN verdict ELSE 0 END) AS by_rel FROM v LEFT JOIN rel ON v.row_id = rel.row_id AND v.ctx_pos = rel.ctx_pos WHERE side = 'answer' GROUP BY ALL)
SELECT c.row_id, round(avg(CASE WHEN coalesce(by_rel, 0) = 1 AND correct = 0 THEN 1.0 ELSE 0.0 END), 6) AS score FROM c LEFT JOIN s ON c.row_id = s.row_id AND c.stmt_pos = s.stmt_pos GROUP BY c.row_id"""


@query(NOISE_SQL)
def noise_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), (F.col("l_suppkey") % 3).alias("ctx_pos"), (F.col("l_partkey") % 4).alias("stmt_pos"), F.when(F.col("l_linestatus") == "O", "answer").otherwise("reference").alias("side"), "l_discount", "l_tax")
    v = lines.groupBy("row_id", "ctx_pos", "stmt_pos", "side").agg(F.max((F.col("l_discount") > 0.03).cast("int")).alias("verdict"))
    c = lines.groupBy("row_id", "stmt_pos").agg(F.max((F.col("l_tax") > 0.04).cast("int")).alias("correct"))
    return judge.noise_sensitivity(v, c).select("row_id", F.round("score", 6).alias("score"))


@query("""SELECT row_id, round(2 * p * r / (p + r + 1e-10), 6) AS score FROM (SELECT row_id, tp / (tp + fp + 1e-10) AS p, tp / (tp + fn + 1e-10) AS r FROM (
SELECT l_orderkey AS row_id, count(*) FILTER (WHERE l_discount > 0.03 AND l_tax > 0.04) AS tp, count(*) FILTER (WHERE l_discount > 0.03 AND l_tax <= 0.04) AS fp, count(*) FILTER (WHERE l_discount <= 0.03 AND l_tax > 0.04) AS fn FROM lineitem GROUP BY 1))""")
def topic_adherence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), (F.col("l_discount") > 0.03).alias("answered"), (F.col("l_tax") > 0.04).alias("in_reference"))
    return judge.topic_adherence(rows).select("row_id", F.round("score", 6).alias("score"))


@query("SELECT user_id AS row_id, round(avg(CASE WHEN event_type <> 'error' THEN event_id % 5 / 4 END), 6) AS score FROM events GROUP BY user_id")
def dual_judge_ratings(spark: SparkSession, d: str) -> DataFrame:
    rating = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise((F.col("event_id") % 5).cast("double"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("row_id"), rating.alias("rating"))
    return judge.dual_judge(rows, 4.0).select("row_id", F.round("score", 6).alias("score"))


@query("""SELECT doc_id, CASE WHEN trim(text) = '' THEN 0.0 WHEN contains(text, source) THEN 0.0 END AS relevance, CASE WHEN trim(text) = '' THEN 0.0 WHEN contains(text, lang) THEN 1.0 END AS groundedness FROM documents""")
def judge_shortcuts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", judge.context_relevance_shortcut(F.col("text"), F.col("source")).alias("relevance"), judge.groundedness_shortcut(F.col("lang"), F.col("text"), "legacy").alias("groundedness"))


EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(f"WITH {EMB} SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.3")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = pairs.cosine_pairs(table(spark, d, "embeddings"), 0.3, "vec_id", "embedding")
    return out.select("src", "dst", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {EMB} SELECT label, round(avg(s), 6) AS similarity, round(avg(CASE WHEN s >= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS reached FROM (SELECT a.label, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON b.vec_id = a.vec_id + 1) GROUP BY label""")
def semantic_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("_id"), F.col("embedding").alias("b"))
    a, b_ = F.col("embedding"), F.col("b")
    rows = e.join(b, F.col("vec_id") == F.col("_id")).select("label", vector.semantic_similarity(a, b_).alias("s"), vector.semantic_similarity(a, b_, 0.1).alias("r"))
    return rows.groupBy("label").agg(F.round(aggregate.nan_mean("s"), 6).alias("similarity"), F.round(aggregate.nan_mean("r"), 6).alias("reached"))


@query(f"""WITH {EMB}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS example_id, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, example_id) AS rk FROM s WHERE sim >= 0.05) SELECT query_id, example_id, round(sim, 6) AS similarity, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 5""")
def few_shot_examples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    out = align.few_shot_examples(q, e.select(F.col("vec_id").alias("example_id"), "embedding"), 5, 0.05)
    return out.select("query_id", "example_id", F.round("similarity", 6).alias("similarity"), "rank")


TOKENS = "tok AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS items FROM documents)"


def token_sets(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.array_distinct(found).alias("items"))


@query(f"""WITH {TOKENS}, n AS (SELECT *, len(items) AS n FROM tok WHERE len(items) > 0), p AS (SELECT a.doc_id AS src, b.doc_id AS dst, a.n AS na, b.n AS nb, len(list_intersect(a.items, b.items)) AS c FROM n a JOIN n b ON a.doc_id < b.doc_id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n)
SELECT src, dst, round(c / (na + nb - c), 6) AS similarity FROM p WHERE c / (na + nb - c) >= 0.8""")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = pairs.jaccard_pairs(token_sets(spark, d), 0.8, "doc_id", "items")
    return out.select("src", "dst", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {TOKENS}, c AS (SELECT item, count(*) AS n FROM (SELECT unnest(items) AS item FROM tok) GROUP BY item), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, item) AS rk, count(*) OVER () AS k FROM c) SELECT item, n FROM r WHERE rk <= greatest(1, floor(k * 0.05))""")
def noisy_items(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.frequent_items(token_sets(spark, d).select(F.explode("items").alias("item")), "item")


@query("""WITH w AS (SELECT DISTINCT p_name AS s FROM part) SELECT a.s AS a, b.s AS b, round(1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)), 6) AS similarity FROM w a JOIN w b ON a.s < b.s WHERE 1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)) >= 0.7 - 1e-12""")
def similar_strings(spark: SparkSession, d: str) -> DataFrame:
    out = pairs.similar_strings(table(spark, d, "part").select("p_name").distinct(), 0.7, "p_name")
    return out.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("""WITH i AS (SELECT DISTINCT l_suppkey AS id, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT item, count(*) AS n FROM i GROUP BY item), noisy AS (SELECT item FROM (SELECT *, row_number() OVER (ORDER BY n DESC, item) AS rk, count(*) OVER () AS k FROM c) WHERE rk <= greatest(1, floor(k * 0.05))),
l AS (SELECT id, lower(item) AS item FROM i WHERE item NOT IN (SELECT item FROM noisy)), s AS (SELECT id, count(*) AS n FROM l GROUP BY id),
h AS (SELECT a.id AS src, b.id AS dst, count(*) AS hits FROM l a JOIN l b ON a.id < b.id AND 1 - levenshtein(a.item, b.item) / greatest(length(a.item), length(b.item)) >= 0.87 GROUP BY ALL)
SELECT src, dst, round(hits / (x.n * y.n), 6) AS score FROM h JOIN s x ON src = x.id JOIN s y ON dst = y.id WHERE hits / (x.n * y.n) >= 0.01""")
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    sold = lines.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    nodes = sold.select(F.col("l_suppkey").alias("id"), "p_brand").distinct().groupBy("id").agg(F.collect_list("p_brand").alias("items"))
    return pairs.overlap_pairs(nodes, 0.01, 0.87, digits=6, overlapped=False)


@query(rf"""SELECT doc_id, regexp_extract_all(text, '{text.EMAILS}') AS emails, len(regexp_extract_all('# ' || text, '(?m)^(#{{1,6}})\s+(.*)$')) AS n_headings, regexp_extract('# ' || text, '(?m)^(#{{1,6}})\s+(.*)$', 2) AS heading FROM documents""")
def extractors(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("marked", F.concat(F.lit("# "), "text"))
    heads = text.headings(F.col("marked"))
    return docs.select("doc_id", text.extract_all(F.col("text"), text.EMAILS).alias("emails"), F.size(heads).cast("long").alias("n_headings"), F.coalesce(F.get(heads, F.lit(0))["title"], F.lit("")).alias("heading"))


@query(r"SELECT page_id, regexp_extract_all(html, '(?i)\b(?:https?://|www\.)\S+\b') AS links FROM pages")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.extract_all(F.col("html"), text.LINKS).alias("links"))


WORDS = r"w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)"


@query(f"WITH {WORDS} SELECT round(avg(CASE WHEN len(w) <= 100 THEN 1.0 ELSE 0.0 END), 6) AS short, round(avg(CASE WHEN len(w) > 100 AND len(w) <= 500 THEN 1.0 ELSE 0.0 END), 6) AS middle, round(avg(CASE WHEN len(w) > 500 THEN 1.0 ELSE 0.0 END), 6) AS long FROM w")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate.length_histogram(table(spark, d, "documents"), F.size(text.words(F.col("text"))))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""WITH {WORDS}, c AS (SELECT doc_id, unnest(range(0, CAST(ceil(len(w) / 200) AS BIGINT))) AS pos, w FROM w) SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(array_to_string(w[pos * 200 + 1 : pos * 200 + 200], ' ')) AS chunk_md5 FROM c""")
def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return splitters.window_chunks(table(spark, d, "documents"), 200, "doc_id").select("doc_id", "pos", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query()
def headline_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("headlines", F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0))
    return splitters.headline_chunks(docs, 100, 300, "doc_id").select("doc_id", "pos", "chunk")


QUOTES = f"""WITH {WORDS}, a AS (SELECT documents.doc_id, 'It says "' || array_to_string(w[3:7], '  ') || '" and "not in any text" and "no".' AS answer, text FROM documents JOIN w ON documents.doc_id = w.doc_id),
s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(answer, '["''`´](.*?)["''`´]', 1), lambda x: lower(trim(regexp_replace(x, '[\\x20\\x09-\\x0D]+', ' ', 'g')))), lambda x: x <> '' AND len(string_split(x, ' ')) >= 3) AS spans, lower(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS t FROM a)
SELECT CAST(sum(len(list_filter(spans, lambda x: contains(t, x)))) AS BIGINT) AS matched, CAST(sum(len(spans)) AS BIGINT) AS total FROM s"""


@query(QUOTES)
def quoted_spans(spark: SparkSession, d: str) -> DataFrame:
    said = F.array_join(F.slice(text.words(F.col("text")), 3, 5), "  ")
    rows = table(spark, d, "documents").select(F.concat(F.lit('It says "'), said, F.lit('" and "not in any text" and "no".')).alias("answer"), F.array("text").alias("sources"))
    hits = rows.select(text.quoted_span_hits(F.col("answer"), F.col("sources")).alias("h"))
    return hits.agg(F.sum("h.matched").cast("long").alias("matched"), F.sum("h.total").cast("long").alias("total"))


CALLS = "c AS (SELECT user_id, list(DISTINCT event_type || props) FILTER (WHERE event_id % 2 = 0) AS p, list(DISTINCT event_type || props) FILTER (WHERE event_id % 2 = 1) AS r FROM events GROUP BY user_id)"


def calls(spark: SparkSession, d: str) -> DataFrame:
    call = F.struct(F.col("event_type").alias("name"), F.from_json("props", "map<string,string>").alias("args"))
    ordered = lambda odd: F.transform(F.array_sort(F.collect_list(F.when(F.col("event_id") % 2 == odd, F.struct("event_id", F.to_json(call).alias("c"))))), lambda x: F.from_json(x["c"], schema.TOOL_CALL))
    return table(spark, d, "events").groupBy("user_id").agg(ordered(0).alias("p"), ordered(1).alias("r"))


@query(f"WITH {CALLS} SELECT user_id, CASE WHEN coalesce(len(p), 0) + coalesce(len(r), 0) = 0 THEN 0.0 ELSE round_even(2 * coalesce(len(list_intersect(p, r)), 0) / (coalesce(len(p), 0) + coalesce(len(r), 0)), 4) END AS f1 FROM c")
def tool_call_f1(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).select("user_id", tools.tool_call_f1(F.col("p"), F.col("r")).alias("f1"))


#: The calls in the order of their names and arguments; the arguments of all have the one key k.
ACCURACY_SQL = """WITH e AS (SELECT user_id, event_id, event_type AS n, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_id % 2 AS odd FROM events),
l AS (SELECT user_id, coalesce(list({n: n, k: k} ORDER BY n, k || '"') FILTER (WHERE odd = 0), []) AS p, coalesce(list({n: n, k: k} ORDER BY n, k || '"') FILTER (WHERE odd = 1), []) AS r FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN len(p) = 0 AND len(r) = 0 THEN 1.0 WHEN len(r) > 0 AND list_transform(p, lambda x: x.n) = list_transform(r, lambda x: x.n)
THEN list_sum(list_transform(list_zip(p, r), lambda z: CASE WHEN z[1].k = z[2].k THEN 1.0 ELSE 0.0 END)) / len(r) ELSE 0.0 END AS sorted_score, 1.0 AS own_score FROM l"""


@query(ACCURACY_SQL)
def tool_call_accuracy(spark: SparkSession, d: str) -> DataFrame:
    same = F.transform("r", lambda c: F.struct(c["name"].alias("name"), F.create_map(F.lit("k"), F.concat(c["args"]["k"], F.lit(""))).alias("args")))
    return calls(spark, d).select("user_id", tools.tool_call_accuracy(F.col("p"), F.col("r"), False).alias("sorted_score"), tools.tool_call_accuracy(same, F.col("r")).alias("own_score"))


@query("""SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Human: ' WHEN role = 'assistant' THEN 'AI: ' END || text, chr(10) ORDER BY turn) AS rendered FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def conversation_render(spark: SparkSession, d: str) -> DataFrame:
    convs = schema.assemble_conversations(table(spark, d, "conversations"))
    return convs.select("conv_id", schema.rendered_conversation(F.col("user_input")).alias("rendered"))


@query("""WITH p AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, count(*) AS turns, CAST(sum(CASE WHEN role = before THEN 1 ELSE 0 END) AS BIGINT) AS repeats, CAST(sum(CASE WHEN role = 'assistant' AND before IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unprompted, count(*) FILTER (WHERE role = 'tool') = 0 AS valid FROM p GROUP BY conv_id""")
def conversation_checks(spark: SparkSession, d: str) -> DataFrame:
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").select("conv_id", "role", before.alias("before"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    counts = rows.groupBy("conv_id").agg(F.count("*").alias("turns"), n(F.col("role") == F.col("before")).alias("repeats"), n((F.col("role") == "assistant") & F.col("before").isNull()).alias("unprompted"))
    held = schema.assemble_conversations(table(spark, d, "conversations")).select("conv_id", schema.valid_conversation(F.col("user_input")).alias("valid"))
    return counts.join(held, "conv_id", "left").withColumn("valid", F.coalesce("valid", F.lit(True)))


@query("""WITH c AS (SELECT quality AS g, 1 - toxic AS p, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), t AS (SELECT sum(n) AS total FROM c), a AS (SELECT g, sum(n) AS a FROM c GROUP BY g), b AS (SELECT p, sum(n) AS b FROM c GROUP BY p)
SELECT round((SELECT sum(n) FROM c WHERE g = p) / total, 6) AS agreement, round(1 - coalesce((SELECT sum(n) FROM c WHERE g <> p), 0) * total / (SELECT sum(a * b) FROM a, b WHERE g <> p), 6) AS kappa FROM t""")
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select("quality", (1 - F.col("toxic")).alias("other"))
    return aggregate.agreement(rows, "quality", "other").select(F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality <> 1 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic <> 0) AS fn, avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END) AS accuracy FROM labels)
SELECT round(accuracy, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision_, round(tp / (tp + fn), 6) AS recall_, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def label_scores(spark: SparkSession, d: str) -> DataFrame:
    out = aggregate.binary_scores(table(spark, d, "labels").withColumn("pred", 1 - F.col("toxic")), "quality", "pred")
    return out.select(F.round("accuracy", 6).alias("accuracy"), F.round("precision", 6).alias("precision_"), F.round("recall", 6).alias("recall_"), F.round("f1", 6).alias("f1"))


@query("""WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) SELECT round(corr(o_totalprice, s), 6) AS pearson, round(avg(power(o_totalprice / 1000 - s / 1000, 2)), 2) AS mse FROM orders JOIN l ON o_orderkey = l_orderkey""")
def numeric_alignment(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    rows = table(spark, d, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.agg(F.round(F.corr("o_totalprice", "s"), 6).alias("pearson"), F.round(aggregate.mse(F.col("o_totalprice") / 1000, F.col("s") / 1000), 2).alias("mse"))


@query("""WITH m AS (SELECT l_suppkey, avg(l_discount) FILTER (WHERE year(l_shipdate) = 1997) AS cur, avg(l_discount) FILTER (WHERE year(l_shipdate) = 1996) AS base FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(cur, 6) AS "current", round(base, 6) AS baseline, round(cur - base, 6) AS delta, (cur - base > 0 OR abs(cur - base) < 0.01) AS passed FROM m WHERE cur IS NOT NULL""")
def baseline_gate(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    year = lambda y: lines.where(F.year("l_shipdate") == y).groupBy("l_suppkey").agg(F.avg("l_discount").alias("score"))
    out = aggregate.baseline_gate(year(1997), year(1996), "l_suppkey", "score")
    return out.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("current", "baseline", "delta")], "passed")


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE year(o_orderdate) = 1997) AS "current", count(*) FILTER (WHERE year(o_orderdate) = 1996) AS baseline, count(*) FILTER (WHERE year(o_orderdate) = 1997) - count(*) FILTER (WHERE year(o_orderdate) = 1996) AS delta FROM orders WHERE year(o_orderdate) IN (1996, 1997) AND o_orderpriority IS NOT NULL GROUP BY 1""")
def category_delta(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return aggregate.category_delta(orders.where(F.year("o_orderdate") == 1997), orders.where(F.year("o_orderdate") == 1996), "o_orderpriority")


@query("""WITH p(model, pi, po) AS (VALUES ('click', 0.5, 1.5), ('error', 1.0, 1.0), ('view', 0.25, 0.75)) SELECT event_type AS model, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, CAST(sum(event_id % 7) AS BIGINT) AS output_tokens, round(sum(event_id % 100) * pi + sum(event_id % 7) * po, 4) AS cost FROM events JOIN p ON event_type = model GROUP BY event_type, pi, po""")
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    usage = table(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"))
    prices = spark.createDataFrame([("click", 0.5, 1.5), ("error", 1.0, None), ("view", 0.25, 0.75)], "model string, input_price double, output_price double")
    return aggregate.cost(usage, prices).withColumn("cost", F.round("cost", 4))


@query("""SELECT coalesce(CAST(json_extract_string(r, '$.usage.input_tokens') AS BIGINT), 0) AS input_tokens, coalesce(json_extract_string(r, '$.model'), '') AS model, count(*) AS n FROM (SELECT '{"model": "m' || (event_id % 3) || '", "usage": ' || CASE WHEN event_type = 'error' THEN '{}' ELSE '{"input_tokens": ' || (event_id % 11) || '}' END || '}' AS r FROM events) GROUP BY 1, 2""")
def usage_parsing(spark: SparkSession, d: str) -> DataFrame:
    usage = F.when(F.col("event_type") == "error", F.lit("{}")).otherwise(F.concat(F.lit('{"input_tokens": '), (F.col("event_id") % 11).cast("string"), F.lit("}")))
    reply = F.concat(F.lit('{"model": "m'), (F.col("event_id") % 3).cast("string"), F.lit('", "usage": '), usage, F.lit("}"))
    parsed = table(spark, d, "events").select(aggregate.parsed_usage(reply, "anthropic").alias("u"))
    return parsed.groupBy(F.col("u.input_tokens").alias("input_tokens"), F.col("u.model").alias("model")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.majority_vote(table(spark, d, "events"), "user_id", "event_id", "event_type")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    return sampling.keep_first(table(spark, d, "documents").select("doc_id", "lang", "text"), "text", "doc_id").select("doc_id", "lang")


MD5 = "md5('42:' || doc_id)"


@query(f"""WITH g AS (SELECT quality, count(*) AS c, sum(count(*)) OVER () AS t FROM labels GROUP BY quality), q AS (SELECT quality, least(c, CAST(round_even(100 * c / t, 0) AS BIGINT)) AS take FROM g),
r AS (SELECT labels.*, take, row_number() OVER (PARTITION BY labels.quality ORDER BY {MD5}, doc_id) AS rn FROM labels JOIN q ON labels.quality = q.quality), s AS (SELECT doc_id, quality FROM r WHERE rn <= take),
rest AS (SELECT doc_id, quality, row_number() OVER (ORDER BY {MD5}, doc_id) AS k FROM r WHERE rn > take) SELECT doc_id, quality FROM s UNION ALL SELECT doc_id, quality FROM rest WHERE k <= 100 - (SELECT count(*) FROM s)""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_sample(table(spark, d, "labels"), 100, "quality", "doc_id").select("doc_id", "quality")


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {MD5}, doc_id) <= CAST(floor((SELECT count(*) FROM labels) * 0.8) AS BIGINT) AS train FROM labels")
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    train, test = sampling.train_test_split(table(spark, d, "labels"), 0.2, "doc_id")
    return train.select("doc_id", F.lit(True).alias("train")).union(test.select("doc_id", F.lit(False).alias("train")))


@query(f"SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY {MD5}, doc_id) - 1) / 16) AS BIGINT) AS batch FROM labels")
def shuffled_batches(spark: SparkSession, d: str) -> DataFrame:
    return sampling.batches(table(spark, d, "labels"), 16, "doc_id").select("doc_id", "batch")


@query(f"SELECT doc_id, (row_number() OVER (PARTITION BY quality ORDER BY {MD5}, doc_id) - 1) % 8 AS batch FROM labels")
def stratified_batches(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_batches(table(spark, d, "labels"), 8, "quality", "doc_id").select("doc_id", F.col("batch").cast("long").alias("batch"))


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {MD5}, doc_id) AS rn FROM documents) WHERE rn <= 10")
def sample_per_group(spark: SparkSession, d: str) -> DataFrame:
    return sampling.per_group(table(spark, d, "documents").select("doc_id", "lang"), "lang", 10, "doc_id")


def geography(spark: SparkSession, d: str) -> graph.Graph:
    """Regions, nations, customers and orders as nodes, with child edges."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    t = lambda n: table(spark, d, n)
    node = lambda df, prefix, c, kind: df.select(name(prefix, c).alias("id"), F.lit(kind).alias("type"))
    nodes = node(t("region"), "r", "r_regionkey", "region").union(node(t("nation"), "n", "n_nationkey", "nation")).union(node(t("customer"), "c", "c_custkey", "customer")).union(node(t("orders"), "o", "o_orderkey", "order"))
    edge = lambda df, p, a, q, b: df.select(name(p, a).alias("src"), name(q, b).alias("dst"))
    edges = edge(t("nation"), "r", "n_regionkey", "n", "n_nationkey").union(edge(t("customer"), "n", "c_nationkey", "c", "c_custkey")).union(edge(t("orders"), "c", "o_custkey", "o", "o_orderkey"))
    return graph.Graph(nodes, edges.select(F.concat_ws(">", "src", "dst").alias("id"), F.lit("child").alias("type"), "src", "dst", F.lit(False).alias("bidirectional")))


EDGES = """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


@query(f"WITH RECURSIVE {EDGES}, h AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS id, 0 AS depth FROM region UNION SELECT root, dst, depth + 1 FROM h JOIN e ON id = src WHERE depth < 3) SELECT root, depth, count(*) AS n FROM h WHERE depth > 0 GROUP BY root, depth")
def child_hops(spark: SparkSession, d: str) -> DataFrame:
    g = geography(spark, d)
    return graph.hops(g.edges, g.nodes.where("type = 'region'"), 3).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {EDGES}, h AS (SELECT 'o' || o_orderkey AS root, 'o' || o_orderkey AS id, 0 AS depth FROM orders UNION SELECT root, src, depth + 1 FROM h JOIN e ON id = dst WHERE depth < 3) SELECT root, max(id) FILTER (WHERE depth = 3) AS region FROM h WHERE depth > 0 GROUP BY root HAVING max(depth) = 3")
def parent_hops(spark: SparkSession, d: str) -> DataFrame:
    g = geography(spark, d)
    up = graph.hops(g.edges, g.nodes.where("type = 'order'"), 3, up=True)
    return up.groupBy("root").agg(F.max(F.when(F.col("depth") == 3, F.col("id"))).alias("region")).where("region is not null")


@query(f"WITH {EDGES} SELECT 'child' AS type, count(*) AS n FROM e WHERE left(src, 1) IN ('r', 'n') AND left(dst, 1) IN ('r', 'n', 'c')")
def filtered_graph(spark: SparkSession, d: str) -> DataFrame:
    return geography(spark, d).where(F.col("type") != "order").edges.groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {EMB} SELECT CAST(least(CAST(a.vec_id AS VARCHAR), CAST(b.vec_id AS VARCHAR)) AS VARCHAR) AS a, 'similar' AS type, greatest(CAST(a.vec_id AS VARCHAR), CAST(b.vec_id AS VARCHAR)) AS b FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.3")
def graph_triples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    edges = graph.similarity_edges(pairs.cosine_pairs(e, 0.3, "vec_id", "embedding"), "similar")
    ways = F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    nodes = e.select(F.col("vec_id").cast("string").alias("id"), F.lit("document").alias("type"))
    return graph.triples(graph.Graph(nodes, edges.select("id", "type", ways, "bidirectional", "score")))


@query()
def indirect_clusters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    edges = written(graph.similarity_edges(pairs.cosine_pairs(e, 0.4, "vec_id", "embedding"), "similar"), "similar")
    nodes = e.select(F.col("vec_id").cast("string").alias("id"), F.lit("document").alias("type"))
    return graph.indirect_clusters(graph.Graph(nodes, edges), 2, most_paths=None)


@query()
def persona_groups(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("summary_embedding"), F.lit("same").alias("summary"))
    return testset.persona_groups(nodes, 0.35)


#: md5 of seed and key orders them; the first of each node and term come first.
SCENARIOS_SQL = f"""WITH {WORDS}, t AS (SELECT doc_id AS node_id, unnest(list_distinct(w)) AS term FROM w),
k AS (SELECT t.*, persona, node_id || '|' || term || '|' || persona AS k FROM t, (VALUES ('editor'), ('student'), ('engineer')) AS p(persona)),
m AS (SELECT *, md5('42:' || k) AS h FROM k), o AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY node_id, term ORDER BY h, k) = 1 THEN '0' ELSE '8' END || h AS o FROM m),
r AS (SELECT node_id, term, persona, row_number() OVER (ORDER BY o, k) - 1 AS r FROM o QUALIFY r < 500)
SELECT node_id, term, persona, ['MISSPELLED', 'PERFECT_GRAMMAR', 'POOR_GRAMMAR', 'WEB_SEARCH_LIKE'][r % 4 + 1] AS style, ['LONG', 'MEDIUM', 'SHORT'][r // 4 % 3 + 1] AS length FROM r"""


@query(SCENARIOS_SQL)
def scenario_sampling(spark: SparkSession, d: str) -> DataFrame:
    """The feature is the sample: 500 scenarios."""
    nodes = table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), F.explode(F.array_distinct(text.words(F.col("text")))).alias("term"))
    personas = spark.createDataFrame([("editor",), ("student",), ("engineer",)], "persona string")
    return testset.scenarios(nodes.join(F.broadcast(personas), F.lit(True)), 500)


BM = """d AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL), q AS (SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark) GROUP BY ALL)"""


@query(f"WITH {BM}, h AS (SELECT item_id, doc_id, CAST(sum(q.n) AS BIGINT) AS score FROM q JOIN d USING (token) GROUP BY ALL) SELECT item_id, doc_id, score, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rk FROM h) WHERE rk <= 5")
def keyword_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keyword_top_k(table(spark, d, "documents"), table(spark, d, "benchmark"), 5, query="item_id").select("item_id", "doc_id", "score", "rank")


@query(f"""WITH {BM}, l AS (SELECT doc_id, sum(n) AS len FROM d GROUP BY 1), z AS (SELECT count(*) AS nn, avg(len) AS av FROM l), f AS (SELECT token, count(*) AS df FROM d GROUP BY 1),
h AS (SELECT item_id, doc_id, sum(q.n * ln(1 + (nn - df + 0.5) / (df + 0.5)) * d.n * 2.5 / (d.n + 1.5 * (0.25 + 0.75 * len / av))) AS s FROM q JOIN d USING (token) JOIN f USING (token) JOIN l USING (doc_id), z GROUP BY ALL)
SELECT item_id, doc_id, CAST(rk AS INTEGER) AS rank, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS rk FROM h) WHERE rk <= 5""")
def bm25_retrieval(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.bm25_top_k(table(spark, d, "documents"), table(spark, d, "benchmark"), 5, query="item_id")
    return out.select("item_id", "doc_id", "rank", F.round("score", 5).alias("score"))


@query("SELECT doc_id, quality AS first, toxic AS second FROM labels")
def experiment_comparison(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    return aggregate.compare_experiments({"first": labels.withColumn("v", F.col("quality")), "second": labels.withColumn("v", F.col("toxic"))}, "doc_id", "v")


@query("""SELECT conv_id, turn, string_split('Repeat the input.' || chr(10) || chr(10) || 'Input: ' || replace(role, 'system', 'user') || chr(10) || text, chr(10))[-1] AS reply FROM conversations""")
def model_replies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("Repeat the input.\n\nInput: "), F.replace("role", F.lit("system"), F.lit("user")), F.lit("\n"), "text").alias("prompt"))
    keyed, answers = model.answer(rows, model.EchoModel)
    return model.with_replies(keyed, answers).select("conv_id", "turn", "reply")


@query()
def embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    return model.embedded(table(spark, d, "conversations"), "text").select("conv_id", "turn", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS "start", time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(avg(value), 6) AS score FROM events GROUP BY ALL""")
def windowed_scores(spark: SparkSession, d: str) -> DataFrame:
    out = continuous.windowed_means(table(spark, d, "events"), "ts", "value", "1 hour", by=["event_type"])
    return out.withColumn("score", F.round("score", 6))


@query("""WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), s AS (SELECT *, sum(CASE WHEN b IS NULL OR ts - b > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS turns FROM s GROUP BY user_id, k""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return continuous.sessions(table(spark, d, "events"), "ts", "user_id")


@query("""WITH t AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events WHERE event_type IN ('click', 'view')) SELECT user_id, n, max(value) FILTER (WHERE event_type = 'click') AS lookup, max(value) FILTER (WHERE event_type = 'view') AS output FROM t GROUP BY ALL""")
def paired_lookups(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("event_type") == "click", "lookup").when(F.col("event_type") == "view", "output")
    rows = table(spark, d, "events").select("user_id", "event_id", kinds.alias("kind"), "value")
    return records.paired_lookups(rows, "user_id", "event_id", "kind", "value").select("user_id", F.col("n").cast("long").alias("n"), "lookup", "output")


@query("""WITH q AS (SELECT 'SELECT  "' || p_brand || '"  FROM t' AS s, p_partkey FROM part) SELECT p_partkey, lower(trim(regexp_replace(replace(s, '"', ''''), '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS sql FROM q""")
def sql_normalisation(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('SELECT  "'), "p_brand", F.lit('"  FROM t'))
    return table(spark, d, "part").select("p_partkey", records.normalised_sql(raw).alias("sql"))


@query("""SELECT c_custkey, regexp_replace(lower(regexp_replace(c_mktsegment, '([a-z])([A-Z])', '\\1_\\2', 'g')), ' ', '', 'g') AS snake,
CASE WHEN contains(c_name, '2') THEN 1.0 WHEN contains(c_name, '1') THEN 0.5 WHEN contains(c_name, '0') THEN 0.0 END AS rating FROM customer""")
def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    rating = text.parsed_rating(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", text.camel_to_snake(F.initcap("c_mktsegment")).alias("snake"), F.when(~F.isnan(rating), rating).alias("rating"))


def _more() -> None:
    """The queries of other modules register themselves."""
    from . import dataset_queries, judge_queries, record_queries, text_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _more()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _more()
    return dict(SQL)
