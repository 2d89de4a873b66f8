"""The operators as queries over the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_extract, langid, packing, phrases, quality_classifier, quality_rules, sharding, simhash, spelling, staging, topk_search, toxicity, url_filter

WORD_BPE = "word_bpe_49k.json"
ARRIVALS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_extract.extract(pages)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk_search.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64.0)
    return topk_search.top_k(rows.where("id % 20 = 0"), rows, 20)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = url_filter.judge(pages.select("page_id", "url"), url_filter.alias_edges(pages))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality_classifier.training_rows(docs, table(spark, sf_dir, "labels"))
    model = quality_classifier.fit(rows, "key", "text", "label")
    out = quality_classifier.score(docs, model)
    return out.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.bpe_encode(table(spark, sf_dir, "documents"), vocabulary_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~quality_classifier.held_out()))
    out = langid.identify(docs, model)
    return out.select("doc_id", quality_classifier.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in ARRIVALS parts, by the hash of their id, written in one pass; after each, tiers are compacted.
    Each document's shard in the last version."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, staging.new_path(spark, "shards"))
    for _ in store.append_parts(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)), ARRIVALS):
        store.compact()
        store.sweep(leftovers=False)
    return store.placed("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html_extraction, op2_topk_search, op3_packing, op4_url_filters, op5_quality_classifier, op6_bpe, op7_quality_rules, op8_simhash, op9_language_id)
    return {f.__name__: f for f in (*found, op10_sharding, op11_phrases, op12_spelling_variants, op13_toxicity)}


#: Fixed values of the rules, as rows (pattern, host, path, verdict).
_RULES = ", ".join(f"('{r.pattern}', '{r.host}', '{r.path}', '{r.verdict}')" for r in url_filter.RULES)

OP2_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 20
"""

#: Of the targets' forms it reads absolute ones and those that begin with a slash; the operator resolves all.
OP4_SQL = f"""
WITH RECURSIVE rules(pattern, rhost, rpath, rverdict) AS (VALUES {_RULES}),
seen AS (
  SELECT url AS src, regexp_replace(html, '(?is)<!--.*?-->|<(script|style|noscript|template|textarea|title|iframe)\\b.*?</(script|style|noscript|template|textarea|title|iframe)\\b', '', 'g') AS html
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
tags AS (
  SELECT src, unnest(regexp_extract_all(html, '(?is)</?[a-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag FROM seen WHERE regexp_matches(html, '(?i)canonical|refresh')),
raw AS (
  SELECT src, trim(replace(coalesce(
    CASE WHEN regexp_matches(tag, '(?is)^<link\\b.*\\srel\\s*=\\s*(canonical\\b|"[^"]*\\bcanonical\\b|''[^'']*\\bcanonical\\b)')
      THEN nullif(regexp_extract(tag, '(?is)\\shref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1), '') END,
    CASE WHEN regexp_matches(tag, '(?is)^<meta\\b.*\\shttp-equiv\\s*=\\s*["'']?\\s*refresh\\b')
      THEN nullif(regexp_extract(tag, '(?is)\\burl\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1), '') END), '&amp;', '&')) AS target FROM tags),
whole AS (
  SELECT src, CASE WHEN contains(target, '://') THEN target
    WHEN starts_with(target, '//') THEN regexp_extract(src, '^[^/]*') || target
    WHEN starts_with(target, '/') THEN regexp_extract(src, '(?s)^.*?://[^/?#]*') || target END AS dst FROM raw WHERE target IS NOT NULL),
folded AS (SELECT regexp_replace(src, '(?s)#.*$', '') AS src, regexp_replace(dst, '(?s)#.*$', '') AS dst FROM whole),
targets AS (
  SELECT translate(regexp_extract(src, '(?s)^.*?://[^/?]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(src, length(regexp_extract(src, '(?s)^.*?://[^/?]*')) + 1) AS src,
         translate(regexp_extract(dst, '(?s)^.*?://[^/?]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(dst, length(regexp_extract(dst, '(?s)^.*?://[^/?]*')) + 1) AS dst FROM folded),
edges AS (SELECT src, dst FROM targets WHERE dst IS NOT NULL AND src <> dst UNION SELECT dst, src FROM targets WHERE dst IS NOT NULL AND src <> dst),
reach(node, other) AS (SELECT src, dst FROM edges UNION SELECT reach.node, edges.dst FROM reach JOIN edges ON reach.other = edges.src),
urls AS (SELECT url AS u FROM pages WHERE url IS NOT NULL UNION SELECT src FROM edges),
parts AS (
  SELECT u,
    translate(coalesce(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM urls),
fits AS (
  SELECT u, pattern, rverdict, row_number() OVER (PARTITION BY u ORDER BY length(pattern) DESC) AS rn
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
ruled AS (SELECT parts.*, pattern, rverdict FROM parts LEFT JOIN fits ON parts.u = fits.u AND rn = 1),
alias AS (
  SELECT node, bool_or(rverdict = 'allow') AS allowed, bool_or(rverdict = 'block') AS blocked
  FROM reach JOIN ruled ON reach.other = ruled.u GROUP BY node)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, pattern AS rule,
  CASE WHEN rverdict IS NOT NULL THEN rverdict WHEN blocked AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END AS verdict
FROM pages LEFT JOIN ruled ON pages.url = ruled.u LEFT JOIN alias ON alias.node =
  translate(regexp_extract(pages.url, '(?s)^.*?://[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  || substr(regexp_replace(pages.url, '(?s)#.*$', ''), length(regexp_extract(pages.url, '(?s)^.*?://[^/?#]*')) + 1)
"""


OP11_SQL = """
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM t),
places AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS sizes(k)),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
parts AS (SELECT lang, k, phrase, a, cut, array_to_string(ws[:cut], ' ') AS one, array_to_string(ws[cut + 1:], ' ') AS two FROM cuts),
scored AS (
  SELECT parts.*, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score
  FROM parts JOIN f x ON x.lang = parts.lang AND x.phrase = one JOIN f y ON y.lang = parts.lang AND y.phrase = two),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM scored),
kept AS (
  SELECT * FROM weakest s WHERE nth = 1 AND NOT EXISTS (
    SELECT 1 FROM c o WHERE o.lang = s.lang AND o.k > s.k AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ')
      AND CAST(100 AS HUGEINT) * o.a >= CAST(80 AS HUGEINT) * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk_search": OP2_SQL, "op4_url_filters": OP4_SQL, "op11_phrases": OP11_SQL}
