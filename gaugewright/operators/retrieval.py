"""Keyword and BM25 ranking with token tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .sampling import top_k


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n): lower-cased letter and digit runs with their counts."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))
    return df.select(key, F.explode(found).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def wanted_tokens(docs: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(key, len, token, n) of the documents' tokens that are among ``terms`` (column token), with the document's length; each document with a
    token also has a row of the empty token, by which documents are counted. Written, so that no text is taken apart again."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0))
    rows = docs.select(F.col(key), found.alias("_f")).where(F.size("_f") > 0)
    rows = rows.select(key, F.size("_f").alias("len"), F.explode(F.array_append("_f", F.lit(""))).alias("token"))
    wanted = terms.select("token").union(terms.sparkSession.createDataFrame([("",)], "token string")).distinct()
    return written(rows.join(wanted, "token", "left_semi").groupBy(key, "len", "token").agg(F.count("*").alias("n")), "tokens")


def _by_document(tokens: DataFrame, key: str) -> DataFrame:
    """A document's tokens in one partition. The queries' terms come to them as a rule, so that scores are summed and ranked where the tokens are,
    and neither a hit nor a frequent token is shuffled."""
    return tokens.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def keyword_top_k(docs: DataFrame, queries: DataFrame, k: int, doc: str = "doc_id", query: str = "query_id", text: str = "text") -> DataFrame:
    """(query, doc, score, rank): how many of a query's words, repeats counted, the document has; only positive scores."""
    q = written(tokens(queries, query, text), "terms")
    d = _by_document(wanted_tokens(docs, q, doc, text), doc).select(doc, F.col("token").alias("_t"))
    hits = d.join(q, F.col("token") == F.col("_t")).groupBy(query, doc).agg(F.sum("n").alias("score"))
    return top_k(hits, query, "score", k, doc)


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, doc: str = "doc_id", query: str = "query_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, score, rank) by BM25 with the idf ln(1 + (N - df + 0.5) / (df + 0.5)). Scores equal to nine places are ties, which go
    to the smaller document. Only the queries' terms leave the texts."""
    q = written(tokens(queries, query, text), "terms").select(query, "token", F.col("n").alias("qn"))
    d = wanted_tokens(docs, q, doc, text)
    size = d.where("token = ''").agg(F.count("*").alias("N"), F.avg("len").alias("avg")).first()
    wanted = written(q.join(d.groupBy("token").agg(F.count("*").alias("df")), "token"), "wanted")
    tf = F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("len") / (size["avg"] or 1.0)))
    idf = F.log(1 + (size["N"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    hits = _by_document(d, doc).join(wanted, "token").groupBy(query, doc).agg(F.round(F.sum(F.col("qn") * idf * tf), 9).alias("score"))
    return top_k(hits, query, "score", k, doc)


def chunked(docs: DataFrame, size: int = 1000, overlap: int = 100, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, chunk, text): windows of ``size`` characters that share ``overlap`` with the one before; equal chunk texts are kept once,
    those of the least document and place."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - overlap - 1), F.lit(step))
    cut = docs.where(F.length(text) > 0).select(doc, F.col(text).alias("_t"), F.posexplode(starts).alias("chunk", "_at"))
    cut = cut.select(doc, "chunk", F.substring(F.col("_t"), F.col("_at") + 1, F.lit(size)).alias(text))
    first = cut.groupBy(F.col(text)).agg(F.min(F.struct(F.col(doc), F.col("chunk"))).alias("_f"))
    return first.select(F.col(f"_f.{doc}").alias(doc), F.col("_f.chunk").alias("chunk"), text)
