"""From raw documents to packed training sequences, in four stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.llm import packing, quality_classifier, quality_rules, simhash
from gaugewright.llm.queries import table, vocabulary_path
from gaugewright.llm.staging import forget, forget_new, fresh, tables, written

#: Characters that a task of the last stage encodes at once: an executor's heap is large by then, so its Python has less room.
PACKED_CHARS = 1_000_000


def filter_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their frequent lines."""
    return quality_rules.clean(docs)


def filter_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half or more; the classifier learns from the stage's own documents that have labels."""
    rows = quality_classifier.training_rows(docs, table(spark, sf_dir, "labels"))
    model = quality_classifier.fit(rows, "key", "text", "label")
    (into,) = fresh(docs, "score_")
    return quality_classifier.score(docs, model, "text", into).where(F.col(into) >= 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 or more of their five-word shingles): that of the least id."""
    return simhash.drop_similar(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences."""
    return packing.pack(docs, vocabulary_path(), batch_chars=PACKED_CHARS)


STAGES = [
    ("quality_rules", filter_by_rules),
    ("quality_classifier", filter_by_classifier),
    ("simhash_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: SQL has neither compression with dictionaries nor XXH64 nor byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of what the stages write only this is left."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, last = tables(), docs
        docs = written(stage(spark, docs, sf_dir), name)
        forget_new(spark, before, docs)
        forget(last)
    return docs
