"""Quality rules with cross-document line frequency.

Each text gives base counts (words, symbols, repeated lines, repeated 8-word windows). Its lines are normalised and hashed, and
for each host and line the documents that hold the line are counted. Lines above the limit are removed, and a document that
keeps too little of its text is rejected.

A document is known by its whole sequence of normalised lines, so copies that differ in letter case or spacing at most count
once. Near copies are documents of their own here: lines that more than the limit of them hold on one host do go, and what is
left of them must carry them. Near copies as such are the work of ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import fresh, written

LIMIT = 20
WINDOW = 8
MIN_WORDS = 20
#: A document is depleted if fewer than this many hundredths of its words stay.
MIN_SHARE = 30
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = [ids.setdefault(w, len(ids)) for w in words]
    if len(ids) == len(seq):
        return 0
    x = np.array(seq, np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for j in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    groups: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(hit).tolist():  # the windows themselves decide, not their hashes
        groups.setdefault(tuple(seq[i : i + window]), []).append(i)
    steps = np.zeros(len(seq) + 1, np.int64)
    for starts in groups.values():
        if len(starts) > 1:
            np.add.at(steps, starts, 1)
            np.add.at(steps, np.array(starts) + window, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def line_key(line: str) -> int:
    """The hash of a line without case and with single spaces; lines without a word have none."""
    h = xxhash.xxh64_intdigest(b" ".join(line.lower().encode().split()))
    return h - (1 << 64) if h >> 63 else h


def measure(text: str | None) -> tuple[int, int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the hash of all lines' keys in their order, and the text's
    different lines: keys and their words."""
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    held: dict[int, int] = {}
    keys = [line_key(line) for line in lines]
    for k, line in zip(keys, lines, strict=True):
        held[k] = held.get(k, 0) + len(line.encode().split())
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        xxhash.xxh64_intdigest(np.array(keys, np.int64).tobytes()) >> 1,
        list(held),
        list(held.values()),
    )


def measures(docs: DataFrame, text: str, keep: dict[str, str]) -> DataFrame:
    """The counts and lines of each row, with the columns of ``keep`` (new name: name in ``docs``) beside them."""
    fields = [docs.schema[c] for c in keep.values()]
    kinds = ", ".join(f"{new} {f.dataType.simpleString()}" for new, f in zip(keep, fields, strict=True))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "same_"]
    schema = f"{kinds}, {', '.join(f'{c} long' for c in longs)}, line array<long>, line_words array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*[measure(t) for t in batch.column(len(keep)).to_pylist()], strict=True)) or [()] * 8
            made = [pa.array(x, pa.int64()) for x in rows[:6]] + [pa.array(x, pa.list_(pa.int64())) for x in rows[6:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, *longs, "line", "line_words"])

    picked = docs.select(*[F.col(c).alias(new) for new, c in keep.items()], F.col(text).cast("string").alias("text_"))
    return picked.mapInArrow(run, schema)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", limit: int = LIMIT) -> DataFrame:
    """One row per document: ``key``, the base counts, ``base_failed``, ``words_left``, ``kept``, ``drop_lines`` (keys of
    lines to remove) and ``text_hash`` (xxhash64 of the text).

    A null text has no words and fails; a null host is a host of its own. Repeated rows are judged alike. An empty
    table gives an empty one; columns other than the three are not read.
    """
    picked = docs.select(F.col(key).alias("k_"), F.col(text).cast("string").alias("t_"), F.col(host).cast("string").alias("h_"))
    picked = picked.withColumns({"x_": F.xxhash64("t_"), "host_": F.coalesce(F.concat(F.lit("="), "h_"), F.lit("")), "row_": F.monotonically_increasing_id()})
    base = written(measures(picked, "t_", {c: c for c in ("k_", "x_", "host_", "row_")}), "measures")

    lines = base.select("row_", "same_", "host_", F.explode(F.arrays_zip("line", "line_words")).alias("l_"))
    lines = lines.select("row_", "same_", "host_", F.col("l_.line").alias("line_"), F.col("l_.line_words").alias("words_"))
    # rows first, which combine before the shuffle; then the different documents of the few lines that so many rows hold
    many = lines.groupBy("host_", "line_").agg(F.count("*").alias("n_")).where(F.col("n_") > limit).select("host_", "line_")
    lines = written(lines.join(many, ["host_", "line_"]), "shared")
    documents = lines.select("host_", "line_", "same_").distinct()  # a step of its own: one line may be in a third of all rows
    frequent = documents.groupBy("host_", "line_").agg(F.count("*").alias("n_")).where(F.col("n_") > limit).select("host_", "line_")
    frequent = written(frequent, "frequent")
    hit = lines.join(frequent, ["host_", "line_"]).groupBy("row_").agg(F.sum("words_").alias("gone_"), F.collect_list("line_").alias("drop_"))

    left = F.col("n_words") - F.coalesce("gone_", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return base.join(hit, "row_", "left").select(
        F.col("k_").alias(key),
        F.col("x_").alias("text_hash"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        left.alias("words_left"),
        (~failed & (100 * left >= MIN_SHARE * F.col("n_words"))).alias("kept"),
        F.coalesce("drop_", F.array().cast("array<long>")).alias("drop_lines"),
    )


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", chars: str | None = "n_chars", limit: int = LIMIT) -> DataFrame:
    """The kept documents with their frequent lines removed, in the columns of ``docs`` (``chars``, if it is there, is set anew).

    A text that loses no line stays as it is, byte for byte; repeated rows stay repeated."""
    k, h, x, drop = fresh(docs, "key_", "hash_", "mark_", "drop_")
    verdicts = judge(docs, key, text, host, limit).where("kept").select(F.col(key).alias(k), F.col("text_hash").alias(h), F.col("drop_lines").alias(drop)).dropDuplicates([k, h])

    @F.pandas_udf("string")
    def without(texts, drops):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for t, d in zip(texts, drops, strict=True):
            if len(d):
                gone = set(d)
                t = "\n".join(line for line in t.split("\n") if not line.strip(WHITE) or line_key(line) not in gone)
            out.append(t)
        return pd.Series(out, dtype=object)

    kept = docs.withColumn(x, F.xxhash64(F.col(text).cast("string"))).join(verdicts, (F.col(x) == F.col(h)) & F.col(key).eqNullSafe(F.col(k)))
    kept = kept.withColumn(text, without(F.col(text), F.col(drop)))
    if chars in docs.columns:
        kept = kept.withColumn(chars, F.when(F.size(drop) > 0, F.length(text).cast(docs.schema[chars].dataType)).otherwise(F.col(chars)))
    return kept.select(*docs.columns)
