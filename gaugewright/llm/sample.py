"""A bounded sample of labelled rows for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 30


#: Bytes of text that a sample holds, about.
BYTES = 64 << 20


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """``key``, ``text``, ``label``, and the text's ``text_bytes`` and ``text_hash``, which are taken before the join, so that who asks for these
    alone moves no text. Null keys, and labels that are neither 0 nor 1, take no part; a key with several texts or labels gives a row
    for each pair of them. Other columns, whatever their names, are not read."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("label_key"), F.col(label).alias("label"))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumns({"text_bytes": F.octet_length("text"), "text_hash": F.xxhash64("text")})
    return rows.join(known, rows["key"] == known["label_key"]).select("key", "text", "label", "text_bytes", "text_hash")


def per_class(rows: DataFrame, label: str, size: int, key: str, text: str, most_bytes: int = BYTES, most_rows: int | None = None, held: str | None = None, drawn_by: str | None = None) -> list:
    """About ``size`` different rows of each class (all, if it has fewer), chosen by the hash of their key and text, in a fixed order.
    Rows of one class that repeat key and text count once, in the shares and in the sample: they teach nothing new.
    Where the sample would hold more than ``most_bytes`` of ``text`` together, about, the share is lowered for rows of every length
    alike. ``most_rows`` bounds the rows of all classes together, about. ``held`` and ``drawn_by`` are columns with the bytes and the hash
    of the text, for rows that come from a join which should not move texts just to measure them.

    The counts decide a share per class, so no class is sorted or gathered anywhere; a hash of each row moves to count the
    different ones, and of the texts only the chosen move."""
    drawn = F.xxhash64(F.lit("sample"), F.col(key), F.col(drawn_by) if drawn_by else F.xxhash64(text))
    different = rows.groupBy(F.col(label).alias("class_"), drawn.alias("drawn_")).agg(F.first(F.col(held) if held else F.octet_length(text)).alias("bytes_"))
    counts = {r[0]: (r[1], r[2] or 0) for r in different.groupBy("class_").agg(F.count("*"), F.sum("bytes_")).collect()}
    if not counts:
        return []
    if most_rows is not None:
        size = max(1, min(size, most_rows // len(counts)))
    shares = {value: min(1.0, size / n) for value, (n, _) in counts.items()}
    scale = min(1.0, most_bytes / max(1.0, sum(shares[value] * size_ for value, (_, size_) in counts.items())))
    spot = F.pmod(drawn, F.lit(BUCKETS))
    want = F.lit(False)
    for value, share in shares.items():
        want = want | ((F.col(label) == F.lit(value)) & (spot < int(BUCKETS * share * scale)))
    chosen = rows.where(want).dropDuplicates([label, key, text])
    return sorted(chosen.collect(), key=lambda r: (str(r[label]), str(r[key]), str(r[text])))
