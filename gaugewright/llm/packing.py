"""Packing documents into fixed-length token sequences by cutting-stock column generation.

Every document is tokenised and cut into full pieces of the sequence length and one rest. The lengths, rounded up to
size classes, make a histogram. A linear program over patterns (how many pieces of each class share a sequence) covers it
with the fewest sequences: its dual prices go into a knapsack over the capacity, which finds the
pattern to add next. The solution is rounded down, a greedy fill covers what is left, and the pieces of a class, in the order
of their rank, take the slots of the patterns. Only the number of pieces of each class comes to the driver: with classes of
16 tokens up to 4096 these are 256 numbers, whatever the input. The ranks are numbered where the pieces are.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import BATCH_CHARS, Encoder, text_parts
from .staging import written

CAPACITY = 4096
#: Tokens that a size class spans.
UNIT = 16
END_ID = 2
#: Pieces that are ranked together, about.
RANKED_TOGETHER = 200_000
#: Sequences above the linear program's bound at which no further column is generated.
GAP = 0.5
#: Columns without a better objective, as degenerate steps give them, after which the search ends with a warning of the gap.
STALLED = 500


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text", batch_chars: int = BATCH_CHARS) -> DataFrame:
    """One row per piece: ``key``, start, length, ids_crc32, doc_tokens. A null text counts as empty; each document ends with ``end_id``. A task
    encodes about ``batch_chars`` characters at once: fewer take less memory and more time."""
    kind = docs.schema[key].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            for first, texts in text_parts(batch.column(1), batch_chars):
                encoded = [e + end for e in encoder(texts)]
                rows, starts, lengths, sums, totals = [], [], [], [], []
                for row, e in enumerate(encoded, first):
                    n = len(e) // 4
                    for at in range(0, n, capacity):
                        rows.append(row)
                        starts.append(at)
                        lengths.append(min(capacity, n - at))
                        sums.append(zlib.crc32(e[4 * at : 4 * (at + capacity)]))
                        totals.append(n)
                longs = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *longs], ["key", "start", "length", "ids_crc32", "doc_tokens"])

    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of the highest total price that fits."""
    value, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        value[w] = value[w - 1]
        m = int(np.searchsorted(sizes, w, "right"))
        if m:
            with_one = value[w - sizes[:m]] + prices[:m]
            j = int(with_one.argmax())
            if with_one[j] > value[w] + 1e-12:
                value[w], took[w] = with_one[j], j
    pattern, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            pattern[took[w]] += 1
            w -= int(sizes[took[w]])
    return float(value[capacity]), pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots, in plain array steps: it starts no threads in the driver."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        pivot = i + int(np.abs(work[i:, i]).argmax())
        work[[i, pivot]] = work[[pivot, i]]
        work[i] /= work[i, i]
        factors = work[:, i].copy()
        factors[i] = 0
        rows = np.flatnonzero(factors)
        work[rows] -= factors[rows, None] * work[i]
    return work[:, n:]


def cutting_stock(sizes: np.ndarray, counts: np.ndarray, capacity: int, stalled: int = STALLED) -> list[tuple[int, np.ndarray]]:
    """(times, pattern) that cover ``counts`` pieces of ``sizes`` (ascending, distinct) with few sequences of ``capacity``.

    Revised simplex: the basis starts with one pattern per size; a pattern whose price under the duals is over 1 enters. The
    objective divided by the best price is a lower bound of the optimum, so the search knows its gap. It ends when
    the gap is below GAP sequences; there is no limit on columns.
    """
    m = len(sizes)
    if not m:
        return []
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    need = counts.astype(float)
    step, lowest, bound, since = 0, np.inf, 0.0, 0
    while True:
        duals = inverse.sum(axis=0)  # of cost 1 per sequence
        price, pattern = best_pattern(np.maximum(duals, 0), sizes, capacity)
        level = (inverse * need).sum(axis=1)
        objective = float(np.maximum(level, 0).sum())
        bound = max(bound, objective / max(price, 1.0))
        if price <= 1 + 1e-7 or objective - bound < GAP:
            break
        since = 0 if objective < lowest - 1e-9 else since + 1
        lowest = min(lowest, objective)
        direction = (inverse * pattern).sum(axis=1)
        ratio = np.where(direction > 1e-9, np.maximum(level, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]) or since > stalled:
            logging.getLogger(__name__).warning("column generation ended %.1f sequences above its bound of %.1f", objective - bound, bound)
            break
        basis[:, out] = pattern
        if step % 50 == 49:
            inverse = inverted(basis)
        else:
            row = inverse[out] / direction[out]
            inverse = inverse - np.outer(direction, row)
            inverse[out] = row
        step += 1
    level = (inverted(basis) * need).sum(axis=1)
    plan = [(int(t), basis[:, j].astype(np.int64)) for j, t in enumerate(np.floor(np.maximum(level, 0) + 1e-6)) if t > 0]
    left = counts - sum((t * p for t, p in plan), np.zeros(m, np.int64))
    left = np.maximum(left, 0)
    while left.any():
        room, pattern = capacity, np.zeros(m, np.int64)
        for j in range(m - 1, -1, -1):
            take = min(int(left[j]), room // int(sizes[j]))
            pattern[j] += take
            room -= take * int(sizes[j])
        times = int(min(left[j] // pattern[j] for j in np.flatnonzero(pattern)))
        plan.append((times, pattern))
        left -= times * pattern
    return plan


def slots(plan: list[tuple[int, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class: the ranks at which its runs of slots begin, the first sequence of each run, and the pieces per sequence."""
    base = np.cumsum([0, *(t for t, _ in plan)])
    out = []
    for c in range(len(plan[0][1]) if plan else 0):
        runs = [(t * int(p[c]), int(b), int(p[c])) for (t, p), b in zip(plan, base, strict=False) if p[c]]
        begins = np.cumsum([0, *(r[0] for r in runs)])[:-1]
        out.append((begins, np.array([r[1] for r in runs]), np.array([r[2] for r in runs])))
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END_ID, key: str = "doc_id", text: str = "text", batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Pack all documents: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset; one row per piece.

    Pieces in a sequence lie without gaps from offset 0 and hold ``capacity`` ids at most. Null and empty texts are one
    piece of the end id; repeated rows are packed as often as they occur; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    pieces = cut_pieces(docs, path, capacity, end_id, key, text, batch_chars).withColumn("piece", F.monotonically_increasing_id())
    pieces = written(pieces, "pieces")
    salts = max(64, pieces.count() // RANKED_TOGETHER)
    pieces = pieces.withColumn("size", F.ceil(F.col("length") / unit).cast("int")).withColumn("salt", F.pmod(F.xxhash64("piece"), F.lit(salts)).cast("int"))
    histogram = written(pieces.groupBy("size", "salt").agg(F.count("*").alias("n")), "histogram")
    counts = {r["size"]: r["n"] for r in histogram.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    sizes = np.array(sorted(counts), np.int64)
    runs = slots(cutting_stock(sizes, np.array([counts[s] for s in sizes.tolist()], np.int64), -(-capacity // unit)))
    shared = spark.sparkContext.broadcast({int(s): r for s, r in zip(sizes, runs, strict=True)})

    earlier = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = histogram.select("size", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("size", "salt").orderBy("piece")) - 1
    ranked = pieces.withColumn("number", number).join(firsts, ["size", "salt"]).withColumn("rank", F.col("first") + F.col("number"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = np.zeros(len(pdf), np.int64)
            size, rank = pdf["size"].to_numpy(), pdf["rank"].to_numpy(np.int64)
            for s in np.unique(size):
                begins, sequence, each = shared.value[int(s)]
                at = np.flatnonzero(size == s)
                run = np.searchsorted(begins, rank[at], "right") - 1
                out[at] = sequence[run] + (rank[at] - begins[run]) // each[run]
            yield pdf.drop(columns=["size", "rank"]).assign(sequence_id=out)

    kept = ["key", "start", "length", "ids_crc32", "doc_tokens", "piece"]
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, piece long, sequence_id long"
    placed = ranked.select(*kept, "size", "rank").mapInPandas(place, schema)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
