"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two such vectors
never exceeds the Hamming distance of the fingerprints. The segments form six groups; vectors at distance 3 or less agree on at
least three whole groups, so a grid with one unit cell for each agreement on three of the six groups (20 grids) holds
every pair in a common cell. In a cell, the Manhattan distance filters and the Hamming distance verifies.
Large cells are cut into blocks and each pair of blocks is a group of its own; a group gives back a spanning
forest of its links, never all its pairs, which keeps the components whole.

A distance of 3 bits is far below that of texts which share four fifths of their shingles (some 10 bits). Where near copies
mean a Jaccard similarity of shingle sets, ``similar_texts`` takes the links of the fingerprints, verified by exact sets, and finds what
they miss: in any one order of the shingles, two such sets share one among the first size - ceil(similarity * size) + 1 of
each. These are the cells there, and exact sets verify.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .staging import forget, fresh, written

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Near copies of the pipeline: words in a shingle, and the least Jaccard similarity of two texts.
COPY_SHINGLE = 5
COPY_SIMILARITY = 0.8
#: Texts that tell which shingles are common, and how many of these are known at most. They set the order, so the cost alone.
COMMON_SAMPLE = 5_000
COMMON = 100_000
#: Longs of a set's parities.
SIGNS = 8
#: Fingerprints of a cell in one block.
BLOCK = 1024
#: Two-bit segments in each of the six groups.
GROUPS = (6, 5, 5, 6, 5, 5)


def shingle_hashes(words: list[bytes], width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The hash of each run of ``width`` words; of all words if they are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    width = min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The majority bits of the shingles' hashes, as a signed 64-bit number; 0 without words."""
    hashes = shingle_hashes(words_of(text), width, seed)
    if not len(hashes):
        return 0
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.bincount((octets + 256 * np.arange(8)).ravel(), minlength=2048).reshape(8, 256)
        ones = (counts @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key_``, ``fp`` (long) and ``x_``, a hash that only equal texts share, of every row, from its whole text."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    whole = F.col(text).cast("string")
    return docs.select(F.col(key).alias("key_"), of(whole).alias("fp"), F.xxhash64(whole).alias("x_"))


def _group_masks() -> list[int]:
    masks, at = [], 0
    for n in GROUPS:
        masks.append(((1 << 2 * n) - 1) << at)
        at += 2 * n
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(values: np.ndarray, other: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Edges that connect what links of ``distance`` or less connect: among ``values``, or between them and ``other``."""
    if other is None and len(values) == 2:
        a, b = values.tolist()
        return [(a, b)] if ((a ^ b) & _ALL).bit_count() <= distance else []
    nodes = values if other is None else np.concatenate([values, other])
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    right, shift = (values, 0) if other is None else (other, len(values))
    words = values.view(np.uint64)
    counts, counts_r = _segment_counts(words), _segment_counts(right.view(np.uint64))
    out = []
    for i in range(len(values)):
        j0 = i + 1 if other is None else 0
        near = np.flatnonzero(_manhattan(counts[i], counts_r[j0:]) <= distance) + j0
        near = near[np.bitwise_count(words[i] ^ right.view(np.uint64)[near]) <= distance]
        for j in near.tolist():
            a, b = find(i), find(j + shift)
            if a != b:
                root[b] = a
                out.append((int(nodes[i]), int(nodes[j + shift])))
    return out


_ALL = (1 << 64) - 1
_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def _segment_counts(x: np.ndarray) -> np.ndarray:
    """Bit counts (0, 1, 2) of the 32 two-bit segments, each in its own two bits."""
    return x - ((x >> _ONE) & _LOW)


def _manhattan(a: np.uint64, b: np.ndarray) -> np.ndarray:
    """Of packed counts: two counts differ by 2 where only the high bit differs, by 1 where the low bit does."""
    x = a ^ b
    low, high = x & _LOW, (x >> _ONE) & _LOW
    return np.bitwise_count(low).astype(np.int16) + 2 * np.bitwise_count(high & ~low).astype(np.int16)


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``a``, ``b``: links between distinct fingerprints (column ``fp``) that connect all that differ in ``distance`` bits or fewer."""
    if distance > DISTANCE:
        raise ValueError(f"the grids hold pairs of up to {DISTANCE} differing bits")
    masks = _group_masks()
    triples = [sum(masks[i] for i in t) for t in combinations(range(6), 3)]
    low = F.lit(0x5555555555555555)
    next_bit = F.shiftrightunsigned("fp", 1)
    both, one = F.col("fp").bitwiseAND(next_bit).bitwiseAND(low), F.col("fp").bitwiseXOR(next_bit).bitwiseAND(low)
    counts = F.shiftleft(both, 1).bitwiseOR(one)  # the count of each segment in the segment's own two bits
    cells = fps.select("fp", F.posexplode(F.array(*[counts.bitwiseAND(F.lit(_signed(m))) for m in triples])).alias("grid", "cell"))
    many = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = cells.join(many, ["grid", "cell"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    mine = shared.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = pairs.groupBy("grid", "cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    groups = groups.agg(F.collect_list(F.when(F.col("mine") == F.least("mine", "other"), F.col("fp"))).alias("left"), F.collect_list(F.when(F.col("mine") != F.least("mine", "other"), F.col("fp"))).alias("right"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for i, j, left, right in zip(pdf["i"], pdf["j"], pdf["left"], pdf["right"], strict=True):
                left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
                if i == j and len(left) > 1:
                    out += _forest(left, None, distance)
                elif i != j and len(left) and len(right):
                    out += _forest(left, right, distance)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return groups.select("i", "j", "left", "right").mapInPandas(run, "a long, b long")


def _linked_prints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key_``, ``x_``, ``fp``, ``group_`` (one fingerprint of each component) and ``component`` of every row."""
    prints = written(fingerprints(docs, key, text), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("key_").alias("least")), "distinct")
    linked = connected_components(links(distinct), "a", "b")
    linked = written(linked.join(distinct, linked["node"] == distinct["fp"]).select("fp", "component", "least"), "linked")
    least = linked.groupBy("component").agg(F.min("least").alias("of_component"))
    named = linked.join(least, "component").select("fp", F.col("component").alias("group_"), "of_component")
    named = distinct.join(named, "fp", "left").select("fp", F.coalesce("group_", "fp").alias("group_"), F.coalesce("of_component", "least").alias("component"))
    return prints.join(written(named, "named"), "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fp`` (long) and ``component`` (the least key of the documents that links reach) of every row.

    Texts without words, null ones included, share the fingerprint 0, linked like any other. Repeated rows come back as
    often as they occur. A null key is never the least key unless all keys of its component are null. Other columns, whatever
    their names, are not read.
    """
    return _linked_prints(docs, key, text).select(F.col("key_").alias(key), "fp", "component")


def _signature(text: str | None) -> int:
    """Equal for texts of equal words."""
    return _signed(xxhash.xxh64_intdigest(b" ".join(words_of(text)), SEED))


def shingle_set(text: str | None, width: int = COPY_SHINGLE) -> np.ndarray:
    """The different shingles' hashes in order, as signed numbers."""
    return np.unique(shingle_hashes(words_of(text), width).view(np.int64))


def common_shingles(texts: DataFrame, width: int = COPY_SHINGLE) -> np.ndarray:
    """Shingles of two or more of a sample of different texts (column ``text_``), the commonest last."""
    share = -(-max(1, texts.count()) // COMMON_SAMPLE)
    sample = texts.withColumn("x_", F.xxhash64("text_")).where(F.pmod(F.col("x_"), F.lit(share)) == 0).dropDuplicates(["x_"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"s_": np.concatenate([np.zeros(0, np.int64), *[shingle_set(t, width) for t in pdf["text_"]]])})

    counts = sample.select("text_").mapInPandas(run, "s_ long").groupBy("s_").agg(F.count("*").alias("n_")).where("n_ > 1")
    return np.array([r["s_"] for r in counts.orderBy(F.desc("n_"), "s_").limit(COMMON).collect()][::-1], np.int64)


def first_shingles(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float = COPY_SIMILARITY) -> np.ndarray:
    """Of a set, those that a similar set must share one of: by hash, the common ones (sorted, with their ranks) last."""
    n = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1 if len(hashes) else 0
    if not len(common):
        return hashes[:n]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    known = common[at] == hashes
    rare = hashes[~known]
    return rare[:n] if len(rare) >= n else np.concatenate([rare, hashes[known][np.argsort(rank[at[known]])]])[:n]


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = COPY_SHINGLE, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """``key`` and ``component`` of every row: the least key of the texts that links reach. Two texts are linked if the sets
    of their ``width``-word shingles have a Jaccard similarity of ``similarity`` or more; no such pair is missed.

    The links of the texts' fingerprints are candidates first, as are the texts of a cell with its head, which joins large clusters in
    a linear number of pairs; only texts of a cell that are still in different components then meet each other. A text of fewer words is
    one shingle; texts without words, null ones included, are copies of each other. Other columns, whatever their names, are not read.
    """
    return _similar(docs, key, text, width, similarity).select(F.col("key_").alias(key), "component")


def parities(hashes: np.ndarray) -> np.ndarray:
    """The parity of a set's hashes in each of SIGNS * 64 bits: two sets differ in as many hashes at least as in bits."""
    odd = np.bincount(hashes.view(np.uint64) % np.uint64(64 * SIGNS), minlength=64 * SIGNS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _similar(docs: DataFrame, key: str, text: str, width: int, similarity: float) -> DataFrame:
    """``key_``, ``x_`` (a hash that only equal texts share), ``group_`` (one signature of each component) and ``component`` of every row."""
    if not 0 < similarity <= 1:
        raise ValueError("the similarity must lie above 0 and not above 1")
    picked = docs.select(F.col(key).alias("key_"), F.col(text).cast("string").alias("text_"))
    common = common_shingles(picked.select("text_"), width)
    order = np.argsort(common)
    shared_order = docs.sparkSession.sparkContext.broadcast((common[order], order))

    @F.pandas_udf("sig_ long, size_ int, fp long, signs_ array<long>, first_ array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            hashes = shingle_set(t, width)
            rows.append((_signature(t), len(hashes), fingerprint(t, width), parities(hashes), first_shingles(hashes, *shared_order.value, similarity)))
        return pd.DataFrame(rows, columns=["sig_", "size_", "fp", "signs_", "first_"])

    taken = written(picked.select("key_", F.xxhash64("text_").alias("x_"), of("text_").alias("r_")).select("key_", "x_", "r_.*"), "first")
    one = [F.first(c).alias(c) for c in ("size_", "fp", "signs_", "first_")]
    held = written(taken.groupBy("sig_").agg(F.min("key_").alias("least_"), F.min("x_").alias("x_"), *one), "held")
    rows = written(taken.select("key_", "x_", "sig_"), "rows")
    forget(taken)
    cells = held.select("sig_", F.explode("first_").alias("cell_")).withColumn("n_", F.count("*").over(Window.partitionBy("cell_")))
    shared = written(cells.where("n_ > 1").select("cell_", "sig_"), "shared")
    texts = written(held.drop("first_"), "texts")
    forget(held)
    # in a large cluster, a text without edits of its own shares most of its first shingles and lies in the middle
    weights = shared.groupBy("sig_").agg(F.count("*").alias("w_")).join(texts.select("sig_", "size_"), "sig_")
    cells = written(shared.join(weights, "sig_"), "cells")
    forget(shared)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf["text_"].iloc[at : at + BLOCK]
                yield pd.DataFrame({"sig_": [_signature(t) for t in part], "set_": [shingle_set(t, width) for t in part]})

    def fits(a: str, b: str) -> Column:
        return (F.col(a) >= similarity * F.col(b) - 1e-9) & (F.col(b) >= similarity * F.col(a) - 1e-9)

    def enough(shared: Column, m: str, n: str) -> Column:
        """Beyond what two sets share of their first shingles, one of them can share its later ones at most."""
        later = F.greatest(*[F.ceil(similarity * F.col(c) - 1e-9) - 1 for c in (m, n)])
        return (1 + similarity) * (shared + later) >= similarity * (F.col(m) + F.col(n)) - 1e-9

    def close(s: str, t: str, m: str, n: str) -> Column:
        """Whether the parities of two sets of these sizes leave open that they are similar."""
        apart = F.lit(0)
        for i in range(SIGNS):
            apart = apart + F.bit_count(F.col(s)[i].bitwiseXOR(F.col(t)[i]))
        return (1 + similarity) * apart <= (1 - similarity) * (F.col(m) + F.col(n)) + 1e-9

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) without those that their sizes or parities refute."""
        for end, signs, size in (("a", "s", "m"), ("b", "t", "n")):
            pairs = pairs.join(texts.select(F.col("sig_").alias(end), F.col("signs_").alias(signs), F.col("size_").alias(size)), end)
        return pairs.where(fits("m", "n") & close("s", "t", "m", "n")).select("a", "b")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        pairs = written(pairs, label)
        ends = pairs.select(F.col("a").alias("sig_")).union(pairs.select("b")).distinct()
        # two numbers a text of a pair, sent to the tasks so that the texts stay where they are
        one = F.broadcast(texts.join(ends, "sig_", "left_semi").select("x_"))
        held = picked.withColumn("x_", F.xxhash64("text_")).join(one, "x_", "left_semi").select("text_").mapInPandas(sets, "sig_ long, set_ array<long>")
        held = written(held.groupBy("sig_").agg(F.first("set_").alias("set_")), "sets")
        both = pairs.join(held.select(F.col("sig_").alias("a"), F.col("set_").alias("s")), "a").join(held.select(F.col("sig_").alias("b"), F.col("set_").alias("t")), "b")
        same = F.size(F.array_intersect("s", "t"))
        out = written(both.where(same / (F.size("s") + F.size("t") - same) >= similarity).select("a", "b"), "verified")
        forget(pairs, held)
        return out

    def components(found: DataFrame) -> DataFrame:
        """``sig_`` and ``c_``, the component, of every text under these links."""
        found = connected_components(found, "a", "b").withColumnRenamed("node", "sig_").withColumnRenamed("component", "component_")
        return written(texts.join(found, "sig_", "left").select("sig_", F.coalesce("component_", "sig_").alias("c_")), "linked")

    # texts of one fingerprint meet the least of them, and those of linked fingerprints each other
    prints = written(texts.groupBy("fp").agg(F.min("sig_").alias("p_")), "prints")
    alike = texts.join(prints, "fp").where("sig_ <> p_").select(F.col("p_").alias("a"), F.col("sig_").alias("b"))
    near = links(prints).join(prints.select(F.col("fp").alias("a"), F.col("p_").alias("p")), "a").join(prints.select(F.col("fp").alias("b"), F.col("p_").alias("q")), "b")
    alike = alike.union(near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))
    # the texts of a cell meet its head: a few pairs a text, which join most of a large cluster; those that share few cells are left for later
    top = cells.groupBy("cell_").agg(F.max(F.struct("w_", "sig_", "size_")).alias("h_"))
    star = cells.join(top, "cell_").where((F.col("sig_") != F.col("h_.sig_")) & fits("size_", "h_.size_"))
    star = star.groupBy(F.least("sig_", "h_.sig_").alias("a"), F.greatest("sig_", "h_.sig_").alias("b")).agg(F.count("*").alias("k"), F.first("size_").alias("m"), F.first("h_.size_").alias("n"))
    star = star.where(enough(2 * F.col("k"), "m", "n")).select("a", "b")
    found = verified(likely(alike.union(star).distinct()), "star")
    # then the texts of a cell that are still in different components meet; how often two do is what they share of their first shingles
    known = components(found)
    ends = Window.partitionBy("cell_")
    rest = cells.join(known, "sig_").withColumn("low_", F.min("c_").over(ends)).withColumn("high_", F.max("c_").over(ends)).where("low_ < high_")
    rest = rest.join(texts.select("sig_", "signs_"), "sig_").select("cell_", F.col("sig_").alias("a"), F.col("size_").alias("m"), F.col("c_").alias("c"), F.col("signs_").alias("s"))
    rest = written(rest, "apart")
    forget(cells, known)
    right = rest.select("cell_", F.col("a").alias("b"), F.col("m").alias("n"), F.col("c").alias("d"), F.col("s").alias("t"))
    met = rest.join(right, "cell_").where((F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & fits("m", "n") & close("s", "t", "m", "n"))
    met = met.groupBy("a", "b", "m", "n").agg(F.count("*").alias("k")).where(enough(F.col("k"), "m", "n"))
    linked = components(found.union(verified(met.select("a", "b"), "rest")))
    forget(rest)
    linked = written(texts.select("sig_", "least_").join(linked, "sig_"), "named")
    least = linked.groupBy("c_").agg(F.min("least_").alias("component"))
    named = linked.join(least, "c_").select("sig_", F.col("c_").alias("group_"), "component")
    return rows.join(named, "sig_").select("key_", "x_", "group_", "component")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of ``near_duplicates``: that of the least key and, where it has several texts there, of the one of the least
    hash. Of rows that repeat key and text one stays; unlike texts that share a key stay both, as do rows with a null key, since
    nothing tells them apart. All columns come back as they were."""
    return _one_of_each(docs, _linked_prints(docs, key, text), key, text)


def drop_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = COPY_SHINGLE, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """Like ``deduplicate``, of the components of ``similar_texts``."""
    return _one_of_each(docs, _similar(docs, key, text, width, similarity), key, text)


def _one_of_each(docs: DataFrame, groups: DataFrame, key: str, text: str) -> DataFrame:
    kept = groups.where("key_ IS NOT NULL").groupBy("group_").agg(F.min(F.struct("key_", "x_")).alias("k_")).select("k_.*").distinct()
    (sign,) = fresh(docs, "sign_")
    signed = docs.where(F.col(key).isNotNull()).withColumn(sign, F.xxhash64(F.col(text).cast("string")))
    known = signed.join(kept, (signed[key] == kept["key_"]) & (signed[sign] == kept["x_"]), "left_semi")
    return known.dropDuplicates([key, sign]).select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))
