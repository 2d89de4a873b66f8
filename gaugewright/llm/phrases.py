"""Phrase collocations by level-wise passes over the corpus.

Pass k counts the signatures (64-bit hashes) of the k-word phrases of all documents, but only where both overlapping (k-1)-word phrases are
frequent: a longer phrase never occurs more often than its parts. What is frequent goes to the tasks as a table of bits of bounded
size. Phrases that share a signature or a bit let a rare phrase through, never stop a frequent one; a last pass counts by their words the
phrases of all lengths that came through, and drops the rare ones. So neither the hashes nor the size of the table can change the
result. The cuts of each frequent phrase are scored from the tables of the levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import forget, written

LEAST = 30
LONGEST = 4
#: A phrase goes if a longer one around it has this percentage of its occurrences or more.
COVERED = 80
SCALE = 2_000_000
FIRST = 2_000
UNKNOWN = "und"
#: Bits for each frequent phrase, and the most of them (32 MB).
BITS_EACH = 16
MOST_BITS = 1 << 28
#: Bytes of text that are counted at a time.
CHUNK = 8 << 20
#: Parts in which a language's phrases are ranked first.
RANK_PARTS = 64

#: A-Z become a-z, what ends a piece becomes a full stop; only the space and the tab are left to split at.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 46 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def _extended(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The signature of a phrase from that of its first words and the hash of its last."""
    mixed = (before ^ (before >> _SHIFT)) * _MULTIPLIER + word
    return mixed ^ (mixed >> _SHIFT)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words of texts, -1 where a piece ends, and the words of the codes."""
    tokens = b"\n".join(texts).translate(_FOLD).replace(b".", b" . ").split()
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    stop = pc.index(coded.dictionary, pa.scalar(b".", pa.binary())).as_py()
    if stop >= 0:
        codes[codes == stop] = -1
    return codes, coded.dictionary


def _signed(codes: np.ndarray, hashes: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For phrases of 1 to ``longest`` words: of each place, the signature of the phrase from there on and whether no piece ends in it."""
    whole, sig = codes >= 0, hashes[codes]
    yield sig, whole
    for j in range(1, longest):
        whole = whole[:-1] & (codes[j:] >= 0)
        sig = _extended(sig[:-1], hashes[codes[j:]])
        yield sig, whole


def _known(sig: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = sig & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)).astype(np.int64)) & 1 == 1


def _hashes(lang: str, words: pa.Array) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()] or [0], np.uint64)


def signature_counts(lang: str, texts: list[bytes], k: int, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The different signatures of the phrases of ``k`` words of texts of one language, and how often they occur; with ``known``, the bits
    of the frequent phrases of k-1 words, only of those whose two such parts have their bit."""
    codes, words = _tokens(texts)
    *_, before, (sig, whole) = [(None, None), *_signed(codes, _hashes(lang, words), k)]
    if known is not None:
        part = _known(before[0], known)
        whole = whole & part[:-1] & part[1:]
    return np.unique(sig[whole], return_counts=True)


def phrase_counts(lang: str, texts: list[bytes], known: list[np.ndarray]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(k, phrases, counts) of the phrases of texts of one language that have their bit among those of their length; and, as phrases of
    0 words, the count of all words."""
    codes, words = _tokens(texts)
    yield 0, pa.array([b""], pa.binary()), np.array([(codes >= 0).sum()])
    for k, (bits, (sig, whole)) in enumerate(zip(known, _signed(codes, _hashes(lang, words), len(known)), strict=False), 1):
        starts = np.flatnonzero(whole & _known(sig, bits))
        # the phrases that occur, numbered column by column so that the numbers stay below 64 bits
        number = codes[starts]
        for j in range(1, k):
            number = np.unique(number * len(words) + codes[starts + j], return_inverse=True)[1]
        _, first, n = np.unique(number, return_index=True, return_counts=True)
        columns = [words.take(pa.array(codes[starts[first] + j])) for j in range(k)]
        yield k, pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())), n


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of each language in parts of about CHUNK bytes. A text beyond that is cut where pieces end, which no phrase crosses."""
    held: dict[str, tuple[list[bytes], int]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
        while text:
            cut = len(text)
            if cut > CHUNK:
                cut = max((text.rfind(stop, 0, CHUNK) for stop in (b"\n", b".", b",")), default=-1) + 1 or cut
            texts, size = held.get(lang, ([], 0))
            texts.append(text[:cut])
            held[lang] = (texts, size + cut)
            text = text[cut:]
            if held[lang][1] >= CHUNK:
                yield lang, held.pop(lang)[0]
    for lang, (texts, _) in held.items():
        yield lang, texts


def _signatures(texts: DataFrame, k: int, known: np.ndarray | None, least: int) -> DataFrame:
    """``sig``: the frequent signatures of the phrases of ``k`` words of ``texts`` (lang, text)."""
    shared = None if known is None else texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, held in _chunks(batch):
                sig, n = signature_counts(lang, held, k, None if shared is None else shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(n.astype(np.int64))], ["sig", "n"])

    return texts.mapInArrow(run, "sig long, n long").groupBy("sig").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("sig")


def _counted(texts: DataFrame, known: list[np.ndarray]) -> DataFrame:
    """``lang``, ``phrase``, ``k`` and ``f`` of the phrases of ``texts`` that have their bit; of 0 words: all words of the language."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, held in _chunks(batch):
                for k, phrases, n in phrase_counts(lang, held, shared.value):
                    columns = [pa.array([lang] * len(n), pa.string()), phrases.cast(pa.string()), pa.array(np.full(len(n), k, np.int32)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "k", "f"])

    return texts.mapInArrow(run, "lang string, phrase string, k int, f long").groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f"))


def frequent_bits(signatures: DataFrame, count: int, most: int = MOST_BITS) -> np.ndarray:
    """The bits of ``signatures``, as longs: BITS_EACH for each of its ``count`` rows, ``most`` together. Spark sets them; the driver gets as
    many longs as the bits fill, 2^22 at most."""
    size = 64
    while size < min(count * BITS_EACH, most):
        size *= 2
    at = F.col("sig").bitwiseAND(F.lit(size - 1))
    bit = F.expr("shiftleft(1L, CAST(at_ & 63 AS INT))")
    held = signatures.select(at.alias("at_")).groupBy(F.shiftright("at_", 6).alias("long_")).agg(F.bit_or(bit).alias("bits_")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[held.column("long_").to_numpy()] = held.column("bits_").to_numpy()
    return bits


def levels(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, most_bits: int = MOST_BITS) -> DataFrame:
    """``lang``, ``phrase``, ``k`` and ``f``: the frequent phrases of 1 to ``longest`` words; of 0 words, all words of each language."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    known: list[np.ndarray] = []
    for k in range(1, longest + 1):
        signatures = written(_signatures(texts, k, known[-1] if known else None, least), "signatures")
        count = signatures.count()
        if not count:
            break
        known.append(frequent_bits(signatures, count, most_bits))
        forget(signatures)
    return written(_counted(texts, known).where((F.col("f") >= least) | (F.col("k") == 0)), "phrases")


def _part(words: Column, start: Column, count: Column) -> Column:
    return F.array_join(F.slice(words, start, count), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, first: int = FIRST, most_bits: int = MOST_BITS) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``: the ``first`` phrases of each language by score, ``a`` and phrase.

    Words are runs without space and tab, of texts with A-Z in lower case; phrases do not cross ``.,;:!?`` and the ends of lines.
    The score is that of the phrase's weakest cut, ``floor(SCALE * a / (l + r))``, the shorter first part where cuts tie. Phrases inside a
    longer frequent one that has ``covered`` percent of their occurrences go. A null text is empty, a null language is ``und``;
    repeated rows count as often as they occur; a language without frequent phrases has no row, an empty table gives an empty one;
    other columns, whatever their names, are not read.
    """
    table = levels(docs, text, lang, least, longest, most_bits)
    totals = table.where("k = 0").select("lang", F.col("f").alias("n"))
    known = table.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of"))
    words = F.split("phrase", " ")
    candidates = table.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    # the cuts, each with the counts of its two parts
    cuts = candidates.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("one", _part(words, F.lit(1), F.col("cut"))).withColumn("two", _part(words, F.col("cut") + 1, F.col("k") - F.col("cut"))).drop("k")
    cuts = cuts.join(known.select("lang", F.col("part").alias("one"), F.col("of").alias("l")), ["lang", "one"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("two"), F.col("of").alias("r")), ["lang", "two"])
    score = F.expr(f"(CAST(a AS DECIMAL(20, 0)) * {SCALE}) div (CAST(l AS DECIMAL(20, 0)) + r)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("cut"))
    # the phrases inside longer ones
    spans = F.explode(F.expr("flatten(transform(sequence(2, k - 1), n -> transform(sequence(1, k - n + 1), i -> struct(i, n))))"))
    inside = candidates.where("k > 2").select("lang", "phrase", "a", spans.alias("s"))
    inside = inside.select("lang", _part(words, F.col("s.i"), F.col("s.n")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = scored.join(inside, ["lang", "phrase"], "left")
    kept = kept.where(F.expr(f"around IS NULL OR CAST(around AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {covered}"))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # the first of each part of a language, then the first of these
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    parted = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
