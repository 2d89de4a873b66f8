"""String metrics and text expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def nan() -> Column:
    return F.lit(float("nan"))


def exact_match(reference: Column, response: Column) -> Column:
    """1.0 if equal (two nulls are equal), else 0.0; case and spaces count."""
    return reference.eqNullSafe(response).cast("double")


def string_present(reference: Column, response: Column) -> Column:
    """1.0 if the response contains the reference; the empty reference is in every response."""
    return F.coalesce(F.contains(response, reference), F.lit(False)).cast("double")


def _similarity(distance: Column, a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - distance / longest)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length, in characters; two empty strings are alike."""
    return _similarity(F.levenshtein(a, b), a, b)


def hamming_similarity(a: Column, b: Column) -> Column:
    """1 minus the share of differing places; what one string has beyond the other differs."""
    left, right = F.split(a, ""), F.split(b, "")
    left, right = F.filter(left, lambda c: c != ""), F.filter(right, lambda c: c != "")
    differing = F.size(F.filter(F.zip_with(left, right, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    return F.when(F.greatest(F.length(a), F.length(b)) == 0, F.lit(1.0)).otherwise(1 - differing / F.greatest(F.length(a), F.length(b)))


def _jaro(a: str, b: str) -> float:
    """Matching characters within half the longer length, less half of those out of order, rounded down."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free, hits = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                hits.append((i, j))
                break
    if not hits:
        return 0.0
    m = len(hits)
    moved = sum(a[i] != b[j] for (i, _), j in zip(hits, sorted(j for _, j in hits), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_similarity(a: Column, b: Column, prefix_weight: float = 0.0) -> Column:
    """Jaro similarity; with ``prefix_weight`` 0.1 Jaro-Winkler, which favours a common beginning of up to four characters."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            if p is None or q is None:
                out.append(None)
                continue
            s = _jaro(p, q)
            same = next((i for i in range(4) if p[i : i + 1] != q[i : i + 1] or i >= len(p)), 4)
            out.append(s + prefix_weight * same * (1 - s) if s > 0.7 else s)
        return pd.Series(out, dtype="float64")

    return of(a, b)


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    return jaro_similarity(a, b, 0.1)


SIMILARITIES = {"levenshtein": levenshtein_similarity, "hamming": hamming_similarity, "jaro": jaro_similarity, "jaro_winkler": jaro_winkler_similarity}


def string_similarity(a: Column, b: Column, measure: str = "levenshtein") -> Column:
    if measure not in SIMILARITIES:
        raise ValueError(f"unknown measure {measure!r}; known: {', '.join(SIMILARITIES)}")
    return SIMILARITIES[measure](a, b)


# Patterns of the extractors and of quoted spans.
LINKS = r"(?i)\b(?:https?://|www\.)\S+\b"
EMAILS = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
HEADINGS = r"(?m)^(#{1,6})\s+(.*)$"
QUOTED = "[\"'`´](.*?)[\"'`´]"


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def headings(text: Column) -> Column:
    """Array of (marks, title) of the markdown headings."""
    return F.arrays_zip(extract_all(text, HEADINGS, 1).alias("marks"), extract_all(text, HEADINGS, 2).alias("title"))


def normalised(text: Column, casefold: bool = True) -> Column:
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.lower(out) if casefold else out


def quoted_spans(answer: Column, min_words: int = 3, casefold: bool = True) -> Column:
    """The normalised quoted spans of an answer that have ``min_words`` words or more."""
    spans = F.transform(extract_all(answer, QUOTED, 1), lambda s: normalised(s, casefold))
    return F.filter(spans, lambda s: (s != "") & (F.size(F.split(s, " ")) >= min_words))


def quoted_span_hits(answer: Column, sources: Column, min_words: int = 3, casefold: bool = True) -> Column:
    """struct(matched, total): quoted spans that occur in the joined sources, and all of them."""
    spans = quoted_spans(answer, min_words, casefold)
    joined = normalised(F.array_join(sources, " "), casefold)
    return F.struct(F.size(F.filter(spans, lambda s: F.contains(joined, s))).alias("matched"), F.size(spans).alias("total"))


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)(?=[A-Z])", "_"))


def conciseness(summary: Column, text: Column) -> Column:
    """1 minus the length of the shorter over the length of the text."""
    return 1 - F.least(F.length(summary), F.length(text)) / (F.length(text) + F.lit(1e-10))


def parsed_rating(reply: Column, top: int = 2) -> Column:
    """The first of top, ..., 1, 0 that the reply contains, over ``top``; NaN if none."""
    chain = nan()
    for r in range(top + 1):
        chain = F.when(F.contains(reply, F.lit(str(r))), F.lit(r / top)).otherwise(chain)
    return F.coalesce(chain, nan())


def json_span(text: str | None) -> str | None:
    """The first JSON object or array of a reply: after a json fence if there is one, up to the bracket that balances it."""
    if text is None:
        return None
    text = text.split("```json", 1)[-1]
    start = min((i for i in (text.find("["), text.find("{")) if i >= 0), default=-1)
    if start < 0:
        return text
    opening = text[start]
    closing, depth = {"[": "]", "{": "}"}[opening], 0
    for i in range(start, len(text)):
        depth += (text[i] == opening) - (text[i] == closing)
        if not depth:
            return text[start : i + 1]
    return text[start:]


def extracted_json(reply: Column) -> Column:
    @F.pandas_udf("string")
    def of(x: pd.Series) -> pd.Series:
        return x.map(json_span)

    return of(reply)


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def rendered_prompt(instruction: str, examples: list[tuple[str, str]], payload: Column) -> Column:
    """A structured prompt: the static head once as a literal, then the row's input as JSON without nulls."""
    head = instruction + "".join(f"\n\nExample {i}\nInput: {a}\nOutput: {b}" for i, (a, b) in enumerate(examples, 1)) + "\n\nInput: "
    return F.concat(F.lit(head), F.to_json(payload), F.lit("\nOutput: "))
