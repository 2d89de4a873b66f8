import math

import pytest
from pyspark.sql import functions as F

from gaugewright.functions import ngram, sets, text, vector
from gaugewright.operators import tools


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<int>' if isinstance(v, list) and v and isinstance(v[0], int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


PAIRS = [("Hello World", "Hello World", 1.0), ("Hello World", "Hallo World", 1 - 1 / 11), ("abc", "xyz", 0.0), ("", "abc", 0.0), ("abc", "", 0.0), ("", "", 1.0), ("é", "e", 0.0)]


@pytest.mark.parametrize(("a", "b", "want"), PAIRS)
@pytest.mark.parametrize("measure", ["levenshtein", "hamming"])
def test_edit_similarity(spark, a, b, want, measure):
    assert one(spark, text.string_similarity(F.col("a"), F.col("b"), measure), a=a, b=b) == pytest.approx(want)


def test_jaro(spark):
    assert text._jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert one(spark, text.jaro_winkler_similarity(F.col("a"), F.col("b")), a="martha", b="marhta") == pytest.approx(0.961111, abs=1e-6)
    with pytest.raises(ValueError, match="unknown measure"):
        text.string_similarity(F.col("a"), F.col("b"), "none")


@pytest.mark.parametrize(("answer", "source", "least", "want"), [
    ('Paris is "the capital of France".', "The capital of France is Paris.", 3, (1, 1)),
    ('GDP was "$2.9T" in 2023.', "It was $2.7T in 2023.", 1, (0, 1)),
    ('Result: "Delta   E    = mc  ^ 2".', "as delta e = mc ^ 2 holds here", 3, (1, 1)),
    ("No quotes here.", "Irrelevant.", 3, (0, 0)),
])
def test_quoted_spans(spark, answer, source, least, want):
    hit = one(spark, text.quoted_span_hits(F.col("a"), F.array("s"), least), a=answer, s=source)
    assert (hit["matched"], hit["total"]) == want


def test_small_helpers(spark):
    assert one(spark, text.camel_to_snake(F.col("a")), a="AnswerSimilarityScore") == "answer_similarity_score"
    assert one(spark, text.parsed_rating(F.col("a")), a="rating 2 of 2") == 1.0
    assert math.isnan(one(spark, text.parsed_rating(F.col("a")), a="none"))
    assert text.json_span('so ```json\n{"a": [1, {"b": 2}]} done') == '{"a": [1, {"b": 2}]}'
    assert text.json_span('x [1, 2') == "[1, 2"


def test_average_precision(spark):
    assert one(spark, sets.average_precision(F.col("v")), v=[1, 0, 1]) == pytest.approx(0.8333333332916666, abs=1e-12)
    assert one(spark, sets.average_precision(F.col("v")), v=[0, 0]) == 0.0


def test_ids(spark):
    assert one(spark, sets.id_precision(F.col("a"), F.col("b")), a=["1", "2", "2"], b=["2", "3", "4"]) == 0.5
    assert one(spark, sets.id_recall(F.col("a"), F.col("b")), a=["1", "2", "2"], b=["2", "3", "4"]) == pytest.approx(1 / 3)
    assert math.isnan(one(spark, sets.id_precision(F.col("a"), F.col("b")), a=[], b=["1"]))


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    row = df.select(vector.cosine(F.col("a"), F.col("b")).alias("c"), vector.semantic_similarity(F.col("a"), F.col("b"), 0.8).alias("t")).first()
    assert row["c"] == pytest.approx(math.sqrt(0.5)) and row["t"] == 0.0


def test_ngrams():
    assert ngram.bleu("the cat sat on the mat", "the cat sat on the mat") == pytest.approx(1.0)
    assert ngram.bleu("a b c", "x y z") == 0.0
    assert ngram.chrf("", "abc") == 0.0 and ngram.chrf("abcdef", "abcdef") == pytest.approx(1.0)
    # the, cat, were, run against the, cat, run: precision 1, recall 3/4
    assert ngram.rouge("the cats were running", "the cat runs", "rouge1") == pytest.approx(6 / 7)
    assert ngram.rouge("a b c d", "a c d", "rougeL", "recall") == pytest.approx(0.75)
    for word, stem in (("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("happy", "happi"), ("probate", "probat")):
        assert ngram.porter(word) == stem


CALL = "array<struct<name: string, args: map<string, string>>>"


@pytest.mark.parametrize(("got", "want", "f1", "accuracy"), [
    ([("a", {"x": "1"}), ("b", {})], [("a", {"x": "1"}), ("b", {})], 1.0, 1.0),
    ([("a", {"x": "1"})], [("a", {"x": "1"}), ("b", {})], 0.6667, 0.0),
    ([("c", {})], [("a", {})], 0.0, 0.0),
    ([], [("a", {})], 0.0, 0.0),
    ([], [], 0.0, 1.0),
    ([("a", {"x": "1", "y": "0"}), ("b", {"z": "3"})], [("a", {"x": "1", "y": "2"}), ("b", {"z": "3"})], 0.5, 0.75),
    ([("b", {}), ("a", {})], [("a", {}), ("b", {})], 1.0, 0.0),
])
def test_tool_calls(spark, got, want, f1, accuracy):
    df = spark.createDataFrame([(got, want)], f"p {CALL}, r {CALL}")
    row = df.select(tools.tool_call_f1(F.col("p"), F.col("r")).alias("f"), tools.tool_call_accuracy(F.col("p"), F.col("r")).alias("a"), tools.tool_call_accuracy(F.col("p"), F.col("r"), False).alias("s")).first()
    assert row["f"] == pytest.approx(f1) and row["a"] == pytest.approx(accuracy)
    if [c[0] for c in got] == ["b", "a"]:
        assert row["s"] == 1.0
