"""BLEU over streams, results within tolerances, nested dates, table functions, usage by one parse."""

import json
import os
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugewright.functions import ngram
from gaugewright.operators import aggregate, sampling, schema, splitters, tokens
from gaugewright.sources import catalog, records


def test_bleu_worked_values():
    """The example of the public scorer's own description, and values by hand."""
    hypotheses = ["The dog bit the man.", "It wasn't surprising.", "The man had just bitten him."]
    streams = [["The dog bit the man.", "It was not unexpected.", "The man bit him first."], ["The dog had bit the man.", "No one was surprised.", "The man had bitten the dog."]]
    assert 100 * ngram.corpus_bleu(hypotheses, streams) == pytest.approx(48.530827009929865)
    assert ngram.bleu("a b c d e. a b c d", "a b c d") == pytest.approx(1.0)  # the nearest length is the second stream's
    assert ngram.bleu("a b c d e", "a b c d") == pytest.approx(2.718281828459045 ** (1 - 5 / 4))
    assert ngram.bleu("a b c d. x", "a b c d. y y y y") == pytest.approx(1.0)  # the first sentence counts
    assert ngram.bleu("a a b c d", "a a a a b c d") == pytest.approx((5 / 7 * 4 / 6 * 3 / 5 * 2 / 4) ** 0.25)  # clipped
    assert ngram.bleu("a b c", "a b c") == 0.0 == ngram.bleu("", "") == ngram.bleu("a b c d", "")
    assert ngram.bleu_tokens("It's 3.5 o'clock, &amp; (1-2)! \nx") == ["It's", "3.5", "o'clock", ",", "&", "(", "1", "-", "2", ")", "!", "x"]


def test_results_within_tolerances(spark):
    row = lambda *values: spark.createDataFrame([(v, t) for v, t in values], "v double, t string")
    same = records.same_result
    assert same(row((1.49999999996e-9, "a")), row((1.50000000004e-9, "a")))
    assert same(row((1e12, "a")), row((1e12 + 0.001, "a"))) and not same(row((1e12, "a")), row((1e12 + 1000, "a")))
    assert not same(row((1.0, "a")), row((1.0 + 1e-8, "a"))) and same(row((1.0, "a")), row((1.0 + 1e-8, "a")), tolerance=1e-7)
    assert not same(row((1.0, "a")), row((1.0, "b"))) and not same(row((1.0, "a"), (1.0, "a")), row((1.0, "a")))
    assert not same(row((1.0, "a"), (1.0, "a"), (2.0, "a")), row((1.0, "a"), (2.0, "a"), (2.0, "a")))  # repeats count
    odd = [(float("nan"), "a"), (None, "a"), (float("inf"), "a"), (float("-inf"), None), (0.0, None)]
    assert same(row(*odd), row(*odd[::-1])) and not same(row((None, "a")), row((float("nan"), "a"))) and not same(row((0.0, "a")), row((None, "a")))
    ints = spark.createDataFrame([(1,), (2,)], "n int")
    assert same(ints, spark.createDataFrame([(2.0,), (1.0 + 1e-11,)], "m double")) and not same(ints, ints.withColumn("x", F.lit(1)))
    assert same(row().limit(0), row().limit(0)) and not same(row(), row((1.0, "a")))


def test_results_of_several_columns(spark):
    """Each number a little off, rows shuffled: the same; one of them beyond the tolerance: not."""
    rng = random.Random(4)
    rows = [(float(rng.randrange(5)), rng.choice([0.1, 0.2, 0.30000000001]), rng.choice("xy"), rng.randrange(3)) for _ in range(200)]
    near = [(a + rng.choice([-4e-11, 0, 4e-11]), b + rng.choice([-4e-11, 0, 4e-11]), c, d) for a, b, c, d in rows]
    rng.shuffle(near)
    schema_ = "a double, b double, c string, d int"
    one, two = spark.createDataFrame(rows, schema_), spark.createDataFrame(near, schema_)
    assert records.same_result(one, two)
    near[7] = (near[7][0], near[7][1] + 1e-7, *near[7][2:])
    assert not records.same_result(one, spark.createDataFrame(near, schema_))


def test_dates_at_any_depth(spark, tmp_path):
    lines = [
        {"id": 1, "s": {"d": "2024-01-02", "t": {"at": "2024-01-02T03:04:05Z"}}, "l": [{"d": "2024-01-02"}, {"d": None}], "m": ["2024-05-06", "no date"], "e": None},
        {"id": 2, "s": None, "l": [], "m": None, "e": None},
        {"id": 3, "s": {"d": None, "t": None}, "l": None, "m": [], "e": None},
    ]
    folder = tmp_path / "datasets" / "x"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"id": 4, "s": \n\n[1, 2]\nnonsense\n')
    store = catalog.FolderCatalog(spark, f"file://{tmp_path}")
    assert store.malformed("x") == 3
    schema_ = "id long, s struct<d: string, t: struct<at: string>>, l array<struct<d: string>>, m array<string>, e string"
    df = store.load("x", schema=schema_)
    assert df.schema.simpleString() == "struct<id:bigint,s:struct<d:date,t:struct<at:timestamp>>,l:array<struct<d:date>>,m:array<string>,e:string>"
    got = {r["id"]: r for r in df.where("id IS NOT NULL").collect()}
    assert str(got[1]["s"]["d"]) == "2024-01-02" and got[1]["l"][1]["d"] is None and got[1]["m"] == ["2024-05-06", "no date"]
    assert got[2]["s"] is None and got[2]["l"] == [] and got[3]["s"]["t"] is None and got[3]["l"] is None
    mapped = catalog.revived(spark.createDataFrame([({"a": "2024-01-02", "b": None},)], "m map<string, string>"))
    assert mapped.schema["m"].dataType.simpleString() == "map<string,date>" and str(mapped.first()["m"]["a"]) == "2024-01-02"
    with pytest.raises(ValueError):
        catalog.FolderCatalog(spark, f"file://{tmp_path}", "csv").malformed("x")


def plain_headlines(text, heads, least, most):
    """Cut in the listed order, evened out."""
    if len(text.split()) < least or not heads:
        return [text]
    at = [0, *(text.find(h) for h in heads if h and h in text), len(text)]
    out, held = [], ""
    for piece in (text[a:b] for a, b in zip(at, at[1:])):
        words = piece.split()
        while len(words) > most:
            out.append(" ".join(words[:most]))
            words = words[most:]
            piece = " ".join(words)
        if len(words) < least:
            held = f"{held} {piece}" if held else piece
            if len(held.split()) >= least:
                out.append(held)
                held = ""
        else:
            out += [held, piece] if held else [piece]
            held = ""
    return [*out, held] if held else out


def test_splitters_in_sql(spark):
    rng = random.Random(3)
    data = []
    for i in range(60):
        words = [rng.choice(["one", "two", "Three", "IV", "five"]) for _ in range(rng.randint(0, 60))]
        heads = rng.choice([None, [], [" ".join(words[a : a + 2]) for a in rng.choices(range(60), k=3)], ["absent"]])
        data.append((i, rng.choice([" ", "\n"]).join(words), heads))
    data.append((99, None, ["x"]))
    df = spark.createDataFrame(data, "id long, text string, headlines array<string>")
    splitters.register_splitters(spark)
    got = spark.sql("SELECT id, pos, chunk FROM {df}, LATERAL headline_chunks(text, headlines, 8, 20)", df=df).collect()
    want = sorted((i, p, c) for i, t, h in data for p, c in enumerate(plain_headlines(t or "", h, 8, 20)))
    assert sorted(map(tuple, got)) == want
    assert sorted(map(tuple, splitters.headline_chunks(df, 8, 20).collect())) == want
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = spark.createDataFrame([(1, "Tokens of a longer text, wörds and more of them."), (2, ""), (3, None)], "id long, text string")
    parts = spark.sql("SELECT id, pos, chunk FROM {t}, LATERAL token_windows(text, {p}, 4, 0) ORDER BY id, pos", t=texts, p=path).collect()
    assert "".join(r["chunk"] for r in parts) == texts.first()["text"] and {r["id"] for r in parts} == {1}
    ids = len(Tokenizer.from_file(path).encode(texts.first()["text"], add_special_tokens=False).ids)
    assert len(parts) == -(-ids // 4)
    assert tokens.token_windows(texts, path, 4, 2).where("id = 1").count() == -(-(ids - 2) // 2)
    with pytest.raises(ValueError):
        tokens.token_windows(texts, path, 4, 4)


def test_splitters_take_few_texts_at_once(spark, monkeypatch):
    class Resident:
        def eval(self, text, headlines, least, most):
            with open("/proc/self/statm") as f:
                yield 0, f.read().split()[1]

    monkeypatch.setitem(splitters.SPLITTERS, "headline_chunks", Resident)
    monkeypatch.setitem(spark.sparkContext.environment, "FRESH_WORKERS", "1")  # no worker that has grown in another test
    docs = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("word "), 20_000).alias("text")).withColumn("headlines", F.array("text"))
    pages = splitters.headline_chunks(docs).select(F.max(F.col("chunk").cast("long"))).first()[0]
    assert pages * os.sysconf("SC_PAGE_SIZE") < 200e6  # an Arrow batch takes it to 320e6


def test_usage_is_parsed_once(spark):
    replies = [
        ("anthropic", {"model": "m", "usage": {"input_tokens": 3, "output_tokens": 4}}, (3, 4, "m")),
        ("azure", {"model_name": "z", "usage": {"input_tokens": "5"}, "token_usage": {"completion_tokens": 6}}, (5, 6, "z")),
        ("openai", {"token_usage": {"prompt_tokens": None}}, (0, 0, "")),
        ("bedrock", {"usage": [1], "model_id": "b"}, (0, 0, "b")),
    ]
    for provider, reply, want in replies:
        df = spark.createDataFrame([(json.dumps(reply),), ("no json",), (None,)], "reply string")
        out = df.select(aggregate.parsed_usage(F.col("reply"), provider).alias("u")).select("u.*")
        assert [tuple(r) for r in out.collect()] == [want, (0, 0, ""), (0, 0, "")]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("parse_json") <= 1 or plan.count("parseJson") <= 1


def test_small_operators(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "c string")
    assert {(r["c"], r["n"], r["share"]) for r in sampling.class_shares(df, "c").collect()} == {("a", 2, 0.5), (None, 1, 0.25), ("b", 1, 0.25)}
    assert sampling.class_shares(df.limit(0), "c").count() == 0
    turns = spark.createDataFrame([(1, 0, "user"), (1, 1, "tool"), (1, 2, "assistant"), (1, 3, None), (2, 0, "tool")], "conv_id long, turn int, role string")
    assert {(r[0], r[1]): r[3] for r in schema.ai_seen_before(turns).collect()} == {(1, 0): False, (1, 1): False, (1, 2): False, (1, 3): True, (2, 0): False}
