"""Judges, prompts, custom metrics and the test-set generator."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.operators import aggregate, pairs, retrieval, sampling, testset, tokens
from gaugewright.plans import align, custom, evaluate, generate, judge_metrics, prompts
from gaugewright.plans.judging import Judge, RuleModel
from gaugewright.sources import records

JUDGE = Judge(RuleModel, "rules")


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, "q", "Rome is old. Rome is big", "Rome is old. It rains", ["Rome is old and warm", "nothing"], ["Rome is old"], {"score1": "bad"}),
        (2, "q", "", "Rome is old", ["x"], ["x"], {"score1": "bad"}),
    ]
    return spark.createDataFrame(data, "row_id long, user_input string, response string, reference string, retrieved_contexts array<string>, reference_contexts array<string>, rubrics map<string,string>")


def test_all_single_turn_judges_run(rows):
    names = [n for n, (_, _, kinds) in judge_metrics.JUDGED.items() if "single" in kinds]
    got = {r["row_id"]: r for r in evaluate.evaluate(rows, names, judge=JUDGE).scores.collect()}
    assert got[1]["faithfulness"] == 0.5 and math.isnan(got[2]["faithfulness"])
    assert got[1]["context_precision"] == pytest.approx(1.0, abs=1e-9) and got[1]["context_recall"] == 0.5
    assert got[1]["factual_correctness"] == 0.5 and got[1]["noise_sensitivity"] == 0.0
    assert 0 < got[1]["answer_correctness"] < 1 and 0 <= got[1]["answer_relevancy"] <= 1
    assert got[2]["answer_correctness"] >= 0.75  # a side without statements
    with pytest.raises(ValueError, match="judge is needed"):
        evaluate.evaluate(rows, ["faithfulness"])


def test_legacy_rules(rows):
    legacy = judge_metrics.answer_correctness((1.0, 0.0), compat="legacy")(rows, JUDGE, "row_id")
    assert {r["row_id"]: r["score"] for r in legacy.collect()}[2] == 0.0
    recall = judge_metrics.context_entity_recall("legacy")(rows, JUDGE, "row_id")
    assert recall.count() == 2


def test_votes_and_classifier(spark, rows):
    class Drift(RuleModel):
        def complete(self, texts):
            self.n = getattr(self, "n", 0)
            out = []
            for _ in texts:
                self.n += 1
                out.append(json.dumps({"verdicts": [{"statement": "s", "verdict": int(self.n % 3 != 0)}]}))
            return out

    one = rows.where("row_id = 1").coalesce(1)
    assert judge_metrics.context_recall(3)(one, Judge(Drift, "d"), "row_id").first()["score"] in (0.0, 1.0)

    class Half:
        def predict(self, given):
            return [0.4 if "big" in s else 0.6 for _, s in given]

    assert judge_metrics.faithfulness_by_classifier(Half)(one, JUDGE, "row_id").first()["score"] == 0.5


def test_repair_finish_and_errors(rows):
    class Scripted:
        """Replies from a list, the last one for ever."""

        def __init__(self, *replies):
            self.replies = list(replies)

        def complete(self, texts):
            return [self.replies.pop(0) if len(self.replies) > 1 else self.replies[0] for _ in texts]

    p = prompts.Prompt("t", "Say.", "value int")
    one = rows.where("row_id = 1").coalesce(1)
    ask = lambda *replies, **kw: Judge(lambda: Scripted(*replies), str(replies), **kw).ask(one, p, text=F.col("response")).first()
    assert ask("no", "still no", '```json\n{"value": 3}\n```')["out"]["value"] == 3
    assert ask("no", repairs=1)["out"] is None and "JSON" in ask("no", repairs=1)["error"]
    assert "did not finish" in ask(('{"value": 1}', "content_filter"))["error"]
    assert ask(('{"value": 1}', "max_tokens"))["out"]["value"] == 1

    class Down:
        def complete(self, texts):
            raise OSError("down")

    assert "down" in Judge(Down, "down").ask(one, p, text=F.col("response")).first()["error"]


def test_equal_requests_are_asked_once(spark):
    seen = spark.sparkContext.accumulator(0)

    class Counting(RuleModel):
        def complete(self, texts):
            seen.add(len(texts))
            return super().complete(texts)

    df = spark.createDataFrame([(i, "Same text. Twice") for i in range(50)], "row_id long, response string")
    out = Judge(Counting, "c").ask(df, judge_metrics.PROMPTS["statements"], text=F.col("response"))
    assert out.count() == 50 and out.where("size(out.statements) = 2").count() == 50 and seen.value == 1


def test_prompts_on_disk(tmp_path):
    p = prompts.Prompt("t", "Say.", "a string, b array<struct<x: int, y: string>>", (({"q": "hi"}, {"a": "yo", "b": []}),))
    assert p.fields() == ["a", "b"]
    prompts.save_prompts({"t": p}, tmp_path)
    assert prompts.load_prompts(["t"], tmp_path)["t"] == p
    with pytest.raises(FileExistsError):
        p.save(tmp_path / "t_english.json")
    changed = json.loads((tmp_path / "t_english.json").read_text()) | {"instruction": "Shout."}
    (tmp_path / "t_english.json").write_text(json.dumps(changed))
    with pytest.raises(ValueError, match="digest"):
        prompts.Prompt.load(tmp_path / "t_english.json")
    loud = p.translated("loud", lambda texts: [t.upper() for t in texts])
    assert loud.examples == (({"q": "HI"}, {"a": "YO", "b": []}),) and loud.digest() != p.digest()
    with pytest.raises(ValueError, match="came back"):
        p.translated("none", lambda texts: [])
    with pytest.raises(ValueError, match="lacks"):
        p.with_examples(({"q": 1}, {"a": 2}))


def test_content_parts(spark):
    values = ["data:image/png;base64,AAAA", "https://img.example/a.png", "https://other.example/a.png", "/etc/a.png", "text", "http://img.example/a.png", "https://x@img.example/a.png"]
    df = spark.createDataFrame([(v,) for v in values], "c string").select(prompts.content_parts(F.col("c"), ("img.example",)).alias("p"))
    assert [r["p"]["kind"] for r in df.collect()] == ["image", "image", "text", "text", "text", "text", "text"]


def test_prompt_metrics(spark, rows, tmp_path):
    m = custom.PromptMetric("length", "How long is {response}?", "numeric", (0, 3))
    m.save(tmp_path / "m.json")
    assert custom.PromptMetric.load(tmp_path / "m.json") == m and m.columns() == ["response"]
    rule = lambda: RuleModel({"length": lambda g: {"value": len(g["response"].split()) or 9, "reason": "counted"}})
    got = {r["row_id"]: r for r in m.judged(rows, Judge(rule, "l"), "row_id").collect()}
    assert got[1]["score"] is None and "outside" in got[1]["reason"]  # six words
    wide = custom.PromptMetric("length", "How long is {response}?", "numeric", (0, 8)).metric()
    assert evaluate.evaluate(rows, [wide], judge=Judge(rule, "w")).scores.where("row_id = 1").first()["length"] == 6.0
    ranking = custom.PromptMetric("rank", "Rank {response}.", "ranking", (2,))
    order = lambda: RuleModel({"rank": lambda g: {"value": ["a", "b"] if g["response"] else ["a"], "reason": ""}})
    got = {r["row_id"]: r["score"] for r in ranking.judged(rows, Judge(order, "r"), "row_id").collect()}
    assert got == {1: ["a", "b"], 2: None}
    shown = m.with_examples(rows.withColumn("gold", F.lit(2.0)), "gold")
    assert len(shown.examples) == 2 and "Example 2" in shown.prompt().head()
    with pytest.raises(ValueError):
        custom.PromptMetric("x", "y", "odd")
    (tmp_path / "m.json").write_text("{}")
    with pytest.raises(ValueError):
        custom.PromptMetric.load(tmp_path / "m.json")


def test_conversation_judges(spark):
    from gaugewright.operators.schema import assemble_conversations

    turns = [(1, 0, "user", "weather today"), (1, 1, "assistant", "the weather today is fine"), (2, 0, "user", "poison"), (2, 1, "assistant", "I cannot say")]
    convs = assemble_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    convs = convs.withColumns({"reference_topics": F.array(F.lit("weather")), "reference": F.lit("fine")})
    names = ["topic_adherence", "agent_goal_accuracy_with_reference", "agent_goal_accuracy_without_reference", "harmfulness"]
    got = {r["conv_id"]: r for r in evaluate.evaluate(convs, names, "conv_id", JUDGE).scores.collect()}
    assert got[1]["topic_adherence"] == pytest.approx(1.0, abs=1e-6) and got[2]["topic_adherence"] == pytest.approx(0.0, abs=1e-6)
    assert [got[1][n] for n in names[1:3]] == [1.0, 1.0] and got[2][names[2]] == 0.0 and got[2]["harmfulness"] == 0.0


# ---- the generator


@pytest.fixture(scope="module")
def library(spark):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()
    texts = [". ".join(f"{words[(i + j) % 10].title()} government number {j} of {words[(i * j) % 10]}" for j in range(40)) for i in range(8)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_generator(spark, library):
    steps = generate.default_steps(library, JUDGE)
    g = generate.transformed(generate.document_nodes(library), steps)
    assert {"summary", "summary_embedding", "themes", "entities"} <= set(g.nodes.columns)
    made = generate.generate(g, JUDGE, 12)
    got = made.collect()
    assert 5 <= len(got) <= 14 and all(r["user_input"] and r["reference_contexts"] for r in got)
    assert {r["synthesizer_name"] for r in got} >= {"single_hop_specific", "multi_hop_specific"}
    assert all(len(r["reference_contexts"]) == 2 and r["reference_contexts"][1].startswith("<2-hop>") for r in got if r["synthesizer_name"].startswith("multi"))
    samples = generate.to_evaluation(made).withColumns({"row_id": F.monotonically_increasing_id(), "response": F.col("reference"), "retrieved_contexts": F.col("reference_contexts")})
    assert evaluate.evaluate(samples, ["faithfulness"], judge=JUDGE).summary().first()["faithfulness"] == 1.0


def test_extractors_keep_what_is_there(spark, library):
    g = generate.document_nodes(library.limit(3))
    g = type(g)(g.nodes.withColumn("title", F.when(F.col("id") == "0", F.lit("kept"))), g.edges)
    out = generate.transformed(g, [[generate.extract(n, JUDGE) for n in generate.EXTRACTORS]])
    titles = {r["id"]: r["title"] for r in out.nodes.collect()}
    assert titles["0"] == "kept" and all(titles.values()) and out.nodes.where("topic_description is null or size(headlines) = 0").count() == 0
    with pytest.raises(ValueError):
        generate.default_steps(spark.createDataFrame([(1, "short")], "doc_id long, text string"), JUDGE)


# ---- against plain Python


def test_cosine_pairs_and_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(6, 8))
    v = [(i, (middles[i % 6] + rng.normal(size=8) * (0.05 if i < 200 else 1.0)).tolist()) for i in range(260)]
    df = spark.createDataFrame(v, "id long, embedding array<double>")
    x = np.array([a for _, a in v])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = x @ x.T
    for threshold in (0.3, 0.95):
        want = {(i, j) for i in range(260) for j in range(i + 1, 260) if sim[i, j] >= threshold}
        got = [(r["src"], r["dst"]) for r in pairs.cosine_pairs(df, threshold, block_rows=16).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    rows = df.select(F.col("id").alias("query_id"), "embedding").where("query_id % 20 = 0")
    found = align.few_shot_examples(rows, df.select(F.col("id").alias("example_id"), "embedding"), 4, -1.0)
    got = {(r["query_id"], r["rank"]): r["example_id"] for r in found.collect()}
    assert got == {(q, k + 1): int(i) for q in range(0, 260, 20) for k, i in enumerate(np.lexsort((np.arange(260), -np.round(sim[q], 12)))[:4])}
    odd = rows.unionByName(spark.createDataFrame([(999, None)], rows.schema))
    back = align.examples_with_fallback(odd, df.select(F.col("id").alias("example_id"), "embedding"), 2, 0.5).where("query_id = 999").collect()
    assert sorted(r["example_id"] for r in back) == [258, 259]


def test_greedy_personas(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(5, 3))
    v = [(i, (middles[i % 5] + rng.normal(size=3) * 0.5).tolist(), "s" * (i % 7 + 1)) for i in range(80)]
    df = spark.createDataFrame(v, "id long, summary_embedding array<double>, summary string")
    x = np.array([a for _, a, _ in v])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    visited, want = set(), set()
    for i in range(80):
        if i not in visited:
            group = [i] + [j for j in range(i + 1, 80) if x[i] @ x[j] > 0.75]
            visited |= set(group)
            want |= {(i, j, max(group, key=lambda k: (len(v[k][2]), k))) for j in group}
    assert {(r["group"], r["id"], r["representative"]) for r in testset.persona_groups(df).collect()} == want


def test_ranks_of_a_hot_class(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RANKED_TOGETHER", 2)
    df = spark.createDataFrame([(i, "a" if i % 5 else None) for i in range(2000)], "id long, c string")
    ranked = sampling.global_rank(df, sampling.shuffled("id"), "id", "c").collect()
    for c in ("a", None):
        own = sorted((r for r in ranked if r["c"] == c), key=lambda r: r["_rank"])
        assert [r["_rank"] for r in own] == list(range(len(own)))
    assert sampling.stratified_sample(df, 100, "c", "id").count() == 100


def test_small_ones(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, "")], "id long, text string")
    assert [r["n"] for r in df.select(tokens.token_count(F.col("text"), path).alias("n")).collect()][1:] == [0, 0]
    cut = tokens.token_windows(df, path, 2).orderBy("pos").collect()
    assert {r["id"] for r in cut} == {1} and "".join(r["chunk"] for r in cut) == "one two three four five six"
    runs = spark.createDataFrame([(i, i - 1 if i else None) for i in range(9)], "run_id long, parent_run_id long")
    assert {r["run_id"]: r["depth"] for r in records.trace_tree(runs).collect()} == {i: i for i in range(9)}
    checks = spark.createDataFrame([(True, None), (False, "syntax"), (False, "syntax")], "valid boolean, error string")
    got = aggregate.validation_summary(checks).first()
    assert (got["total"], got["valid"]) == (3, 1) and got["reasons"][0]["reason"] == "syntax"
    labels = spark.createDataFrame([(["a", "b"], ["b", "a"]), (["a"], ["a", "c"]), ([], [])], "g array<string>, p array<string>")
    assert [(r["exact"], round(r["f1"], 3)) for r in aggregate.label_set_scores(labels, "g", "p").collect()] == [(1.0, 1.0), (0.0, 0.667), (1.0, 1.0)]
    chunks = retrieval.chunked(spark.createDataFrame([(1, "abcdefghij"), (2, "abcdefghij"), (3, "")], "doc_id long, text string"), 6, 2).orderBy("chunk").collect()
    assert [(r["doc_id"], r["text"]) for r in chunks] == [(1, "abcdef"), (1, "efghij")]
    quadratic = aggregate.agreement(spark.createDataFrame([(1, 2), (2, 2), (3, 1), (3, 3)], "g int, p int"), "g", "p", "quadratic").first()
    o, g, p = [1, 0, 4, 0], [1, 2, 3, 3], [2, 2, 1, 3]
    assert quadratic["kappa"] == pytest.approx(1 - sum(o) * 4 / sum((a - b) ** 2 for a in g for b in p))
    assert aggregate.named_with_mode("f", "recall") == "f(mode=recall)" and aggregate.named_with_mode("f", None) == "f"


def test_optimiser(spark):
    gold = spark.createDataFrame([(i, i % 2) for i in range(12)], "row long, gold int")

    def losses(candidates):
        cs = F.explode(F.array(*map(F.lit, candidates)))
        return gold.withColumn("candidate", cs).select("candidate", "row", (F.length("candidate") > F.col("row")).cast("double").alias("value"))

    best, value = align.optimised(["a", "bb"], losses, lambda a, b: a + (b or "+"), rounds=3)
    assert len(best) > 2 and value > 2 / 12
    with pytest.raises(ValueError):
        align.optimised(["a"], lambda c: losses(c).where("row < 3"), lambda a, b: a)


def test_long_texts_are_asked_about_part_by_part(spark, monkeypatch):
    """The stand-in's topic is the first sentence it sees, its title the first four words: parts' replies are asked about once more."""
    monkeypatch.setattr(generate, "CHUNK_WORDS", 4)
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "short text")], "doc_id long, text string")
    heard = []

    class Kept(Judge):
        def ask(self, df, prompt, **inputs):
            out = super().ask(df, prompt, **inputs)
            heard.append(sorted(map(tuple, out.select("out.text").collect())))
            return out

    out = generate.transformed(generate.document_nodes(docs), [[generate.extract("title", Kept(RuleModel, "rules"))]])
    assert {r["id"]: r["title"] for r in out.nodes.collect()} == {"1": "one two three four", "2": "short text"}
    assert heard == [[("five six seven eight",), ("nine ten",), ("one two three four",), ("short text",)], [("one two three four",)]]


def test_requests_are_told_apart_without_sorting_prompts(spark, monkeypatch, capsys):
    """Equal requests are made once, and no task sorts the prompts for that."""
    from gaugewright.plans import judging

    asked, keep = [], judging.written
    monkeypatch.setattr(judging, "written", lambda df, label: asked.append(df) or keep(df, label))
    df = spark.range(40).select("id", (F.col("id") % 4).cast("string").alias("response"))
    for n in (1, 2):
        out = Judge(RuleModel, "told apart").ask(df, judge_metrics.PROMPTS["statements"], n=n, text=F.col("response")).collect()
        assert len(out) == 40 * n and all(r["out"]["statements"] == [r["response"]] for r in out)
        asked[-1].explain()
        assert "SortAggregate" not in capsys.readouterr().out and asked[-1].count() == 4 * n
