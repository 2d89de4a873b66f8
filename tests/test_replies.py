"""The reply cache, both judges of a pair, ties of votes, and roles that are null."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from gaugewright.operators import schema
from gaugewright.plans import evaluate, judge_metrics
from gaugewright.plans.judging import Judge, RuleModel
from gaugewright.plans.replies import ReplyCache
from gaugewright.sources import records


def silent():
    """A model that must not be called."""

    class Silent:
        def complete(self, prompts):
            raise AssertionError("called")

    return Silent


def twisted():
    """Rates 2 on the first prompt and 0 on the second."""

    class Twisted:
        def complete(self, prompts):
            return [json.dumps({"rating": 0 if "second" in p.rsplit("\nTask: ", 1)[1].split("\n")[0] else 2}) for p in prompts]

    return Twisted


def samples(spark, n=12):
    rows = [(i, "q", f"Rome {i % 5} is old. Rome is big", "Rome is old", [f"Rome {i % 3} is old"]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, user_input string, response string, reference string, retrieved_contexts array<string>")


def test_a_second_run_asks_nothing(spark, tmp_path):
    cache = ReplyCache(spark, f"file://{tmp_path}/cache")
    rows, names = samples(spark), ["faithfulness", "context_precision", "nv_context_relevance"]
    first = sorted(map(repr, evaluate.evaluate(rows, names, judge=Judge(RuleModel, "m", cache=cache)).scores.collect()))
    again = evaluate.evaluate(rows, names, judge=Judge(silent(), "m", retries=0, cache=cache)).scores.collect()
    assert sorted(map(repr, again)) == first
    assert cache.compact() > 1 and len(cache.parts()) == 1
    again = evaluate.evaluate(rows, names, judge=Judge(silent(), "m", retries=0, cache=cache)).scores.collect()
    assert sorted(map(repr, again)) == first
    # another model's name is another request; what failed is not kept
    asked = Judge(silent(), "other", retries=0, cache=cache).ask(rows, judge_metrics.PROMPTS["statements"], text=F.col("response"))
    assert asked.where("error IS NULL").count() == 0
    asked = Judge(RuleModel, "other", cache=cache).ask(rows, judge_metrics.PROMPTS["statements"], text=F.col("response"))
    assert asked.where("error IS NOT NULL").count() == 0


def test_two_writers_lose_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/shared"

    def write(name):
        cache = ReplyCache(spark, root, most_parts=3)
        for i in range(4):
            cache.put(spark.range(5).select(F.concat(F.lit(f"{name}{i}-"), "id").alias("key"), F.lit(name).alias("reply")))

    writers = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    cache = ReplyCache(spark, root)
    assert {r["key"] for r in cache.read().collect()} == {f"{n}{i}-{j}" for n in "ab" for i in range(4) for j in range(5)}


def test_newest_reply_counts(spark, tmp_path):
    cache = ReplyCache(spark, f"file://{tmp_path}/new")
    assert cache.read().count() == 0 and cache.compact() == 0 and cache.forget(0) == 0
    row = lambda *kv: spark.createDataFrame([kv], "key string, reply string")
    cache.put(row("a", "old"))
    then = int(cache.parts()[0][5:18])
    while not cache.parts() or int(cache.parts()[-1][5:18]) <= then:
        cache.put(row("a", "new").union(row("b", None)).union(row(None, "x")))
    assert [tuple(r)[:2] for r in cache.read().collect()] == [("a", "new")]
    assert [tuple(r)[:2] for r in cache.read(as_of=then).collect()] == [("a", "old")]
    (tmp_path / "new" / "part-9999999999999-cut").mkdir()  # a writer that has not finished
    assert cache.read().count() == 1 and cache.compact() >= 2
    assert [tuple(r)[:2] for r in cache.read().collect()] == [("a", "new")]
    assert cache.forget(9_999_999_999_999) == 1 and cache.read().count() == 0


@pytest.mark.parametrize("metric", ["nv_context_relevance", "nv_response_groundedness"])
def test_the_second_judge_has_a_prompt_of_its_own(spark, metric):
    got = evaluate.evaluate(samples(spark, 2), [metric], judge=Judge(twisted(), "t")).scores.collect()
    assert [r[metric] for r in got] == [0.5, 0.5]


def test_even_votes_take_the_first(spark):
    """Two generations that disagree, in either order."""

    votes = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 0), (2, 0, 0, 0), (2, 0, 1, 1), (3, 0, 0, 1), (3, 0, 1, 1), (3, 0, 2, 0)], "row_id long, stmt_pos int, sample_no int, verdict int")

    class Fixed(Judge):
        def ask(self, df, prompt, n=1, into="out", **inputs):
            v = F.struct(F.lit("s").alias("statement"), F.col("verdict").alias("verdict"))
            return votes.select("row_id", "sample_no", F.struct(F.array(v).alias("verdicts")).alias(into))

    rows = spark.createDataFrame([(i, "q", "r", ["c"]) for i in (1, 2, 3)], "row_id long, user_input string, reference string, retrieved_contexts array<string>")
    got = {r["row_id"]: r["score"] for r in judge_metrics.context_recall(3)(rows, Fixed(RuleModel), "row_id").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 1.0}


def test_null_roles_are_errors(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, None, "b"), (2, 0, "system", "s"), (2, 1, "assistant", "c")], "conv_id long, turn int, role string, text string")
    with pytest.raises(Exception, match="unknown role"):
        schema.assemble_conversations(turns).collect()
    with pytest.raises(Exception, match="unknown role"):
        records.agent_messages(turns, "conv_id", "turn", "role", "text").collect()
    fine = turns.where("role IS NOT NULL")
    assert [len(r["user_input"]) for r in schema.assemble_conversations(fine).orderBy("conv_id").collect()] == [1, 1]
    assert [len(r["user_input"]) for r in records.agent_messages(fine, "conv_id", "turn", "role", "text").orderBy("conv_id").collect()] == [1, 1]


def test_prompts_of_a_metric(spark):
    """They are read, set on the judge, and reach the model."""
    from gaugewright.plans.prompts import Prompt

    rows = samples(spark, 2)
    assert list(judge_metrics.prompts_of("faithfulness")) == ["statements", "support"]
    with pytest.raises(KeyError):
        judge_metrics.prompts_of("none")

    def heard():
        class Heard(RuleModel):
            def complete(self, prompts):
                assert all("Zerlege" in p for p in prompts if "Task: statements" in p)
                return super().complete(prompts)

        return Heard

    own = Prompt("statements", "Zerlege den Text.", "statements array<string>")
    judge = Judge(heard(), "m", retries=0, prompts={"statements": own})
    assert judge_metrics.prompts_of("faithfulness", judge)["statements"] == own
    scores = evaluate.evaluate(rows, ["faithfulness"], judge=judge).scores.collect()
    assert all(r["faithfulness"] == r["faithfulness"] for r in scores)  # no error, so no NaN
    shown = F.array(F.struct(F.lit("{}").alias("input"), F.lit("{}").alias("output")))
    asked = judge.ask(rows, judge_metrics.PROMPTS["statements"], shown=shown, text=F.col("response"))
    assert asked.where("error IS NULL").count() == 2


def test_nodes_go_by_id_and_chunks_by_their_parent(spark):
    from gaugewright.operators.graph import Graph

    nodes = spark.createDataFrame([("d", "document", "sum", "t"), ("e", "document", " ", "t"), ("c1", "chunk", None, "x"), ("c2", "chunk", "own", "y"), ("c3", "chunk", None, "z")], "id string, type string, summary string, page_content string")
    edges = spark.createDataFrame([("1", "child", "d", "c1", False), ("2", "child", "d", "c2", False), ("3", "child", "e", "c3", False), ("4", "child", "e", "c2", False)], "id string, type string, src string, dst string, bidirectional boolean")
    g = Graph(nodes, edges)
    assert {(r["id"], r["summary"]) for r in g.rated_summaries().collect()} == {("d", "sum"), ("c1", "sum"), ("c2", "sum")}
    less = g.remove("c2")
    assert {r["id"] for r in less.nodes.collect()} == {"d", "e", "c1", "c3"} and less.edges.count() == 2
    with pytest.raises(ValueError, match="no such node: x"):
        g.remove("d", "x")
