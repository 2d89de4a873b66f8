import json

import pytest
from pyspark.sql import functions as F

from gaugewright.operators import aggregate, graph, judge, splitters, testset
from gaugewright.sources import catalog, records
from gaugewright.streaming import continuous


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_agent_messages_refuse_unknown_roles(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s", None), (1, 2, "ai", "b", '[{"name": "f", "arguments": "{\\"x\\": 1}"}]'), (1, 1, "human", "a", None)], "c long, t long, r string, m string, calls string")
    (row,) = records.agent_messages(turns, "c", "t", "r", "m", "calls").collect()
    assert [(m["type"], m["content"]) for m in row["user_input"]] == [("human", "a"), ("ai", "b")]
    assert row["user_input"][1]["tool_calls"][0]["args"] == {"x": "1"}
    with pytest.raises(Exception, match="unknown role"):
        records.agent_messages(turns.withColumn("r", F.lit("robot")), "c", "t", "r", "m").collect()


def test_compared_tables(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "n long, v string")
    b = spark.createDataFrame([(10, "x"), (20, "q")], "n long, v string")
    assert rows(records.compared_tables(a, b, "n")) == [(pytest.approx(1 / 3), 0.5, pytest.approx(0.4))]
    assert rows(records.compared_tables(a.limit(0), b, "n")) == [(0.0, 0.0, 0.0)]


def test_trace_tree_without_roots(spark):
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "run_id string, parent_run_id string")
    assert records.trace_tree(loop).count() == 0


def test_memory_catalog_and_annotations(spark, tmp_path):
    store = catalog.registry["memory"](spark, "")
    df = spark.createDataFrame([(1,)], "x int")
    store.save(df, "b")
    store.save(df.withColumn("x", F.lit(2)), "a")
    assert store.names() == ["a", "b"] and store.load("a").first()["x"] == 2 and store.names("experiments") == []
    with pytest.raises(FileNotFoundError):
        store.load("c")
    with pytest.raises(KeyError, match="unknown catalog"):
        catalog.registry["nowhere"]
    (tmp_path / "a.json").write_text(json.dumps({"m": [{"score": 1, "ok": True}, {"score": 0, "ok": False}]}))
    assert rows(catalog.annotations(spark, f"file://{tmp_path}/a.json", "m").select("ok", "score")) == [(False, 0), (True, 1)]
    with pytest.raises(ValueError, match="no annotations"):
        catalog.annotations(spark, f"file://{tmp_path}/a.json", "n")
    tests = spark.createDataFrame([("approved",), ("rejected",), (None,)], "approval_status string")
    assert catalog.approved(tests).count() == 1


def test_choose_pipeline(spark):
    sizes = lambda *n: spark.createDataFrame([(x,) for x in n], "n int")
    assert splitters.choose_pipeline(sizes(10, 10, 10, 600), F.col("n")) == "headline"
    assert splitters.choose_pipeline(sizes(10, 10, 101, 500), F.col("n")) == "document"
    with pytest.raises(ValueError, match="too short"):
        splitters.choose_pipeline(sizes(10, 100), F.col("n"))


def test_graph_without_scores_keeps_nodes(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "old"), ("c", None)], "id string, note string")
    edges = spark.createDataFrame([("1", "x", "a", "b"), ("2", "x", "b", "c")], "id string, type string, src string, dst string")
    g = graph.Graph(nodes, edges).with_property("Note", F.lit("new")).with_property("size", F.lit(1))
    assert rows(g.nodes) == [("a", "new", 1), ("b", "old", 1), ("c", "new", 1)]
    kept = g.drop_low_scores(spark.createDataFrame([("a", 2.0), ("b", 2.5)], "id string, score double"))
    assert [r[0] for r in rows(kept.nodes)] == ["b", "c"] and [r[0] for r in rows(kept.edges)] == ["2"]


def test_ranks_and_summaries(spark):
    ranks = spark.createDataFrame([([1, 2, 3], [1, 2, 3]), ([1, 2, 3], [3, 2, 1]), ([1, 1], [1, 1])], "g array<int>, p array<int>")
    assert aggregate.mean_rank_agreement(ranks, "g", "p").first()["kappa"] == pytest.approx((1 - 1 + 1) / 3)
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first()["x"]
    half, tenth = F.lit(0.5), F.lit(0.1)
    assert pick(judge.summary_score(half, tenth)) == pytest.approx(0.3)
    assert pick(judge.summary_score(half, tenth, False)) == 0.5 and pick(judge.summary_score(half, tenth, False, compat="legacy")) == 0.25
    with pytest.raises(ValueError):
        judge.summary_score(half, tenth, coeff=2)


def test_contexts_and_personas(spark):
    clusters = spark.createDataFrame([(1, "d"), (1, "e")], "cluster_id long, node_id string")
    children = spark.createDataFrame([("d", "d1"), ("d", "d2")], "root string, id string")
    nodes = spark.createDataFrame([("d", "D"), ("d1", "one"), ("d2", "two"), ("e", "E")], "id string, page_content string")
    assert rows(testset.cluster_contexts(clusters, children, nodes)) == [(1, ["<1-hop>\n\none", "<2-hop>\n\ntwo", "<3-hop>\n\nE"])]
    themed = spark.createDataFrame([(1, ["Sea", "sky"]), (2, [])], "id long, themes array<string>")
    people = spark.createDataFrame([("p", ["SEA", "SKY"]), ("q", ["land"])], "persona string, persona_themes array<string>")
    assert rows(testset.matching_personas(themed, people).select("id", "persona")) == [(1, "p")]


def test_drift_gate_alarms_on_low_windows(spark, tmp_path):
    minutes = [(f"2024-01-01 00:{m:02d}:00", 1.0 if m < 10 else 0.2) for m in range(20)]
    df = spark.createDataFrame(minutes, "ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    low = []
    q = continuous.drift_gate(continuous.windowed_means(stream, "ts", "value"), 0.9, 0.1, lambda b, _: low.extend(r["start"].minute for r in b.collect()), f"file://{tmp_path}/check")
    q.processAllAvailable()
    q.stop()
    assert sorted(low) == [10, 15]
