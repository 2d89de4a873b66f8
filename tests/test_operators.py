import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugewright.operators import aggregate, graph, judge, pairs, retrieval, sampling, schema, splitters, testset
from gaugewright.plans import align, evaluate, model, queries
from gaugewright.sources import catalog, records
from gaugewright.streaming import continuous


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_nan_mean(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    assert df.agg(aggregate.nan_mean("x")).first()[0] == 2.0
    assert math.isnan(df.where("x is null").agg(aggregate.nan_mean("x")).first()[0])


def test_evaluate_and_renames(spark):
    df = spark.createDataFrame([(1, "a b", "a b"), (2, "a", "b")], "row_id long, ground_truth string, answer string")
    result = evaluate.evaluate(df, ["exact_match", "levenshtein_similarity", "bleu_score"])
    assert result.summary().first()["exact_match"] == 0.5
    assert result.long().count() == 6
    with pytest.raises(ValueError, match="needs the columns"):
        evaluate.evaluate(df.drop("answer"), ["exact_match"])


def test_custom_metric_and_experiment(spark):
    df = spark.createDataFrame([(1, "x"), (2, "yy"), (3, None)], "id long, t string")
    size = evaluate.custom_metric(lambda t: float(len(t)), "double", (0, 1))
    out = {r["id"]: r["m"] for r in df.select("id", size(t=F.col("t")).alias("m")).collect()}
    assert out[1]["value"] == 1.0 and out[2]["value"] is None and "domain" in out[2]["reason"] and "TypeError" in out[3]["reason"]
    ran = evaluate.run_experiment(df, lambda r: None if r["id"] == 1 else {"n": len(r["t"])}, "n long")
    assert sorted((r["n"], r["error"] is None) for r in ran.fillna(-1, ["n"]).collect()) == [(-1, False), (2, True)]


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 2, "assistant", "hi"), (1, 1, "user", "hello")], "conv_id long, turn long, role string, text string")
    convs = schema.assemble_conversations(turns)
    row = convs.select(schema.rendered_conversation(F.col("user_input")).alias("r"), schema.valid_conversation(F.col("user_input")).alias("v")).first()
    assert row["r"] == "Human: hello\nAI: hi" and row["v"]
    bad = spark.createDataFrame([([("human", "x", None, None), ("tool", "y", None, None)],)], f"m array<{schema.MESSAGE}>")
    assert not bad.select(schema.valid_conversation(F.col("m"))).first()[0]
    assert schema.kind_of(convs) == "multi"


def test_agreement_and_gate(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "g int, p int")
    row = aggregate.agreement(df, "g", "p").first()
    assert row["agreement"] == 0.75 and row["kappa"] == pytest.approx(0.5)
    cur = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "k string, v double")
    base = spark.createDataFrame([("a", 0.9), ("b", 0.6)], "k string, v double")
    assert [r["passed"] for r in aggregate.baseline_gate(cur, base, "k", "v").orderBy("k").collect()] == [True, False]
    same = aggregate.compare_experiments({"x": cur, "y": base}, "k", "v")
    assert rows(same) == [("a", 1.0, 0.9), ("b", 0.5, 0.6)]
    with pytest.raises(Exception, match="repeated or missing"):
        aggregate.compare_experiments({"x": cur, "y": base.where("k = 'a'")}, "k", "v").collect()


def test_sampling(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, y int")
    two = sampling.stratified_sample(df, 2, "y", "id")
    assert sorted(r["y"] for r in two.collect()) == [0, 1]
    train, test = sampling.train_test_split(df, 0.3, "id")
    assert (train.count(), test.count()) == (14, 6) and not {r["id"] for r in train.collect()} & {r["id"] for r in test.collect()}
    assert all(r["s"] == 1 for r in sampling.stratified_batches(df, 10, "y", "id").groupBy("batch").agg(F.sum("y").alias("s")).collect())
    assert sampling.sample(df, 5, "id").count() == 5
    with pytest.raises(ValueError):
        sampling.sample(df, 21, "id")


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9])
def test_jaccard_pairs_against_all_pairs(spark, threshold):
    rng = random.Random(3)
    data = {i: sorted({str(rng.randrange(12)) for _ in range(rng.randrange(0, 8))}) for i in range(40)}
    want = sorted((i, j) for i, j in itertools.combinations(data, 2) if set(data[i]) | set(data[j]) and len(set(data[i]) & set(data[j])) / len(set(data[i]) | set(data[j])) >= threshold)
    df = spark.createDataFrame(list(data.items()), "id long, items array<string>")
    assert sorted((r["src"], r["dst"]) for r in pairs.jaccard_pairs(df, threshold).collect()) == want


def test_overlap_pairs_of_copies_against_all_pairs(spark, monkeypatch):
    """Nodes of the same items are compared once, however many there are; every pair comes out, with its items the right way round."""
    rng = random.Random(8)
    kinds = [["walnut", "cherry", "plum"], ["walnuts", "Cherry"], ["cherry", "walnuts"], ["plums1", "apple"], ["pear"]]
    data = {i: [x.upper() if rng.random() < 0.3 else x for x in kinds[rng.randrange(5)]] for i in range(30)}
    near = lambda x, y: x == y or {x, y} == {"walnut", "walnuts"}
    want = {}
    for i, j in itertools.combinations(data, 2):
        hits = [(x.lower(), y.lower()) for x in data[i] for y in data[j] if near(x.lower(), y.lower())]
        if len(hits) / (len(data[i]) * len(data[j])) >= 0.2:
            want[i, j] = (pytest.approx(len(hits) / (len(data[i]) * len(data[j]))), sorted(set(hits)))
    df = spark.createDataFrame(list(data.items()), "id long, items array<string>")
    compared, whole = [], pairs._between_members
    monkeypatch.setattr(pairs, "_between_members", lambda found, *more: compared.append(found.count()) or whole(found, *more))
    monkeypatch.setattr(pairs._classes, "__defaults__", (3,))  # large classes are cut into blocks
    got = pairs.overlap_pairs(df, 0.2, 0.85, 0).collect()
    assert {(r["src"], r["dst"]): (r["score"], [tuple(x) for x in r["overlapped"]]) for r in got} == want and len(got) == len(want)
    assert compared[0] <= 10 < len(want)


def test_pairs_of_members_are_made_in_batches(spark, monkeypatch):
    """Not row by row, and their score is rounded before: neither costs a step of Spark's for each pair."""
    df = spark.createDataFrame([(f"n{i:02}", ["walnut", "plum"] if i % 3 else ["walnuts", "cherry", "pear"]) for i in range(30)], "id string, items array<string>")
    got = pairs.overlap_pairs(df, 0.01, 0.85, 0, digits=3, overlapped=False)
    want = {(f"n{i:02}", f"n{j:02}", 0.333 if i % 3 == j % 3 == 0 else 0.5 if i % 3 and j % 3 else 0.167) for i, j in itertools.combinations(range(30), 2)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    plan = plan_of(got).split("Exchange")[0]
    assert "MapInArrow" in plan and "Generate" not in plan and "round" not in plan
    ids = [list(x) for x in (range(0, 100, 2), range(1, 80, 2))]
    monkeypatch.setattr(pairs, "MET", 90)
    batch = pa.RecordBatch.from_pydict({"ids1": pa.array([ids[0], ids[0]]), "ids2": pa.array([ids[1], ids[0]]), "alone": [False, True], "score": [0.5, 0.25]})
    made = list(pairs._met(iter([batch]), ["score"]))
    assert max(b.num_rows for b in made) <= 90
    want = {(min(i, j), max(i, j), 0.5) for i in range(0, 100, 2) for j in range(1, 80, 2)} | {(i, j, 0.25) for i, j in itertools.combinations(range(0, 100, 2), 2)}
    assert sorted(tuple(r.values()) for b in made for r in b.to_pylist()) == sorted(want)


@pytest.mark.parametrize("items", [6000, 1_000_000])
def test_sets_go_out_once_for_a_block_not_for_each_candidate(spark, monkeypatch, items):
    """Forty near copies are 780 candidates; their sets are not shuffled with each of them. Groups of too many items are cut."""
    monkeypatch.setattr(pairs, "ITEMS", items)
    words = [str(x) for x in range(60)]
    data = {f"n{i:02}": [*words, f"own{i}", f"group{i % 3}"] for i in range(40)} | {"other": [*words[:40], "x"], "none": []}
    want = {(i, j): len(set(data[i]) & set(data[j])) / len(set(data[i]) | set(data[j])) for i, j in itertools.combinations(sorted(data), 2) if data[i] and data[j]}
    want = {pair: x for pair, x in want.items() if x >= 0.8}
    sent, whole = [], pairs._between_members
    monkeypatch.setattr(pairs, "_between_members", lambda found, *more: sent.append(plan_of(found)) or whole(found, *more))
    df = spark.createDataFrame(list(data.items()), "id string, items array<string>")
    assert {(r["src"], r["dst"]): r["similarity"] for r in pairs.jaccard_pairs(df, 0.8).collect()} == want and len(want) == 780
    assert "FlatMapCoGroupsInArrow" in sent[0] and "array_intersect" not in sent[0]


def test_jaccard_pairs_verifies_few_sets(spark, monkeypatch):
    """Unlike sets that share rare items are refuted without their items, and copies are compared once; every pair comes out."""
    rng = random.Random(2)
    data = {i: [str(x) for x in rng.sample(range(150), 60)] for i in range(60)}
    data |= {60 + i: data[0][::-1] for i in range(8)} | {70 + i: [*data[1][:57], "z"] for i in range(4)}
    want = sorted((i, j) for i, j in itertools.combinations(data, 2) if len(set(data[i]) & set(data[j])) / len(set(data[i]) | set(data[j])) >= 0.8)
    verified, whole = [], pairs._candidates
    monkeypatch.setattr(pairs, "_candidates", lambda df: verified.append(df.count()) or whole(df))
    df = spark.createDataFrame(list(data.items()), "id long, items array<string>")
    assert sorted((r["src"], r["dst"]) for r in pairs.jaccard_pairs(df, 0.8).collect()) == want
    assert len(want) == 36 + 10 and verified[0] < 10


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hits_of_keywords_are_summed_where_a_documents_tokens_are(spark):
    docs = spark.createDataFrame([(i, f"the word{i % 7} of {i}") for i in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the word3"), (2, "word5 the the")], "query_id long, text string")
    for top in (retrieval.keyword_top_k, retrieval.bm25_top_k):
        got = top(docs, asked, 3)
        assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id#", plan_of(got))
        assert [r["doc_id"] for r in got.where("query_id = 1").orderBy("rank").collect()] == [3, 10, 17]


def test_nearest_sends_no_blocks_through_the_driver(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, v array<double>")
    got = pairs.nearest(rows.where("id < 3"), rows, 1, block_rows=4)
    assert "Broadcast" not in plan_of(got) and got.where("query_id = row_id").count() == 3


def test_triples_compare_vectors_once(spark):
    plan = plan_of(queries.queries()["graph_triples"](spark, "/root/testdata/sf0.001"))
    assert plan.count("MapInPandas") == 1


def test_cosine_pairs_send_each_row_no_more_than_the_packs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(150, 6)), np.repeat(rng.normal(size=(1, 6)), 50, axis=0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sorted((i, j) for i in range(200) for j in range(i + 1, 200) if unit[i] @ unit[j] >= 0.5)
    made, written = [], pairs.written
    monkeypatch.setattr(pairs, "written", lambda df, label: made.append((label, out := written(df, label))) or out)
    for packs, most in ((3, 1 << 25), (1, 1 << 25), (32, 1)):
        made.clear()
        monkeypatch.setattr(pairs, "PACKS", packs)
        monkeypatch.setattr(pairs, "PACK_BYTES", most)
        assert sorted((r["src"], r["dst"]) for r in pairs.cosine_pairs(df, 0.5, block_rows=8).collect()) == want
        assert most == 1 or dict(made)["packs"].count() <= packs


def test_cosine_pairs_against_all_pairs(spark):
    x = np.random.default_rng(0).normal(size=(60, 4))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sorted((i, j) for i, j in itertools.combinations(range(60), 2) if u[i] @ u[j] >= 0.6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    assert sorted((r["src"], r["dst"]) for r in pairs.cosine_pairs(df, 0.6, block_rows=16).collect()) == want
    with pytest.raises(ValueError):
        pairs.cosine_pairs(df.union(spark.createDataFrame([(99, [1.0])], df.schema)))


def test_similar_strings_against_all_pairs(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(3, 12))) for _ in range(80)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = sorted((a, b) for a, b in itertools.combinations(words, 2) if 1 - distance(a, b) / max(len(a), len(b)) >= 0.8)
    got = pairs.similar_strings(spark.createDataFrame([(w,) for w in words], "item string"), 0.8)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want


def chain(spark):
    nodes = spark.createDataFrame([(c, "document") for c in "abcd"], "id string, type string")
    edges = spark.createDataFrame([("1", "x", "a", "b", True), ("2", "x", "c", "d", True)], "id string, type string, src string, dst string, bidirectional boolean")
    return graph.Graph(nodes, edges)


def test_graph(spark, tmp_path):
    g = chain(spark)
    assert rows(graph.n_indirect_clusters(g, 2, 2)) == [(["a", "b"],), (["c", "d"],)]
    assert rows(graph.indirect_clusters(g, 2)) == [(["a", "b"],), (["c", "d"],)]
    assert g.where(F.col("id") != "a").edges.count() == 1
    assert g.without(spark.createDataFrame([("c",)], "id string")).edges.count() == 1
    g.save(f"file://{tmp_path}/g")
    assert graph.Graph.load(spark, f"file://{tmp_path}/g").nodes.count() == 4
    graph.Graph(g.nodes.where("id <> 'a'"), g.edges).save(f"file://{tmp_path}/h")
    with pytest.raises(KeyError):
        graph.Graph.load(spark, f"file://{tmp_path}/h")
    with pytest.raises(ValueError):
        graph.indirect_clusters(g, 1)


def test_indirect_clusters_of_a_hub_are_whole(spark, tmp_path):
    from gaugewright.plans import queries

    leaves = np.hstack([np.full((30, 1), 0.45), np.eye(30) * np.sqrt(1 - 0.45**2)])
    vectors = np.vstack([np.eye(31)[:1], leaves])
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    want = {frozenset({"0", str(i)}) for i in range(1, 31)} | {frozenset({"0", str(i), str(j)}) for i, j in itertools.combinations(range(1, 31), 2)}
    got = queries.indirect_clusters(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(want) and {frozenset(r["cluster"]) for r in got} == want


def test_scenarios_take_terms_of_the_whole_text(spark, tmp_path):
    from gaugewright.plans import queries

    spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.scenario_sampling(spark, f"file://{tmp_path}").collect()
    assert {r["term"] for r in got} == set("one two three four five six".split()) and len(got) == 18


@pytest.mark.parametrize(("repeats", "most"), [(1, 100_000), (30, 100_000), (30, 50)])
def test_scenarios_come_from_the_least_hashes(spark, monkeypatch, repeats, most):
    """Only the least hashes are shuffled; where they repeat, more of them are, or all."""
    from hashlib import md5

    monkeypatch.setattr(testset, "MOST", most)
    sizes, keep = [], testset._first_turns
    monkeypatch.setattr(testset, "_first_turns", lambda df, seed: sizes.append(df.count()) or keep(df, seed))
    data = [(i, t, p) for i in range(40) for t in "abc" for p in ("x", "y", "z")]
    by_hash = sorted(data, key=lambda r: md5(f"42:{r[0]}|{r[1]}|{r[2]}".encode()).hexdigest())
    first = list({r[:2]: r for r in by_hash[::-1]}.values())
    want = [r for r in by_hash if r in first][:5]
    df = spark.createDataFrame(data * repeats, "node_id long, term string, persona string")
    assert rows(testset.scenarios(df, 5).select("node_id", "term", "persona")) == sorted(want)
    assert sizes == ([40] if repeats == 1 else [40, 640] if most > 50 else [40, 10800])


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "")], "id long, text string")
    assert rows(splitters.window_chunks(df, 2)) == [(1, 0, "a b"), (1, 1, "c d"), (1, 2, "e")]
    docs = spark.createDataFrame([(1, "Intro x x x Part y y y y", ["Part"])], "id long, text string, headlines array<string>")
    cut = splitters.headline_chunks(docs, 3, 10)
    assert [r["chunk"].strip() for r in cut.orderBy("pos").collect()] == ["Intro x x x", "Part y y y y"]
    assert splitters.chunk_graph(cut).edges.count() == 3


def test_judges(spark):
    v = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1)], "row_id long, ctx_pos int, verdict int")
    assert judge.context_precision(v).first()["score"] == pytest.approx(0.8333333332916666, abs=1e-12)
    r = spark.createDataFrame([(1, 4.0), (1, float("nan")), (2, float("nan"))], "row_id long, rating double")
    got = dict(rows(judge.dual_judge(r, 4.0)))
    assert got[1] == 1.0 and math.isnan(got[2])


def test_model_answers_once(spark):
    calls = spark.sparkContext.accumulator(0)

    class Counting:
        def complete(self, prompts):
            calls.add(len(prompts))
            return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, prompt string")
    keyed, answers = model.answer(df, Counting)
    out = model.with_replies(keyed, answers)
    assert sorted((r["id"], r["reply"]) for r in out.collect()) == [(1, "A"), (2, "A"), (3, "B")]
    assert calls.value == 2
    cache = spark.createDataFrame([(r["request_hash"], "X") for r in keyed.where("prompt = 'a'").limit(1).collect()], "request_hash string, reply string")
    keyed, answers = model.answer(df, Counting, cache)
    assert answers.count() == 1


@pytest.mark.parametrize("form", ["csv", "jsonl", "parquet"])
def test_catalog(spark, tmp_path, form):
    store = catalog.registry[f"local/{form}"](spark, f"file://{tmp_path}")
    df = spark.createDataFrame([("a,\"b\"\nc", "2024-01-02")], "t string, d string")
    store.save(df, "x")
    assert store.names() == ["x"] and store.load("x").first()["t"] == "a,\"b\"\nc"
    with pytest.raises(FileNotFoundError):
        store.load("y")
    with pytest.raises(FileNotFoundError):
        store.load("x", "experiments")


def test_records(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "x int, y double")
    b = spark.createDataFrame([(2, 0.2), (1, 0.1)], "p int, q double")
    assert records.same_result(a, b) and not records.same_result(a, b.limit(1))
    assert records.executed(spark, "delete from x")[0] is False
    assert records.executed(spark, "select 1 as a")[0] is True
    z = spark.createDataFrame([([1, 2], ["a", "b"])], "n array<int>, s array<string>")
    assert rows(records.zipped_rows(z, n="n", s="s")) == [(0, 1, "a"), (1, 2, "b")]
    runs = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "run_id string, parent_run_id string")
    assert rows(records.trace_tree(runs)) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2)]


def test_alignment(spark):
    v = spark.createDataFrame([("a", [0, 1]), ("b", [0, 1]), ("c", [1, 0])], "candidate string, results array<int>")
    assert rows(align.farthest_partners(v)) == [("a", "c", 2), ("b", "c", 2), ("c", "a", 2)]
    losses = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "candidate string, value double")
    assert align.best_candidate(losses, False).first()["candidate"] == "b"
    assert testset.query_distribution({"x": 1, "y": 0, "z": 2}) == {"x": 0.5, "z": 0.5}


def test_streaming_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", float(m)) for m in range(30)], "ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    q = continuous.windowed_means(stream, "ts", "value").writeStream.format("memory").queryName("means").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("means")) == rows(continuous.windowed_means(df, "ts", "value"))
