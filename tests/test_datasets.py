import math
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gaugewright.operators import aggregate, sampling, testset
from gaugewright.sources import records
from gaugewright.streaming import continuous


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(
    ("reference", "response", "mode", "metric", "want"),
    [
        ("a,b\n1,x\n2,y\n", "a,b\n1,x\n2,y\n", "rows", "f1", 1.0),
        ("a,b\n1,x\n2,y\n", "A, B\n1.0,x\n3,y\n4,z\n", "rows", "precision", 1 / 3),
        ("a,b\n1,x\n2,y\n", "a,b\n1,x\n3,y\n", "columns", "recall", 0.5),
        ("a,b\n1,\n", "a,c\n1,2\n", "columns", "precision", 0.5),
        ("a\n1\n", "a\n2\n", "rows", "f1", math.nan),
        ("", "a\n2\n", "rows", "recall", math.nan),
        (None, None, "rows", "f1", math.nan),
        ("a\n1,2\n", "a\n1\n", "rows", "f1", math.nan),
    ],
)
def test_compared_csv(spark, reference, response, mode, metric, want):
    df = spark.createDataFrame([(reference, response)], "a string, b string")
    (got,) = df.select(records.compared_csv(F.col("a"), F.col("b"), mode, metric)).first()
    assert (math.isnan(got) and math.isnan(want)) or got == pytest.approx(want)


def test_compared_csv_refuses_unknown_modes(spark):
    with pytest.raises(ValueError, match="unknown mode"):
        records.compared_csv(F.col("a"), F.col("b"), "cells")


def test_proportional_batches_of_two_classes(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, out long")
    sums = sampling.proportional_batches(df, 2, "out", "id").groupBy("batch").agg(F.count("*").alias("n"), F.sum("out").alias("s")).collect()
    assert sorted((r["batch"], r["n"], r["s"]) for r in sums) == [(b, 2, 1) for b in range(10)]


@pytest.mark.parametrize("sizes", [{"a": 7, "b": 1, None: 3, "c": 20}, {"a": 5}, {}])
def test_proportional_batches_against_sorting(spark, sizes):
    table = [(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(table, "id string, c string").withColumn("batch_", F.lit(0))
    ranked = {r["id"]: r["_rank"] for r in sampling.global_rank(df, sampling.shuffled("id"), "id", "c").collect()} if table else {}
    order = sorted(table, key=lambda x: (Fraction(2 * ranked[x[0]] + 1, sizes[x[1]]), x[1] is not None, x[1] or ""))
    want = {key: i // 4 for i, (key, _) in enumerate(order)}
    assert {r["id"]: r["batch"] for r in sampling.proportional_batches(df, 4, "c", "id").collect()} == want
    full = sampling.proportional_batches(df, 4, "c", "id", drop_last=True)
    assert {r["id"] for r in full.collect()} == {k for k, b in want.items() if b < len(table) // 4}
    filled = Counter(r["batch"] for r in sampling.proportional_batches(df, 4, "c", "id", refill=True).collect())
    assert set(filled.values()) <= {4}


def test_diverse_scenarios(spark):
    combos = spark.createDataFrame([(1, ["Tea", "Cups"]), (2, ["rain"]), (3, None)], "id long, combination array<string>")
    who = spark.createDataFrame([("cook", ["tea"]), ("sailor", ["RAIN", "cups"])], "persona string, persona_themes array<string>")
    every = testset.diverse_scenarios(combos, who, 1000)
    assert Counter((r["id"], r["persona"]) for r in every.collect()) == {(1, "cook"): 12, (1, "sailor"): 12, (2, "sailor"): 12}
    assert testset.diverse_scenarios(combos, who, 5).count() == 5
    with pytest.raises(ValueError, match="1 or more"):
        testset.diverse_scenarios(combos, who, 0)


def test_conversations_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(k, m, f"2024-01-01 0{m // 60}:{m % 60:02d}:00", "user" if m % 2 else "assistant", f"t{m}") for k in (1, 2) for m in (0, 5, 20, 90, 95)], "c long, turn long, ts string, role string, text string")
    df = df.withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    made = continuous.conversations(stream, "ts", "c", "turn", "role", "text", late="2 hours")
    q = made.writeStream.format("memory").queryName("held").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = rows(continuous.conversations(df, "ts", "c", "turn", "role", "text"))
    assert rows(spark.table("held")) == want
    assert [[t["turn"] for t in w[3]] for w in want] == [[0, 5, 20], [90, 95]] * 2


def test_slices_of_checks(spark):
    checks = spark.createDataFrame([("easy", True, None, 1.0), ("easy", False, "syntax: x", None), ("hard", False, "syntax: y: z", 3.0)], "level string, valid boolean, error string, seconds double")
    got = {r["level"]: (r["overall"], r["total"], r["valid"], r["seconds"]) for r in aggregate.validation_slices(checks, "level").collect()}
    assert got == {None: (True, 3, 1, 2.0), "easy": (False, 2, 1, 1.0), "hard": (False, 1, 0, 3.0)}
    assert rows(aggregate.error_kinds(checks)) == [("syntax", 2)]
    assert aggregate.validation_slices(checks.limit(0), "level").count() == 0


def test_csv_rows_of_a_small_file_go_to_many_tasks(spark, tmp_path):
    from gaugewright.plans import dataset_queries

    path = f"file://{tmp_path}/part.parquet"
    spark.range(1, 65, numPartitions=1).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "concat('b', id) AS p_brand").write.parquet(path)
    got = dataset_queries.csv_comparison(spark, f"file://{tmp_path}")
    assert got.select(F.spark_partition_id().alias("t")).distinct().count() > 8
    agrees = {r["p_partkey"]: (int(r["p_partkey"] % 50 % 3 == 0) + int(r["p_partkey"] % 50 % 2 == 0), r["row_precision"]) for r in got.collect()}
    assert len(agrees) == 64 and all(p == pytest.approx(k / 3, abs=1e-6) for k, p in agrees.values())
