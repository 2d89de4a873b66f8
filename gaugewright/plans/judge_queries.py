"""The judge metrics end to end over the driver's tables, with the stand-in judge, whose rules SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema import assemble_conversations
from . import judge_metrics
from .evaluate import METRICS, Metric, evaluate
from .judging import Judge, RuleModel
from .queries import query, table

JUDGE = Judge(RuleModel, "rules")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Parts as question, answer, reference and contexts; sizes decide what agrees with what."""
    name, brand, kind, size = "p_name", "p_brand", "p_type", F.col("p_size")
    fact = F.concat(brand, F.lit(" is "), kind)
    first = F.when(size % 2 == 0, fact).otherwise(F.concat(F.lit("No "), brand))
    second = F.when(size % 3 == 0, F.col(name)).otherwise(F.lit("odd size"))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.when(size % 7 < 3, F.lit("what now")).otherwise(F.col(name)).alias("user_input"),
        F.concat_ws(". ", name, fact).alias("response"),
        F.concat_ws(". ", first, second).alias("reference"),
        F.array(F.concat(name, F.lit(" of "), brand), F.when(size % 5 < 2, fact).otherwise(F.col(kind))).alias("retrieved_contexts"),
        F.array(first, second).alias("reference_contexts"),
        F.create_map(F.lit("score1"), F.lit("poor")).alias("rubrics"),
    )


#: The same rows: s, r and c are the sentences of response and reference, and the contexts.
ROWS = """j0 AS (SELECT *, p_brand || ' is ' || p_type AS fact FROM part),
j1 AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN fact ELSE 'No ' || p_brand END AS r1, CASE WHEN p_size % 3 = 0 THEN p_name ELSE 'odd size' END AS r2 FROM j0),
j AS (SELECT p_partkey AS row_id, CASE WHEN p_size % 7 < 3 THEN 'what now' ELSE p_name END AS question,
  [p_name, fact] AS s, [r1, r2] AS r, [p_name || ' of ' || p_brand, CASE WHEN p_size % 5 < 2 THEN fact ELSE p_type END] AS c,
  p_name || '. ' || fact AS response, r1 || '. ' || r2 AS reference FROM j1),
k AS (SELECT *, array_to_string(c, chr(10)) AS ctx, array_to_string(r, chr(10)) AS refs,
  list_transform(s, lambda x: CAST(contains(lower(reference), lower(x)) AS INT)) AS s_ref,
  list_transform(r, lambda x: CAST(contains(lower(response), lower(x)) AS INT)) AS r_resp,
  list_transform(c, lambda y: CAST(len(list_filter(r, lambda x: contains(lower(y), lower(x)))) > 0 AS INT)) AS c_r,
  list_transform(c, lambda y: CAST(len(list_filter(s, lambda x: contains(lower(y), lower(x)))) > 0 AS INT)) AS c_s FROM j)"""

AP = "({0}[1] * {0}[1] + {0}[2] * ({0}[1] + {0}[2]) / 2.0) / ({0}[1] + {0}[2] + 1e-10)"
WORDS_OF = "list_distinct(list_filter(regexp_split_to_array(replace({0}, '.', ' '), '\\s+'), lambda x: x <> ''))"


def scores(spark: SparkSession, d: str, metrics: list[str | Metric]) -> DataFrame:
    out = evaluate(samples(spark, d), metrics, judge=JUDGE)
    return out.scores.select("row_id", *[F.round(m, 6).alias(m) for m in out.metrics])


@query(f"""WITH {ROWS} SELECT row_id,
round(list_avg(list_transform(s, lambda x: CAST(contains(lower(ctx), lower(x)) AS INT))), 6) AS faithfulness,
round({AP.format("c_r")}, 6) AS context_precision, round({AP.format("c_s")}, 6) AS context_utilization,
round(list_avg(list_transform(r, lambda x: CAST(contains(lower(ctx), lower(x)) AS INT))), 6) AS context_recall,
round(len(list_intersect({WORDS_OF.format("reference")}, {WORDS_OF.format("ctx")})) / (len({WORDS_OF.format("reference")}) + 1e-8), 6) AS context_entity_recall FROM k""")
def judged_contexts(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d, ["faithfulness", "context_precision", "context_utilization", "context_recall", "context_entity_recall"])


@query(f"""WITH {ROWS}, n AS (SELECT *, s_ref[1] + s_ref[2] AS tp, 2 - s_ref[1] - s_ref[2] AS fp, 2 - r_resp[1] - r_resp[2] AS fn,
  len(list_intersect(s, r)) AS both_,
  list_transform([1, 2], lambda i: CAST((c_r[1] = 1 AND contains(lower(c[1]), lower(s[i]))) OR (c_r[2] = 1 AND contains(lower(c[2]), lower(s[i]))) AS INT)) AS by_rel,
  list_transform([1, 2], lambda i: CAST((c_r[1] = 0 AND contains(lower(c[1]), lower(s[i]))) OR (c_r[2] = 0 AND contains(lower(c[2]), lower(s[i]))) AS INT)) AS by_other,
  {WORDS_OF.format("refs")} AS keys, {WORDS_OF.format("response")} AS told FROM k),
f AS (SELECT *, tp / (tp + fp + 1e-8) AS p_, tp / (tp + fn + 1e-8) AS r_ FROM n)
SELECT row_id, CASE WHEN p_ + r_ = 0 THEN 0.0 ELSE round_even(2 * p_ * r_ / (p_ + r_), 2) END AS factual_correctness,
round(CASE WHEN both_ = 0 THEN 0.0 ELSE 2.0 * both_ / (2 * both_ + (2 - both_) + (2 - both_)) END, 6) AS statement_f1,
round((by_rel[1] * (1 - s_ref[1]) + by_rel[2] * (1 - s_ref[2])) / 2.0, 6) AS noise_sensitivity,
round((by_other[1] * (1 - by_rel[1]) * (1 - s_ref[1]) + by_other[2] * (1 - by_rel[2]) * (1 - s_ref[2])) / 2.0, 6) AS noise_sensitivity_irrelevant,
round(0.5 * len(list_intersect(keys, told)) / len(keys) + 0.5 * (1 - least(length(response), length(refs)) / (length(refs) + 1e-10)), 6) AS summary_score FROM f""")
def judged_answers(spark: SparkSession, d: str) -> DataFrame:
    """``statement_f1`` is answer correctness with all its weight on the statements."""
    required = METRICS["answer_correctness"].requires
    statement_f1 = Metric("statement_f1", required, judged=judge_metrics.answer_correctness((1.0, 0.0)))
    return scores(spark, d, ["factual_correctness", statement_f1, "noise_sensitivity", "noise_sensitivity_irrelevant", "summary_score"])


@query(f"""WITH {ROWS} SELECT row_id, CASE WHEN response = reference THEN 1.0 WHEN contains(response, reference) OR contains(reference, response) THEN 0.5 ELSE 0.0 END AS nv_accuracy,
CASE WHEN question = ctx OR contains(question, ctx) THEN 0.0 WHEN len(list_intersect(string_split(lower(question), ' '), regexp_split_to_array(lower(ctx), '\\s+'))) > 0 THEN 1.0 ELSE 0.0 END AS nv_context_relevance,
CASE WHEN len(list_filter(string_split(response, ' '), lambda w: NOT contains(ctx, w))) = 0 THEN 1.0 WHEN len(list_filter(string_split(response, ' '), lambda w: contains(ctx, w))) > 0 THEN 0.5 ELSE 0.0 END AS nv_response_groundedness FROM k""")
def judged_ratings(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d, ["nv_accuracy", "nv_context_relevance", "nv_response_groundedness"])


@query(f"""WITH {ROWS}, w AS (SELECT *, string_split(response, ' ') AS w FROM k) SELECT row_id, CASE WHEN contains(response, 'ECONOMY') THEN 1.0 ELSE 0.0 END AS economy, CAST(len(w) AS DOUBLE) AS words,
CAST(least(5, 1 + len(w)) AS DOUBLE) AS domain_rubrics, CAST(least(5, 1 + len(w)) AS DOUBLE) AS instance_rubrics, CASE WHEN lower(response) = lower(reference) THEN 1.0 ELSE 0.0 END AS sql_equivalence,
CASE WHEN len(list_filter(w, lambda x: NOT contains(ctx, x))) = 0 THEN 1.0 ELSE 0.0 END AS multimodal_faithfulness, CASE WHEN len(list_filter(w, lambda x: contains(ctx, x))) > 0 THEN 1.0 ELSE 0.0 END AS multimodal_relevance FROM w""")
def judged_criteria(spark: SparkSession, d: str) -> DataFrame:
    economy = Metric("economy", ["response"], judged=judge_metrics.aspect_critic("Does it speak of ECONOMY?", strictness=2))
    words = Metric("words", ["response"], judged=judge_metrics.simple_criteria("How many words has it?"))
    return scores(spark, d, [economy, words, "domain_rubrics", "instance_rubrics", "sql_equivalence", "multimodal_faithfulness", "multimodal_relevance"])


#: Topics that the conversations are held against.
TOPICS = ("the", "and", "on", "of", "de", "la", "der", "und")


@query(f"""WITH l AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS ls FROM conversations WHERE role <> 'system'),
h AS (SELECT conv_id, list_distinct(list(lower(regexp_split_to_array(trim(ls[1]), '\\s+')[1]))) AS ts FROM l WHERE role = 'user' AND trim(ls[1]) <> '' GROUP BY 1),
n AS (SELECT conv_id, len(list_filter(ts, lambda t: t IN {TOPICS})) AS tp, len(ts) AS n FROM h),
g AS (SELECT conv_id, coalesce(arg_min(ls[1], turn) FILTER (WHERE role = 'user'), '') AS goal, coalesce(arg_max(ls[1], turn) FILTER (WHERE role = 'assistant'), '') AS end_ FROM l GROUP BY 1)
SELECT g.conv_id, round(CASE WHEN n.conv_id IS NULL THEN CAST('nan' AS DOUBLE) ELSE 2 * (tp / (n + 1e-10)) * (tp / (tp + 1e-10)) / ((tp / (n + 1e-10)) + (tp / (tp + 1e-10)) + 1e-10) END, 6) AS topic_adherence,
CASE WHEN contains(lower(end_), lower(goal)) THEN 1.0 ELSE 0.0 END AS agent_goal_accuracy_without_reference,
CASE WHEN contains(lower(end_), 'the') THEN 1.0 ELSE 0.0 END AS agent_goal_accuracy_with_reference FROM g LEFT JOIN n ON g.conv_id = n.conv_id""")
def judged_conversations(spark: SparkSession, d: str) -> DataFrame:
    rows = assemble_conversations(table(spark, d, "conversations")).withColumns({"reference_topics": F.array(*map(F.lit, TOPICS)), "reference": F.lit("the")})
    out = evaluate(rows, ["topic_adherence", "agent_goal_accuracy_without_reference", "agent_goal_accuracy_with_reference"], "conv_id", JUDGE)
    return out.scores.select("conv_id", *[F.round(m, 6).alias(m) for m in out.metrics])
