"""Call counters, turn counts, response grades and the comparison of two runs."""

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.cleaning import strip
from tidemark.functions.model_text import json_block, whole_number, with_json_object


def call_outcomes(calls: DataFrame, *by: str) -> DataFrame:
    """Successful and rejected calls, overall or per ``by`` columns.

    ``calls`` has a boolean ``success``.
    """
    return calls.groupBy(*by).agg(
        F.count_if(F.col("success")).alias("success"),
        F.count_if(~F.col("success")).alias("rejected"),
    )


def turn_counts(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns per conversation, for turns kept as rows."""
    return turns.groupBy(key).agg(F.count(F.lit(1)).alias("score"))


def parse_grades(verdicts: DataFrame, text: str = "text") -> DataFrame:
    """Adds grade (1..5, else NULL) and explanation from a JSON verdict."""
    fields = "score: STRING, explanation: STRING"
    parsed = with_json_object(verdicts, strip(json_block(F.col(text))), fields, "_doc")
    scored = parsed.withColumn("grade", whole_number(F.col("_doc.score")))
    return scored.withColumns(
        {
            "grade": F.when(F.col("grade").between(1, 5), F.col("grade")),
            "explanation": F.col("_doc.explanation"),
        }
    ).drop("_doc")


def grade_summary(graded: DataFrame, metric: str = "metric") -> DataFrame:
    return graded.groupBy(metric).agg(
        F.count("grade").alias("graded"),
        F.count_if(F.col("grade").isNull()).alias("invalid"),
        F.avg("grade").alias("avg_grade"),
        F.min("grade").alias("min_grade"),
        F.max("grade").alias("max_grade"),
    )


def compare_grades(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Base and candidate grade per (case_id, metric), with their difference."""
    keys = ["case_id", "metric"]
    return (
        base.select(*keys, F.col("grade").alias("base_grade"))
        .join(candidate.select(*keys, F.col("grade").alias("candidate_grade")), keys, "full")
        .withColumn("difference", F.col("candidate_grade") - F.col("base_grade"))
    )
