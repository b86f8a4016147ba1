"""Evaluation-case files, in both shapes, and counts over them."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.schemas import EVAL_DATASET


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(EVAL_DATASET).option("multiLine", "true").json(path)
    return eval_cases(docs)


def eval_cases(docs: DataFrame) -> DataFrame:
    """One row per case: id, shape, turns, the user message it ends with.

    A case has a single prompt, or earlier turns whose last event is the user's.
    """
    cases = docs.select(F.explode("eval_cases").alias("c")).select("c.*")
    turns = F.col("agent_data.turns")
    last = F.try_element_at(F.try_element_at(turns, F.lit(-1)).getField("events"), F.lit(-1))

    def text(parts):
        return F.array_join(F.transform(parts, lambda p: p.getField("text")), "\n")

    return cases.select(
        F.col("eval_case_id").alias("case_id"),
        F.when(F.col("prompt").isNotNull(), "prompt").otherwise("turns").alias("shape"),
        F.coalesce(
            text(F.col("prompt.parts")), text(last.getField("content").getField("parts"))
        ).alias("message"),
        F.coalesce(F.when(turns.isNotNull(), F.size(turns)), F.lit(0)).alias("turn_count"),
        turns.alias("turns"),
    )


def case_events(cases: DataFrame) -> DataFrame:
    """One row per message part of the turns of each case."""
    return (
        cases.select("case_id", F.explode("turns").alias("t"))
        .select("case_id", "t.turn_index", F.posexplode("t.events").alias("event_idx", "e"))
        .select(
            "case_id",
            "turn_index",
            "event_idx",
            "e.author",
            F.col("e.content.role").alias("role"),
            F.explode("e.content.parts").alias("part"),
        )
        .select("case_id", "turn_index", "event_idx", "author", "role", "part.text")
    )
