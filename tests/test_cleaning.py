import pytest
from pyspark.sql import functions as F

from tidemark.functions import cleaning, model_text, names, observation, sets


def value(spark, column, **inputs):
    frame = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} STRING" for k in inputs))
    return frame.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "cell, expected",
    [("8", 8), (" 8 ", 8), ("+8", 8), ("-3", -3), ("8.0", 0), ("", 0), ("abc", 0), ("1_000", 0),
     ("99999999999", 0), (None, 0), ("8\t", 8)],
)
def test_whole_numbers(spark, cell, expected):
    assert value(spark, cleaning.safe_int(F.col("c"), 0), c=cell) == expected


@pytest.mark.parametrize(
    "cell, expected",
    [("1.5", 1.5), (".5", 0.5), ("5.", 5.0), ("1e2", 100.0), ("1.5d", 0.0), ("1.5f", 0.0), ("x", 0.0),
     (None, 0.0), ("nan", None), ("-inf", float("-inf"))],
)
def test_floating_numbers(spark, cell, expected):
    assert value(spark, cleaning.safe_double(F.col("c"), 0.0), c=cell) == expected


def test_names_and_capitals(spark):
    assert value(spark, cleaning.first_token(F.col("c")), c="  Ana  Maria Lopez") == "Ana"
    assert value(spark, cleaning.first_token(F.col("c")), c=" \t ") == "Unknown"
    assert value(spark, cleaning.first_token(F.col("c")), c=None) == "Unknown"
    assert value(spark, cleaning.capitalise(F.col("c")), c="vERY negative") == "Very negative"


def test_pseudonym_hides_the_name(spark):
    made = value(spark, names.pseudonym(F.col("c"), "risk"), c="Alice")
    # First 12 hex digits of SHA-256("alice").
    assert made == "session_employee_2bd806c97f0e_risk"
    assert made == value(spark, names.pseudonym(F.col("c"), "risk"), c="alice")
    assert made != value(spark, names.pseudonym(F.col("c"), "risk"), c="bob")
    assert "alice" not in made.lower()


@pytest.mark.parametrize(
    "text, expected",
    [('```json\n{"a":1}\n```', '{"a":1}'), ('```{"a":1}```  ', '{"a":1}'), (' {"a":1} ', '{"a":1}'),
     ("```", ""), ('```json```{"a":1}', '{"a":1}')],
)
def test_code_fences(spark, text, expected):
    assert value(spark, model_text.strip_fences(F.col("c")), c=text) == expected


def test_json_block(spark):
    assert value(spark, model_text.json_block(F.col("c")), c='so {"a":\n{"b":1}} ok') == '{"a":\n{"b":1}}'
    assert value(spark, model_text.json_block(F.col("c")), c="none") == "none"


def test_similarity(spark):
    frame = spark.createDataFrame(
        [([], []), (["a"], []), (["a", "b"], ["b", "c"]), (["a"], ["a"])], "x ARRAY<STRING>, y ARRAY<STRING>"
    )
    got = [r.s for r in frame.select(sets.jaccard(F.col("x"), F.col("y")).alias("s")).collect()]
    assert got == [1.0, 0.0, 1 / 3, 1.0]
    assert value(spark, sets.percent(F.col("c").cast("double")), c="0.57") == int(0.57 * 100)


def test_observation_metrics(spark):
    text = "john had 3 days off and 2 late logins, spent 35 hours, quality was 88, delay of 1.5, 7 tasks, negative"
    m = value(spark, observation.metrics_from_text(F.col("c")), c=text)
    assert m.asDict() == {
        "name": "John", "tasks_completed": 7, "avg_response_time": 1.5, "after_hours_logins": 2,
        "sick_days": 3, "weekly_hours": 35, "task_accuracy": 88, "sentiment": "Negative",
    }
    empty = value(spark, observation.metrics_from_text(F.col("c")), c="")
    assert (empty.name, empty.weekly_hours, empty.task_accuracy, empty.sentiment) == ("Unknown", 40, 95, "Neutral")


def test_extracted_answer(spark):
    frame = spark.createDataFrame(
        [(1, 'ok: {"employee_name": "gRETA", "tasks_completed": "4", "sentiment": "POSITIVE"} bye'), (2, "no")],
        "i INT, text STRING")
    m, none = (r.metrics for r in observation.with_metrics_from_answer(frame).orderBy("i").collect())
    assert none is None
    assert (m.name, m.tasks_completed, m.weekly_hours, m.task_accuracy, m.sentiment) == ("Greta", 4, 40, 95, "Positive")
