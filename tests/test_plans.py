"""Shapes of the main plans: what is shuffled, pushed down and broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.plans import driver_tables as d, registry
from tidemark.plans.weekly_run import evaluate, no_responses
from tidemark.operators.signals import signals_as_of
from tidemark.sources.evaluations import empty_state
from tidemark.schemas import EMPLOYEE_WEEK

import os

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not there")


def plan(frame):
    text = frame._jdf.queryExecution().executedPlan().toString()
    return re.sub(r"#\d+L?", "", text)


@pytest.fixture
def no_small_tables(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def weeks(spark):
    return spark.createDataFrame([("a", 1, 1, 1.0, 0, 0, 40, 90, "x", "f")], EMPLOYEE_WEEK)


def test_signals_shuffle_once(spark):
    text = plan(signals_as_of(d.densify(weeks(spark), 4)))
    assert text.count("Exchange hashpartitioning") == 1 and "hashpartitioning(employee," in text
    assert "Join" not in text


def test_evaluation_keeps_the_partitioning(spark, no_small_tables):
    text = plan(evaluate(weeks(spark), 4, empty_state(spark), no_responses(spark), "main", d.AS_OF))
    main = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    # Joins with state and answers and the fold add no shuffle of the timeline.
    assert not any("hashpartitioning(employee, week" in line and "stored" in line for line in main)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert text.count("SortMergeJoin [employee, week], [employee, week], LeftOuter") == 2
    fold = text[: text.index("SortMergeJoin")]
    assert "Exchange hashpartitioning" not in fold


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_cross_joins_or_python(spark, no_small_tables, name):
    if name in {"realtime_files", "pasted_stream", "state_upsert"}:
        pytest.skip("writes first; its steps are looked at above")
    text = plan(registry.QUERIES[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in text


@needs_tables
def test_scans_are_narrow(spark):
    text = plan(registry.QUERIES["employee_week_metrics"](spark, SF_DIR))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text
    assert "partial_count" in text
    week = plan(registry.QUERIES["last_week"](spark, SF_DIR))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in week


@needs_tables
def test_first_copies_are_limited_before_the_shuffle(spark):
    text = plan(registry.QUERIES["completions_view"](spark, SF_DIR))
    above = text.split("Exchange hashpartitioning(conversation_id, message_type, role")
    assert len(above) == 2 and "WindowGroupLimit" in above[1].splitlines()[1]


def test_days_are_pruned(spark, tmp_path):
    from tidemark.sources import telemetry

    if os.path.isdir(SF_DIR):
        telemetry.append_logs(d.inference_logs(spark, SF_DIR), str(tmp_path / "logs"))
        text = plan(telemetry.read_logs(spark, str(tmp_path / "logs"), F.col("day") > "2024-01-01"))
        assert "PartitionFilters: [isnotnull(day), (day > 2024-01-01)]" in text


@needs_tables
@pytest.mark.parametrize("name", ["evaluation_run", "model_prompts"])
def test_a_run_does_not_scan_events_again(spark, name):
    text = plan(registry.QUERIES[name](spark, SF_DIR))
    assert "events.parquet" not in text
