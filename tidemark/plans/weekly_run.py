"""One evaluation run: records, state and model answers in, new evaluations out.

Everything per employee (timeline, flags, runs, severity, score fold) shares one
partitioning by employee.  State and answers join it on (employee, week).
"""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark import constants as C
from tidemark.functions.model_text import TREND_ANSWER, strip_fences
from tidemark.functions.sets import signal_names
from tidemark.operators import cases, readmodels, risk
from tidemark.operators.briefing import choose_briefing
from tidemark.operators.risk import is_flagged
from tidemark.operators.signals import add_details, signals_as_of
from tidemark.operators.timeline import densify, keep_first, max_week_of
from tidemark.schemas import EMPLOYEE_WEEK, EVALUATION_COLUMNS, MODEL_RESPONSE
from tidemark.session import drop_dir, scratch_dir
from tidemark.sources import evaluations as state_table, reports, weekly

_CARRY = (
    "signals",
    "briefing_text",
    "past_similarity",
    "past_briefing",
    "stored_briefing",
)


def no_responses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MODEL_RESPONSE)


def responses_per_week(responses: DataFrame) -> DataFrame:
    """One row per (employee, week) with the text of each kind.

    Of several answers the last by ``seq`` counts; without such a column different
    answers for one key are an error.
    """
    ordered = "seq" in responses.columns

    def one(kind: str) -> Column:
        text = F.when(F.col("kind") == kind, F.col("text"))
        if ordered:
            return F.max_by(text, F.when(text.isNotNull(), F.col("seq")))
        clash = F.raise_error(F.lit(f"several {kind} answers for one employee and week need a seq column"))
        return F.when(F.min(text) != F.max(text), clash.cast("string")).otherwise(F.max(text))

    return responses.groupBy("employee", "week").agg(
        *[one(kind).alias(f"{kind}_text") for kind in ("trend", "risk", "briefing")]
    )


def missing_evaluations(expected: DataFrame, state: DataFrame, scope: str) -> DataFrame:
    """Expected (employee, week) without a stored evaluation."""
    stored = state.filter(F.col("scope") == scope).select("employee", "week")
    return expected.select("employee", "week").join(stored, ["employee", "week"], "left_anti")


def repairs_due(expected: DataFrame, due: DataFrame) -> DataFrame:
    """Stored evaluations that need a briefing and belong to an expected week."""
    return due.join(expected.select("employee", "week"), ["employee", "week"], "left_semi")


def late_frontier(records: DataFrame, state: DataFrame, scope: str) -> DataFrame:
    """employee, redo_from: the first week a record has reached after evaluations were stored without it.

    A stored evaluation names the weeks it missed in its gap marker; a week that is named
    and has a record by now came late, and all evaluations from it on are out of date.
    """
    gaps = F.filter("signals", lambda s: s.getField("kind") == "gap")
    named = F.flatten(F.transform(gaps, lambda s: F.regexp_extract_all(s.getField("details"), F.lit(r"(\d+)"))))
    missed = (
        state.filter(F.col("scope") == scope)
        .select("employee", F.explode(named).alias("week"))
        .select("employee", F.col("week").cast("int").alias("week"))
        .distinct()
    )
    late = records.select("employee", "week").join(missed, ["employee", "week"], "left_semi")
    return late.groupBy("employee").agg(F.min("week").alias("redo_from"))


def _with_redo(stored: DataFrame, recompute_from: DataFrame | int | None) -> DataFrame:
    """``redo``: whether a stored week is computed again, by one first week for all or one an employee."""
    if recompute_from is None or isinstance(recompute_from, int):
        first = F.lit(recompute_from).cast("int")
        return stored.withColumn("redo", F.coalesce(F.col("week") >= first, F.lit(False)))
    joined = stored.join(recompute_from.select("employee", "redo_from"), "employee", "left")
    return joined.withColumn("redo", F.coalesce(F.col("week") >= F.col("redo_from"), F.lit(False))).drop("redo_from")


def in_window(evaluated_at: Column, as_of: dt.datetime | Column, days: int = C.HISTORY_DAYS) -> Column:
    """Stored within the history window that ends at ``as_of``."""
    end = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return evaluated_at >= end - F.make_dt_interval(F.lit(days))


def evaluate(
    records: DataFrame,
    max_week: Column | int,
    state: DataFrame,
    responses: DataFrame,
    scope: str,
    as_of: dt.datetime,
    reuse_state: bool = True,
    recompute_from: DataFrame | int | None = None,
    streak_mode: str = "stored",
    pool: DataFrame | None = None,
) -> DataFrame:
    """New and repaired EVALUATION rows of one scope.

    ``records``: one EMPLOYEE_WEEK row per (employee, week).  Stored weeks are kept as
    they are and only count as history, unless ``reuse_state`` is off or the week is
    at or after ``recompute_from`` (a week, or rows of employee and ``redo_from`` as
    ``late_frontier`` gives them); a stored week that is not Healthy and lacks a
    briefing gets signals and briefing, and keeps its score and class.  ``pool`` holds the
    cases to search, if ``state`` is only that of some employees.
    """
    own = state.filter(F.col("scope") == scope)
    if not reuse_state:
        own = own.filter(F.lit(False))
    elif recompute_from is not None:
        own = _with_redo(own, recompute_from).filter(~F.col("redo")).drop("redo")
    stored = own.select(
        "employee",
        "week",
        F.col("score").alias("st_score"),
        F.col("classification").alias("st_class"),
        F.col("rationale").alias("st_rationale"),
        F.col("healthy_streak").alias("stored_streak"),
        F.col("origin").alias("st_origin"),
        F.col("briefing").alias("stored_briefing"),
        F.coalesce(in_window(F.col("evaluated_at"), as_of), F.lit(False)).alias("in_history"),
        F.lit(True).alias("stored"),
    )
    detected = signals_as_of(densify(records, max_week)).select("employee", "week", "signals")
    rows = (
        detected.join(responses_per_week(responses), ["employee", "week"], "left")
        .join(stored, ["employee", "week"], "left")
        .withColumns(
            {
                "stored": F.coalesce("stored", F.lit(False)),
                "in_history": F.coalesce("in_history", F.lit(True)),
                "details": F.from_json(strip_fences(F.col("trend_text")), TREND_ANSWER),
            }
        )
        .withColumn("signals", add_details(F.col("signals"), F.col("details")))
        .withColumn("names", signal_names(F.col("signals")))
    )
    known = (state if pool is None else pool).filter(F.col("scope") == scope).withColumn("names", signal_names(F.col("signals")))
    rows = cases.nearest_cases(rows, known, (cases.case_search(), cases.briefing_search()))
    scored = risk.base_scores(rows)
    keep = F.col("stored")
    scored = scored.withColumns(
        {
            "origin": F.when(keep, F.col("st_origin")).otherwise(F.col("origin")),
            "base_score": F.when(keep, F.col("st_score")).otherwise(F.col("base_score")),
            "base_class": F.when(keep, F.col("st_class")).otherwise(F.col("base_class")),
            "base_rationale": F.when(keep, F.col("st_rationale")).otherwise(F.col("base_rationale")),
        }
    )
    folded = risk.fold_scores(scored, streak_mode, carry=_CARRY)
    # Filtered before the texts are screened, on what decides that there is a text.
    lacks_briefing = risk.is_flagged(F.col("classification")) & (
        F.coalesce("stored_briefing", F.lit("")) == ""
    )
    due = folded.filter(~F.col("stored") | lacks_briefing)
    return choose_briefing(due).select(
        F.lit(scope).alias("scope"),
        "employee",
        "week",
        "score",
        "classification",
        "rationale",
        "healthy_streak",
        "signals",
        "briefing",
        "origin",
        F.lit(as_of).cast("timestamp").alias("evaluated_at"),
    )


def merged_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """State as it reads after the new rows are stored."""
    kept = state.join(new.select(*state_table.KEY), state_table.KEY, "left_anti")
    return kept.unionByName(new.select(*EVALUATION_COLUMNS))


def write_scope_report(spark: SparkSession, state_path: str, scope: str, path: str) -> None:
    """Text report of what one scope has stored."""
    state = state_table.read_state(spark, state_path, scope)
    lines = readmodels.report_lines(readmodels.latest_rows(state), state)
    reports.write_report(lines, path, f"Run complete, scope {scope}.")


def employees_due(
    records: DataFrame,
    max_week: Column,
    state: DataFrame,
    scope: str,
    recompute_from: DataFrame | int | None = None,
) -> DataFrame:
    """Employees with a week that lacks its evaluation, or a stored one to repair or redo."""
    stored = state.filter(F.col("scope") == scope).withColumn("_max", max_week).filter(
        (F.col("week") >= 1) & (F.col("week") <= F.col("_max"))
    )
    stored = _with_redo(stored, recompute_from)
    lacks = is_flagged(F.col("classification")) & (F.coalesce("briefing", F.lit("")) == "")
    per_employee = stored.groupBy("employee").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(lacks | F.col("redo")).alias("_again")
    )
    known = records.select("employee").distinct().join(per_employee, "employee", "left")
    due = (F.coalesce("_n", F.lit(0)) < F.col("_max")) | F.coalesce("_again", F.lit(False))
    return known.withColumn("_max", max_week).filter(due).select("employee")


def run_weekly(
    spark: SparkSession,
    folder: str,
    state_path: str,
    responses: DataFrame | None = None,
    scope: str = "main",
    as_of: dt.datetime | None = None,
    strict: bool = False,
    reuse_state: bool = True,
    recompute_from: int | None = None,
    max_weeks: int | None = None,
    streak_mode: str = "stored",
    report_path: str | None = None,
    recompute_late: bool = False,
    **reading,
) -> str | None:
    """Reads a folder of weekly files, evaluates what is missing and stores it.

    The files are parsed once, into a table of first records in the shared folder; the
    last week and the run itself read that.  With ``report_path`` the text report of the
    scope is written there.  With ``recompute_late`` an employee's stored weeks are computed
    again from the first one on whose record came late.  ``reading`` goes to ``weekly.scan_employee_weeks``.
    Returns None, or in words why nothing was done.
    """
    problem = weekly.input_problem(spark, folder)
    if problem:
        return problem
    rows = weekly.scan_employee_weeks(spark, folder, strict=strict, **reading)
    staging = scratch_dir(spark, "records")
    keep_first(rows, F.col(weekly.ROW_ORDER)).drop(weekly.ROW_ORDER).write.parquet(staging)
    records = spark.read.schema(EMPLOYEE_WEEK).parquet(staging)
    problem = weekly.input_problem(spark, folder, records)
    if problem:
        return problem
    state = state_table.read_state(spark, state_path)
    if recompute_late and recompute_from is None:
        recompute_from = late_frontier(records, state, scope)
    new = evaluate(
        records,
        max_week_of(records.select("week"), max_weeks),
        state,
        no_responses(spark) if responses is None else responses,
        scope,
        as_of or dt.datetime.now(dt.timezone.utc),
        reuse_state,
        recompute_from,
        streak_mode,
    )
    state_table.upsert_state(spark, state_path, new)
    if report_path is not None:
        write_scope_report(spark, state_path, scope, report_path)
    drop_dir(spark, staging)
    return None
