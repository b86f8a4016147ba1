"""Dense employee timelines.

After :func:`keep_first` an employee has at most one row per week; every window below
therefore works on as many rows as there are weeks, whatever share of the raw rows one
name holds.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.schemas import METRICS

_BASE_COLUMNS = {
    "base_tasks": "completed_tasks",
    "base_response": "response_time",
    "base_sick": "sick_days",
}


def employee_order() -> W:
    """The one partitioning and order all per-employee steps share."""
    return W.partitionBy("employee").orderBy("week")


def keep_first(rows: DataFrame, order: Column) -> DataFrame:
    """First record per (employee, week) in ``order``.

    ``min_by`` combines on the map side, so a name that fills a third of the input
    still sends one row per map task and week.
    """
    others = [c for c in rows.columns if c not in ("employee", "week")]
    first = F.min_by(F.struct(*others), order).alias("first")
    return rows.groupBy("employee", "week").agg(first).select(
        "employee", "week", *[F.col(f"first.{c}").alias(c) for c in others]
    )


def max_week_of(weeks: DataFrame, max_weeks: int | None = None) -> Column:
    """Largest week as a scalar subquery, NULL on no rows.

    ``weeks`` needs a ``week`` column only; pass the narrowest source there is.  Every
    employee gets as many rows as the last week says; with ``max_weeks`` a higher week
    (a year in a file name, say) is an error.
    """
    last = weeks.agg(F.max("week").cast("int").alias("w"))
    if max_weeks is None:
        return last.scalar()
    checked = last.select(
        F.when(
            F.col("w") > max_weeks,
            F.raise_error(
                F.format_string("week %d is above the limit of %d", "w", F.lit(max_weeks))
            ).cast("int"),
        )
        .otherwise(F.col("w"))
        .cast("int")
        .alias("w")
    )
    return checked.scalar()


def densify(records: DataFrame, max_week: Column | int) -> DataFrame:
    """One row per employee and week 1..max_week; weeks without data are gap rows.

    No join with a week spine: each record fills the weeks up to the next one.  Adds
    ``data_missing`` and the week-1 baseline (``has_baseline``, ``base_*``).
    """
    order = employee_order()
    last_week = max_week if isinstance(max_week, Column) else F.lit(max_week)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first_week = F.col("_first_week")
    spans = (
        records.withColumn("_max", last_week)
        .filter((F.col("week") >= 1) & (F.col("week") <= F.col("_max")))
        .withColumn("_next", F.lead("week").over(order))
        .withColumn("_first_week", F.first("week").over(whole))
        .withColumns(
            {base: F.first(metric).over(whole) for base, metric in _BASE_COLUMNS.items()}
        )
        .withColumn(
            "_weeks",
            F.sequence(
                F.when(F.col("week") == first_week, F.lit(1)).otherwise(F.col("week")),
                F.coalesce(F.col("_next") - 1, F.col("_max")),
            ),
        )
    )
    carried = [c for c in records.columns if c not in ("employee", "week")]
    present = F.col("_week") == F.col("week")
    return (
        spans.withColumn("_week", F.explode("_weeks"))
        .select(
            "employee",
            F.col("_week").alias("week"),
            *[F.when(present, F.col(c)).alias(c) for c in carried],
            (~present).alias("data_missing"),
            (first_week == 1).alias("has_baseline"),
            *[F.when(first_week == 1, F.col(b)).alias(b) for b in _BASE_COLUMNS],
        )
    )


def with_missing_weeks(timeline: DataFrame) -> DataFrame:
    """Adds the missing weeks up to and including each row's week.

    Gaps are kept as stretches (first, last): those that ended before the week and the one
    that reaches it; single weeks are listed only in the result.
    """
    before = employee_order().rowsBetween(W.unboundedPreceding, -1)
    stretch = F.struct(F.col("_since").alias("first"), F.col("week").alias("last"))
    present_next = ~F.lead("data_missing", 1, True).over(employee_order())
    placed = timeline.withColumns(
        {
            "_since": F.coalesce(F.max(F.when(~F.col("data_missing"), F.col("week"))).over(before), F.lit(0)) + 1,
            "_ends": F.col("data_missing") & present_next,
        }
    )
    gaps = placed.withColumn("_gaps", F.collect_list(F.when(F.col("_ends"), stretch)).over(before))
    reached = F.when(F.col("data_missing"), F.array_append("_gaps", stretch)).otherwise(F.col("_gaps"))
    weeks = F.flatten(F.transform(reached, lambda g: F.sequence(g.getField("first"), g.getField("last"))))
    return gaps.withColumn("missing_weeks", weeks).drop("_since", "_ends", "_gaps")


def expected_weeks(employees: DataFrame, max_week: Column | int) -> DataFrame:
    """(employee, week) for every employee and week 1..max_week."""
    last_week = max_week if isinstance(max_week, Column) else F.lit(max_week)
    return (
        employees.select("employee")
        .distinct()
        .select("employee", F.explode(F.sequence(F.lit(1), last_week)).alias("week"))
    )


def missing_weeks(records: DataFrame, max_week: Column | int) -> DataFrame:
    """Expected minus processed weeks, one row per missing (employee, week)."""
    timeline = densify(records.select("employee", "week", *METRICS), max_week)
    return timeline.filter("data_missing").select("employee", "week")
