"""Status, briefing lookup, team table, risk cards, cohort overview, report lines."""

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import constants as C
from tidemark.functions.cleaning import capitalise
from tidemark.functions.sets import display_name
from tidemark.operators.briefing import section_checks, shown_briefing
from tidemark.operators.risk import badge, is_flagged


def _score() -> Column:
    return F.coalesce("score", F.lit(C.STATUS_SCORE))


def _class() -> Column:
    return F.coalesce("classification", F.lit(C.STATUS_CLASS))


def listed_signals(signals: Column) -> Column:
    """Signal entries without the gap marker."""
    return F.filter(signals, lambda s: s.getField("kind") != "gap")


def employee_status(state: DataFrame) -> DataFrame:
    """Latest evaluation and week history per employee.

    State holds one row per (scope, employee, week) and weeks are bounded, so the
    history array is.
    """
    latest = F.struct(
        _score().alias("score"),
        _class().alias("classification"),
        F.coalesce("rationale", F.lit("")).alias("rationale"),
        "signals",
    )
    point = F.struct("week", _score().alias("score"), _class().alias("classification"))
    return (
        state.groupBy("scope", "employee")
        .agg(
            F.max("week").alias("latest_week"),
            F.max_by(latest, "week").alias("latest"),
            F.array_sort(F.collect_list(point)).alias("history"),
        )
        .select(
            "scope",
            capitalise(F.col("employee")).alias("name"),
            "latest.score",
            "latest.classification",
            "latest.rationale",
            "latest_week",
            F.coalesce("latest.signals", F.array()).alias("signals"),
            "history",
        )
    )


def latest_briefing(state: DataFrame, requests: DataFrame) -> DataFrame:
    """Briefing of the latest week per requested (name, scope), with a found flag."""
    latest = state.groupBy("scope", F.lower("employee").alias("_key")).agg(
        F.max_by("briefing", "week").alias("_text")
    )
    wanted = requests.withColumn("_key", F.lower(F.trim("name")))
    text = F.nullif(F.col("_text"), F.lit(""))
    return wanted.join(latest, ["scope", "_key"], "left").select(
        "name",
        "scope",
        text.isNotNull().alias("found"),
        F.coalesce(text, F.lit(C.BRIEFING_NOT_FOUND_TEXT)).alias("briefing"),
    )


def latest_rows(state: DataFrame) -> DataFrame:
    """Each employee's newest evaluation."""
    rest = [c for c in state.columns if c not in ("scope", "employee")]
    newest = F.max_by(F.struct(*rest), "week").alias("r")
    return state.groupBy("scope", "employee").agg(newest).select("scope", "employee", "r.*")


def signal_text(signals: Column, length: int | None = None) -> Column:
    """Signal names in one line, "None" without any."""
    joined = F.array_join(F.transform(listed_signals(signals), display_name), ", ")
    text = F.when(F.coalesce(F.length(joined), F.lit(0)) > 0, joined).otherwise(F.lit("None"))
    return text if length is None else F.substring(text, 1, length)


def team_summary(latest: DataFrame, signal_chars: int = 50) -> DataFrame:
    """One line per employee: score, badge, signal names cut to ``signal_chars``."""
    return latest.select(
        "employee",
        "score",
        badge(F.col("classification")).alias("badge"),
        signal_text(F.col("signals"), signal_chars).alias("signals"),
    )


def risk_cards(latest: DataFrame, rationale_chars: int = 90) -> DataFrame:
    """Card of every flagged employee, one row per card."""
    marks = F.transform(
        listed_signals(F.col("signals")),
        lambda s: F.concat(
            F.lit("["), F.coalesce(s.getField("severity"), F.lit("?")), F.lit("] "), display_name(s)
        ),
    )
    return latest.filter(is_flagged(F.col("classification"))).select(
        "employee",
        "score",
        badge(F.col("classification")).alias("badge"),
        "classification",
        F.substring(F.coalesce("rationale", F.lit("")), 1, rationale_chars).alias("rationale"),
        marks.alias("signals"),
        shown_briefing(F.col("briefing")).alias("briefing"),
    )


def briefing_checks(rows: DataFrame, text: str = "briefing") -> DataFrame:
    return rows.withColumns(section_checks(F.col(text)))


def cohort_overview(latest: DataFrame) -> DataFrame:
    """Employees per class: count, average score, number of signals."""
    return latest.groupBy("classification").agg(
        F.count(F.lit(1)).alias("employees"),
        F.avg("score").alias("avg_score"),
        F.sum(F.size(listed_signals(F.coalesce("signals", F.array())))).alias("signals"),
    )


def cohort_payload(latest: DataFrame) -> DataFrame:
    """One JSON document per employee, as the report writer gets it."""
    return latest.select(
        "employee",
        F.to_json(
            F.struct(
                "employee",
                "score",
                "classification",
                "rationale",
                listed_signals(F.col("signals")).alias("signals"),
                shown_briefing(F.col("briefing")).alias("briefing"),
            )
        ).alias("payload"),
    )


_RULE = "-" * 72


def report_lines(latest: DataFrame, state: DataFrame) -> DataFrame:
    """Text report as rows (section, employee, ord, line).

    Sections: 1 team table, 2 cards and briefings, 3 stored evaluations.  Sorting by
    (section, employee, ord) gives the report; rows stay spread over the cluster.
    """
    team = F.array(
        F.format_string(
            "%-12s %5d  %-14s  %s",
            "employee",
            "score",
            F.coalesce("classification", F.lit("")),
            signal_text(F.col("signals")),
        )
    )
    marks = F.transform(
        listed_signals(F.col("signals")),
        lambda s: F.concat(
            F.lit("  ["), F.coalesce(s.getField("severity"), F.lit("?")), F.lit("] "), display_name(s)
        ),
    )
    card = F.concat(
        F.array(
            F.concat(F.lit("Employee      : "), "employee"),
            F.format_string("Score         : %d/10", "score"),
            F.concat(F.lit("Classification: "), "classification"),
            F.concat(F.lit("Rationale     : "), F.coalesce("rationale", F.lit(""))),
            F.lit("Signals:"),
        ),
        marks,
        F.array(F.lit("Manager Briefing:")),
        F.split(shown_briefing(F.col("briefing")), "\n"),
        F.array(F.lit(_RULE)),
    )
    # Both sections of an employee from one row, so the newest rows are found once.
    parts = F.array(
        F.struct(F.lit(1).alias("section"), team.alias("lines")),
        F.when(
            is_flagged(F.col("classification")),
            F.struct(F.lit(2).alias("section"), card.alias("lines")),
        ),
    )
    own = latest.select("employee", F.explode(F.array_compact(parts)).alias("part")).select(
        "part.section", "employee", "part.lines"
    )
    stored = state.groupBy("employee").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("week", "score", "classification"))),
            lambda e: F.format_string(
                "%-35s  score=%d  class=%s",
                F.concat(F.lower("employee"), F.lit("_week"), e.getField("week").cast("string")),
                e.getField("score"),
                e.getField("classification"),
            ),
        ).alias("lines")
    ).select(F.lit(3).alias("section"), "employee", "lines")
    return own.unionByName(stored).select(
        "section", "employee", F.posexplode("lines").alias("ord", "line")
    )
