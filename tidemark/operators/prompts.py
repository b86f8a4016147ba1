"""Prompt texts from rows.  Calling a model is left to the user."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import constants as C
from tidemark.functions.names import pseudonym
from tidemark.functions.sets import display_name

def history_summary(state: DataFrame) -> DataFrame:
    """JSON list of earlier evaluations as of each stored week (week excluded).

    One window over an employee's bounded number of weeks.
    """
    before = W.partitionBy("scope", "employee").orderBy("week").rowsBetween(
        W.unboundedPreceding, -1
    )
    record = F.struct(
        F.concat(F.lower("employee"), F.lit("_week"), F.col("week").cast("string"), F.lit(".json")).alias(
            "week_file"
        ),
        "score",
        "classification",
    )
    past = F.collect_list(record).over(before)
    return state.select(
        "scope",
        "employee",
        "week",
        F.size(past).alias("weeks"),
        F.to_json(past).alias("history"),
    )


def trend_prompts(rows: DataFrame) -> DataFrame:
    """Prompt per (employee, week) with confirmed signals."""
    return _one(rows, "trend", "trends", _trend_text())


def risk_prompts(rows: DataFrame, history: DataFrame, weeks: int = C.HISTORY_DAYS // 7) -> DataFrame:
    """Prompt per (employee, week): signals plus the history of earlier weeks."""
    return _one(_with_history(rows, history), "risk", "risk", _risk_text(weeks))


def detection_prompts(rows: DataFrame, history: DataFrame, weeks: int = C.HISTORY_DAYS // 7) -> DataFrame:
    """Trend and risk prompts out of one pass over the detected signals."""
    both = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), pseudonym(F.col("employee"), step).alias("session_id"), text.alias("prompt"))
            for kind, step, text in (("trend", "trends", _trend_text()), ("risk", "risk", _risk_text(weeks)))
        ]
    )
    return (
        _with_history(rows, history)
        .select("employee", "week", F.explode(both).alias("p"))
        .select("p.kind", "employee", "week", "p.session_id", "p.prompt")
        .filter(F.col("prompt").isNotNull())
    )


def _one(rows: DataFrame, kind: str, step: str, text: Column) -> DataFrame:
    return rows.select(
        F.lit(kind).alias("kind"), "employee", "week",
        pseudonym(F.col("employee"), step).alias("session_id"), text.alias("prompt"),
    ).filter(F.col("prompt").isNotNull())


def _with_history(rows: DataFrame, history: DataFrame) -> DataFrame:
    return rows.join(
        history.select("employee", "week", F.col("weeks").alias("_n"), F.col("history").alias("_h")),
        ["employee", "week"],
        "left",
    )


def _trend_text() -> Column:
    """NULL without confirmed signals."""
    own = F.filter("signals", lambda s: s.getField("kind") == "signal")
    text = F.concat(
        F.lit("First name: "), "employee",
        F.lit("\nSignals seen in two or more adjacent weeks:\n"),
        F.to_json(own),
        F.lit("\nAdd a short, supportive text as 'details' to each; answer with the JSON array."),
    )
    return F.when(F.size(own) > 0, text)


def _risk_text(weeks: int) -> Column:
    return F.concat(
        F.lit("First name: "), "employee",
        F.format_string("\nWeek: %d\nSignals:\n", "week"),
        F.to_json("signals"),
        F.when(
            F.coalesce("_n", F.lit(0)) > 0,
            F.concat(
                F.format_string(
                    f"\nEarlier weeks (%d, at most {weeks} weeks old):\n", "_n"
                ),
                "_h",
                F.lit("\n"),
            ),
        ).otherwise(F.lit("\nEarlier weeks: none\n")),
        F.lit("\nAnswer with a JSON object: score, classification, rationale."),
    )


def briefing_prompts(flagged: DataFrame) -> DataFrame:
    """Prompt per flagged evaluation."""
    lines = F.array_join(F.transform("signals", _signal_line), "\n")
    text = F.concat(
        F.lit("Write a manager briefing. First name: "), "employee",
        F.lit("\nClass: "), "classification",
        F.format_string(", score %d of 10\nReason: ", "score"),
        F.coalesce("rationale", F.lit("")),
        F.lit("\nSignals:\n"), lines,
    )
    return flagged.select(
        F.lit("briefing").alias("kind"), "employee", "week",
        pseudonym(F.col("employee"), "briefing").alias("session_id"), text.alias("prompt"),
    )


def _signal_line(s: Column) -> Column:
    return F.concat(
        F.lit("- "), display_name(s),
        F.lit(" ("), F.coalesce(s.getField("severity"), F.lit("?")), F.lit("): "),
        F.coalesce(s.getField("details"), F.lit("")),
    )


def enrich(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Prompts with the text a model gave, where there is one."""
    keys = ["kind", "employee", "week"]
    return prompts.join(responses.select(*keys, "text"), keys, "left")
