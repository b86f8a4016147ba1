"""Manager briefings: who gets one, which text, and the section checks."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import constants as C
from tidemark.functions.screening import safe_text, with_blocked_by
from tidemark.operators.cases import case_briefing
from tidemark.operators.risk import is_flagged


def choose_briefing(
    rows: DataFrame,
    text: str = "briefing_text",
    prefix: str = "past_",
    patterns: Sequence[str] = C.DENY_PATTERNS,
) -> DataFrame:
    """Adds ``briefing``: the screened model text, else the screened text of the nearest
    case, else the safe text.  Healthy rows get NULL."""
    from_case = F.when(
        F.col(f"{prefix}similarity").isNotNull(),
        case_briefing(F.col(f"{prefix}similarity"), F.col(f"{prefix}briefing")),
    )
    candidate = F.coalesce(F.col(text), from_case, F.lit(C.SAFE_BRIEFING))
    chosen = rows.withColumn(
        "_candidate", F.when(is_flagged(F.col("classification")), candidate)
    )
    scanned = with_blocked_by(chosen, "_candidate", "_blocked", patterns)
    return scanned.withColumn(
        "briefing", safe_text(F.col("_candidate"), F.col("_blocked"))
    ).drop("_candidate", "_blocked")


def shown_briefing(briefing: Column) -> Column:
    """Text to show when there is no briefing."""
    return F.coalesce(F.nullif(briefing, F.lit("")), F.lit(C.NO_BRIEFING_TEXT))


def section_checks(text: Column) -> dict[str, Column]:
    """One boolean per expected section, by phrase, in any letter case."""
    lowered = F.lower(text)
    checks = {}
    for name, phrases in C.BRIEFING_SECTIONS:
        found = lowered.contains(phrases[0])
        for phrase in phrases[1:]:
            found = found | lowered.contains(phrase)
        checks[name] = found
    return checks


def needs_repair(state: DataFrame) -> DataFrame:
    """Stored evaluations that are not Healthy and have no briefing."""
    return state.filter(
        (F.upper(F.coalesce("classification", F.lit(""))) != "HEALTHY")
        & (F.coalesce("briefing", F.lit("")) == "")
    )
