"""Risk classes, base scores and the week-by-week score fold."""

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import constants as C
from tidemark.functions.model_text import strip_fences, whole_number, with_json_object
from tidemark.operators.cases import case_rationale


def classify(score: Column) -> Column:
    label = F.lit(C.HEALTHY)
    for cut, name in reversed(C.CLASS_CUTS):
        label = F.when(score >= cut, F.lit(name)).otherwise(label)
    return label


def badge(classification: Column, unknown: str = "[?]") -> Column:
    label = F.lit(unknown)
    for name, text in C.BADGES:
        label = F.when(classification == name, F.lit(text)).otherwise(label)
    return label


def is_flagged(classification: Column) -> Column:
    """Watch or above, in any letter case."""
    return F.upper(classification).isin(*C.ELEVATED_CLASSES)


def with_risk_answer(rows: DataFrame, text: str = "text", out: str = "answer") -> DataFrame:
    """Adds struct(score, classification, rationale) of a model's risk answer.

    NULL for text that is no JSON object and for a score that is no number; an absent
    score counts 1.
    """
    fields = "score: STRING, classification: STRING, rationale: STRING"
    parsed = with_json_object(rows, strip_fences(F.col(text)), fields, "_doc")
    written = F.col("_doc.score")
    parsed = parsed.withColumn(
        "_score",
        F.when(written.isNull(), F.lit(C.STATUS_SCORE)).otherwise(whole_number(written)),
    )
    answer = F.struct(
        F.col("_score").alias("score"),
        F.coalesce("_doc.classification", F.lit("")).alias("classification"),
        F.coalesce("_doc.rationale", F.lit("")).alias("rationale"),
    )
    valid = F.col("_doc").isNotNull() & F.col("_score").isNotNull()
    return parsed.withColumn(out, F.when(valid, answer)).drop("_doc", "_score")


def base_scores(rows: DataFrame, answer: str = "risk_text", prefix: str = "case_") -> DataFrame:
    """Adds origin, base_score, base_class and base_rationale.

    A valid model answer wins, else the nearest case, else the fixed default.
    """
    parsed = with_risk_answer(rows, answer, "_a")
    ok = F.col("_a").isNotNull()
    has_case = F.col(f"{prefix}similarity").isNotNull()

    def pick(model: Column, case: Column, default) -> Column:
        return F.when(ok, model).when(has_case, case).otherwise(F.lit(default))

    return parsed.withColumns(
        {
            "origin": pick(F.lit("model"), F.lit("case"), "default"),
            "base_score": pick(
                F.col("_a.score"),
                F.coalesce(F.col(f"{prefix}score"), F.lit(C.DEFAULT_SCORE)),
                C.DEFAULT_SCORE,
            ).cast("int"),
            "base_class": pick(
                F.col("_a.classification"),
                F.coalesce(F.col(f"{prefix}classification"), F.lit(C.DEFAULT_CLASS)),
                C.DEFAULT_CLASS,
            ),
            "base_rationale": pick(
                F.col("_a.rationale"),
                case_rationale(F.col(f"{prefix}similarity"), F.col(f"{prefix}rationale")),
                C.DEFAULT_RATIONALE,
            ),
        }
    ).drop("_a")


def default_scores(rows: DataFrame) -> DataFrame:
    """Rows whose scoring failed: fixed score, class and a text naming the week."""
    return rows.withColumns(
        {
            "score": F.coalesce("score", F.lit(C.DEFAULT_SCORE)),
            "classification": F.coalesce("classification", F.lit(C.DEFAULT_CLASS)),
            "rationale": F.coalesce(
                "rationale", F.format_string(C.ROW_ERROR_FORMAT, F.col("week"))
            ),
            "healthy_streak": F.coalesce("healthy_streak", F.lit(0)),
        }
    )


_OUT = (
    "STRUCT<week: INT, score: INT, classification: STRING, rationale: STRING, "
    "healthy_streak: INT, bonus: BOOLEAN, label_conflict: BOOLEAN, prior_elevated: INT, "
    "prior_streak: INT>"
)


def fold_scores(
    rows: DataFrame,
    streak_mode: str = "stored",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Applies recurrence and recovery week by week.

    ``rows``: employee, week, origin, base_score, base_class, base_rationale and,
    for weeks already evaluated, ``stored`` (true), ``stored_streak`` and
    ``in_history`` (inside the history window).  Returns one row per (employee, week)
    with the final score, class, rationale, healthy_streak, whether the bonus applied,
    and the history seen (prior_elevated, prior_streak).

    Week w depends on the classes of earlier weeks, which contain earlier bonuses: a
    true recurrence.  An employee has at most one row per week, so the array is bounded.
    It is folded in blocks of ``FOLD_BLOCK`` weeks: only the state (elevated weeks, streak,
    run) goes from one to the next, and a week is appended to its block's rows, not to
    all before it, so time grows with the weeks and not with their square.  Streaks count
    up to ``MAX_STREAK``.
    ``streak_mode="true_count"`` counts healthy weeks once instead of adding the walk
    to the stored streak.
    """
    columns = set(rows.columns)
    stored = F.col("stored") if "stored" in columns else F.lit(False)
    in_history = F.col("in_history") if "in_history" in columns else F.lit(True)
    stored_streak = F.col("stored_streak") if "stored_streak" in columns else F.lit(0)
    step = F.struct(
        F.col("week"),
        stored.alias("stored"),
        F.coalesce(in_history, F.lit(True)).alias("in_history"),
        F.coalesce(stored_streak, F.lit(0)).cast("int").alias("stored_streak"),
        "origin",
        "base_score",
        "base_class",
        "base_rationale",
        *carry,
    )
    per_employee = rows.groupBy("employee").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    folded = F.aggregate(
        _blocks(F.col("steps")),
        _state(f"ARRAY<ARRAY<{_OUT}>>", *[F.lit(0)] * 3),
        lambda acc, block: _advance_block(acc, block, streak_mode),
        lambda acc: F.flatten(acc.getField("out")),
    )
    zipped = per_employee.select(
        "employee", F.inline(F.arrays_zip(folded.alias("r"), F.col("steps").alias("x")))
    )
    names = ("score", "classification", "rationale", "healthy_streak", "bonus",
             "label_conflict", "prior_elevated", "prior_streak")
    return zipped.select(
        "employee",
        "r.week",
        *[F.col(f"r.{n}").alias(n) for n in names],
        F.col("x.origin").alias("origin"),
        F.col("x.base_score").alias("base_score"),
        F.col("x.base_class").alias("base_class"),
        F.col("x.stored").alias("stored"),
        *[F.col(f"x.{c}").alias(c) for c in carry],
    )


FOLD_BLOCK = 64
MAX_STREAK = 1_000_000_000
_STATE = ("elevated", "streak", "run")


def _blocks(steps: Column) -> Column:
    """An array cut into arrays of ``FOLD_BLOCK`` entries."""
    last = F.floor((F.size(steps) - 1) / FOLD_BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(steps, i * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)))


def _state(out: str, *values: Column) -> Column:
    """State of the fold with no rows yet."""
    named = [v.cast("int").alias(n) for n, v in zip(_STATE, values)]
    return F.struct(F.array().cast(out).alias("out"), *named)


def _advance_block(acc: Column, block: Column, streak_mode: str) -> Column:
    """One block of the fold."""
    start = _state(f"ARRAY<{_OUT}>", *[acc.getField(n) for n in _STATE])
    folded = F.aggregate(block, start, lambda inner, x: _advance(inner, x, streak_mode))
    # Through an array of one, so that the block is folded once for all its fields.
    return F.transform(
        F.array(folded),
        lambda end: F.struct(
            F.array_append(acc.getField("out"), end.getField("out")).cast(f"ARRAY<ARRAY<{_OUT}>>").alias("out"),
            *[end.getField(n).alias(n) for n in _STATE],
        ),
    )[0]


def _advance(acc: Column, x: Column, streak_mode: str) -> Column:
    """One week of the fold."""
    elevated, streak, run = (acc.getField(n) for n in ("elevated", "streak", "run"))
    is_new_answer = ~x.getField("stored") & (x.getField("origin") == "model")
    bonus = (
        is_new_answer
        & (streak < C.HEALTHY_WEEKS_TO_CLEAR)
        & (elevated >= C.ELEVATED_WEEKS_FOR_BONUS)
    )
    raised = F.least(x.getField("base_score") + 1, F.lit(C.MAX_SCORE))
    score = F.when(bonus, raised).otherwise(x.getField("base_score"))
    label = F.when(bonus, classify(raised)).otherwise(x.getField("base_class"))
    upper = F.upper(F.trim(label))
    healthy = upper == "HEALTHY"
    new_streak = (
        F.when(x.getField("stored"), x.getField("stored_streak"))
        .when(is_new_answer & healthy, streak + 1)
        .otherwise(F.lit(0))
    )
    note = F.format_string(C.RECURRENCE_NOTE_FORMAT, x.getField("base_score"), raised)
    row = F.struct(
        x.getField("week").alias("week"),
        score.alias("score"),
        label.alias("classification"),
        F.when(bonus, F.concat(x.getField("base_rationale"), note))
        .otherwise(x.getField("base_rationale"))
        .alias("rationale"),
        new_streak.alias("healthy_streak"),
        bonus.alias("bonus"),
        (label != classify(score)).alias("label_conflict"),
        elevated.alias("prior_elevated"),
        streak.alias("prior_streak"),
    ).cast(_OUT)
    if streak_mode == "true_count":
        grown = run + 1
    else:
        # Walking back over stored streaks, each record adds one to what came before.
        grown = F.greatest(streak, new_streak + run, run + 1)
    seen = x.getField("in_history")
    return F.struct(
        F.array_append(acc.getField("out"), row).cast(f"ARRAY<{_OUT}>").alias("out"),
        (elevated + F.when(seen & upper.isin(*C.ELEVATED_CLASSES), 1).otherwise(0)).alias("elevated"),
        F.when(~seen, streak).when(healthy, F.least(grown, F.lit(MAX_STREAK))).otherwise(F.lit(0)).alias("streak"),
        F.when(~seen, run).when(healthy, run + 1).otherwise(F.lit(0)).alias("run"),
    )
