"""Every registered query: name, inventory rows it covers, and its DataFrame."""

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark import constants as C
from tidemark.functions import cleaning, model_text, names, observation, screening, sets
from tidemark.operators import (
    briefing,
    cases,
    completions as comp,
    grading,
    prompts,
    readmodels,
    risk,
    signals as sig,
    timeline as tl,
)
from tidemark.plans import driver_tables as d, weekly_run as run
from tidemark.schemas import EVALUATION_JSON
from tidemark.session import drop_dir, scratch_dir
from tidemark.sources import evalset, evaluations as ev, reports, telemetry, weekly
from tidemark.streaming import realtime

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def register(*rows: str):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        COVERS[fn.__name__] = rows
        return fn

    return add


def _weeks(column: str = "weeks_detected") -> Column:
    """Week arrays as text, so that any engine compares them alike."""
    return F.array_join(column, ",").alias("weeks")


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("response_time", F.round("response_time", 6))


def _signal_names(column: str = "signals") -> Column:
    return F.array_join(sets.signal_names(F.col(column)), "|")


# --- employee weeks and timelines -----------------------------------------------


@register("X7")
def employee_week_metrics(spark, sf_dir):
    return _rounded(d.employee_weeks(spark, sf_dir))


@register("A1")
def last_week(spark, sf_dir):
    return d.events_by_week(spark, sf_dir).agg(F.max("week").alias("max_week"))


@register("W6", "O1")
def first_record_per_week(spark, sf_dir):
    events = d.events_by_week(spark, sf_dir).select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("employee"),
        "week",
        "event_id",
        "event_type",
        "value",
    )
    return tl.keep_first(events, F.col("event_id"))


@register("J1", "U1", "A2", "O2")
def dense_timeline(spark, sf_dir):
    return d.timeline(spark, sf_dir).select(
        "employee", "week", "data_missing", "completed_tasks", "sick_days", "weekly_hours", "sentiment"
    )


@register("J2", "P13")
def own_baseline(spark, sf_dir):
    return d.timeline(spark, sf_dir).select(
        "employee", "week", "has_baseline", "base_tasks", "base_sick",
        F.round("base_response", 6).alias("base_response"),
    )


@register("U1", "A8")
def weeks_without_data(spark, sf_dir):
    rows = tl.with_missing_weeks(d.timeline(spark, sf_dir))
    return rows.select("employee", "week", F.array_join("missing_weeks", ",").alias("missing"))


@register("U1", "J3")
def missing_week_rows(spark, sf_dir):
    return tl.missing_weeks(d.employee_weeks(spark, sf_dir, True), d.max_week(spark, sf_dir))


# --- flags, runs, signals -------------------------------------------------------


@register("P1", "P2", "P3", "P4", "P5", "P6", "P7", "F1", "X6", "X7")
def weekly_flag_columns(spark, sf_dir):
    flagged = sig.weekly_flags(d.timeline(spark, sf_dir))
    return flagged.select("employee", "week", *[c for c in flagged.columns if c.startswith("flag_")])


@register("P8")
def weekly_flags_long(spark, sf_dir):
    return sig.flags_long(d.timeline(spark, sf_dir))


@register("W1", "A7")
def flags_in_runs(spark, sf_dir):
    return sig.confirmed_weeks(d.timeline(spark, sf_dir, with_gaps=False))


@register("J4", "F2", "A7")
def confirmed_as_of_week(spark, sf_dir):
    timeline = d.timeline(spark, sf_dir, with_gaps=False)
    rows = sig.confirmed_as_of_join(timeline, sig.confirmed_weeks(timeline))
    return rows.select("employee", "as_of_week", "signal_name", _weeks())


@register("P9", "A3", "A4", "A5", "A6", "A7", "A11", "J4", "F2")
def signals_as_of_week(spark, sf_dir):
    found = sig.explode_signals(sig.signals_as_of(d.timeline(spark, sf_dir, with_gaps=False)))
    return found.filter("kind = 'signal'").select(
        "employee", "week", "signal_name", _weeks(), "severity"
    )


@register("P9", "P13", "P14", "A8", "A11", "F1")
def signals_with_gaps(spark, sf_dir):
    found = sig.explode_signals(sig.signals_as_of(d.timeline(spark, sf_dir)))
    return found.select(
        "employee", "week", "kind", "signal_name",
        F.coalesce(_weeks(), F.lit("")).alias("weeks"), "severity",
        F.coalesce("details", F.lit("")).alias("details"),
    )


# --- scores ---------------------------------------------------------------------


@register("P10", "P17")
def score_classes(spark, sf_dir):
    rows = d.employee_weeks(spark, sf_dir)
    score = d.spread_score(F.col("employee"), F.col("week"))
    label = risk.classify(score)
    return rows.select(
        "employee", "week", score.alias("score"), label.alias("classification"), risk.badge(label).alias("badge")
    )


@register("X12", "X13", "X14")
def parsed_risk_answers(spark, sf_dir):
    answers = d.risk_answers(spark, sf_dir)
    block = model_text.json_block(F.col("text"))
    both = F.explode(F.create_map(F.lit("fenced"), "text", F.lit("block"), block))
    texts = answers.select("employee", "week", both.alias("source", "text"))
    return risk.with_risk_answer(texts).select(
        "employee", "week", "source", F.col("answer").isNotNull().alias("ok"), "answer.*"
    )


def _base_rows(spark, sf_dir):
    """Base scores for the fold: every sixth row is a default and gets no bonus."""
    rows = d.employee_weeks(spark, sf_dir, with_gaps=True)
    score = d.spread_score(F.col("employee"), F.col("week"))
    default = (d.user_number(F.col("employee")) + F.col("week")) % 6 == 0
    base = F.when(default, F.lit(C.DEFAULT_SCORE)).otherwise(F.when(score > 6, score - 6).otherwise(score))
    return rows.select(
        "employee", "week",
        F.when(default, "default").otherwise("model").alias("origin"),
        base.cast("int").alias("base_score"),
        risk.classify(base).alias("base_class"),
        F.concat(F.lit("r"), F.col("week").cast("string")).alias("base_rationale"),
    )


_FOLD_COLUMNS = (
    "employee", "week", "score", "classification", "rationale", "healthy_streak", "bonus",
    "label_conflict", "prior_elevated", "prior_streak",
)


@register("W2", "W3", "P11", "P12", "A10")
def score_recurrence(spark, sf_dir):
    return risk.fold_scores(_base_rows(spark, sf_dir)).select(*_FOLD_COLUMNS)


@register("W2", "W3")
def score_recurrence_true_count(spark, sf_dir):
    folded = risk.fold_scores(_base_rows(spark, sf_dir), streak_mode="true_count")
    return folded.select(*_FOLD_COLUMNS)


@register("P22")
def default_scores(spark, sf_dir):
    answers = risk.with_risk_answer(d.risk_answers(spark, sf_dir)).select("employee", "week", "answer.*")
    healthy = F.col("classification") == "Healthy"
    rows = answers.withColumn("healthy_streak", F.when(healthy, 1).when(~healthy, 0))
    return risk.default_scores(rows)


@register("J6", "O5", "U3", "G3", "X10", "X11", "X21", "F7")
def nearest_case(spark, sf_dir):
    state = d.stored_evaluations(spark, sf_dir).withColumn("names", sets.signal_names(F.col("signals")))
    queries = (
        sig.signals_as_of(d.timeline(spark, sf_dir))
        .withColumn("names", sets.signal_names(F.col("signals")))
        .select("employee", "week", "names")
    )
    found = cases.nearest_cases(queries, state, [cases.case_search("employee", "week")])
    return found.select(
        "employee", "week",
        F.array_join("names", "|").alias("names"),
        sets.percent(F.col("case_similarity")).alias("percent"),
        F.col("case_employee"), F.col("case_week"), F.col("case_score"), F.col("case_classification"),
        F.when(
            F.col("case_similarity").isNotNull(),
            cases.case_rationale(F.col("case_similarity"), F.col("case_rationale")),
        ).alias("rationale"),
    )


@register("J6", "F7", "X21")
def nearest_briefing(spark, sf_dir):
    state = d.stored_evaluations(spark, sf_dir).withColumn("names", sets.signal_names(F.col("signals")))
    queries = state.select("employee", "week", "classification", F.array_intersect(
        "names", F.array(*[F.lit(n) for n in C.SIGNAL_VOCABULARY])).alias("names"))
    found = cases.nearest_cases(queries, state, [cases.briefing_search()])
    chosen = briefing.choose_briefing(found.withColumn("briefing_text", F.lit(None).cast("string")))
    return chosen.select("employee", "week", "briefing")


@register("J6", "O5", "X10", "X11")
def nearest_document(spark, sf_dir):
    """New documents (ids divisible by 100) against all others, as sets of words: no fixed vocabulary."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")
    rows = d.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("employee"), F.col("doc_id").alias("week"), "n_chars", F.filter(words, lambda w: w != "").alias("names"))
    new = F.col("doc_id") % 100 == 0
    question = [cases.Search("near_", F.lit(True), ("week", "employee", "n_chars"))]
    found = cases.nearest_cases(rows.where(new), rows.where(~new), question, vocabulary=None)
    return found.select(
        "doc_id",
        sets.percent(F.col("near_similarity")).alias("percent"),
        F.col("near_week").alias("near_id"),
        F.col("near_employee").alias("near_source"),
        F.col("near_n_chars").alias("near_chars"),
    )


@register("X10", "U3")
def set_similarity(spark, sf_dir):
    state = d.stored_evaluations(spark, sf_dir).withColumn("names", sets.signal_names(F.col("signals")))
    week = W.partitionBy("employee").orderBy("week")
    rows = state.withColumn("before", F.lag("names").over(week)).filter(F.col("before").isNotNull())
    return rows.select("employee", "week", F.round(sets.jaccard(F.col("names"), F.col("before")), 6).alias("similarity"))


# --- text -----------------------------------------------------------------------

# Stands in for the deny-list on the corpus: words and a two-word span that occur there.
CORPUS_PATTERNS = (r"\bthe thing\b", r"\bund\b.*\bder\b", r"^Re\b", r"\bdes\b|\bles\b")
CORPUS_WORDS = {CORPUS_PATTERNS[0]: "the thing", CORPUS_PATTERNS[1]: "und", CORPUS_PATTERNS[2]: "re"}


@register("X18")
def blocked_documents(spark, sf_dir):
    texts = d.table(spark, sf_dir, "documents")
    scanned = screening.with_blocked_by(texts, patterns=CORPUS_PATTERNS, words=CORPUS_WORDS)
    return scanned.select("doc_id", "blocked_by")


_PHRASES = (
    "a Performance Improvement Plan", "DISCIPLINARY action", "we monitored all activity",
    "under surveillance", "termination of employment", "no consequences", "a warning letter",
    "\nError: quota", "\nException: timeout", "Traceback (most recent call last)",
    "google.api_core.exceptions.Aborted", "supportive words", "monitored\nactivity", "multierror: x",
)


@register("X18", "X21")
def screened_texts(spark, sf_dir):
    """Every document with one phrase appended; all but three phrases are blocked."""
    phrase = F.element_at(
        F.array(*[F.lit(p) for p in _PHRASES]), (F.col("doc_id") % len(_PHRASES) + 1).cast("int")
    )
    texts = d.table(spark, sf_dir, "documents").withColumn("full", F.concat("text", F.lit("\n"), phrase))
    scanned = screening.with_blocked_by(texts, "full")
    shown = screening.safe_text(F.col("full"), F.col("blocked_by"))
    return scanned.select("doc_id", "blocked_by", F.md5(shown.cast("binary")).alias("text_md5"))


@register("X18")
def screened_conversations(spark, sf_dir):
    turns = d.table(spark, sf_dir, "conversations")
    scanned = screening.with_blocked_by(turns, patterns=CORPUS_PATTERNS, words=CORPUS_WORDS)
    return scanned.select("conv_id", "turn", "blocked_by")


@register("P18")
def briefing_sections(spark, sf_dir):
    rows = d.stored_evaluations(spark, sf_dir).select(
        "employee", "week",
        F.concat(
            F.coalesce("briefing", F.lit("Stay in touch.")),
            F.when(F.col("week") % 2 == 0, F.lit("\n2 Things NEVER to say: none")).otherwise(F.lit("")),
            F.when(F.col("score") > 7, F.lit("\nUse the next 1-on-1.")).otherwise(F.lit("")),
        ).alias("briefing"),
    )
    return readmodels.briefing_checks(rows).drop("briefing")


@register("P15", "F5")
def shown_briefings(spark, sf_dir):
    state = d.stored_evaluations(spark, sf_dir)
    return state.select(
        "employee", "week", risk.is_flagged(F.col("classification")).alias("flagged"),
        briefing.shown_briefing(F.col("briefing")).alias("briefing"),
    )


@register("X8", "X9")
def pseudonyms(spark, sf_dir):
    customers = d.table(spark, sf_dir, "customer")
    return customers.select(
        "c_custkey",
        names.pseudonym(F.col("c_name"), "risk").alias("session_id"),
        names.slug(F.col("c_name")).alias("slug"),
    )


@register("X2", "X5", "X6")
def cleaned_names(spark, sf_dir):
    parts = d.table(spark, sf_dir, "part")
    shape = F.when(F.col("p_partkey") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" \t"), "p_type", F.lit(" ")))
    return parts.select(
        "p_partkey",
        cleaning.first_token(shape).alias("first_token"),
        cleaning.capitalise(F.col("p_type")).alias("capitalised"),
    )


@register("X3", "X4")
def parsed_numbers(spark, sf_dir):
    events = d.table(spark, sf_dir, "events")
    whole = F.floor("value").cast("long").cast("string")
    cell = (
        F.when(F.col("event_id") % 8 == 0, F.concat(F.lit(" "), whole, F.lit(" ")))
        .when(F.col("event_id") % 8 == 1, F.concat(whole, F.lit(".0")))
        .when(F.col("event_id") % 8 == 2, F.concat(F.lit("-1"), whole))
        .when(F.col("event_id") % 8 == 3, F.concat(whole, F.lit("d")))
        .when(F.col("event_id") % 8 == 4, F.lit("n/a"))
        .when(F.col("event_id") % 8 == 5, F.lit(""))
        .when(F.col("event_id") % 8 == 6, F.concat(whole, F.lit("e1")))
        .otherwise(F.concat(F.lit("+"), whole))
    )
    return events.select(
        "event_id", cell.alias("cell"),
        cleaning.safe_int(cell, 0).alias("whole_or_zero"),
        cleaning.safe_int(cell).alias("whole"),
        cleaning.safe_double(cell, 0.0).alias("number"),
    )


@register("X16", "S10")
def observed_metrics(spark, sf_dir):
    rows = d.observations(spark, sf_dir).withColumn("m", observation.metrics_from_text(F.col("text")))
    return rows.select("employee", "week", "m.*")


@register("X15", "X14")
def extracted_metrics(spark, sf_dir):
    rows = d.employee_weeks(spark, sf_dir)
    doc = F.to_json(
        F.struct(
            F.col("employee").alias("employee_name"),
            F.col("completed_tasks").alias("tasks_completed"),
            F.col("sick_days").cast("string").alias("sick_days"),
            F.when(F.col("week") > 2, F.col("weekly_hours")).alias("weekly_hours"),
            F.when(F.col("week") > 3, F.lower("sentiment")).alias("sentiment"),
        )
    )
    answer = F.concat(F.lit("Sure: "), doc, F.lit(" - anything else?"))
    texts = rows.select("employee", "week", answer.alias("text"))
    return observation.with_metrics_from_answer(texts).select("employee", "week", "metrics.*")


@register("X1")
def resolved_headers(spark, sf_dir):
    """Employee weeks under other column names, found again by their spelling."""
    rows = d.employee_weeks(spark, sf_dir).select(
        F.col("employee").alias("User Name"),
        F.col("completed_tasks").alias("Completed-Tasks"),
        F.col("response_time").alias("avg_response_time_hours"),
        F.col("after_hours_logins").alias("count of after-hours"),
        F.col("sick_days").alias("days absent"),
        F.col("task_accuracy").alias("QUALITY SCORE"),
        F.col("sentiment").alias("team_morale"),
        "week",
    )
    found = weekly.alias_table(rows, F.col("week"))
    return _rounded(found.drop("source_file"))


# --- files ----------------------------------------------------------------------


def _metric_rows(spark, sf_dir):
    rows = d.employee_weeks(spark, sf_dir, with_gaps=True)
    return rows.select(
        F.col("employee").alias("employee_name"),
        F.col("completed_tasks").alias("tasks_completed"),
        F.col("response_time").alias("avg_response_time_hours"),
        "after_hours_logins", "sick_days", "weekly_hours", "task_accuracy", "sentiment", "week",
    )


@register("S1", "S3", "S10", "U4", "X1", "W6")
def weekly_files(spark, sf_dir):
    """Two files per week with different headers, read back in one scan, first row kept."""
    folder = scratch_dir(spark, "weekly")
    rows = _metric_rows(spark, sf_dir)
    even = d.user_number(F.col("employee_name")) % 2 == 0
    weekly.append_rows(rows.filter(even), folder)
    other = rows.filter(~even).select(
        F.col("sick_days").alias("Sick Leaves"),
        F.concat("employee_name", F.lit(" Smith")).alias("First Name"),
        F.col("tasks_completed").alias("task_count"),
        F.col("avg_response_time_hours").alias("Latency"),
        F.col("weekly_hours").alias("hours_worked"),
        F.col("sentiment").alias("tone"),
        "week",
    )
    weekly.append_rows(other, folder)
    scanned = weekly.scan_employee_weeks(spark, folder)
    return _rounded(tl.keep_first(scanned, F.col(weekly.ROW_ORDER)).drop(weekly.ROW_ORDER))


@register("S1", "U4", "X1", "X2")
def weekly_files_quoted(spark, sf_dir):
    """Files whose cells and headers hold line ends, commas and quotes, read block by block."""
    folder = scratch_dir(spark, "quoted")
    rows = _metric_rows(spark, sf_dir).select(
        F.concat(F.lit('see "notes",\n'), F.repeat(F.concat("employee_name", F.lit("\n")), 3)).alias("what,\nwhy"),
        F.concat("employee_name", F.lit('\nof "team", '), F.col("week").cast("string")).alias("name"),
        F.col("tasks_completed").alias("tasks"), "weekly_hours", "sentiment", "week",
    )
    weekly.append_rows(rows, folder)
    scanned = weekly.scan_employee_weeks(spark, folder)
    first = tl.keep_first(scanned, F.col(weekly.ROW_ORDER))
    return first.select("employee", "week", "completed_tasks", "weekly_hours", "sentiment", "source_file")


@register("S2", "S3")
def weekly_files_strict(spark, sf_dir):
    folder = scratch_dir(spark, "strict")
    rows = _metric_rows(spark, sf_dir).withColumn("completed_tasks", F.col("tasks_completed") + 1)
    empty = F.col("week") == 2
    rows = rows.withColumn("tasks_completed", F.when(~empty, F.col("tasks_completed")))
    weekly.append_rows(rows, folder)
    return _rounded(weekly.scan_employee_weeks(spark, folder, strict=True).drop(weekly.ROW_ORDER))


def _pasted(spark, sf_dir):
    return d.table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 3).alias("week"),
        F.lit(1).alias("seq"),
        F.concat(
            F.lit("\nname,tasks\n"), "r_name", F.lit(" x,"),
            (F.col("r_regionkey") + 5).cast("string"), F.lit("\n\n"),
        ).alias("csv_content"),
    )


@register("S12")
def weekly_files_of_one_week(spark, sf_dir):
    """A folder read as one given week, whatever its file names say."""
    folder = scratch_dir(spark, "target")
    weekly.append_rows(_metric_rows(spark, sf_dir), folder)
    rows = weekly.scan_employee_weeks(spark, folder, target_week=9)
    return rows.groupBy("employee", "week").agg(
        F.count(F.lit(1)).alias("n"), F.sum("completed_tasks").alias("tasks")
    )


@register("S9", "S3")
def pasted_weeks(spark, sf_dir):
    """CSV texts pasted for a week replace what the week held before."""
    folder = scratch_dir(spark, "pasted")
    weekly.append_rows(_metric_rows(spark, sf_dir), folder)
    weekly.land_csv_text(_pasted(spark, sf_dir), folder)
    rows = weekly.scan_employee_weeks(spark, folder)
    return rows.groupBy("week").agg(
        F.count(F.lit(1)).alias("employees"),
        F.sum("completed_tasks").alias("tasks"),
        F.min("employee").alias("first_name"),
    )


@register("S5", "S8", "T2")
def state_upsert(spark, sf_dir):
    """State after storing an update over earlier weeks, in two scopes."""
    path = scratch_dir(spark, "state")
    state = d.stored_evaluations(spark, sf_dir)
    both = state.unionByName(state.filter("week <= 2").withColumn("scope", F.lit("realtime")))
    ev.upsert_state(spark, path, both)
    changed = (
        state.filter(F.col("week") >= 4)
        .withColumn("score", F.lit(10))
        .withColumn("classification", F.lit("Silent Exit"))
    )
    ev.upsert_state(spark, path, changed)
    return ev.read_state(spark, path).select(
        "scope", "employee", "week", "score", "classification", "healthy_streak", "origin",
        _signal_names().alias("names"),
    )


@register("S6", "S7", "F4", "G5")
def evaluation_documents(spark, sf_dir):
    """Evaluations as JSON documents with a file name; invalid ones are left out."""
    state = d.stored_evaluations(spark, sf_dir)
    user, week = d.user_number(F.col("employee")), F.col("week")
    doc = F.to_json(
        F.struct(
            "score", "classification",
            F.when(user % 10 != 3, F.col("rationale")).alias("rationale"),
            "healthy_streak",
            F.transform(
                "signals",
                lambda s: F.struct(
                    F.when(s.kind == "gap", s.signal_name).alias("signal"),
                    F.when(s.kind != "gap", s.signal_name).alias("signal_name"),
                    s.weeks_detected.alias("weeks_detected"),
                    s.severity.alias("severity"),
                ),
            ).alias("signals"),
            "briefing",
        )
    )
    text = F.when(user % 10 == 4, F.lit("NOT VALID JSON {{{{")).otherwise(doc)
    file = F.concat(
        F.lower("employee"), F.when(user % 10 == 5, F.lit("_day")).otherwise(F.lit("_week")),
        week.cast("string"), F.lit(".json"),
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    docs = state.select(
        F.from_json(text, EVALUATION_JSON, options).alias("j"),
        file.alias("file"), F.col("evaluated_at").alias("written_at"),
    ).select("j.*", "file", "written_at")
    rows = ev.parse_evaluations(docs, "main")
    shown = F.array_join(F.transform("signals", sets.display_name), "|")
    return rows.select(
        "scope", "employee", "week", "score", "classification", "rationale", "healthy_streak",
        shown.alias("shown"), _signal_names().alias("names"),
    )


@register("S19", "S20", "O4")
def report_file(spark, sf_dir):
    """Lines of the text report with their numbers, written and read back."""
    path = scratch_dir(spark, "report")
    state = d.stored_evaluations(spark, sf_dir)
    lines = readmodels.report_lines(readmodels.latest_rows(state), state)
    reports.write_report(lines, path, "end of report")
    return reports.read_report(spark, path)


# --- state and read models ------------------------------------------------------


@register("A9", "P16", "S8")
def employee_status(spark, sf_dir):
    status = readmodels.employee_status(d.stored_evaluations(spark, sf_dir))
    history = F.array_join(
        F.transform("history", lambda h: F.concat_ws(":", h.week.cast("string"), h.score.cast("string"), h.classification)),
        "|",
    )
    return status.select(
        "name", "score", "classification", "rationale", "latest_week",
        _signal_names().alias("names"), history.alias("history"),
    )


@register("O3")
def briefing_lookup(spark, sf_dir):
    state = d.stored_evaluations(spark, sf_dir)
    requests = d.table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" USER_"), F.col("c_custkey").cast("string"), F.lit(" ")).alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, "main").otherwise("realtime").alias("scope"),
    ).distinct()
    return readmodels.latest_briefing(state, requests)


@register("O4", "P17", "F6", "G5")
def team_summary(spark, sf_dir):
    return readmodels.team_summary(readmodels.latest_rows(d.stored_evaluations(spark, sf_dir)))


@register("F5", "F6", "P15", "P17", "O4")
def risk_cards(spark, sf_dir):
    cards = readmodels.risk_cards(readmodels.latest_rows(d.stored_evaluations(spark, sf_dir)))
    return cards.withColumn("signals", F.array_join("signals", "|"))


@register("A16")
def cohort_overview(spark, sf_dir):
    overview = readmodels.cohort_overview(readmodels.latest_rows(d.stored_evaluations(spark, sf_dir)))
    return overview.withColumn("avg_score", F.round("avg_score", 6))


@register("A16", "X20", "P19")
def cohort_payload(spark, sf_dir):
    rows = readmodels.cohort_payload(readmodels.latest_rows(d.stored_evaluations(spark, sf_dir)))
    field = lambda path: F.get_json_object("payload", path)
    return rows.select(
        "employee", field("$.score").alias("score"), field("$.classification").alias("classification"),
        field("$.briefing").alias("briefing"), field("$.signals[0].signal_name").alias("first_signal"),
    )


@register("O7", "S20")
def report_previews(spark, sf_dir):
    texts = d.table(spark, sf_dir, "documents")
    shown = cleaning.preview(F.col("text"))
    return texts.select("doc_id", F.length(shown).alias("n"), F.md5(shown.cast("binary")).alias("md5"))


@register("S19", "O4", "F6")
def report_rows(spark, sf_dir):
    state = d.stored_evaluations(spark, sf_dir)
    return readmodels.report_lines(readmodels.latest_rows(state), state).select(
        "section", "employee", F.col("ord").cast("int").alias("ord"), "line"
    )


@register("J3", "U1", "T2")
def evaluations_to_do(spark, sf_dir):
    expected = tl.expected_weeks(d.employee_weeks(spark, sf_dir, True), d.max_week(spark, sf_dir))
    return run.missing_evaluations(expected, d.earlier_state(spark, sf_dir), "main")


@register("J5")
def briefings_to_repair(spark, sf_dir):
    due = briefing.needs_repair(d.stored_evaluations(spark, sf_dir)).select("employee", "week", "classification")
    return run.repairs_due(d.employee_weeks(spark, sf_dir, True), due)


@register("F3")
def recent_history(spark, sf_dir):
    state = d.stored_evaluations(spark, sf_dir)
    return state.filter(run.in_window(F.col("evaluated_at"), d.AS_OF)).select("employee", "week", "score")


def _evaluated(spark, sf_dir, recompute_from=None):
    weeks = d.staged_weeks(spark, sf_dir)
    return run.evaluate(
        d.employee_weeks(spark, sf_dir, True, weeks),
        tl.max_week_of(weeks.select("week")),
        d.earlier_state(spark, sf_dir, weeks),
        d.risk_answers(spark, sf_dir, weeks),
        "main",
        d.AS_OF,
        recompute_from=recompute_from,
    )


@register("J3", "J5", "J6", "J7", "W3", "P11", "P14", "P22", "F3", "T2", "D2")
def evaluation_run(spark, sf_dir):
    """New and repaired evaluations of all employees and weeks, in one plan."""
    return _evaluated(spark, sf_dir).select(
        "employee", "week", "score", "classification", "rationale", "healthy_streak", "origin",
        F.coalesce("briefing", F.lit("")).alias("briefing"), _signal_names().alias("names"),
        F.size(F.filter("signals", lambda s: s.kind == "gap")).alias("gap_markers"),
    )


@register("J7", "D2", "P15", "X12", "X18")
def evaluation_run_all_answers(spark, sf_dir):
    """The run with a model's answers of all three kinds: details, scores and briefings, some of them blocked."""
    weeks = d.staged_weeks(spark, sf_dir)
    risks = d.risk_answers(spark, sf_dir, weeks)
    user, week = d.user_number(F.col("employee")), F.col("week").cast("string")
    notes = F.concat(
        F.lit('```json\n[{"signal_name": "Other", "details": "x"}, {"signal_name": "Burnout Risk", "details": "seen w'),
        week, F.lit('"}]\n```'))
    talk = F.concat(F.when(user % 3 == 1, "A disciplinary talk").otherwise("A talk"), F.lit(" with "), "employee", F.lit(" in w"), week)
    trends = risks.filter(user % 2 == 0).withColumns({"kind": F.lit("trend"), "text": notes})
    talks = risks.filter(user % 3 < 2).withColumns({"kind": F.lit("briefing"), "text": talk})
    rows = run.evaluate(
        d.employee_weeks(spark, sf_dir, True, weeks), tl.max_week_of(weeks.select("week")), d.earlier_state(spark, sf_dir, weeks),
        risks.unionByName(trends).unionByName(talks), "main", d.AS_OF)
    burnout = F.filter("signals", lambda s: s.signal_name == C.BURNOUT)
    return rows.select(
        "employee", "week", "score", "classification", "origin", _signal_names().alias("names"),
        F.coalesce("briefing", F.lit("")).alias("briefing"),
        F.array_join(F.transform(burnout, lambda s: F.coalesce(s.details, F.lit(""))), ",").alias("details"),
    )


@register("T3", "T2", "P14")
def late_weeks_redone(spark, sf_dir):
    """Week 3 of every third employee comes late: only they are computed again, from that week on.

    Signals of all weeks, and the scores of those left alone (the others may take scores from cases now).
    """
    weeks = d.staged_weeks(spark, sf_dir)
    records, answers = d.employee_weeks(spark, sf_dir, True, weeks), d.risk_answers(spark, sf_dir, weeks)
    late = (d.user_number(F.col("employee")) % 3 == 1) & (F.col("week") == 3)
    last = tl.max_week_of(weeks.select("week"))
    path = scratch_dir(spark, "late")
    ev.upsert_state(spark, path, run.evaluate(
        records.filter(~late), last, ev.empty_state(spark), answers, "main", d.AS_OF))
    state = ev.read_state(spark, path)
    again = run.evaluate(
        records, last, state, answers, "main", d.AS_OF + dt.timedelta(days=1),
        recompute_from=run.late_frontier(records, state, "main"))
    redone = F.col("evaluated_at") > F.lit(d.AS_OF)
    return run.merged_state(state, again).select(
        "employee", "week", redone.alias("redone"), _signal_names().alias("names"),
        *[F.when(~redone, F.col(c)).alias(c) for c in ("score", "classification", "healthy_streak", "origin")],
    )


@register("T3", "T2")
def evaluation_run_recomputed(spark, sf_dir):
    """The same run where stored weeks from week 2 on are computed again."""
    rows = _evaluated(spark, sf_dir, recompute_from=2)
    return rows.select("employee", "week", "score", "classification", "healthy_streak", "origin")


@register("T1", "T2", "S8", "S10", "A1")
def realtime_files(spark, sf_dir):
    """State after the stream has taken the weekly files that arrived in its folder."""
    incoming, store, state, checkpoint = (
        scratch_dir(spark, name) for name in ("incoming", "store", "state", "stream")
    )
    weekly.append_rows(_metric_rows(spark, sf_dir), incoming)
    realtime.run(
        spark, incoming, store, state, checkpoint, d.risk_answers(spark, sf_dir),
        as_of=d.AS_OF, max_files=2,
    )
    return ev.read_state(spark, state, "realtime").select(
        "scope", "employee", "week", "score", "classification", "rationale", "healthy_streak", "origin",
        _signal_names().alias("names"),
    )


@register("S9", "T1", "A1", "P14")
def pasted_stream(spark, sf_dir):
    """Pasted texts replace weeks that were appended, and both reach the stream's state."""
    incoming, store, state, checkpoint = (
        scratch_dir(spark, name) for name in ("incoming", "store", "state", "stream")
    )
    weekly.append_rows(_metric_rows(spark, sf_dir), incoming)
    realtime.start(spark, incoming, store, checkpoint).awaitTermination()
    weekly.land_csv_text(_pasted(spark, sf_dir), incoming)
    realtime.run(spark, incoming, store, state, checkpoint, as_of=d.AS_OF, scope="pasted")
    rows = ev.read_state(spark, state, "pasted")
    return rows.select(
        "employee", "week", "score", "classification", "origin",
        F.exists("signals", lambda s: s.signal_name == C.GAP_MARKER).alias("has_gap"),
    )


@register("X20", "G4", "A10")
def history_summaries(spark, sf_dir):
    rows = prompts.history_summary(d.stored_evaluations(spark, sf_dir))
    return rows.select("employee", "week", "weeks", "history")


@register("X20", "G4", "X8", "D2", "J7")
def model_prompts(spark, sf_dir):
    weeks = d.staged_weeks(spark, sf_dir)
    state = d.stored_evaluations(spark, sf_dir, weeks)
    records = d.employee_weeks(spark, sf_dir, True, weeks)
    detected = sig.signals_as_of(tl.densify(records, tl.max_week_of(weeks.select("week"))))
    texts = prompts.detection_prompts(detected, prompts.history_summary(state)).unionByName(
        prompts.briefing_prompts(state.filter(risk.is_flagged(F.col("classification"))))
    )
    answered = prompts.enrich(texts, d.risk_answers(spark, sf_dir, weeks))
    return answered.select(
        "kind", "employee", "week", "session_id",
        F.when(F.col("kind") == "briefing", F.col("prompt")).alias("briefing_prompt"),
        F.col("prompt").contains("Earlier weeks (").alias("has_history"),
        F.col("text").alias("answer"),
    )


# --- model logs -----------------------------------------------------------------


@register("P20", "F8", "U2", "X17")
def message_refs(spark, sf_dir):
    refs = comp.unpivot_refs(comp.log_refs(d.inference_logs(spark, sf_dir)))
    return refs.select(
        "insert_id", F.unix_seconds("timestamp").alias("ts"), "conversation_id", "message_type",
        "messages_ref_uri", comp.api_call_id(F.col("messages_ref_uri")).alias("api_call_id"),
        "usage_input_tokens", "user_id",
    )


@register("J8", "G1", "X19")
def message_parts(spark, sf_dir):
    refs = comp.unpivot_refs(comp.log_refs(d.inference_logs(spark, sf_dir)))
    parts = comp.flatten_parts(comp.join_messages(refs, d.completions(spark, sf_dir), any_scheme=True))
    return parts.select(
        "insert_id", "message_type", "role", "message_idx", "part_idx", "part_type",
        F.length("content").alias("chars"), "data_md5_hex",
    )


@register("W4")
def latest_part_in_span(spark, sf_dir):
    refs = comp.unpivot_refs(comp.log_refs(d.inference_logs(spark, sf_dir)))
    parts = comp.flatten_parts(comp.join_messages(refs, d.completions(spark, sf_dir), any_scheme=True))
    return comp.latest_in_span(parts).select(
        "insert_id", "conversation_id", "trace", "message_type", "role", "message_idx", "part_idx"
    )


@register("S17", "P20", "P21", "F8", "F9", "U2", "J8", "G1", "W4", "W5", "O6", "X17", "X19")
def completions_view(spark, sf_dir):
    view = comp.completions_view(d.inference_logs(spark, sf_dir), d.completions(spark, sf_dir), any_scheme=True)
    return comp.register_view(view).withColumn("timestamp", F.unix_seconds("timestamp"))


@register("S15")
def routed_logs(spark, sf_dir):
    routed = telemetry.route_inference_logs(d.inference_logs(spark, sf_dir), "1-")
    return routed.select("insertId", "logName")


@register("S13", "S14")
def stored_completions(spark, sf_dir):
    """Log and message files that were written and read back, counted."""
    logs_path, files = scratch_dir(spark, "logs"), scratch_dir(spark, "messages")
    telemetry.append_logs(d.inference_logs(spark, sf_dir), logs_path)
    d.completions(spark, sf_dir).drop("file_path").write.json(files)
    stored, _ = telemetry.read_completions(spark, files)
    logs = telemetry.read_logs(spark, logs_path, F.col("day") >= "2024-01-02")
    return logs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("trace").alias("traces")).withColumn(
        "what", F.lit("logs")
    ).unionByName(
        stored.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct(F.md5(F.get("parts", F.lit(0)).content.cast("binary"))).alias("traces"),
        ).withColumn("what", F.lit("messages"))
    )


def _message_name(uri: Column) -> Column:
    """Name of a message file, also where each is a folder of parts."""
    return F.regexp_extract(uri, r"([^/=]+\.jsonl)(/|$)", 1)


@register("S13", "S14", "J8", "S17")
def stored_view_of_one_day(spark, sf_dir):
    """The view of one day over stored logs and message files, some of whose lines are malformed."""
    logs_path, files, messages = (scratch_dir(spark, name) for name in ("logs", "files", "messages"))
    telemetry.append_logs(d.inference_logs(spark, sf_dir), logs_path)
    line = F.to_json(F.struct("parts", "role", "index", "file_path"))
    lines = d.completions(spark, sf_dir).select(
        F.explode(F.when(F.col("index") == 1, F.array(line, F.lit('{"role": "broken'))).otherwise(F.array(line))).alias("value"))
    # Bundles: a file for each message file would be tens of thousands.
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", 100_000).text(files)
    logs = telemetry.read_logs(spark, logs_path)
    refs = comp.unpivot_refs(comp.log_refs(logs))
    telemetry.store_messages(spark, files, refs, messages, max_bad_records=10_000_000, key=_message_name, bundled=True)
    view = comp.stored_view(logs.filter("day = DATE'2024-01-02'"), telemetry.read_messages(spark, messages), _message_name)
    return view.withColumn("timestamp", F.unix_seconds("timestamp"))


@register("W4", "W5", "S17")
def view_day_by_day(spark, sf_dir):
    """The view put together from its days, each deduplicated against all before."""
    path, logs_path, joined_path = (scratch_dir(spark, name) for name in ("view", "logs", "joined"))
    telemetry.append_logs(d.inference_logs(spark, sf_dir), logs_path)
    undated = F.lit("0000-00-00")  # before all days
    logs = telemetry.read_logs(spark, logs_path).withColumn("day", F.coalesce(F.col("day").cast("string"), undated))
    messages = d.completions(spark, sf_dir)
    refs = comp.latest_refs(comp.unpivot_refs(comp.log_refs(logs)), "day")
    comp.join_messages(refs, messages, any_scheme=True).write.parquet(joined_path)  # all days: messages are joined once
    joined = spark.read.parquet(joined_path)
    days = [row.day for row in logs.select("day").distinct().orderBy("day").collect()]  # one row a day
    # The first day by itself, then eight times as many each time: the stored keys are read a few times, not once a day.
    at, many = 0, 1
    while at < len(days):
        added = days[at : at + many]
        comp.add_days(spark, joined.filter(F.col("day").between(added[0], added[-1])), added, path)
        at, many = at + many, 8 * many
    drop_dir(spark, joined_path)
    return comp.read_days(spark, path).withColumn("timestamp", F.unix_seconds("timestamp"))


@register("S15")
def routed_entries(spark, sf_dir):
    """All routes in one scan and one write, read back."""
    path = scratch_dir(spark, "routes")
    logs = d.inference_logs(spark, sf_dir).withColumn(
        "payload", F.to_json(F.struct(
            F.when(F.col("labels.user_id").endswith("7"), "feedback").otherwise("trace").alias("log_type"),
            F.lit("engine").alias("service_name"))))
    telemetry.write_routes(logs, {
        "inference": telemetry.is_inference_log("1-"),
        "feedback": telemetry.is_feedback("engine"),
        "other": ~F.col("logName").endswith(telemetry.INFERENCE_LOG_NAME),
    }, path)
    return spark.read.parquet(path).select("route", "insertId")


@register("S16", "S15")
def feedback_rows(spark, sf_dir):
    labels = d.table(spark, sf_dir, "labels")
    entries = labels.select(
        "doc_id", (1 + F.col("quality") * 3 + F.col("toxic")).alias("score"),
        F.when(F.col("toxic") == 1, "rude").alias("text"),
        F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("user_id"),
        F.to_json(
            F.struct(
                F.when(F.col("quality") + F.col("toxic") > 0, "feedback").otherwise("trace").alias("log_type"),
                F.when(F.col("doc_id") % 5 != 0, "engine").otherwise("other").alias("service_name"),
            )
        ).alias("payload"),
    )
    rows = telemetry.feedback_rows(telemetry.route_feedback(entries, "engine"), "engine")
    return rows.select(
        "score", "text", "log_type", "service_name", "user_id",
        F.col("session_id").rlike("^[0-9a-f-]{36}$").alias("has_session"),
    )


# --- counters, grades, evaluation cases -----------------------------------------


@register("A12")
def call_outcomes(spark, sf_dir):
    calls = d.table(spark, sf_dir, "events").select(
        F.concat(F.lit("model_"), (F.col("user_id") % 5).cast("string")).alias("model"),
        (F.col("event_type") != "error").alias("success"),
    )
    return grading.call_outcomes(calls, "model").unionByName(
        grading.call_outcomes(calls).withColumn("model", F.lit("all"))
    )


@register("A13", "D1")
def turn_counts(spark, sf_dir):
    return grading.turn_counts(d.table(spark, sf_dir, "conversations"))


@register("A14", "X12", "X13")
def grade_summary(spark, sf_dir):
    summary = grading.grade_summary(grading.parse_grades(d.verdicts(spark, sf_dir)))
    return summary.withColumn("avg_grade", F.round("avg_grade", 6))


@register("A15", "A14")
def grade_comparison(spark, sf_dir):
    """Grades of the labelled documents against grades of all documents by length."""
    base = grading.parse_grades(d.verdicts(spark, sf_dir))
    texts = d.table(spark, sf_dir, "documents")
    by_length = F.least(F.lit(1) + F.floor(F.col("n_chars") / 500), F.lit(5)).cast("string")
    verdict = F.concat(F.lit('{"score": "'), by_length, F.lit('"}'))
    metric = F.when(F.col("lang") == "en", "quality").otherwise("tone")
    candidate = grading.parse_grades(
        texts.select(F.col("doc_id").alias("case_id"), metric.alias("metric"), verdict.alias("text"))
    )
    return grading.compare_grades(base, candidate)


@register("S18", "G2", "D1", "A13")
def evaluation_cases(spark, sf_dir):
    """Cases of both shapes: one prompt, or the turns before a user's message."""
    turns = d.table(spark, sf_dir, "conversations")

    def message(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), F.array(F.struct(text.alias("text"))).alias("parts"))

    def event(role: Column, text: Column) -> Column:
        return F.struct(role.alias("author"), message(role, text).alias("content"))

    def turn(index: int, *events: Column) -> Column:
        return F.struct(F.lit(index).alias("turn_index"), F.array(*events).alias("events"))

    own, intro = event(F.col("role"), F.col("text")), event(F.lit("agent"), F.col("role"))
    is_prompt = F.col("conv_id") % 2 == 0
    case = F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("eval_case_id"),
        F.when(is_prompt, message(F.lit("user"), F.col("text"))).alias("prompt"),
        F.when(~is_prompt, F.struct(F.array(turn(0, own, intro), turn(1, intro, own)).alias("turns"))).alias("agent_data"),
    )
    cases_ = evalset.eval_cases(turns.select(F.array(case).alias("eval_cases")))
    events = evalset.case_events(cases_).groupBy("case_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "turn_index", "event_idx", "author"))), " ").alias("events"))
    return cases_.join(events, "case_id", "left").select(
        "case_id", "shape", F.md5(F.col("message").cast("binary")).alias("message_md5"), "turn_count",
        F.coalesce("events", F.lit("")).alias("events"),
    )
