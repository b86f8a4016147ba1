"""The engine's inputs, derived from the driver tables.

Every derivation is row-wise or a map-side combined aggregate over a whole table; no
key of the driver tables is gathered.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.names import slug
from tidemark.operators.risk import classify
from tidemark.operators.timeline import densify, max_week_of
from tidemark.schemas import SIGNAL_DDL
from tidemark.session import scratch_dir

AS_OF = dt.datetime(2024, 2, 5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week_of(ts: Column) -> Column:
    return (F.floor(F.datediff(ts, F.lit("2024-01-01")) / 7) + 1).cast("int")


def events_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("week", week_of(F.col("ts")))


def max_week(spark: SparkSession, sf_dir: str) -> Column:
    """Largest week, from the time column alone."""
    return max_week_of(events_by_week(spark, sf_dir).select("week"))


def _mean_cents(cents: Column, count: Column) -> Column:
    """Average from whole cents: the same double on any partitioning."""
    return F.when(count > 0, cents / 100.0 / count)


def staged_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All employee weeks, derived once and kept in the shared folder.

    Records, state, answers and the last week of a run are row-wise uses of it.
    """
    path = scratch_dir(spark, "employee-weeks")
    employee_weeks(spark, sf_dir, keep_signups=True).write.parquet(path)
    return spark.read.parquet(path)


def employee_weeks(
    spark: SparkSession,
    sf_dir: str,
    with_gaps: bool = False,
    staged: DataFrame | None = None,
    keep_signups: bool = False,
) -> DataFrame:
    """EMPLOYEE_WEEK rows out of events; ``with_gaps`` keeps weeks with a signup only."""
    if staged is not None:
        return (staged.filter("signups > 0") if with_gaps else staged).drop("signups")
    kind = F.col("event_type")
    cents = F.floor(F.col("value") * 100 + 0.5)
    hour = F.hour("ts")
    counts = (
        events_by_week(spark, sf_dir)
        .groupBy("user_id", "week")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(kind == "click").alias("clicks"),
            F.count_if(kind == "view").alias("views"),
            F.sum(F.when(kind == "view", cents)).alias("view_cents"),
            F.sum(cents).alias("cents"),
            F.count_if((hour >= 18) | (hour < 8)).alias("late"),
            F.count_if(kind == "error").alias("errors"),
            F.count_if(kind == "purchase").alias("purchases"),
            F.count_if(kind == "signup").alias("signups"),
        )
    )
    if with_gaps:
        counts = counts.filter("signups > 0")
    return counts.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("employee"),
        "week",
        F.col("clicks").cast("int").alias("completed_tasks"),
        F.coalesce(_mean_cents(F.col("view_cents"), F.col("views")), F.lit(0.0)).alias("response_time"),
        F.col("late").cast("int").alias("after_hours_logins"),
        F.col("errors").cast("int").alias("sick_days"),
        (20 + 3 * F.col("n")).cast("int").alias("weekly_hours"),
        (100 - F.floor(_mean_cents(F.col("cents"), F.col("n")) / 3)).cast("int").alias("task_accuracy"),
        F.when(F.col("purchases") == 0, "Withdrawn").otherwise("Neutral").alias("sentiment"),
        F.concat(F.lit("week"), F.col("week").cast("string"), F.lit(".csv")).alias("source_file"),
        *(["signups"] if keep_signups else []),
    )


def timeline(spark: SparkSession, sf_dir: str, with_gaps: bool = True) -> DataFrame:
    return densify(employee_weeks(spark, sf_dir, with_gaps), max_week(spark, sf_dir))


def user_number(employee: Column) -> Column:
    return F.regexp_extract(employee, r"(\d+)$", 1).cast("long")


def spread_score(employee: Column, week: Column) -> Column:
    """1..10, evenly spread, by arithmetic only."""
    return (1 + (user_number(employee) * 7 + week * 3) % 10).cast("int")


def _named(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))


def stored_evaluations(spark: SparkSession, sf_dir: str, staged: DataFrame | None = None) -> DataFrame:
    """A full EVALUATION table: one row per employee-week of the gap variant.

    Signals follow simple rules on the metrics, one name in them is outside the signal
    vocabulary, and every fifth row came from the default.
    """
    rows = employee_weeks(spark, sf_dir, True, staged)
    user, week = user_number(F.col("employee")), F.col("week")
    score = spread_score(F.col("employee"), week)
    names = _named(
        (F.col("weekly_hours") > 55, "Burnout Risk"),
        (F.col("after_hours_logins") > 6, "Excessive After-Hours Logins"),
        (F.col("sick_days") > 3, "Increasing Sick Days"),
        (F.col("task_accuracy") < 84, "Quality Degradation"),
        (F.col("sentiment") == "Withdrawn", "Quiet Week"),
    )
    signals = F.transform(
        names,
        lambda n: F.struct(
            F.lit("signal").alias("kind"),
            n.alias("signal_name"),
            F.array(week).alias("weeks_detected"),
            F.lit("medium").alias("severity"),
            F.lit(None).cast("string").alias("details"),
        ),
    )
    gap = F.when(
        user % 7 == 0,
        F.array(
            F.struct(
                F.lit("gap").alias("kind"),
                F.lit("MISSING_DATA_GAP").alias("signal_name"),
                F.lit(None).cast("array<int>").alias("weeks_detected"),
                F.lit("low").alias("severity"),
                F.lit("gap").alias("details"),
            )
        ),
    ).otherwise(F.array().cast(f"ARRAY<{SIGNAL_DDL}>"))
    label = classify(score)
    return rows.select(
        F.lit("main").alias("scope"),
        "employee",
        "week",
        score.alias("score"),
        label.alias("classification"),
        F.concat(F.lit("reason "), "employee", F.lit(" w"), week.cast("string")).alias("rationale"),
        F.when(label == "Healthy", 1).otherwise(0).alias("healthy_streak"),
        F.concat(signals, gap).cast(f"ARRAY<{SIGNAL_DDL}>").alias("signals"),
        F.when(
            (label != "Healthy") & (user % 4 != 0),
            F.concat(F.lit("Actions for "), "employee", F.lit(".\nPre-meeting observation: w"), week.cast("string")),
        ).alias("briefing"),
        F.when((user + week) % 5 == 0, "default").otherwise("model").alias("origin"),
        F.when(user % 2 == 0, F.lit(dt.datetime(2024, 2, 1)))
        .otherwise(F.lit(dt.datetime(2023, 10, 1)))
        .cast("timestamp")
        .alias("evaluated_at"),
    )


def earlier_state(spark: SparkSession, sf_dir: str, staged: DataFrame | None = None) -> DataFrame:
    """State before a run: what was stored after week 2."""
    return stored_evaluations(spark, sf_dir, staged).filter(F.col("week") <= 2)


def risk_answers(spark: SparkSession, sf_dir: str, staged: DataFrame | None = None) -> DataFrame:
    """MODEL_RESPONSE rows of kind risk: plain, fenced, wrapped in prose, and broken."""
    rows = employee_weeks(spark, sf_dir, staged=staged)
    user, week = user_number(F.col("employee")), F.col("week")
    score = spread_score(F.col("employee"), week)
    doc = F.concat(
        F.lit('{"score": "'), score.cast("string"),
        F.lit('", "classification": "'), classify(score),
        F.lit('", "rationale": "answer w'), week.cast("string"), F.lit('"}'),
    )
    kind = (user * 5 + week) % 6
    text = (
        F.when(kind == 0, F.lit("service unavailable"))
        .when(kind == 1, F.concat(F.lit("```json\n"), doc, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("```"), doc, F.lit("```  ")))
        .when(kind == 3, F.concat(F.lit("Here it is: "), doc, F.lit(" - done")))
        .otherwise(doc)
    )
    return rows.select(F.lit("risk").alias("kind"), "employee", "week", text.alias("text"))


def _file(conv: Column, turn: Column, kind: str) -> Column:
    return F.concat(
        F.lit("/messages/"), conv.cast("string"), F.lit("-"), turn.cast("string"), F.lit(f"_{kind}.jsonl")
    )


def inference_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INFERENCE_LOG rows: one call per assistant turn, every third logged twice.

    Every fifth conversation has no id.  System turns are logged without references.
    """
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") != "user")
    conv, turn = F.col("conv_id"), F.col("turn")
    copies = F.when(turn % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    is_call = F.col("role") == "assistant"
    rows = turns.select("conv_id", "turn", "role", F.length("text").alias("size"), F.explode(copies).alias("copy"))
    key = F.concat(conv.cast("string"), F.lit("-"), turn.cast("string"))
    none = F.lit(None).cast("string")
    labels = {
        "gen_ai_conversation_id": F.when(conv % 5 != 0, F.concat(F.lit("c"), conv.cast("string"))),
        "gen_ai_agent_name": F.lit("assistant"),
        "gen_ai_input_messages_ref": F.when(is_call & (turn > 0), F.concat(F.lit("gs:/"), _file(conv, turn, "input"))),
        "gen_ai_output_messages_ref": F.when(is_call, F.concat(F.lit("gs:/"), _file(conv, turn, "output"))),
        "gen_ai_system_instructions_ref": none,
        "gen_ai_usage_input_tokens": (turn * 10).cast("string"),
        "gen_ai_usage_output_tokens": F.col("size").cast("string"),
        "gen_ai_response_finish_reasons": F.lit("stop"),
        "gen_ai_tool_definitions": none,
        "gen_ai_tool_definitions_ref": none,
        "gcp_vertex_agent_invocation_id": none,
        "gcp_vertex_agent_event_id": none,
        "event_name": none,
        "user_id": F.concat(F.lit("u"), (conv % 50).cast("string")),
    }
    seconds = 1704067200 + conv * 1000 + turn * 10 + F.col("copy")
    return rows.select(
        F.concat(
            F.lit("projects/demo/logs/"),
            F.when(is_call, "gen_ai.client.inference.operation.details").otherwise("other"),
        ).alias("logName"),
        none.alias("textPayload"),
        F.timestamp_seconds(seconds).alias("timestamp"),
        F.timestamp_seconds(seconds).alias("receiveTimestamp"),
        F.lit("INFO").alias("severity"),
        F.concat(key, F.lit("#"), F.col("copy").cast("string")).alias("insertId"),
        F.concat(F.lit("t"), key).alias("trace"),
        F.lit("s1").alias("spanId"),
        F.lit(True).alias("traceSampled"),
        F.struct(
            F.lit("run").alias("type"),
            F.struct(F.lit("demo").alias("project_id"), F.lit("eu").alias("location")).alias("labels"),
        ).alias("resource"),
        F.struct(*[c.alias(n) for n, c in labels.items()]).alias("labels"),
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored messages with ``file_path``: each message is the output of its own turn
    and an input of every later turn of its conversation."""
    turns = table(spark, sf_dir, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    turns = turns.join(last, "conv_id")
    conv, turn = F.col("conv_id"), F.col("turn")
    targets = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("last_turn") - turn),
        lambda i: F.when(i == 0, _file(conv, turn, "output")).otherwise(
            _file(conv, turn + i, "input")
        ),
    )
    none = F.lit(None).cast("string")

    def part(kind: str, content: Column, data: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), content.alias("content"), none.alias("mime_type"),
            none.alias("uri"), data.cast("binary").alias("data"), none.alias("id"),
            none.alias("name"), none.alias("arguments"), none.alias("response"),
        )

    text = part("text", F.col("text"), none)
    blob = part("blob", none, F.concat(F.lit("data-"), conv.cast("string")))
    parts = (
        F.when(conv % 11 == 10, F.array().cast(text_array()))
        .when(turn % 4 == 2, F.array(text, blob))
        .otherwise(F.array(text))
    )
    return turns.select(
        parts.alias("parts"),
        F.when(conv % 13 != 12, F.col("role")).alias("role"),
        turn.alias("index"),
        F.explode(targets).alias("file_path"),
    ).withColumn("file_path", F.concat(F.lit("file://"), "file_path"))


def text_array() -> str:
    return (
        "ARRAY<STRUCT<type: STRING, content: STRING, mime_type: STRING, uri: STRING, "
        "data: BINARY, id: STRING, name: STRING, arguments: STRING, response: STRING>>"
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grader answers (case_id, metric, text) out of labels."""
    rows = table(spark, sf_dir, "labels")
    score = 1 + F.col("quality") * 3 + F.col("toxic")
    doc = F.concat(F.lit('{"score": '), score.cast("string"), F.lit(', "explanation": "ok"}'))
    text = (
        F.when(F.col("doc_id") % 9 == 0, F.lit("no verdict"))
        .when(F.col("doc_id") % 9 == 1, F.lit('{"score": 7, "explanation": "out of range"}'))
        .when(F.col("doc_id") % 9 == 2, F.concat(F.lit("```json\n"), doc, F.lit("\n```")))
        .otherwise(doc)
    )
    metric = F.when(F.col("doc_id") % 2 == 0, "quality").otherwise("tone")
    return rows.select(F.col("doc_id").alias("case_id"), metric.alias("metric"), text.alias("text"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text observations that state each employee-week's metrics."""
    return employee_weeks(spark, sf_dir).select(
        "employee",
        "week",
        F.concat(
            F.concat(F.lit("Ana"), F.translate(slug(F.col("employee")), "_0123456789", "")),
            F.lit(" finished "), F.col("completed_tasks").cast("string"),
            F.lit(" tasks and worked "), F.col("weekly_hours").cast("string"),
            F.lit(" hours, accuracy of "), F.col("task_accuracy").cast("string"),
            F.lit("%, latency "), F.round("response_time", 0).cast("int").cast("string"),
            F.when(F.col("sick_days") > 0, F.concat(F.lit("h, "), F.col("sick_days").cast("string"), F.lit(" days off")))
            .otherwise(F.lit("h")),
            F.lit(", "), F.col("after_hours_logins").cast("string"),
            F.lit(" night logins, mood "), F.lower("sentiment"),
        ).alias("text"),
    )
