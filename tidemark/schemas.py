"""Schemas of the tables the engine reads and writes, as DDL texts."""

METRICS = (
    "completed_tasks",
    "response_time",
    "after_hours_logins",
    "sick_days",
    "weekly_hours",
    "task_accuracy",
    "sentiment",
)

EMPLOYEE_WEEK = (
    "employee STRING, week INT, completed_tasks INT, response_time DOUBLE, "
    "after_hours_logins INT, sick_days INT, weekly_hours INT, task_accuracy INT, "
    "sentiment STRING, source_file STRING"
)

SIGNAL_DDL = (
    "STRUCT<kind: STRING, signal_name: STRING, weeks_detected: ARRAY<INT>, "
    "severity: STRING, details: STRING>"
)

EVALUATION = (
    "scope STRING, employee STRING, week INT, score INT, classification STRING, "
    f"rationale STRING, healthy_streak INT, signals ARRAY<{SIGNAL_DDL}>, "
    "briefing STRING, origin STRING, evaluated_at TIMESTAMP"
)
EVALUATION_COLUMNS = (
    "scope",
    "employee",
    "week",
    "score",
    "classification",
    "rationale",
    "healthy_streak",
    "signals",
    "briefing",
    "origin",
    "evaluated_at",
)

# One stored evaluation as a JSON document.  A gap marker carries its name under
# "signal" instead of "signal_name".
EVALUATION_JSON = (
    "score STRING, classification STRING, rationale STRING, healthy_streak STRING, "
    "signals ARRAY<STRUCT<signal: STRING, signal_name: STRING, "
    "weeks_detected: ARRAY<INT>, severity: STRING, details: STRING>>, "
    "briefing STRING, _corrupt_record STRING"
)

MODEL_RESPONSE = "kind STRING, employee STRING, week INT, text STRING"

_LABELS = (
    "gen_ai_conversation_id",
    "gen_ai_agent_name",
    "gen_ai_input_messages_ref",
    "gen_ai_output_messages_ref",
    "gen_ai_system_instructions_ref",
    "gen_ai_usage_input_tokens",
    "gen_ai_usage_output_tokens",
    "gen_ai_response_finish_reasons",
    "gen_ai_tool_definitions",
    "gen_ai_tool_definitions_ref",
    "gcp_vertex_agent_invocation_id",
    "gcp_vertex_agent_event_id",
    "event_name",
    "user_id",
)
INFERENCE_LOG_COLUMNS = (
    "logName",
    "textPayload",
    "timestamp",
    "receiveTimestamp",
    "severity",
    "insertId",
    "trace",
    "spanId",
    "traceSampled",
    "resource",
    "labels",
)
INFERENCE_LOG = (
    "logName STRING, textPayload STRING, timestamp TIMESTAMP, "
    "receiveTimestamp TIMESTAMP, severity STRING, insertId STRING, trace STRING, "
    "spanId STRING, traceSampled BOOLEAN, resource STRUCT<type: STRING, "
    "labels: STRUCT<project_id: STRING, location: STRING>>, labels STRUCT<"
    + ", ".join(f"{name}: STRING" for name in _LABELS)
    + ">"
)

COMPLETION = (
    "parts ARRAY<STRUCT<type: STRING, content: STRING, mime_type: STRING, "
    "uri: STRING, data: BINARY, id: STRING, name: STRING, arguments: STRING, "
    "response: STRING>>, role STRING, index BIGINT"
)

FEEDBACK = (
    "score DOUBLE, text STRING, log_type STRING, service_name STRING, "
    "user_id STRING, session_id STRING"
)

_MESSAGE = "role: STRING, parts: ARRAY<STRUCT<text: STRING>>"
EVAL_DATASET = (
    "eval_cases ARRAY<STRUCT<eval_case_id: STRING, "
    f"prompt: STRUCT<{_MESSAGE}>, "
    "agent_data: STRUCT<turns: ARRAY<STRUCT<turn_index: INT, "
    f"events: ARRAY<STRUCT<author: STRING, content: STRUCT<{_MESSAGE}>>>>>>>>"
)
