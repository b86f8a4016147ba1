"""SQL that another engine runs on the driver tables to check the registered queries.

Written independently of the DataFrame code: week spines, self joins and recursive
queries instead of windows over dense timelines and array folds.
"""

from tidemark import constants as C

ORACLES: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _with(*ctes: str, body: str, recursive: bool = False) -> str:
    keyword = "WITH RECURSIVE " if recursive else "WITH "
    return keyword + ",\n".join(ctes) + "\n" + body


def _class(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 8 THEN 'Silent Exit' WHEN {score} >= 6 THEN 'At Risk' "
        f"WHEN {score} >= 4 THEN 'Watch' ELSE 'Healthy' END"
    )


def _badge(label: str, unknown: str = "[?]") -> str:
    cases = " ".join(f"WHEN {label} = {_q(n)} THEN {_q(b)}" for n, b in C.BADGES)
    return f"CASE {cases} ELSE {_q(unknown)} END"


# --- employee weeks -------------------------------------------------------------

_WEEK = "CAST(floor(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) + 1 AS INTEGER)"

EV = f"ev AS (SELECT *, {_WEEK} AS week FROM events)"
COUNTS = """counts AS (
  SELECT user_id AS u, week, count(*) AS n,
    count(*) FILTER (event_type = 'click') AS clicks,
    count(*) FILTER (event_type = 'view') AS views,
    sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'view') AS view_cents,
    sum(CAST(round(value * 100) AS BIGINT)) AS cents,
    count(*) FILTER (hour(ts) >= 18 OR hour(ts) < 8) AS late,
    count(*) FILTER (event_type = 'error') AS errors,
    count(*) FILTER (event_type = 'purchase') AS purchases,
    count(*) FILTER (event_type = 'signup') AS signups
  FROM ev GROUP BY user_id, week)"""
EW = """ew_all AS (
  SELECT u, 'user_' || u AS employee, week, signups,
    CAST(clicks AS INTEGER) AS completed_tasks,
    CASE WHEN views > 0 THEN CAST(view_cents AS DOUBLE) / 100.0::DOUBLE / views ELSE 0.0::DOUBLE END AS response_time,
    CAST(late AS INTEGER) AS after_hours_logins,
    CAST(errors AS INTEGER) AS sick_days,
    CAST(20 + 3 * n AS INTEGER) AS weekly_hours,
    CAST(100 - floor(CAST(cents AS DOUBLE) / 100.0::DOUBLE / n / 3) AS INTEGER) AS task_accuracy,
    CASE WHEN purchases = 0 THEN 'Withdrawn' ELSE 'Neutral' END AS sentiment,
    'week' || week || '.csv' AS source_file
  FROM counts)"""
FULL = "ew AS (SELECT * FROM ew_all)"
GAPS = "ew AS (SELECT * FROM ew_all WHERE signups > 0)"
_EW_FULL = (EV, COUNTS, EW, FULL)
_EW_GAPS = (EV, COUNTS, EW, GAPS)

TL = """spine AS (
  SELECT e.employee, CAST(w.week AS INTEGER) AS week
  FROM (SELECT DISTINCT employee FROM ew) e,
       (SELECT unnest(range(1, (SELECT max(week) FROM ev) + 1)) AS week) w),
tl AS (
  SELECT s.employee, s.week, e.week IS NULL AS data_missing,
    e.completed_tasks, e.response_time, e.after_hours_logins, e.sick_days,
    e.weekly_hours, e.task_accuracy, e.sentiment,
    b.week IS NOT NULL AS has_baseline,
    b.completed_tasks AS base_tasks, b.response_time AS base_response, b.sick_days AS base_sick
  FROM spine s
  LEFT JOIN ew e ON e.employee = s.employee AND e.week = s.week
  LEFT JOIN ew b ON b.employee = s.employee AND b.week = 1)"""

ORACLES["employee_week_metrics"] = _with(
    *_EW_FULL,
    body="SELECT employee, week, completed_tasks, round(response_time, 6) AS response_time, "
    "after_hours_logins, sick_days, weekly_hours, task_accuracy, sentiment, source_file FROM ew",
)
ORACLES["last_week"] = _with(EV, body="SELECT max(week) AS max_week FROM ev")
ORACLES["first_record_per_week"] = _with(
    EV,
    body="SELECT 'user_' || user_id AS employee, week, event_id, event_type, value FROM "
    "(SELECT *, row_number() OVER (PARTITION BY user_id, week ORDER BY event_id) AS rn FROM ev) "
    "WHERE rn = 1",
)
ORACLES["dense_timeline"] = _with(
    *_EW_GAPS, TL,
    body="SELECT employee, week, data_missing, completed_tasks, sick_days, weekly_hours, sentiment FROM tl",
)
ORACLES["own_baseline"] = _with(
    *_EW_GAPS, TL,
    body="SELECT employee, week, has_baseline, base_tasks, base_sick, "
    "round(base_response, 6) AS base_response FROM tl",
)
MISSING = """missing AS (
  SELECT t.employee, t.week, coalesce(string_agg(CAST(m.week AS VARCHAR), ', ' ORDER BY m.week), '') AS missing
  FROM tl t LEFT JOIN tl m ON m.employee = t.employee AND m.week <= t.week AND m.data_missing
  GROUP BY t.employee, t.week)"""
ORACLES["weeks_without_data"] = _with(
    *_EW_GAPS, TL, MISSING,
    body="SELECT employee, week, replace(missing, ', ', ',') AS missing FROM missing",
)
ORACLES["missing_week_rows"] = _with(
    *_EW_GAPS, TL,
    body="SELECT employee, week FROM spine EXCEPT SELECT employee, week FROM ew",
)

# --- flags ----------------------------------------------------------------------

_RULES = (
    # name, condition, worst measure, aggregate, high, medium
    (C.BURNOUT, "weekly_hours > 50", "coalesce(nullif(weekly_hours, 0), 40)", "max", "> 60", "> 55"),
    (C.TASKS, "base_tasks > 0 AND (base_tasks - completed_tasks) / CAST(base_tasks AS DOUBLE) >= CAST(0.20 AS DOUBLE)",
     "(base_tasks - completed_tasks) / CAST(base_tasks AS DOUBLE)", "max", ">= CAST(0.40 AS DOUBLE)", ">= CAST(0.20 AS DOUBLE)"),
    (C.AFTER_HOURS, "after_hours_logins > 2", "after_hours_logins", "max", ">= 6", ">= 4"),
    (C.SICK, "sick_days > base_sick + 1", "sick_days - base_sick", "max", ">= 3", ">= 2"),
    (C.LOW_ACTIVITY, "weekly_hours < 30", "coalesce(nullif(weekly_hours, 0), 40)", "min", "< 20", "< 25"),
    (C.QUALITY, "task_accuracy < 85", "coalesce(nullif(task_accuracy, 0), 100)", "min", "< 70", "< 80"),
    (C.RESPONSE, "base_response > 0 AND (response_time - base_response) / base_response > CAST(0.5 AS DOUBLE)",
     "(response_time - base_response) / base_response", "max", ">= 1", ">= CAST(0.5 AS DOUBLE)"),
    (C.WITHDRAWN, "lower(trim(sentiment)) = 'withdrawn'", "1", "max", "> 1", ">= 1"),
)


def _key(name: str) -> str:
    return "flag_" + name.lower().replace(" ", "_").replace("-", "_")


_COUNTED = "NOT data_missing AND week <> 1 AND has_baseline"
FLAGS = (
    "flags AS (\n"
    + "\n  UNION ALL ".join(
        f"SELECT employee, week, {_q(n)} AS signal_name, CAST({worst} AS DOUBLE) AS worst "
        f"FROM tl WHERE {_COUNTED} AND {cond}"
        for n, cond, worst, *_ in _RULES
    )
    + ")"
)
ORACLES["weekly_flag_columns"] = _with(
    *_EW_GAPS, TL,
    body="SELECT employee, week, "
    + ", ".join(f"({_COUNTED} AND coalesce({cond}, false)) AS {_key(n)}" for n, cond, *_ in _RULES)
    + " FROM tl",
)
ORACLES["weekly_flags_long"] = _with(
    *_EW_GAPS, TL, FLAGS, body="SELECT employee, week, signal_name FROM flags"
)
NEIGHBOURS = """neighbours AS (
  SELECT f.*, p.week IS NOT NULL AS has_prev, n.week IS NOT NULL AS has_next
  FROM flags f
  LEFT JOIN flags p ON p.employee = f.employee AND p.signal_name = f.signal_name AND p.week = f.week - 1
  LEFT JOIN flags n ON n.employee = f.employee AND n.signal_name = f.signal_name AND n.week = f.week + 1)"""
ORACLES["flags_in_runs"] = _with(
    *_EW_FULL, TL, FLAGS, NEIGHBOURS,
    body="SELECT employee, signal_name, week, CASE WHEN has_prev THEN week ELSE week + 1 END AS confirm_week "
    "FROM neighbours WHERE has_prev OR has_next",
)
# Every prefix of the timeline on its own: a flag counts as of week w when a neighbour
# of it lies in the prefix too.
AS_OF = """as_of AS (
  SELECT s.employee, s.week, f.signal_name, f.week AS hit, f.worst
  FROM spine s JOIN neighbours f ON f.employee = s.employee AND f.week <= s.week
   AND (f.has_prev OR (f.has_next AND f.week + 1 <= s.week)))"""
_SEVERITY = (
    "CASE "
    + " ".join(
        f"WHEN signal_name = {_q(n)} THEN CASE WHEN {agg}(worst) {high} THEN 'high' "
        f"WHEN {agg}(worst) {medium} THEN 'medium' ELSE 'low' END"
        for n, _, _, agg, high, medium in _RULES
    )
    + " END"
)
SIGNALS = f"""signals AS (
  SELECT employee, week, signal_name, string_agg(CAST(hit AS VARCHAR), ',' ORDER BY hit) AS weeks,
    {_SEVERITY} AS severity
  FROM as_of GROUP BY employee, week, signal_name)"""
_DETECT = (TL, FLAGS, NEIGHBOURS, AS_OF, SIGNALS)
ORACLES["confirmed_as_of_week"] = _with(
    *_EW_FULL, *_DETECT,
    body="SELECT employee, week AS as_of_week, signal_name, weeks FROM signals",
)
ORACLES["signals_as_of_week"] = _with(
    *_EW_FULL, *_DETECT,
    body="SELECT employee, week, signal_name, weeks, severity FROM signals",
)
ENTRIES = """entries AS (
  SELECT employee, week, 'signal' AS kind, signal_name, weeks, severity, '' AS details FROM signals
  UNION ALL
  SELECT employee, week, 'no_baseline', 'Baseline Week Missing', '', 'low', '' FROM tl WHERE NOT has_baseline
  UNION ALL
  SELECT employee, week, 'gap', 'MISSING_DATA_GAP', '', 'low',
    'Missing data for week(s): [' || missing || ']. Handled as data gap, not disengagement.'
  FROM missing WHERE missing <> '')"""
ORACLES["signals_with_gaps"] = _with(
    *_EW_GAPS, *_DETECT, MISSING, ENTRIES, body="SELECT * FROM entries"
)

# --- scores ---------------------------------------------------------------------

_SPREAD = "CAST(1 + (u * 7 + week * 3) % 10 AS INTEGER)"
ORACLES["score_classes"] = _with(
    *_EW_FULL,
    f"s AS (SELECT employee, week, {_SPREAD} AS score FROM ew)",
    f"c AS (SELECT *, {_class('score')} AS classification FROM s)",
    body=f"SELECT employee, week, score, classification, {_badge('classification')} AS badge FROM c",
)
ANSWERS = f"""answers AS (
  SELECT employee, u, week, (u * 5 + week) % 6 AS kind, {_SPREAD} AS score,
    {_class(_SPREAD)} AS classification, 'answer w' || week AS rationale FROM ew_all)"""
ORACLES["parsed_risk_answers"] = _with(
    *_EW_FULL, ANSWERS,
    """both_ AS (
      SELECT *, 'block' AS source, kind <> 0 AS ok FROM answers
      UNION ALL SELECT *, 'fenced', kind NOT IN (0, 3) FROM answers)""",
    body="SELECT employee, week, source, ok, CASE WHEN ok THEN score END AS score, "
    "CASE WHEN ok THEN classification END AS classification, "
    "CASE WHEN ok THEN rationale END AS rationale FROM both_",
)
ORACLES["default_scores"] = _with(
    *_EW_FULL, ANSWERS,
    body="""SELECT employee, week,
      CASE WHEN kind IN (0, 3) THEN 4 ELSE score END AS score,
      CASE WHEN kind IN (0, 3) THEN 'Watch' ELSE classification END AS classification,
      CASE WHEN kind IN (0, 3) THEN 'Scoring unavailable due to error in week ' || week || '.'
        ELSE rationale END AS rationale,
      CASE WHEN kind NOT IN (0, 3) AND classification = 'Healthy' THEN 1 ELSE 0 END AS healthy_streak
    FROM answers""",
)


def _fold(grown: str) -> tuple[str, ...]:
    """Week-by-week recursion over ``base`` (employee, week, origin, base_*, stored,
    stored_streak, in_history)."""
    raised = "least(b.base_score + 1, 10)"
    label = f"CASE WHEN {{bonus}} THEN {_class(raised)} ELSE b.base_class END"
    bonus = "(NOT b.stored AND b.origin = 'model' AND f.streak < 4 AND f.elevated >= 2)"
    label = label.format(bonus=bonus)
    step = f"""
      SELECT b.employee, b.i, b.week,
        CASE WHEN {bonus} THEN {raised} ELSE b.base_score END AS score,
        {label} AS classification,
        CASE WHEN {bonus} THEN b.base_rationale || ' [Recurrence adjustment applied: score increased from '
          || b.base_score || ' to ' || {raised} || '.]' ELSE b.base_rationale END AS rationale,
        {bonus} AS bonus, f.elevated AS prior_elevated, f.streak AS prior_streak,
        CASE WHEN b.stored THEN b.stored_streak
          WHEN b.origin = 'model' AND upper(trim({label})) = 'HEALTHY' THEN f.streak + 1 ELSE 0 END AS healthy_streak,
        f.run AS prior_run, b.in_history, b.stored, b.origin
      FROM {{source}} f JOIN ordered b ON {{on}}"""
    after = f"""SELECT *,
        CASE WHEN NOT in_history THEN prior_elevated
          WHEN upper(trim(classification)) IN ('WATCH', 'AT RISK', 'SILENT EXIT') THEN prior_elevated + 1
          ELSE prior_elevated END AS elevated,
        CASE WHEN NOT in_history THEN prior_streak
          WHEN upper(trim(classification)) = 'HEALTHY' THEN {grown} ELSE 0 END AS streak,
        CASE WHEN NOT in_history THEN prior_run
          WHEN upper(trim(classification)) = 'HEALTHY' THEN prior_run + 1 ELSE 0 END AS run
      FROM ({{step}})"""
    first = after.format(
        step=step.format(source="(SELECT 0 AS elevated, 0 AS streak, 0 AS run)", on="b.i = 1")
    )
    later = after.format(
        step=step.format(source="fold", on="b.employee = f.employee AND b.i = f.i + 1")
    )
    return (
        "ordered AS (SELECT *, row_number() OVER (PARTITION BY employee ORDER BY week) AS i FROM base)",
        f"fold AS ({first} UNION ALL {later})",
    )


_STORED_GROWTH = "greatest(prior_streak, healthy_streak + prior_run, prior_run + 1)"
BASE = f"""base AS (
  SELECT employee, week, CASE WHEN (u + week) % 6 = 0 THEN 'default' ELSE 'model' END AS origin,
    base_score, {_class('base_score')} AS base_class, 'r' || week AS base_rationale,
    false AS stored, 0 AS stored_streak, true AS in_history
  FROM (SELECT *, CASE WHEN (u + week) % 6 = 0 THEN 4
      WHEN {_SPREAD} > 6 THEN {_SPREAD} - 6 ELSE {_SPREAD} END AS base_score FROM ew))"""
_FOLD_BODY = (
    "SELECT employee, week, score, classification, rationale, healthy_streak, bonus, "
    f"classification <> {_class('score')} AS label_conflict, prior_elevated, prior_streak FROM fold"
)
ORACLES["score_recurrence"] = _with(
    *_EW_GAPS, BASE, *_fold(_STORED_GROWTH), body=_FOLD_BODY, recursive=True
)
ORACLES["score_recurrence_true_count"] = _with(
    *_EW_GAPS, BASE, *_fold("prior_run + 1"), body=_FOLD_BODY, recursive=True
)

# --- stored evaluations ---------------------------------------------------------

STATE = f"""state AS (
  SELECT employee, u, week, score, classification,
    'reason ' || employee || ' w' || week AS rationale,
    CASE WHEN classification = 'Healthy' THEN 1 ELSE 0 END AS healthy_streak,
    list_filter([
      CASE WHEN weekly_hours > 55 THEN 'Burnout Risk' END,
      CASE WHEN after_hours_logins > 6 THEN 'Excessive After-Hours Logins' END,
      CASE WHEN sick_days > 3 THEN 'Increasing Sick Days' END,
      CASE WHEN task_accuracy < 84 THEN 'Quality Degradation' END,
      CASE WHEN sentiment = 'Withdrawn' THEN 'Quiet Week' END], lambda x: x IS NOT NULL) AS names,
    u % 7 = 0 AS has_gap,
    CASE WHEN classification <> 'Healthy' AND u % 4 <> 0
      THEN 'Actions for ' || employee || '.' || chr(10) || 'Pre-meeting observation: w' || week END AS briefing,
    CASE WHEN (u + week) % 5 = 0 THEN 'default' ELSE 'model' END AS origin,
    CASE WHEN u % 2 = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2023-10-01' END AS evaluated_at
  FROM (SELECT *, {_class('score')} AS classification FROM
    (SELECT *, {_SPREAD} AS score FROM ew_all WHERE signups > 0)))"""
_STATE = (*_EW_GAPS, STATE)
_NAMES = "array_to_string(names, '|')"
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY employee ORDER BY week DESC) AS rn FROM state) WHERE rn = 1)"

# Signal names as of each week, as a sorted list (the gap marker is not a name).
NAMED = """named AS (
  SELECT t.employee, t.week,
    coalesce(list(e.signal_name ORDER BY e.signal_name) FILTER (e.signal_name IS NOT NULL), []) AS names
  FROM tl t LEFT JOIN entries e ON e.employee = t.employee AND e.week = t.week AND e.kind <> 'gap'
  GROUP BY t.employee, t.week)"""


def _nearest(queries: str, pool: str, keep: str, name: str = "near") -> tuple[str, ...]:
    """Best case per distinct query set, by comparing it with every case."""
    return (
        f"{name}_sets AS (SELECT DISTINCT names FROM {queries})",
        f"""{name} AS (
          SELECT names, similarity, {keep} FROM (
            SELECT *, row_number() OVER (PARTITION BY names ORDER BY similarity DESC, c_employee, c_week) AS rn
            FROM (
              SELECT q.names, {keep}, c.employee AS c_employee, c.week AS c_week,
                CASE WHEN len(list_distinct(list_concat(q.names, c.case_names))) = 0 THEN CAST(1 AS DOUBLE)
                  ELSE CAST(len(list_intersect(q.names, c.case_names)) AS DOUBLE)
                    / len(list_distinct(list_concat(q.names, c.case_names))) END AS similarity
              FROM {name}_sets q, (SELECT *, names AS case_names FROM {pool}) c)
            WHERE similarity >= 0.5) WHERE rn = 1)""",
    )


_CASE_TEXT = (
    "'[Local ML Fallback Model] Classified with ' || CAST(trunc(n.similarity * 100) AS INTEGER) || "
    "'% signal similarity based on historical behavioral patterns. Reference Rationale: ' || n.c_rationale"
)
POOL = """pool AS (SELECT *, score AS c_score, classification AS c_class, rationale AS c_rationale
  FROM state WHERE origin = 'model')"""
ORACLES["nearest_case"] = _with(
    *_STATE, *_DETECT, MISSING, ENTRIES, NAMED, POOL,
    "pool_named AS (SELECT *, employee AS case_employee, week AS case_week FROM pool)",
    *_nearest("named", "pool_named", "c_score, c_class, c_rationale, case_employee, case_week"),
    body=f"""SELECT q.employee, q.week, array_to_string(q.names, '|') AS names,
      CAST(trunc(n.similarity * 100) AS INTEGER) AS percent, n.case_employee, n.case_week,
      n.c_score AS case_score, n.c_class AS case_classification, {_CASE_TEXT} AS rationale
    FROM named q LEFT JOIN near n ON n.names = q.names""",
)
_CASE_BRIEFING = (
    "'[Local ML Fallback Briefing] (Matched ' || CAST(trunc({n}.similarity * 100) AS INTEGER) || "
    "'% similarity to historical behavioral patterns)' || chr(10) || chr(10) || {n}.c_briefing"
)
BRIEFING_POOL = "briefing_pool AS (SELECT *, briefing AS c_briefing FROM state WHERE coalesce(briefing, '') <> '')"
ORACLES["nearest_briefing"] = _with(
    *_STATE, BRIEFING_POOL,
    "wanted AS (SELECT employee, week, classification, list_filter(names, lambda x: x <> 'Quiet Week') AS names FROM state)",
    *_nearest("wanted", "briefing_pool", "c_briefing"),
    body=f"""SELECT q.employee, q.week, CASE WHEN q.classification <> 'Healthy' THEN
        coalesce({_CASE_BRIEFING.format(n='n')}, {_q(C.SAFE_BRIEFING)}) END AS briefing
    FROM wanted q LEFT JOIN near n ON n.names = q.names""",
)
ORACLES["nearest_document"] = r"""
  WITH s AS (
    SELECT doc_id, source, n_chars, list_distinct(list_filter(
      string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS names
    FROM documents),
  pairs AS (
    SELECT q.doc_id, p.doc_id AS near_id, p.source AS near_source, p.n_chars AS near_chars,
      len(list_intersect(q.names, p.names)) AS shared, len(q.names) + len(p.names) AS total
    FROM s q JOIN s p ON p.doc_id % 100 <> 0 WHERE q.doc_id % 100 = 0),
  ranked AS (
    SELECT *, CASE WHEN total = shared THEN 1.0::DOUBLE ELSE shared::DOUBLE / (total - shared) END AS similarity FROM pairs),
  near AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, near_source, near_id) AS rn
    FROM ranked WHERE similarity >= 0.5)
  SELECT s.doc_id, CAST(trunc(similarity * 100) AS INTEGER) AS percent, near_id, near_source, near_chars
  FROM s LEFT JOIN near n ON n.doc_id = s.doc_id AND rn = 1 WHERE s.doc_id % 100 = 0
"""
ORACLES["set_similarity"] = _with(
    *_STATE,
    "pairs AS (SELECT employee, week, names, lag(names) OVER (PARTITION BY employee ORDER BY week) AS before FROM state)",
    body="""SELECT employee, week, round(CASE WHEN len(list_distinct(list_concat(names, before))) = 0 THEN 1.0::DOUBLE
      ELSE CAST(len(list_intersect(names, before)) AS DOUBLE) / len(list_distinct(list_concat(names, before))) END, 6)
      AS similarity FROM pairs WHERE before IS NOT NULL""",
)

# --- text -----------------------------------------------------------------------


def _blocked(text: str, patterns: tuple[str, ...]) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({text}, {_q('(?im)' + p)}) THEN {_q(p)}" for p in patterns
    )
    return f"CASE {cases} END"


_CORPUS = (r"\bthe thing\b", r"\bund\b.*\bder\b", r"^Re\b", r"\bdes\b|\bles\b")
_PHRASE_SQL = (
    "a Performance Improvement Plan", "DISCIPLINARY action", "we monitored all activity",
    "under surveillance", "termination of employment", "no consequences", "a warning letter",
    "\nError: quota", "\nException: timeout", "Traceback (most recent call last)",
    "google.api_core.exceptions.Aborted", "supportive words", "monitored\nactivity", "multierror: x",
)
# RE2 borders know ASCII letters only; spell out "no letter or digit beside it".


def _blocked_unicode(text: str) -> str:
    before, after = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"
    checks = (
        before + "the thing" + after,
        before + "und(?:[^\\pL\\pN_\\n].*[^\\pL\\pN_\\n]|[^\\pL\\pN_\\n])der" + after,
        "^Re" + after,
        before + "(?:des|les)" + after,
    )
    cases = " ".join(
        f"WHEN regexp_matches({text}, {_q('(?im)' + c)}) THEN {_q(p)}" for c, p in zip(checks, _CORPUS)
    )
    return f"CASE {cases} END"


ORACLES["blocked_documents"] = f"SELECT doc_id, {_blocked_unicode('text')} AS blocked_by FROM documents"
ORACLES["screened_conversations"] = (
    f"SELECT conv_id, turn, {_blocked_unicode('text')} AS blocked_by FROM conversations"
)
_phrases = "[" + ", ".join(_q(p) for p in _PHRASE_SQL) + "]"
ORACLES["screened_texts"] = _with(
    f"t AS (SELECT doc_id, text || chr(10) || ({_phrases})[doc_id % {len(_PHRASE_SQL)} + 1] AS full_text FROM documents)",
    f"b AS (SELECT *, {_blocked('full_text', C.DENY_PATTERNS)} AS blocked_by FROM t)",
    body=f"SELECT doc_id, blocked_by, md5(CASE WHEN blocked_by IS NULL THEN full_text ELSE {_q(C.SAFE_BRIEFING)} END) AS text_md5 FROM b",
)
ORACLES["briefing_sections"] = _with(
    *_STATE,
    """t AS (SELECT employee, week, lower(coalesce(briefing, 'Stay in touch.')
        || CASE WHEN week % 2 = 0 THEN chr(10) || '2 Things NEVER to say: none' ELSE '' END
        || CASE WHEN score > 7 THEN chr(10) || 'Use the next 1-on-1.' ELSE '' END) AS b FROM state)""",
    body="SELECT employee, week, "
    + ", ".join(
        "(" + " OR ".join(f"contains(b, {_q(p)})" for p in phrases) + f") AS {name}"
        for name, phrases in C.BRIEFING_SECTIONS
    )
    + " FROM t",
)
ORACLES["shown_briefings"] = _with(
    *_STATE,
    body=f"SELECT employee, week, classification <> 'Healthy' AS flagged, coalesce(briefing, {_q(C.NO_BRIEFING_TEXT)}) AS briefing FROM state",
)
ORACLES["pseudonyms"] = (
    "SELECT c_custkey, 'session_employee_' || substr(sha256(lower(c_name)), 1, 12) || '_risk' AS session_id, "
    "lower(c_name) AS slug FROM customer"
)
ORACLES["cleaned_names"] = (
    "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'Unknown' ELSE split_part(p_type, ' ', 1) END AS first_token, "
    "upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS capitalised FROM part"
)
ORACLES["parsed_numbers"] = """
WITH w AS (SELECT event_id, event_id % 8 AS k, CAST(floor(value) AS BIGINT) AS v FROM events)
SELECT event_id,
  CASE k WHEN 0 THEN ' ' || v || ' ' WHEN 1 THEN v || '.0' WHEN 2 THEN '-1' || v WHEN 3 THEN v || 'd'
    WHEN 4 THEN 'n/a' WHEN 5 THEN '' WHEN 6 THEN v || 'e1' ELSE '+' || v END AS cell,
  CAST(CASE k WHEN 0 THEN v WHEN 2 THEN -CAST('1' || v AS BIGINT) WHEN 7 THEN v ELSE 0 END AS INTEGER) AS whole_or_zero,
  CAST(CASE k WHEN 0 THEN v WHEN 2 THEN -CAST('1' || v AS BIGINT) WHEN 7 THEN v END AS INTEGER) AS whole,
  CAST(CASE k WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN -CAST('1' || v AS BIGINT) WHEN 6 THEN v * 10 WHEN 7 THEN v ELSE 0 END AS DOUBLE)
    + CAST(0 AS DOUBLE) AS number
FROM w"""
ORACLES["observed_metrics"] = _with(
    *_EW_FULL,
    body="""SELECT employee, week, 'Anauser' AS name, completed_tasks AS tasks_completed,
      round(response_time, 0) AS avg_response_time, after_hours_logins, sick_days, weekly_hours,
      task_accuracy, sentiment FROM ew""",
)
ORACLES["extracted_metrics"] = _with(
    *_EW_FULL,
    body="""SELECT employee, week, 'U' || substr(employee, 2) AS name, completed_tasks AS tasks_completed,
      CAST(0 AS DOUBLE) AS avg_response_time, 0 AS after_hours_logins, sick_days,
      CASE WHEN week > 2 THEN weekly_hours ELSE 40 END AS weekly_hours, 95 AS task_accuracy,
      CASE WHEN week > 3 THEN sentiment ELSE 'Neutral' END AS sentiment FROM ew""",
)
ORACLES["resolved_headers"] = _with(
    *_EW_FULL,
    body="""SELECT employee, week, completed_tasks, round(response_time, 6) AS response_time, after_hours_logins,
      sick_days, CAST(NULL AS INTEGER) AS weekly_hours, task_accuracy, sentiment FROM ew""",
)

# --- files ----------------------------------------------------------------------

ORACLES["weekly_files"] = _with(
    *_EW_GAPS,
    body="""SELECT employee, week, completed_tasks,
      round(response_time, 6) AS response_time,
      CASE WHEN u % 2 = 0 THEN after_hours_logins ELSE 0 END AS after_hours_logins, sick_days, weekly_hours,
      CASE WHEN u % 2 = 0 THEN task_accuracy END AS task_accuracy, sentiment, source_file FROM ew""",
)
ORACLES["weekly_files_quoted"] = _with(
    *_EW_GAPS, body="SELECT employee, week, completed_tasks, weekly_hours, sentiment, source_file FROM ew"
)
ORACLES["weekly_files_strict"] = _with(
    *_EW_GAPS,
    body="""SELECT employee, week, CASE WHEN week = 2 THEN completed_tasks + 1 ELSE completed_tasks END AS completed_tasks,
      round(response_time, 6) AS response_time, after_hours_logins, sick_days, CAST(NULL AS INTEGER) AS weekly_hours,
      CAST(NULL AS INTEGER) AS task_accuracy, CAST(NULL AS VARCHAR) AS sentiment, source_file FROM ew""",
)
ORACLES["weekly_files_of_one_week"] = _with(
    *_EW_GAPS,
    body="SELECT employee, 9 AS week, count(*) AS n, CAST(sum(completed_tasks) AS BIGINT) AS tasks FROM ew GROUP BY employee",
)
ORACLES["pasted_stream"] = _with(
    *_EW_GAPS,
    """landed AS (SELECT employee, week FROM ew WHERE week < 3 OR week > 7
      UNION ALL SELECT split_part(r_name, ' ', 1), r_regionkey + 3 FROM region)""",
    """weeks AS (SELECT CAST(unnest(range(1, (SELECT max(week) FROM landed) + 1)) AS INTEGER) AS week)""",
    body=f"""SELECT e.employee, w.week, {C.DEFAULT_SCORE} AS score, {_q(C.DEFAULT_CLASS)} AS classification,
      'default' AS origin, (SELECT count(*) FROM landed l WHERE l.employee = e.employee AND l.week <= w.week) < w.week AS has_gap
    FROM (SELECT DISTINCT employee FROM landed) e, weeks w""",
)
ORACLES["pasted_weeks"] = _with(
    *_EW_GAPS,
    body="""SELECT week, count(*) AS employees, CAST(sum(completed_tasks) AS BIGINT) AS tasks, min(employee) AS first_name
      FROM ew WHERE week < 3 GROUP BY week
    UNION ALL SELECT r_regionkey + 3, 1, r_regionkey + 5, split_part(r_name, ' ', 1) FROM region""",
)
ORACLES["state_upsert"] = _with(
    *_STATE,
    "m AS (SELECT *, week >= 4 AS changed FROM state)",
    body=f"""SELECT 'main' AS scope, employee, week, CASE WHEN changed THEN 10 ELSE score END AS score,
      CASE WHEN changed THEN 'Silent Exit' ELSE classification END AS classification, healthy_streak, origin,
      {_NAMES} AS names FROM m
    UNION ALL SELECT 'realtime', employee, week, score, classification, healthy_streak, origin, {_NAMES}
      FROM state WHERE week <= 2""",
)
ORACLES["evaluation_documents"] = _with(
    *_STATE,
    body=f"""SELECT 'main' AS scope, 'U' || substr(employee, 2) AS employee, week, score, classification, rationale,
      healthy_streak, array_to_string(CASE WHEN has_gap THEN list_append(names, 'MISSING_DATA_GAP') ELSE names END, '|') AS shown,
      {_NAMES} AS names FROM state WHERE u % 10 NOT IN (3, 4, 5)""",
)
_SHOWN = "CASE WHEN len(names) > 0 THEN array_to_string(names, ', ') ELSE 'None' END"
_SHOWN_BRIEFING = f"coalesce(briefing, {_q(C.NO_BRIEFING_TEXT)})"
REPORT = f"""card_lines AS (
  SELECT employee, list_concat(list_concat(
    ['Employee      : ' || employee, printf('Score         : %d/10', score),
     'Classification: ' || classification, 'Rationale     : ' || rationale, 'Signals:'],
    list_transform(names, lambda n: '  [medium] ' || n)),
    list_concat(list_concat(['Manager Briefing:'], string_split({_SHOWN_BRIEFING}, chr(10))), [{_q('-' * 72)}])) AS lines
  FROM latest WHERE classification <> 'Healthy'),
sections AS (
  SELECT 1 AS section, employee, [printf('%-12s %5d  %-14s  %s', employee, score, classification, {_SHOWN})] AS lines FROM latest
  UNION ALL SELECT 2, employee, lines FROM card_lines
  UNION ALL SELECT 3, employee, list(printf('%-35s  score=%d  class=%s', employee || '_week' || week, score, classification) ORDER BY week)
    FROM state GROUP BY employee),
report AS (
  SELECT section, employee, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS ord, unnest(lines) AS line FROM sections)"""
ORACLES["report_rows"] = _with(*_STATE, LATEST, REPORT, body="SELECT * FROM report")
ORACLES["report_file"] = _with(
    *_STATE, LATEST, REPORT,
    body="""SELECT row_number() OVER (ORDER BY section, employee, ord) AS n, line FROM (
      SELECT section, employee, ord, line FROM report
      UNION ALL VALUES (1, '', -1, 'TEAM SUMMARY'), (2, '', -1, 'INDIVIDUAL RISK CARDS'),
        (3, '', -1, 'STORED EVALUATIONS'), (9, '', 0, 'end of report'))""",
)

# --- read models ----------------------------------------------------------------

ORACLES["employee_status"] = _with(
    *_STATE, LATEST,
    "h AS (SELECT employee, string_agg(week || ':' || score || ':' || classification, '|' ORDER BY week) AS history FROM state GROUP BY employee)",
    body=f"""SELECT 'U' || substr(l.employee, 2) AS name, score, classification, rationale, week AS latest_week,
      {_NAMES} AS names, history FROM latest l JOIN h ON h.employee = l.employee""",
)
ORACLES["briefing_lookup"] = _with(
    *_STATE, LATEST,
    """req AS (SELECT DISTINCT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'main' ELSE 'realtime' END AS scope FROM customer)""",
    body=f"""SELECT ' USER_' || k || ' ' AS name, scope, l.briefing IS NOT NULL AS found,
      coalesce(l.briefing, {_q(C.BRIEFING_NOT_FOUND_TEXT)}) AS briefing
    FROM req LEFT JOIN latest l ON l.u = req.k AND scope = 'main'""",
)
ORACLES["team_summary"] = _with(
    *_STATE, LATEST,
    body=f"SELECT employee, score, {_badge('classification')} AS badge, substr({_SHOWN}, 1, 50) AS signals FROM latest",
)
ORACLES["risk_cards"] = _with(
    *_STATE, LATEST,
    body=f"""SELECT employee, score, {_badge('classification')} AS badge, classification, substr(rationale, 1, 90) AS rationale,
      coalesce(array_to_string(list_transform(names, lambda n: '[medium] ' || n), '|'), '') AS signals,
      {_SHOWN_BRIEFING} AS briefing FROM latest WHERE classification <> 'Healthy'""",
)
ORACLES["cohort_overview"] = _with(
    *_STATE, LATEST,
    body="""SELECT classification, count(*) AS employees, round(avg(score), 6) AS avg_score,
      CAST(sum(len(names)) AS BIGINT) AS signals FROM latest GROUP BY classification""",
)
ORACLES["cohort_payload"] = _with(
    *_STATE, LATEST,
    body=f"""SELECT employee, CAST(score AS VARCHAR) AS score, classification, {_SHOWN_BRIEFING} AS briefing,
      names[1] AS first_signal FROM latest""",
)
ORACLES["report_previews"] = (
    "SELECT doc_id, length(substr(text, 1, 2000)) + 3 AS n, md5(substr(text, 1, 2000) || '...') AS md5 FROM documents"
)
ORACLES["evaluations_to_do"] = _with(
    *_STATE, TL,
    body="""SELECT employee, week FROM spine
    EXCEPT SELECT employee, week FROM state WHERE week <= 2""",
)
ORACLES["briefings_to_repair"] = _with(
    *_STATE,
    body="SELECT employee, week, classification FROM state WHERE classification <> 'Healthy' AND briefing IS NULL",
)
ORACLES["recent_history"] = _with(
    *_STATE,
    body="SELECT employee, week, score FROM state WHERE evaluated_at >= TIMESTAMP '2024-02-05' - INTERVAL 84 DAY",
)

# --- evaluation run -------------------------------------------------------------


def _run(stored: str, earlier: str = "week <= 2") -> tuple[str, ...]:
    return (
        f"earlier AS (SELECT * FROM state WHERE {earlier})",
        f"kept AS (SELECT * FROM earlier WHERE {stored})",
        "run_pool AS (SELECT *, score AS c_score, classification AS c_class, rationale AS c_rationale FROM earlier WHERE origin = 'model')",
        "run_briefings AS (SELECT *, briefing AS c_briefing FROM earlier WHERE coalesce(briefing, '') <> '')",
        *_nearest("named", "run_pool", "c_score, c_class, c_rationale"),
        *_nearest("named", "run_briefings", "c_briefing", "nearb"),
        f"""base AS (
          SELECT q.employee, q.week, k.employee IS NOT NULL AS stored,
            coalesce(k.healthy_streak, 0) AS stored_streak,
            CASE WHEN k.employee IS NULL THEN true ELSE k.evaluated_at >= TIMESTAMP '2024-02-05' - INTERVAL 84 DAY END AS in_history,
            CASE WHEN k.employee IS NOT NULL THEN k.origin WHEN a.kind NOT IN (0, 3) THEN 'model'
              WHEN n.similarity IS NOT NULL THEN 'case' ELSE 'default' END AS origin,
            CASE WHEN k.employee IS NOT NULL THEN k.score WHEN a.kind NOT IN (0, 3) THEN a.score
              WHEN n.similarity IS NOT NULL THEN n.c_score ELSE 4 END AS base_score,
            CASE WHEN k.employee IS NOT NULL THEN k.classification WHEN a.kind NOT IN (0, 3) THEN a.classification
              WHEN n.similarity IS NOT NULL THEN n.c_class ELSE 'Watch' END AS base_class,
            CASE WHEN k.employee IS NOT NULL THEN k.rationale WHEN a.kind NOT IN (0, 3) THEN a.rationale
              WHEN n.similarity IS NOT NULL THEN {_CASE_TEXT} ELSE {_q(C.DEFAULT_RATIONALE)} END AS base_rationale
          FROM named q
          LEFT JOIN kept k ON k.employee = q.employee AND k.week = q.week
          LEFT JOIN answers a ON a.employee = q.employee AND a.week = q.week
          LEFT JOIN near n ON n.names = q.names)""",
    )


def _run_body(columns: str) -> str:
    return f"""SELECT {columns} FROM (
      SELECT f.employee, f.week, f.score, f.classification, f.rationale, f.healthy_streak, f.origin,
        CASE WHEN upper(f.classification) IN ('WATCH', 'AT RISK', 'SILENT EXIT') THEN
          coalesce({_CASE_BRIEFING.format(n='b')}, {_q(C.SAFE_BRIEFING)}) ELSE '' END AS briefing,
        array_to_string(q.names, '|') AS names,
        CASE WHEN m.missing <> '' THEN 1 ELSE 0 END AS gap_markers
      FROM fold f
      JOIN named q ON q.employee = f.employee AND q.week = f.week
      JOIN missing m ON m.employee = f.employee AND m.week = f.week
      LEFT JOIN nearb b ON b.names = q.names
      LEFT JOIN earlier s ON s.employee = f.employee AND s.week = f.week
      WHERE NOT f.stored OR (f.classification <> 'Healthy' AND coalesce(s.briefing, '') = ''))"""


ORACLES["evaluation_run"] = _with(
    *_STATE, ANSWERS, *_DETECT, MISSING, ENTRIES, NAMED, *_run("true"), *_fold(_STORED_GROWTH),
    body=_run_body("*"), recursive=True,
)
ORACLES["evaluation_run_all_answers"] = _with(
    *_STATE, ANSWERS, *_DETECT, MISSING, ENTRIES, NAMED, *_run("true"), *_fold(_STORED_GROWTH),
    body=f"""SELECT r.employee, r.week, r.score, r.classification, r.origin, r.names,
      CASE WHEN r.briefing = '' OR a.employee IS NULL OR r.u % 3 = 2 THEN r.briefing
        WHEN r.u % 3 = 1 THEN {_q(C.SAFE_BRIEFING)} ELSE 'A talk with ' || r.employee || ' in w' || r.week END AS briefing,
      CASE WHEN contains(r.names, 'Burnout Risk') AND a.employee IS NOT NULL AND r.u % 2 = 0 THEN 'seen w' || r.week ELSE '' END AS details
    FROM (SELECT *, CAST(substr(employee, 6) AS INTEGER) AS u FROM ("""
    + _run_body("*")
    + """)) r LEFT JOIN answers a ON a.employee = r.employee AND a.week = r.week""",
    recursive=True,
)
ORACLES["evaluation_run_recomputed"] = _with(
    *_STATE, ANSWERS, *_DETECT, MISSING, ENTRIES, NAMED, *_run("week < 2"), *_fold(_STORED_GROWTH),
    body=_run_body("employee, week, score, classification, healthy_streak, origin"), recursive=True,
)
ORACLES["realtime_files"] = _with(
    *_STATE, ANSWERS, *_DETECT, MISSING, ENTRIES, NAMED, *_run("true", "false"), *_fold(_STORED_GROWTH),
    body="SELECT 'realtime' AS scope, r.* FROM ("
    + _run_body("employee, week, score, classification, rationale, healthy_streak, origin, names")
    + ") r",
    recursive=True,
)
ORACLES["late_weeks_redone"] = _with(
    *_STATE, ANSWERS, *_DETECT, MISSING, ENTRIES, NAMED, *_run("true", "false"), *_fold(_STORED_GROWTH),
    "came_late AS (SELECT employee FROM ew WHERE week = 3 AND u % 3 = 1)",
    body="SELECT employee, week, redone, names, "
    + ", ".join(f"CASE WHEN NOT redone THEN {c} END AS {c}" for c in ("score", "classification", "healthy_streak", "origin"))
    + " FROM (SELECT r.*, r.week >= 3 AND r.employee IN (SELECT employee FROM came_late) AS redone FROM ("
    + _run_body("employee, week, score, classification, healthy_streak, origin, names")
    + ") r) x",
    recursive=True,
)
ORACLES["history_summaries"] = _with(
    *_STATE,
    """h AS (SELECT s.employee, s.week, count(p.week) AS weeks,
        coalesce(string_agg('{"week_file":"' || p.employee || '_week' || p.week || '.json","score":' || p.score
          || ',"classification":"' || p.classification || '"}', ',' ORDER BY p.week), '') AS items
      FROM state s LEFT JOIN state p ON p.employee = s.employee AND p.week < s.week GROUP BY s.employee, s.week)""",
    body="SELECT employee, week, CAST(weeks AS INTEGER) AS weeks, '[' || items || ']' AS history FROM h",
)
_SESSION = "'session_employee_' || substr(sha256(lower({e})), 1, 12) || '_{s}'"
ORACLES["model_prompts"] = _with(
    *_STATE, ANSWERS, *_DETECT, MISSING,
    "hist AS (SELECT s.employee, s.week FROM state s WHERE EXISTS (SELECT 1 FROM state p WHERE p.employee = s.employee AND p.week < s.week))",
    f"""answer_text AS (SELECT employee, week, CASE kind WHEN 0 THEN 'service unavailable'
        WHEN 1 THEN '```json' || chr(10) || doc || chr(10) || '```' WHEN 2 THEN '```' || doc || '```  '
        WHEN 3 THEN 'Here it is: ' || doc || ' - done' ELSE doc END AS answer
      FROM (SELECT *, '{{"score": "' || score || '", "classification": "' || classification || '", "rationale": "' || rationale || '"}}' AS doc FROM answers))""",
    body=f"""SELECT 'trend' AS kind, employee, week, {_SESSION.format(e='employee', s='trends')} AS session_id,
        CAST(NULL AS VARCHAR) AS briefing_prompt, false AS has_history, CAST(NULL AS VARCHAR) AS answer
      FROM (SELECT DISTINCT employee, week FROM signals)
    UNION ALL
    SELECT 'risk', t.employee, t.week, {_SESSION.format(e='t.employee', s='risk')}, NULL, h.week IS NOT NULL, a.answer
      FROM tl t LEFT JOIN hist h ON h.employee = t.employee AND h.week = t.week
      LEFT JOIN answer_text a ON a.employee = t.employee AND a.week = t.week
    UNION ALL
    SELECT 'briefing', employee, week, {_SESSION.format(e='employee', s='briefing')},
      'Write a manager briefing. First name: ' || employee || chr(10) || 'Class: ' || classification || ', score ' || score
        || ' of 10' || chr(10) || 'Reason: ' || rationale || chr(10) || 'Signals:' || chr(10)
        || coalesce(array_to_string(list_concat(list_transform(names, lambda n: '- ' || n || ' (medium): '),
             CASE WHEN has_gap THEN ['- MISSING_DATA_GAP (low): gap'] ELSE [] END), chr(10)), ''),
      false, NULL FROM state WHERE classification <> 'Healthy'""",
)

# --- model logs -----------------------------------------------------------------

LOGS = """logs AS (
  SELECT conv_id, turn, role, c.copy, conv_id || '-' || turn || '#' || c.copy AS insert_id,
    1704067200 + conv_id * 1000 + turn * 10 + c.copy AS ts,
    CASE WHEN conv_id % 5 <> 0 THEN 'c' || conv_id END AS conversation_id,
    't' || conv_id || '-' || turn AS trace, 's1' AS span_id,
    CAST(turn * 10 AS VARCHAR) AS usage_input_tokens, CAST(length(text) AS VARCHAR) AS usage_output_tokens,
    'u' || (conv_id % 50) AS user_id
  FROM conversations, (SELECT unnest([0, 1]) AS copy) c
  WHERE role <> 'user' AND (c.copy = 0 OR turn % 3 = 0)),
refs AS (
  SELECT *, 'output' AS message_type, 'gs://messages/' || conv_id || '-' || turn || '_output.jsonl' AS uri
    FROM logs WHERE role = 'assistant'
  UNION ALL
  SELECT *, 'input', 'gs://messages/' || conv_id || '-' || turn || '_input.jsonl'
    FROM logs WHERE role = 'assistant' AND turn > 0)"""
PARTS = """parts AS (
  SELECT r.*, CASE WHEN m.conv_id % 13 <> 12 THEN m.role END AS m_role, m.turn AS message_idx,
    CAST(p.part_idx AS INTEGER) AS part_idx, p.part_idx = 1 AS is_blob,
    CASE WHEN p.part_idx = 0 THEN m.text END AS content,
    CASE WHEN p.part_idx = 1 THEN md5('data-' || m.conv_id) END AS data_md5_hex
  FROM refs r
  JOIN conversations m ON m.conv_id = r.conv_id AND (
    (r.message_type = 'output' AND m.turn = r.turn)
    OR (r.message_type = 'input' AND m.turn < r.turn))
  JOIN (SELECT unnest([0, 1]) AS part_idx) p ON m.conv_id % 11 <> 10 AND (p.part_idx = 0 OR m.turn % 4 = 2))"""
SPAN = """span_copies AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id, trace, span_id, message_type, m_role, message_idx, part_idx
    ORDER BY ts DESC, insert_id, uri) AS row_num FROM parts),
across AS (
  SELECT *, CASE WHEN message_type = 'input' THEN row_number() OVER (
      PARTITION BY conversation_id, message_type, m_role, message_idx, part_idx ORDER BY ts ASC, insert_id, uri)
    ELSE 1 END AS cross_num FROM span_copies WHERE row_num = 1)"""
ORACLES["message_refs"] = _with(
    LOGS,
    body="""SELECT insert_id, ts, conversation_id, message_type, uri AS messages_ref_uri, conv_id || '-' || turn AS api_call_id,
      usage_input_tokens, user_id FROM refs""",
)
ORACLES["message_parts"] = _with(
    LOGS, PARTS,
    body="""SELECT insert_id, message_type, m_role AS role, message_idx, part_idx,
      CASE WHEN is_blob THEN 'blob' ELSE 'text' END AS part_type, CAST(length(content) AS INTEGER) AS chars, data_md5_hex FROM parts""",
)
ORACLES["latest_part_in_span"] = _with(
    LOGS, PARTS, SPAN,
    body="SELECT insert_id, conversation_id, trace, message_type, m_role AS role, message_idx, part_idx FROM span_copies WHERE row_num = 1",
)
_VIEW_BODY = """SELECT ts AS timestamp, insert_id, trace, span_id, conversation_id, conv_id || '-' || turn AS api_call_id,
      message_type, m_role AS role, message_idx, part_idx, content, CASE WHEN is_blob THEN 'blob' ELSE 'text' END AS part_type,
      CAST(NULL AS VARCHAR) AS tool_name, CAST(NULL AS VARCHAR) AS tool_args, CAST(NULL AS VARCHAR) AS tool_response,
      usage_input_tokens, usage_output_tokens, 'assistant' AS agent_name, 'stop' AS finish_reasons, user_id,
      CAST(NULL AS VARCHAR) AS uri, CAST(NULL AS VARCHAR) AS mime_type, data_md5_hex, uri AS messages_ref_uri
    FROM across WHERE cross_num = 1 AND NOT (message_type = 'input' AND m_role = 'assistant')
    ORDER BY conversation_id ASC NULLS FIRST, timestamp ASC NULLS FIRST, message_type, message_idx, part_idx"""
ORACLES["completions_view"] = _with(LOGS, PARTS, SPAN, body=_VIEW_BODY)
ORACLES["view_day_by_day"] = ORACLES["completions_view"]
ORACLES["stored_view_of_one_day"] = _with(
    LOGS.replace("FROM logs WHERE", "FROM logs WHERE ts >= 1704153600 AND ts < 1704240000 AND"),
    PARTS, SPAN, body=_VIEW_BODY,
)
ORACLES["routed_entries"] = _with(
    LOGS,
    body="""SELECT 'inference' AS route, insert_id AS "insertId" FROM logs
      WHERE role = 'assistant' AND contains('gs://messages/' || conv_id || '-' || turn || '_output.jsonl', '1-')
    UNION ALL SELECT 'feedback', insert_id FROM logs WHERE user_id LIKE '%7'
    UNION ALL SELECT 'other', insert_id FROM logs WHERE role <> 'assistant'""",
)
ORACLES["routed_logs"] = _with(
    LOGS,
    body="""SELECT insert_id AS "insertId", 'projects/demo/logs/gen_ai.client.inference.operation.details' AS "logName"
      FROM logs WHERE role = 'assistant' AND contains('gs://messages/' || conv_id || '-' || turn || '_output.jsonl', '1-')""",
)
ORACLES["stored_completions"] = _with(
    LOGS,
    body="""SELECT 'logs' AS what, count(*) AS n, count(DISTINCT trace) AS traces FROM logs WHERE ts >= 1704153600
    UNION ALL SELECT 'messages', sum(1 + last_turn - turn)::BIGINT, count(DISTINCT CASE WHEN conv_id % 11 <> 10 THEN md5(text) END)
      FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations)""",
)
ORACLES["feedback_rows"] = """
SELECT CAST(1 + quality * 3 + toxic AS DOUBLE) AS score, CASE WHEN toxic = 1 THEN 'rude' ELSE '' END AS text,
  'feedback' AS log_type, 'engine' AS service_name, 'u' || doc_id AS user_id, true AS has_session
FROM labels WHERE quality + toxic > 0 AND doc_id % 5 <> 0"""

# --- counters, grades, cases ----------------------------------------------------

ORACLES["call_outcomes"] = """
SELECT 'model_' || (user_id % 5) AS model, count(*) FILTER (event_type <> 'error') AS success,
  count(*) FILTER (event_type = 'error') AS rejected FROM events GROUP BY 1
UNION ALL SELECT 'all', count(*) FILTER (event_type <> 'error'), count(*) FILTER (event_type = 'error') FROM events"""
ORACLES["turn_counts"] = "SELECT conv_id, count(*) AS score FROM conversations GROUP BY conv_id"
GRADED = """graded AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 2 = 0 THEN 'quality' ELSE 'tone' END AS metric,
  CASE WHEN doc_id % 9 > 1 THEN CAST(1 + quality * 3 + toxic AS INTEGER) END AS grade FROM labels)"""
ORACLES["grade_summary"] = _with(
    GRADED,
    body="""SELECT metric, count(grade) AS graded, count(*) FILTER (grade IS NULL) AS invalid,
      round(avg(grade), 6) AS avg_grade, min(grade) AS min_grade, max(grade) AS max_grade FROM graded GROUP BY metric""",
)
ORACLES["grade_comparison"] = _with(
    GRADED,
    """cand AS (SELECT doc_id AS case_id, CASE WHEN lang = 'en' THEN 'quality' ELSE 'tone' END AS metric,
      CAST(least(1 + floor(n_chars / 500), 5) AS INTEGER) AS grade FROM documents)""",
    body="""SELECT coalesce(b.case_id, c.case_id) AS case_id, coalesce(b.metric, c.metric) AS metric,
      b.grade AS base_grade, c.grade AS candidate_grade, c.grade - b.grade AS difference
    FROM graded b FULL JOIN cand c ON b.case_id = c.case_id AND b.metric = c.metric""",
)
ORACLES["evaluation_cases"] = """
SELECT conv_id || '-' || turn AS case_id, CASE WHEN conv_id % 2 = 0 THEN 'prompt' ELSE 'turns' END AS shape,
  md5(text) AS message_md5, CAST(2 * (conv_id % 2) AS INTEGER) AS turn_count,
  CASE WHEN conv_id % 2 = 0 THEN '' ELSE '0:0:' || role || ' 0:1:agent 1:0:agent 1:1:' || role END AS events FROM conversations"""
