"""Thresholds, labels and texts that decide results."""

# Signal names, in name order (the order signals are listed in).
BASELINE_MISSING = "Baseline Week Missing"
BURNOUT = "Burnout Risk"
TASKS = "Declining Task Completion"
AFTER_HOURS = "Excessive After-Hours Logins"
SICK = "Increasing Sick Days"
LOW_ACTIVITY = "Low Activity"
QUALITY = "Quality Degradation"
RESPONSE = "Response Time Spike"
WITHDRAWN = "Withdrawn Communication"

DETECTED_SIGNALS = (
    BURNOUT,
    TASKS,
    AFTER_HOURS,
    SICK,
    LOW_ACTIVITY,
    QUALITY,
    RESPONSE,
    WITHDRAWN,
)
SIGNAL_VOCABULARY = (BASELINE_MISSING, *DETECTED_SIGNALS)
GAP_MARKER = "MISSING_DATA_GAP"

# Flag thresholds.
TASK_DROP_FLAG = 0.20
RESPONSE_RISE_FLAG = 0.50
AFTER_HOURS_FLAG = 2
SICK_DAYS_MARGIN = 1
ACCURACY_FLAG = 85
LOW_HOURS_FLAG = 30
HIGH_HOURS_FLAG = 50
WITHDRAWN_WORD = "withdrawn"

# Severity cuts: (high, medium).
TASK_DROP_CUTS = (0.40, 0.20)  # at or above
RESPONSE_RISE_CUTS = (1.0, 0.5)  # at or above
AFTER_HOURS_CUTS = (6, 4)  # at or above
SICK_RISE_CUTS = (3, 2)  # at or above
ACCURACY_CUTS = (70, 80)  # below
LOW_HOURS_CUTS = (20, 25)  # below
HIGH_HOURS_CUTS = (60, 55)  # above
ACCURACY_WHEN_ZERO = 100
HOURS_WHEN_ZERO = 40

# Risk classes and score rules.
HEALTHY, WATCH, AT_RISK, SILENT_EXIT = "Healthy", "Watch", "At Risk", "Silent Exit"
CLASS_CUTS = ((8, SILENT_EXIT), (6, AT_RISK), (4, WATCH))
ELEVATED_CLASSES = ("WATCH", "AT RISK", "SILENT EXIT")
BADGES = (
    (HEALTHY, "[HEALTHY]"),
    (WATCH, "[WATCH]"),
    (AT_RISK, "[AT RISK]"),
    (SILENT_EXIT, "[SILENT EXIT]"),
)
MAX_SCORE = 10
ELEVATED_WEEKS_FOR_BONUS = 2
HEALTHY_WEEKS_TO_CLEAR = 4
HISTORY_DAYS = 84  # 12 weeks
SIMILARITY_FLOOR = 0.5
DEFAULT_SCORE, DEFAULT_CLASS = 4, WATCH
STATUS_SCORE, STATUS_CLASS = 1, HEALTHY

# Fixed texts.
DEFAULT_RATIONALE = (
    "Evaluation could not be completed via APIs. Defaulted to Watch classification "
    "as no highly similar training patterns were found in local history."
)
CASE_RATIONALE_FORMAT = (
    "[Local ML Fallback Model] Classified with %d%% signal similarity "
    "based on historical behavioral patterns. Reference Rationale: %s"
)
CASE_BRIEFING_FORMAT = (
    "[Local ML Fallback Briefing] (Matched %d%% similarity to "
    "historical behavioral patterns)\n\n%s"
)
RECURRENCE_NOTE_FORMAT = (
    " [Recurrence adjustment applied: score increased from %d to %d.]"
)
ROW_ERROR_FORMAT = "Scoring unavailable due to error in week %d."
GAP_DETAILS_FORMAT = (
    "Missing data for week(s): [%s]. Handled as data gap, not disengagement."
)
NO_BRIEFING_TEXT = "No briefing required (Healthy status)."
BRIEFING_NOT_FOUND_TEXT = "No individual briefing card found for this employee."
SAFE_BRIEFING_MARK = "A temporary issue prevented a detailed briefing"
SAFE_BRIEFING = (
    "Manager Briefing:\n"
    "A temporary issue prevented a detailed briefing from being generated. "
    "Please conduct the next 1-on-1 using open, supportive questions -- for example: "
    "'How are you finding your current workload?' or 'Is there anything I can do to "
    "better support you right now?' Focus on listening and removing obstacles rather "
    "than drawing conclusions from metrics alone."
)

# Unsafe-text patterns; matched case-insensitively, "^" at any line start.
DENY_PATTERNS = (
    r"performance improvement plan",
    r"\bdisciplinar(y|ied|ies)\b",
    r"\bmonitor(ed|ing|s)?\b.*\bactivity\b",
    r"\bsurveillance\b",
    r"\bterminate\b|\btermination\b",
    r"\bconsequence[s]?\b",
    r"\bwarning letter\b",
    r"^Error:",
    r"^Exception:",
    r"Traceback \(most recent call last\)",
    r"google\.api_core\.exceptions\.",
)

# Lower-case text that every match of the pattern contains.
DENY_PATTERN_WORDS = dict(
    zip(
        DENY_PATTERNS,
        (
            "performance improvement plan",
            "disciplinar",
            "monitor",
            "surveillance",
            "terminat",
            "consequence",
            "warning letter",
            "error:",
            "exception:",
            "traceback (most recent call last)",
            "google.api_core.exceptions.",
        ),
    )
)

# Briefing sections and the phrases that show them.
BRIEFING_SECTIONS = (
    (
        "has_actions",
        ("evidence-based actions", "evidence based actions", "actions"),
    ),
    (
        "has_supportive",
        ("things to say", "supportive", "1-on-1", "one-on-one"),
    ),
    ("has_observation", ("pre-meeting", "observation")),
    ("has_never_say", ("never to say", "never say")),
)

# Header spellings accepted for each metric.
COLUMN_ALIASES = {
    "name": (
        "employee_name",
        "name",
        "first_name",
        "employee",
        "username",
        "user",
        "first name",
        "employee name",
    ),
    "tasks_completed": (
        "tasks_completed",
        "completed_tasks",
        "tasks",
        "completed",
        "task_count",
        "tasks completed",
        "completed tasks",
    ),
    "avg_response_time": (
        "avg_response_time_hours",
        "response_time",
        "avg_response_time",
        "response_time_hours",
        "latency",
        "average response time",
        "response time",
    ),
    "after_hours_logins": (
        "after_hours_logins",
        "after_hours",
        "logins",
        "after hours logins",
        "night_logins",
        "after-hours",
        "afterhours",
    ),
    "sick_days": (
        "sick_days",
        "sick_leaves",
        "sick",
        "absences",
        "sick days",
        "leaves",
        "absent",
    ),
    "weekly_hours": (
        "weekly_hours",
        "hours_worked",
        "hours",
        "weekly hours",
        "work hours",
        "logged_hours",
    ),
    "task_accuracy": (
        "task_accuracy",
        "accuracy",
        "quality",
        "accuracy_score",
        "task accuracy",
        "quality_score",
    ),
    "sentiment": (
        "sentiment",
        "tone",
        "response_tone",
        "attitude",
        "communication_sentiment",
        "morale",
    ),
}

# Exact headers accepted by the strict loader; empty cells fall through.
STRICT_COLUMNS = {
    "name": ("employee_name", "name", "first_name"),
    "tasks_completed": ("tasks_completed", "completed_tasks"),
    "avg_response_time": ("avg_response_time_hours", "response_time"),
    "after_hours_logins": ("after_hours_logins",),
    "sick_days": ("sick_days",),
}

# Words that stand for a metric in a free-text observation ("sick days" is our own).
OBSERVATION_WORDS = {
    "sick_days": ("holiday", "absences", "leaves", "days off", "vacation", "sick days"),
    "weekly_hours": ("worked", "spent", "only for"),
    "after_hours_logins": ("worked everyday", "night logins", "late logins", "after-hours"),
    "task_accuracy": ("accuracy", "quality", "score", "performance accuracy"),
    "avg_response_time": ("latency", "response", "delay", "avg response", "response speed"),
}
OBSERVED_HOURS, OBSERVED_ACCURACY, OBSERVED_SENTIMENT = 40, 95, "Neutral"
