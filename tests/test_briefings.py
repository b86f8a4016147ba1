import pytest
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions.screening import blocked_by, screen, with_blocked_by
from tidemark.operators import briefing

SUPPORTIVE = (
    "Signals Detected: Declining task completion over 3 weeks.\n"
    "Pre-Meeting Observation: Notice energy levels and tone in team meetings.\n"
    "3 Supportive Things to Say:\n"
    "  1. 'How are you finding your current workload?'\n"
    "2 Things Never to Say:\n"
    "  1. 'Your numbers have dropped.'"
)
BLOCKED = [
    ("You should consider a Performance Improvement Plan.", 0),
    ("A disciplinary meeting should be scheduled.", 1),
    ("DISCIPLINARY action is recommended.", 1),
    ("We are Monitoring all her activity", 2),
    ("Consider enabling surveillance on the workstation.", 3),
    ("You may need to consider termination of employment.", 4),
    ("There will be Consequences.", 5),
    ("Send a warning letter", 6),
    ("Error: API quota exceeded.\nPlease try again later.", 7),
    ("fine\nexception: timeout", 8),
    ("x Traceback (most recent call last) y", 9),
    ("google.api_core.exceptions.NotFound", 10),
]
PASSED = [
    SUPPORTIVE, C.SAFE_BRIEFING, "monitored\nactivity", "note\rError: x", "note Error: x", "terminated",
    "éterminate", "googleXapi_core.exceptions.", "put on a PIP", "",
]


def scan(spark, text, column):
    return spark.createDataFrame([(text,)], "t STRING").select(column.alias("v")).first().v


@pytest.mark.parametrize("text, pattern", BLOCKED)
def test_blocked(spark, text, pattern):
    assert scan(spark, text, blocked_by(F.col("t"))) == C.DENY_PATTERNS[pattern]
    assert scan(spark, text, screen(F.col("t"))) == C.SAFE_BRIEFING


@pytest.mark.parametrize("text", PASSED)
def test_passed(spark, text):
    assert scan(spark, text, screen(F.col("t"))) == text


def test_scan_of_rows(spark):
    """The scan with word hints equals running every pattern, odd letters included."""
    odd = ["\u017furveillance", "term\u0131nate", "TERM\u0130NATE", "terminate\u212a", "\u212a terminate", "Con\u017fequence"]
    texts = [t for t, _ in BLOCKED] + PASSED + odd + [None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, text STRING")
    plain = {r.i: r.b for r in frame.select("i", blocked_by(F.col("text")).alias("b")).collect()}
    assert {r.i: r.blocked_by for r in with_blocked_by(frame).collect()} == plain
    assert plain[len(BLOCKED) + len(PASSED)] == C.DENY_PATTERNS[3]
    assert set(C.DENY_PATTERN_WORDS) == set(C.DENY_PATTERNS)


def test_extra_pattern(spark):
    assert scan(spark, "put on a PIP", screen(F.col("t"), (*C.DENY_PATTERNS, r"\bpip\b"))) == C.SAFE_BRIEFING


def test_choice(spark):
    schema = "id INT, classification STRING, briefing_text STRING, past_similarity DOUBLE, past_briefing STRING"
    frame = spark.createDataFrame(
        [(1, "Watch", "hello", 1.0, "old"), (2, "at risk", None, 0.5, "old"), (3, "Silent Exit", None, None, None),
         (4, "Healthy", "hello", 1.0, "old"), (5, "Watch", "surveillance", 1.0, "old"), (6, "Watch", None, 1.0, "termination")], schema)
    got = {r.id: r.briefing for r in briefing.choose_briefing(frame).collect()}
    assert got[1] == "hello" and got[3] == got[5] == got[6] == C.SAFE_BRIEFING and got[4] is None
    assert got[2] == "[Local ML Fallback Briefing] (Matched 50% similarity to historical behavioral patterns)\n\nold"


def test_sections(spark):
    frame = spark.createDataFrame([(SUPPORTIVE,), ("Evidence-Based ACTIONS",)], "b STRING")
    got = [tuple(r) for r in frame.select(*[c.alias(n) for n, c in briefing.section_checks(F.col("b")).items()]).collect()]
    assert got == [(False, True, True, True), (True, False, False, False)]


def test_repair(spark):
    frame = spark.createDataFrame([("Watch", None), ("Watch", ""), ("Watch", "x"), ("healthy", None), ("", None)], "classification STRING, briefing STRING")
    assert briefing.needs_repair(frame).count() == 3
