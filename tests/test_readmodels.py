import json

from pyspark.sql import functions as F

from conftest import rows
from test_state import evaluation
from tidemark import constants as C
from tidemark.operators import grading, prompts, readmodels
from tidemark.schemas import EVALUATION
from tidemark.sources import evalset, reports


def state(spark):
    frame = spark.createDataFrame(
        [evaluation("ana", 2, 3, "Healthy", briefing=None), evaluation("ana", 10, 7, "At Risk", signals=("Low Activity", "Burnout Risk")),
         evaluation("bo", 1, None, None, briefing="")], EVALUATION)
    gap = F.array(F.struct(F.lit("gap").alias("kind"), F.lit(C.GAP_MARKER).alias("signal_name"), F.array().cast("array<int>").alias("weeks_detected"),
                           F.lit("low").alias("severity"), F.lit("d").alias("details")))
    return frame.withColumn("signals", F.concat("signals", gap))


def test_status(spark):
    got = {r.name: r for r in readmodels.employee_status(state(spark)).collect()}
    assert (got["Ana"].latest_week, got["Ana"].score, got["Ana"].classification) == (10, 7, "At Risk")
    assert [tuple(h) for h in got["Ana"].history] == [(2, 3, "Healthy"), (10, 7, "At Risk")]
    assert (got["Bo"].score, got["Bo"].classification) == (1, "Healthy")


def test_briefing_lookup(spark):
    wanted = spark.createDataFrame([(" ANA ", "main"), ("Bo", "main"), ("ana", "realtime"), ("eve", "main")], "name STRING, scope STRING")
    got = {(r.name.strip(), r.scope): (r.found, r.briefing) for r in readmodels.latest_briefing(state(spark), wanted).collect()}
    assert got["ANA", "main"] == (True, "b")
    assert got["Bo", "main"] == got["ana", "realtime"] == got["eve", "main"] == (False, C.BRIEFING_NOT_FOUND_TEXT)


def test_summary_and_cards(spark):
    latest = readmodels.latest_rows(state(spark))
    assert rows(readmodels.team_summary(latest, 15)) == [("ana", 7, "[AT RISK]", "Low Activity, B"), ("bo", None, "[?]", "None")]
    card = readmodels.risk_cards(latest, 2).collect()
    assert len(card) == 1 and card[0].signals == ["[low] Low Activity", "[low] Burnout Risk"] and card[0].rationale == "wh"
    overview = {r.classification: r for r in readmodels.cohort_overview(latest).collect()}
    assert overview["At Risk"].employees == 1 and overview["At Risk"].signals == 2
    payload = json.loads(readmodels.cohort_payload(latest).filter("employee = 'ana'").first().payload)
    assert payload["briefing"] == "b" and len(payload["signals"]) == 2


def test_report_text(spark, tmp_path):
    frame = state(spark).filter("employee = 'ana'")
    path = str(tmp_path / "report")
    reports.write_report(readmodels.report_lines(readmodels.latest_rows(frame), frame), path, "closing words")
    lines = [line for part in sorted((tmp_path / "report").glob("part-*")) for line in part.read_text().splitlines()]
    assert lines == [
        "TEAM SUMMARY", f"{'ana':<12} {7:>5}  {'At Risk':<14}  Low Activity, Burnout Risk",
        "INDIVIDUAL RISK CARDS", "Employee      : ana", "Score         : 7/10", "Classification: At Risk", "Rationale     : why",
        "Signals:", "  [low] Low Activity", "  [low] Burnout Risk", "Manager Briefing:", "b", "-" * 72,
        "STORED EVALUATIONS", f"{'ana_week2':<35}  score=3  class=Healthy", f"{'ana_week10':<35}  score=7  class=At Risk", "closing words"]


def test_prompts(spark):
    frame = state(spark).filter("employee = 'ana'")
    history = prompts.history_summary(frame)
    risk = {r.week: r.prompt for r in prompts.risk_prompts(frame.select("employee", "week", "signals"), history).collect()}
    assert "Earlier weeks: none" in risk[2] and '[{"week_file":"ana_week2.json","score":3,"classification":"Healthy"}]' in risk[10]
    brief = prompts.briefing_prompts(frame.filter("week = 10")).first()
    assert "- Low Activity (low): " in brief.prompt and "ana" not in brief.session_id
    assert prompts.trend_prompts(frame).count() == 1


def test_grades(spark):
    verdicts = spark.createDataFrame(
        [(1, "m", '{"score": 4, "explanation": "good"}'), (2, "m", '```json\n{"score": "2"}\n```'), (3, "m", '{"score": 6}'),
         (4, "m", "I cannot"), (5, "m", 'Sure {"score": 1} ok')], "case_id INT, metric STRING, text STRING")
    graded = grading.parse_grades(verdicts)
    assert [r.grade for r in graded.orderBy("case_id").collect()] == [4, 2, None, None, 1]
    s = grading.grade_summary(graded).first()
    assert (s.graded, s.invalid, s.min_grade, s.max_grade) == (3, 2, 1, 4) and abs(s.avg_grade - 7 / 3) < 1e-12
    other = graded.filter("case_id > 1").withColumn("grade", F.lit(5))
    assert rows(grading.compare_grades(graded, other))[:2] == [(1, "m", 4, None, None), (2, "m", 2, 5, 3)]
    calls = spark.createDataFrame([(True,), (True,), (False,)], "success BOOLEAN")
    assert rows(grading.call_outcomes(calls)) == [(2, 1)]
    assert rows(grading.call_outcomes(calls.limit(0))) == [(0, 0)]


def test_evaluation_cases(spark, tmp_path):
    def say(who, text):
        return {"author": who, "content": {"role": who, "parts": [{"text": text}]}}

    (tmp_path / "set.json").write_text(json.dumps({"eval_cases": [
        {"eval_case_id": "greeting", "prompt": {"role": "user", "parts": [{"text": "Hello"}]}},
        {"eval_case_id": "long", "agent_data": {"turns": [{"turn_index": 0, "events": [say("user", "a"), say("agent", "b"), say("user", "c")]}]}},
        {"prompt": {"role": "user", "parts": [{"text": "x"}, {"text": "y"}]}}]}, indent=1))
    cases = evalset.read_eval_cases(spark, str(tmp_path / "set.json"))
    assert rows(cases, "case_id", "shape", "message", "turn_count") == [
        ("greeting", "prompt", "Hello", 0), ("long", "turns", "c", 1), (None, "prompt", "x\ny", 0)]
    assert rows(evalset.case_events(cases), "event_idx", "author", "text") == [(0, "user", "a"), (1, "agent", "b"), (2, "user", "c")]
