import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from samples import CONFIRMED, write_weeks
from tidemark import constants as C
from tidemark.operators import signals as S, timeline as TL
from tidemark.schemas import EMPLOYEE_WEEK
from tidemark.sources import weekly

CALM = dict(tasks=10, resp=1.0, late=0, sick=0, hours=40, acc=95, tone="Neutral")


def record(employee, week, **changes):
    m = {**CALM, **changes}
    return (employee, week, m["tasks"], m["resp"], m["late"], m["sick"], m["hours"], m["acc"], m["tone"], "f")


def detect(spark, records, max_week=None):
    frame = spark.createDataFrame(records, EMPLOYEE_WEEK)
    timeline = TL.densify(frame, max_week or TL.max_week_of(frame))
    return S.signals_as_of(timeline)


def found(spark, records, max_week=None):
    return {
        (r.week, r.employee, r.signal_name, tuple(r.weeks_detected or ()), r.severity)
        for r in S.explode_signals(detect(spark, records, max_week)).collect()
        if r.kind != "gap"
    }


def test_sample_weeks(spark, tmp_path):
    write_weeks(tmp_path)
    scanned = weekly.scan_employee_weeks(spark, str(tmp_path))
    records = TL.keep_first(scanned, F.col(weekly.ROW_ORDER)).drop(weekly.ROW_ORDER)
    timeline = TL.densify(records, TL.max_week_of(scanned.select("week")))
    got = {
        (r.week, r.employee, r.signal_name, tuple(r.weeks_detected), r.severity)
        for r in S.explode_signals(S.signals_as_of(timeline)).collect()
    }
    assert got == set(CONFIRMED)
    assert ("Oskar", 3, "Declining Task Completion") in rows(S.flags_long(timeline))  # exactly 0.20
    joined = S.confirmed_as_of_join(timeline, S.confirmed_weeks(timeline))
    assert {(r.as_of_week, r.employee, r.signal_name, tuple(r.weeks_detected)) for r in joined.collect()} == {
        c[:4] for c in CONFIRMED
    }


# signal, metric, base value, (value, severity or None when not flagged) ...
BOUNDARIES = [
    (C.TASKS, "tasks", 100, [(81, None), (80, "medium"), (61, "medium"), (60, "high"), (0, "high")]),
    (C.RESPONSE, "resp", 2.0, [(3.0, None), (3.01, "medium"), (3.99, "medium"), (4.0, "high")]),
    (C.AFTER_HOURS, "late", 0, [(2, None), (3, "low"), (4, "medium"), (5, "medium"), (6, "high")]),
    (C.SICK, "sick", 1, [(2, None), (3, "medium"), (4, "high")]),
    (C.QUALITY, "acc", 95, [(85, None), (84, "low"), (80, "low"), (79, "medium"), (70, "medium"), (69, "high"), (0, "low")]),
    (C.LOW_ACTIVITY, "hours", 40, [(30, None), (29, "low"), (25, "low"), (24, "medium"), (20, "medium"), (19, "high"), (0, "low")]),
    (C.BURNOUT, "hours", 40, [(50, None), (51, "low"), (55, "low"), (56, "medium"), (60, "medium"), (61, "high")]),
    (C.WITHDRAWN, "tone", "Neutral", [("Negative", None), (" withdrawn ", "medium"), ("\tWithDrawn\n", "medium"), ("Withdrawn", "medium")]),
]


def test_flag_and_severity_boundaries(spark):
    records, expected = [], set()
    for name, metric, base, cases in BOUNDARIES:
        for i, (value, severity) in enumerate(cases):
            who = f"{metric}_{name}_{i}"
            records.append(record(who, 1, **{metric: base}))
            records += [record(who, w, **{metric: value}) for w in (2, 3)]
            if severity:
                expected.add((3, who, name, (2, 3), severity))
    assert found(spark, records) == expected


def test_no_flag_from_nothing(spark):
    empty = dict(tasks=0, resp=0.0, hours=None, acc=None, tone=None)
    nan = dict(resp=float("nan"))
    records = [record("zero", 1, **empty), record("zero", 2, **empty), record("zero", 3, **empty)]
    records += [record("nan", 1), record("nan", 2, **nan), record("nan", 3, **nan)]
    assert found(spark, records) == set()


def test_gap_breaks_a_run_and_is_reported(spark):
    late = dict(late=5)
    records = [record("a", 1), record("a", 2, **late), record("a", 4, **late), record("b", 5)]
    got = {(r.employee, r.week): r.signals for r in detect(spark, records).collect()}
    assert len(got) == 10 and got["a", 2] == []
    gap = got["a", 5][0]
    assert (gap.kind, gap.signal_name, gap.severity) == ("gap", "MISSING_DATA_GAP", "low")
    assert gap.details == "Missing data for week(s): [3, 5]. Handled as data gap, not disengagement."
    kinds = [(s.kind, s.signal_name) for s in got["b", 1]]
    assert kinds == [("no_baseline", "Baseline Week Missing"), ("gap", "MISSING_DATA_GAP")]
    assert [s.kind for s in got["a", 4]] == ["gap"]


def test_week_limit(spark):
    frame = spark.createDataFrame([record("a", 12024)], EMPLOYEE_WEEK)
    with pytest.raises(Exception, match="above the limit"):
        TL.densify(frame, TL.max_week_of(frame, 520)).collect()
    assert TL.densify(frame, TL.max_week_of(frame)).count() == 12024
    vanished = spark.createDataFrame([record("a", 0), record("a", 1)], EMPLOYEE_WEEK)
    assert TL.densify(vanished, TL.max_week_of(vanished)).count() == 1
    later = spark.createDataFrame([record("a", 1), record("a", 7)], EMPLOYEE_WEEK)
    assert rows(TL.densify(later, 5), "week", "data_missing") == [(1, False)] + [(w, True) for w in (2, 3, 4, 5)]


def flags_of(m, base):
    """Flag rules for one week, with the measure that grades them."""
    out = {}
    tasks, resp, late, sick, hours, acc, tone = m
    if base[0] and (base[0] - tasks) / base[0] >= 0.2:
        out[C.TASKS] = (base[0] - tasks) / base[0]
    if base[1] and (resp - base[1]) / base[1] > 0.5:
        out[C.RESPONSE] = (resp - base[1]) / base[1]
    if late > 2:
        out[C.AFTER_HOURS] = late
    if sick > base[3] + 1:
        out[C.SICK] = sick - base[3]
    if acc is not None and acc < 85:
        out[C.QUALITY] = acc or 100
    if hours is not None and hours < 30:
        out[C.LOW_ACTIVITY] = hours or 40
    if hours is not None and hours > 50:
        out[C.BURNOUT] = hours
    if tone == "Withdrawn":
        out[C.WITHDRAWN] = 1
    return out


def grade(name, values):
    cuts = {
        C.TASKS: (max, lambda v: (v >= 0.4, v >= 0.2)), C.RESPONSE: (max, lambda v: (v >= 1, v >= 0.5)),
        C.AFTER_HOURS: (max, lambda v: (v >= 6, v >= 4)), C.SICK: (max, lambda v: (v >= 3, v >= 2)),
        C.QUALITY: (min, lambda v: (v < 70, v < 80)), C.LOW_ACTIVITY: (min, lambda v: (v < 20, v < 25)),
        C.BURNOUT: (max, lambda v: (v > 60, v > 55)), C.WITHDRAWN: (max, lambda v: (False, True)),
    }
    pick, test = cuts[name]
    high, medium = test(pick(values))
    return "high" if high else "medium" if medium else "low"


def brute_force(records, max_week):
    people = {}
    for r in records:
        people.setdefault(r[0], {})[r[1]] = r[2:9]
    out = set()
    for who, weeks in people.items():
        for w in range(1, max_week + 1):
            if 1 not in weeks:
                out.add((w, who, C.BASELINE_MISSING, (), "low"))
                continue
            hits = {k: flags_of(weeks[k], weeks[1]) for k in range(2, w + 1) if k in weeks}
            for name in C.DETECTED_SIGNALS:
                on = [k for k in hits if name in hits[k]]
                run = tuple(k for k in on if k - 1 in on or k + 1 in on)
                if run:
                    out.add((w, who, name, run, grade(name, [hits[k][name] for k in run])))
    return out


def test_against_brute_force_on_every_prefix(spark):
    rnd = random.Random(7)
    records = []
    for p in range(60):
        for w in range(1, 10):
            if rnd.random() < 0.12:
                continue
            records.append(
                record(
                    f"p{p}", w, tasks=rnd.choice([0, 4, 6, 8, 10]), resp=rnd.choice([0.0, 0.5, 1.0, 1.6, 3.0]),
                    late=rnd.choice([0, 3, 4, 7]), sick=rnd.choice([0, 1, 2, 4]),
                    hours=rnd.choice([None, 0, 18, 27, 40, 57, 65]), acc=rnd.choice([None, 0, 60, 75, 84, 95]),
                    tone=rnd.choice([None, "Neutral", "Withdrawn"]),
                )
            )
    rnd.shuffle(records)
    assert found(spark, records, 9) == brute_force(records, 9)


def test_unrelated_employee_changes_nothing(spark):
    records = [record("a", 1), record("a", 2, late=3), record("a", 3, late=9)]
    alone = found(spark, records)
    both = found(spark, records + [record("b", 1), record("b", 2, sick=5), record("b", 3, sick=5)])
    assert {r for r in both if r[1] == "a"} == alone


def test_details_by_name(spark):
    records = [record("a", 1), record("a", 2, late=3, sick=3), record("a", 3, late=3, sick=3)]
    answers = spark.createDataFrame(
        [([("Increasing Sick Days", "was ill"), ("Renamed", "x")],)], "a ARRAY<STRUCT<signal_name: STRING, details: STRING>>"
    )
    last = detect(spark, records).filter("week = 3").join(answers)
    got = last.select(S.add_details(F.col("signals"), F.col("a")).alias("s")).first().s
    assert [(s.signal_name, s.details) for s in got] == [(C.AFTER_HOURS, None), (C.SICK, "was ill")]
    none = detect(spark, records).filter("week = 3").select(S.add_details(F.col("signals"), F.lit(None).cast("ARRAY<STRUCT<signal_name: STRING, details: STRING>>")).alias("s"))
    assert [s.severity for s in none.first().s] == ["low", "high"]


def test_as_of_merge_joins_nothing(spark):
    spine = spark.createDataFrame([(e, w) for e in "ab" for w in range(1, 8)], "employee STRING, week INT")
    confirmed = spark.createDataFrame(
        [("a", "x", 2, 3), ("a", "x", 3, 3), ("a", "y", 5, 6), ("a", "x", 7, 9), ("c", "x", 1, 1)],
        "employee STRING, signal_name STRING, week INT, confirm_week INT")
    found = S.confirmed_as_of_join(spine, confirmed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {(r.employee, r.as_of_week, r.signal_name): list(r.weeks_detected) for r in found.collect()}
    assert got == {("a", w, "x"): [2, 3] for w in range(3, 8)} | {("a", w, "y"): [5] for w in (6, 7)}


def test_weeks_of_many_runs_and_gaps(spark):
    rnd = random.Random(3)
    weeks = [w for w in range(1, 400) if w == 1 or rnd.random() > 0.15]
    hours = {w: rnd.choice([20, 20, 40]) for w in weeks}
    hours[1] = 40
    records = spark.createDataFrame([("a", w, 5, 1.0, 0, 0, hours[w], 95, "Neutral", "f") for w in weeks], EMPLOYEE_WEEK)
    low = {w for w in weeks if w > 1 and hours[w] < 30}
    for r in S.signals_as_of(TL.densify(records, 400)).collect():
        seen = {w for w in low if w <= r.week}
        want = sorted(w for w in seen if w - 1 in seen or w + 1 in seen)
        found = [s.weeks_detected for s in r.signals if s.signal_name == C.LOW_ACTIVITY]
        assert found == ([want] if want else [])
        assert r.missing_weeks == [w for w in range(1, r.week + 1) if w not in hours]
