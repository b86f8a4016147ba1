import datetime as dt
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from samples import write_weeks
from tidemark import constants as C
from tidemark.plans import weekly_run
from tidemark.schemas import EVALUATION, MODEL_RESPONSE
from tidemark.sources import evaluations as ev, weekly
from tidemark.streaming import realtime

AS_OF = dt.datetime(2024, 3, 1)


def evaluation(employee, week, score=5, cls="Watch", scope="main", briefing="b", signals=(), origin="model", streak=0, at=AS_OF):
    return (scope, employee, week, score, cls, "why", streak,
            [("signal", s, [week], "low", None) for s in signals], briefing, origin, at)


def test_upsert_replaces_and_keeps(spark, tmp_path):
    path = str(tmp_path / "state")
    assert ev.read_state(spark, path).count() == 0
    first = spark.createDataFrame([evaluation("a", 1), evaluation("a", 2), evaluation("b", 2), evaluation("a", 2, scope="realtime")], EVALUATION)
    ev.upsert_state(spark, path, first)
    ev.upsert_state(spark, path, spark.createDataFrame([evaluation("a", 2, 9, "Silent Exit"), evaluation("c", 3)], EVALUATION))
    ev.upsert_state(spark, path, ev.empty_state(spark))
    assert rows(ev.read_state(spark, path), "scope", "employee", "week", "score") == [
        ("main", "a", 1, 5), ("main", "a", 2, 9), ("main", "b", 2, 5), ("main", "c", 3, 5), ("realtime", "a", 2, 5)]
    assert ev.read_state(spark, path, "realtime").count() == 1
    assert sorted(p for p in os.listdir(path) if p.startswith("scope")) == ["scope=main", "scope=realtime"]


def test_evaluation_files(spark, tmp_path):
    def put(name, doc):
        (tmp_path / name).write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=2))

    good = {"score": 4, "classification": "Watch", "rationale": "mild", "healthy_streak": 2, "extra": 1,
            "signals": [{"signal_name": "Low Activity", "weeks_detected": [2, 3], "severity": "low"},
                        {"signal": "MISSING_DATA_GAP", "severity": "low", "details": "gap"}, {"severity": "low"}]}
    put("alice_week6.json", good)
    put("alice_week5.json", {"score": 6, "classification": "At Risk"})
    put("alice_week3.json", "NOT VALID JSON {{{{")
    put("alice_day3.json", good)
    put("a_week1_week2.json", good)
    put("bob_weekx.json", good)
    put("bob_week10.json", {"score": "7", "classification": "At Risk", "rationale": "[Local ML Fallback Model] x"})
    got = ev.read_evaluation_files(spark, str(tmp_path)).orderBy("employee").collect()
    assert [(r.employee, r.week, r.score, r.origin, r.healthy_streak) for r in got] == [
        ("Alice", 6, 4, "model", 2), ("Bob", 10, 7, "case", 0)]
    assert [(s.kind, s.signal_name) for s in got[0].signals] == [
        ("signal", "Low Activity"), ("gap", "MISSING_DATA_GAP"), ("gap", "Unknown")]
    assert got[0].evaluated_at is not None


def answer(kind, who, week, text):
    return (kind, who, week, text)


def test_run_over_a_folder(spark, tmp_path):
    folder = tmp_path / "weekly"
    folder.mkdir()
    write_weeks(folder)
    path = str(tmp_path / "state")
    docs = []
    for week, score in enumerate([5, 6, 5, 5], start=1):
        docs.append(answer("risk", "Tomas", week, json.dumps({"score": score, "classification": "Watch" if score < 6 else "At Risk", "rationale": "r"})))
    docs += [answer("risk", "Ines", w, '{"score": 2, "classification": "Healthy", "rationale": "fine"}') for w in (1, 2, 3, 4)]
    docs.append(answer("briefing", "Tomas", 4, "Talk about workload."))
    docs.append(answer("briefing", "Tomas", 3, "Plan termination of the contract."))
    docs.append(answer("trend", "Tomas", 4, '```json\n[{"signal_name": "Response Time Spike", "details": "slower"}]\n```'))
    responses = spark.createDataFrame(docs, MODEL_RESPONSE)
    assert weekly_run.run_weekly(spark, str(folder), path, responses, as_of=AS_OF) is None
    state = ev.read_state(spark, path).cache()
    assert state.count() == 24
    tomas = {r.week: r for r in state.filter("employee = 'Tomas'").collect()}
    # Two elevated weeks before week 3: one more point there and in week 4.
    assert [tomas[w].score for w in (1, 2, 3, 4)] == [5, 6, 6, 6]
    assert tomas[4].classification == "At Risk" and "from 5 to 6" in tomas[4].rationale
    assert tomas[4].briefing == "Talk about workload." and tomas[3].briefing == C.SAFE_BRIEFING
    assert {s.signal_name: s.details for s in tomas[4].signals} == {"Declining Task Completion": None, "Response Time Spike": "slower"}
    ines = {r.week: r for r in state.filter("employee = 'Ines'").collect()}
    assert [ines[w].healthy_streak for w in (1, 2, 3, 4)] == [1, 2, 4, 7] and ines[4].briefing is None
    # No answer and no stored case: the default, with no streak.
    assert rows(state.filter("employee = 'Greta'"), "score", "classification", "origin")[0] == (4, "Watch", "default")
    state.unpersist()

    # A later week reuses what is stored; a new case answers for those without a model.
    (folder / "week5.csv").write_text("name,tasks,latency\nTomas,9,1.5\nGreta,10,0.4\n")
    weekly_run.run_weekly(spark, str(folder), path, as_of=AS_OF + dt.timedelta(days=7))
    later = ev.read_state(spark, path)
    assert later.count() == 30
    assert later.filter(F.col("evaluated_at") == F.lit(AS_OF)).count() == 24
    greta = later.filter("employee = 'Greta' AND week = 5").first()
    # The first stored case with no signals is Ines's first week.
    assert (greta.origin, greta.score, greta.healthy_streak) == ("case", 2, 0)
    gap = later.filter("employee = 'Lena' AND week = 5").first()
    assert [s.kind for s in gap.signals] == ["gap"]


def test_repair_keeps_the_score(spark):
    records = spark.createDataFrame([("a", 1, 5, 1.0, 0, 0, 40, 95, "x", "f")], "employee STRING, week INT, completed_tasks INT, response_time DOUBLE, after_hours_logins INT, sick_days INT, weekly_hours INT, task_accuracy INT, sentiment STRING, source_file STRING")
    state = spark.createDataFrame([evaluation("a", 1, 7, "At Risk", briefing=None, signals=("Old",))], EVALUATION)
    new = weekly_run.evaluate(records, 1, state, weekly_run.no_responses(spark), "main", AS_OF).collect()
    assert [(r.score, r.classification, r.briefing, r.signals) for r in new] == [(7, "At Risk", C.SAFE_BRIEFING, [])]
    merged = weekly_run.merged_state(state, spark.createDataFrame(new, EVALUATION))
    assert rows(merged, "score", "briefing") == [(7, C.SAFE_BRIEFING)]
    done = state.withColumn("briefing", F.lit("text"))
    assert weekly_run.evaluate(records, 1, done, weekly_run.no_responses(spark), "main", AS_OF).count() == 0
    again = weekly_run.evaluate(records, 1, done, weekly_run.no_responses(spark), "main", AS_OF, reuse_state=False)
    assert rows(again, "score", "origin") == [(7, "case")] or rows(again, "score", "origin") == [(4, "default")]


def test_missing_and_repairs(spark):
    expected = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "employee STRING, week INT")
    state = spark.createDataFrame([evaluation("a", 1, briefing=None), evaluation("b", 1, scope="realtime")], EVALUATION)
    assert rows(weekly_run.missing_evaluations(expected, state, "main")) == [("a", 2), ("b", 1)]
    assert weekly_run.repairs_due(expected, state.select("employee", "week")).count() == 2


def test_files_arriving_one_by_one(spark, tmp_path):
    incoming, store, path, checkpoint = (str(tmp_path / n) for n in ("in", "store", "state", "check"))
    os.mkdir(incoming)
    write_weeks_to = tmp_path / "all"
    write_weeks_to.mkdir()
    write_weeks(write_weeks_to)

    def arrive(*weeks):
        for w in weeks:
            (tmp_path / "in" / f"week{w}.csv").write_text((write_weeks_to / f"week{w}.csv").read_text())
        realtime.run(spark, incoming, store, path, checkpoint, as_of=AS_OF)
        return ev.read_state(spark, path)

    assert arrive(1, 2).count() == 12
    got = arrive(3, 4)
    assert got.count() == 24 and rows(got.select("scope").distinct()) == [("realtime",)]
    tomas = got.filter("employee = 'Tomas' AND week = 4").first()
    assert [(s.signal_name, s.weeks_detected, s.severity) for s in tomas.signals] == [
        ("Declining Task Completion", [2, 3, 4], "high"), ("Response Time Spike", [2, 3, 4], "high")]
    # A batch that is run again changes nothing.
    before = rows(got, "employee", "week", "score")
    files = [f"{incoming}/week3.csv", f"{incoming}/week4.csv"]
    realtime.land_batch(spark, files, 1, store)
    realtime.evaluate_landed(spark, store, path, as_of=AS_OF)
    assert rows(ev.read_state(spark, path), "employee", "week", "score") == before
    # A back-filled file does not recompute stored later weeks.
    (tmp_path / "in" / "week2b.csv").write_text("name,tasks\nZoe,4\n")
    late = arrive()
    assert late.count() == 28 and rows(late.filter("employee <> 'Zoe'"), "employee", "week", "score") == before


def test_batch_size_changes_nothing(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    write_weeks(incoming)
    lines = (incoming / "week2.csv").read_text().splitlines()
    (incoming / "week2.csv").write_text("\n".join(lines[:3]) + "\n")
    (incoming / "a_week2.csv").write_text("\n".join(lines[:1] + lines[3:]) + "\n")
    (incoming / "notes2024.txt").write_text("name,tasks\nBob,1\n")
    got = []
    for size in (1, 2, 1000):
        store, path, checkpoint = (str(tmp_path / f"{n}{size}") for n in ("store", "state", "check"))
        realtime.run(spark, str(incoming), store, path, checkpoint, as_of=AS_OF, max_files=size, report_path=str(tmp_path / f"report{size}"))
        got.append(rows(ev.read_state(spark, path)))
    assert len(got[0]) == 24 and got[0] == got[1] == got[2]
    text = spark.read.text(str(tmp_path / "report1")).collect()
    assert any("TEAM SUMMARY" in r[0] for r in text)


def test_one_new_file_reads_the_buckets_it_touches(spark, tmp_path):
    incoming, store, path, checkpoint = (str(tmp_path / n) for n in ("in", "store", "state", "check"))
    os.mkdir(incoming)
    people = [f"P{k}" for k in range(40)]

    def arrive(name, *lines):
        (tmp_path / "in" / name).write_text("name,tasks,hours\n" + "".join(f"{line}\n" for line in lines))

    def land():
        realtime.start(spark, incoming, store, checkpoint).awaitTermination()

    def state():
        return {(r.employee, r.week): r for r in ev.read_state(spark, path).collect()}

    for week in (1, 2, 3):
        arrive(f"week{week}.csv", *(f"{p},{9 - week},40" for p in people if (p, week) != ("P7", 2)))
    land()
    assert realtime.touched_buckets(spark, store, "realtime") is None
    realtime.evaluate_landed(spark, store, path, as_of=AS_OF)
    first = state()
    assert len(first) == 120 and realtime.touched_buckets(spark, store, "realtime") == []

    arrive("week2b.csv", "P7,1,60")
    land()
    bucket = spark.createDataFrame([("P7",)], "e STRING").select(ev.bucket_of(F.col("e"))).first()[0]
    assert realtime.touched_buckets(spark, store, "realtime") == [bucket]
    # What lies in other buckets can't be read any more: neither store nor state may be asked for it.
    hidden = {}
    for file in [*(tmp_path / "store" / "rows").rglob("*.parquet"), *(tmp_path / "state").rglob("*.parquet")]:
        own = file.relative_to(tmp_path).parts
        if f"bucket={bucket}" not in own and own[0] == "store":
            hidden[file] = file.read_bytes()
            file.write_bytes(b"unreadable")
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert hidden
    plan = realtime.landed_rows(spark, store, [bucket])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+", plan)
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "state").rglob("*.parquet") if f"bucket={bucket}" not in f.parts}
    realtime.evaluate_landed(spark, store, path, as_of=AS_OF + dt.timedelta(1), recompute_late=True)
    second = state()
    assert {k for k, r in second.items() if r != first[k]} == {("P7", 2), ("P7", 3)}
    assert untouched == {f: f.stat().st_mtime_ns for f in (tmp_path / "state").rglob("*.parquet") if f"bucket={bucket}" not in f.parts}
    for file, data in hidden.items():
        file.write_bytes(data)

    # Compaction changes nothing but the number of files; a later week concerns everybody.
    before = rows(realtime.landed_rows(spark, store))
    assert realtime.compact(spark, store) is None
    assert realtime._batches(spark, f"{store}/rows") == [-1] == realtime._batches(spark, f"{store}/journal")
    assert rows(realtime.landed_rows(spark, store)) == before
    assert realtime.touched_buckets(spark, store, "realtime") == []
    arrive("week4.csv", "P1,5,40")
    land()
    assert realtime.touched_buckets(spark, store, "realtime") is None
    realtime.evaluate_landed(spark, store, path, as_of=AS_OF + dt.timedelta(2))
    assert len(state()) == 160 and realtime.touched_buckets(spark, store, "other") is None
    realtime.compact(spark, store)
    assert realtime._batches(spark, f"{store}/rows") == [-2]


def test_pasted_week_replaces_what_landed(spark, tmp_path):
    incoming, store, path, checkpoint = (str(tmp_path / n) for n in ("in", "store", "state", "check"))
    os.mkdir(incoming)
    (tmp_path / "in" / "week1.csv").write_text("name,tasks\nAnn,5\n")

    def paste(text, seq):
        weekly.land_csv_text(spark.createDataFrame([(1, seq, text)], "week INT, seq INT, csv_content STRING"), incoming)
        realtime.start(spark, incoming, store, checkpoint).awaitTermination()
        both = realtime.landed_rows(spark, store), weekly.scan_employee_weeks(spark, incoming)
        return [rows(found, "employee", "completed_tasks") for found in both]

    realtime.start(spark, incoming, store, checkpoint).awaitTermination()
    assert paste("name,tasks\nZoe,5", 1) == [[("Zoe", 5)]] * 2
    assert paste('name,tasks,tone\nAna,9,"good\nvery"', 2) == [[("Ana", 9)]] * 2
    realtime.evaluate_landed(spark, store, path, as_of=AS_OF)
    assert rows(ev.read_state(spark, path), "employee", "week") == [("Ana", 1)]
    realtime.evaluate_landed(spark, store, path, as_of=AS_OF + dt.timedelta(1), recompute_from=1)
    assert ev.read_state(spark, path).first().evaluated_at == AS_OF + dt.timedelta(1)


def test_late_weeks_of_some_employees(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    for week in range(1, 6):
        names = ["Ann", "Bob", "Cy"] if week != 3 else ["Cy"]
        (folder / f"week{week}.csv").write_text("name,tasks,hours\n" + "".join(f"{n},{9 - week},{38 + 4 * week}\n" for n in names))
    weekly_run.run_weekly(spark, str(folder), path, as_of=AS_OF)
    (folder / "week3b.csv").write_text("name,tasks,hours\nBob,1,60\n")
    later = AS_OF + dt.timedelta(1)
    records = weekly.scan_employee_weeks(spark, str(folder))
    frontier = weekly_run.late_frontier(records, ev.read_state(spark, path), "main")
    assert rows(frontier) == [("Bob", 3)]
    before = {(r.employee, r.week): r for r in ev.read_state(spark, path).collect()}
    weekly_run.run_weekly(spark, str(folder), path, as_of=later, recompute_late=True)
    after = {(r.employee, r.week): r for r in ev.read_state(spark, path).collect()}
    redone = {k for k, r in after.items() if r.evaluated_at == later}
    assert redone == {("Bob", 3), ("Bob", 4), ("Bob", 5)}
    assert all(after[k] == before[k] for k in before if k not in redone)
    gaps = {k for k, r in after.items() if any(s.kind == "gap" for s in r.signals)}
    assert gaps == {("Ann", 3), ("Ann", 4), ("Ann", 5)}
    # Nothing is late any more: a further run leaves all as it is.
    weekly_run.run_weekly(spark, str(folder), path, as_of=later + dt.timedelta(1), recompute_late=True)
    assert {(r.employee, r.week): r for r in ev.read_state(spark, path).collect()} == after


def test_several_answers_need_an_order(spark):
    two = [answer("risk", "a", 1, "x"), answer("risk", "a", 1, "b")]
    frame = spark.createDataFrame(two, MODEL_RESPONSE)
    with pytest.raises(Exception, match="seq"):
        weekly_run.responses_per_week(frame).collect()
    ordered = frame.withColumn("seq", F.when(F.col("text") == "b", 2).otherwise(1))
    assert rows(weekly_run.responses_per_week(ordered), "risk_text", "trend_text") == [("b", None)]


def test_failed_replacement_keeps_the_rows(spark, tmp_path):
    path = tmp_path / "state"
    ev.upsert_state(spark, str(path), spark.createDataFrame([evaluation("a", 1), evaluation("b", 1)], EVALUATION))
    blocked = tmp_path / "file"
    blocked.write_text("")
    with pytest.raises(RuntimeError, match="whole in") as caught:
        ev.upsert_state(spark, str(blocked), spark.createDataFrame([evaluation("a", 1, 9)], EVALUATION))
    kept = str(caught.value).split("whole in ")[1]
    assert rows(spark.read.schema(EVALUATION).parquet(kept), "employee", "score") == [("a", 9)]
