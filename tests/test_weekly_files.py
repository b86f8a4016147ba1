import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from samples import HEADER, WEEKS, write_weeks
from tidemark.operators.timeline import keep_first
from tidemark.plans.weekly_run import run_weekly
from tidemark.sources import weekly


def test_header_resolution():
    two = {"n": ("employee_name", "name")}
    assert weekly.resolve_headers(["employee_name", "tasks_completed"], two)["n"] == "employee_name"
    assert weekly.resolve_headers(["Name", "Tasks Completed"], two)["n"] == "Name"
    assert weekly.resolve_headers(["user_first_name_raw"], {"n": ("first_name", "name")})["n"] == "user_first_name_raw"
    assert weekly.resolve_headers(["some_other_field"], {"n": ("name",)})["n"] is None


def test_latency_is_not_taken_for_hours():
    headers = ["employee_name", "avg_response_time_hours", "after_hours_logins"]
    assert weekly.resolve_headers(headers)["weekly_hours"] is None
    assert weekly.resolve_headers(headers, strict_parity=True)["weekly_hours"] == "avg_response_time_hours"
    assert weekly.resolve_headers(["after_hours_logins"])["weekly_hours"] is None


def test_header_value_default(spark):
    frame = spark.createDataFrame([("", "x")], "name STRING, other STRING")
    assert frame.select(weekly.header_value(frame.columns, ["name"], "D").alias("v")).first().v == "D"
    assert frame.select(weekly.header_value(["other"], ["name"], "D").alias("v")).first().v == "D"


def test_other_spellings(spark):
    raw = spark.createDataFrame(
        [("Nora", "8", "1.5", "2", "0", 1), ("Nora", "6", "2.5", "1", "1", 2)],
        "name STRING, completed_tasks STRING, avg_response_time STRING, after_hours_logins STRING, sick_days STRING, week INT",
    )
    got = rows(weekly.alias_table(raw, F.col("week")))
    assert got[0][:6] == ("Nora", 1, 8, 1.5, 2, 0)
    assert got[0][6:9] == (None, None, None)


def test_scan_of_a_folder(spark, tmp_path):
    write_weeks(tmp_path)
    (tmp_path / "week 5.csv").write_text('Sick,Name,Hours Worked\n2,"O""Neil, Pat",33\n\n,  ,x\n')
    (tmp_path / "notes.txt.bak").write_text("x")
    scanned = weekly.scan_employee_weeks(spark, str(tmp_path))
    got = rows(scanned, "employee", "week", "completed_tasks", "sick_days", "weekly_hours", "source_file")
    assert len(got) == 26
    assert ('O"Neil,', 5, 0, 2, 33, "week 5.csv") in got
    assert ("Unknown", 5, 0, 0, None, "week 5.csv") in got
    raw = weekly.scan_raw(spark, str(tmp_path))
    assert {"employee_name", "Sick", "Name", "__week_number__"} <= set(raw.columns) and raw.count() == 26


def test_files_laid_out_alike_share_a_scan(spark, tmp_path):
    (tmp_path / "week1.csv").write_text("name,tasks,qq1\nBo,1,9\n")
    (tmp_path / "week2.csv").write_text("Employee Name,Completed-Tasks,qq2\nBo,2,9\n")
    (tmp_path / "week3.csv").write_text("tasks,name,tasks\n7,Bo,3\n")
    scanned = weekly.scan_employee_weeks(spark, str(tmp_path))
    assert rows(scanned, "employee", "week", "completed_tasks") == [("Bo", 1, 1), ("Bo", 2, 2), ("Bo", 3, 3)]
    assert scanned._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2


def test_week_numbers(spark):
    frame = spark.createDataFrame([("week1",), ("data",), ("week1_2024",), ("w0",)], "s STRING")
    assert [r.w for r in frame.select(weekly.week_from_stem(F.col("s")).alias("w")).collect()] == [1, 1, 12024, 0]


def test_strict_columns(spark, tmp_path):
    (tmp_path / "week1.csv").write_text(
        "employee_name,name,tasks_completed,completed_tasks,weekly_hours,Response Time\n,Bo K,,7,40,2\n"
    )
    got = rows(weekly.scan_employee_weeks(spark, str(tmp_path), strict=True).drop(weekly.ROW_ORDER))
    assert got == [("Bo", 1, 7, 0.0, 0, 0, None, None, None, "week1.csv")]


def test_first_record_wins(spark, tmp_path):
    (tmp_path / "week01.csv").write_text("name,tasks\nBo,1\nBo,2\nBo,3\n")
    (tmp_path / "week1.csv").write_text("name,tasks\nBo,4\nAl,5\n")
    scanned = weekly.scan_employee_weeks(spark, str(tmp_path)).repartition(7)
    first = keep_first(scanned, F.col(weekly.ROW_ORDER))
    assert rows(first, "employee", "completed_tasks") == [("Al", 5), ("Bo", 1)]


def test_pasted_text_replaces_a_week_and_rows_are_appended(spark, tmp_path):
    folder = str(tmp_path / "in")
    row = spark.createDataFrame([("Bo", 1, 2), ("Cy", 1, 3)], "employee_name STRING, tasks_completed INT, week INT")
    weekly.append_rows(row, folder)
    weekly.append_rows(row.withColumn("tasks_completed", F.lit(9)), folder)
    both = keep_first(weekly.scan_employee_weeks(spark, folder), F.col(weekly.ROW_ORDER))
    assert rows(both, "employee", "week", "completed_tasks") == [("Bo", 2, 1), ("Cy", 3, 1)]
    pasted = spark.createDataFrame([(2, 1, "name,tasks\nOld,1"), (2, 2, "\nname,tasks\nNew,5\n\n")], "week INT, seq INT, csv_content STRING")
    weekly.land_csv_text(pasted, folder)
    after = keep_first(weekly.scan_employee_weeks(spark, folder), F.col(weekly.ROW_ORDER))
    assert rows(after, "employee", "week", "completed_tasks") == [("Cy", 3, 1), ("New", 2, 5)]


def test_people_with_one_first_name(spark, tmp_path):
    (tmp_path / "week1.csv").write_text("name,tasks\nAnn Lee,1\n Ann  Ray ,2\n  ,3\n")
    folder = str(tmp_path)
    assert {r[0] for r in rows(weekly.scan_employee_weeks(spark, folder), "employee")} == {"Ann", "Unknown"}
    full = weekly.scan_employee_weeks(spark, folder, full_names=True)
    assert rows(full, "employee") == [("Ann  Ray",), ("Ann Lee",), ("Unknown",)]


def test_target_week_and_missing_as_null(spark, tmp_path):
    (tmp_path / "week7.csv").write_text(HEADER + "\nBo,,,,,,,\n")
    got = rows(weekly.scan_employee_weeks(spark, str(tmp_path), target_week=3, missing_as_null=True), "week", "completed_tasks", "response_time")
    assert got == [(3, None, None)]


def test_messages_instead_of_errors(spark, tmp_path):
    state = str(tmp_path / "state")
    as_of = dt.datetime(2024, 1, 1)
    assert "does not exist" in run_weekly(spark, str(tmp_path / "none"), state, as_of=as_of)
    (tmp_path / "empty").mkdir()
    assert "No CSV files" in run_weekly(spark, str(tmp_path / "empty"), state, as_of=as_of)
    (tmp_path / "empty" / "week1.csv").write_text(HEADER + "\n")
    assert "No valid employee data" in run_weekly(spark, str(tmp_path / "empty"), state, as_of=as_of)
    assert weekly.empty_employee_weeks(spark).count() == 0


def test_unreadable_file_is_skipped(spark, tmp_path):
    (tmp_path / "week1.csv").write_text("name,tasks\nBo,1\n")
    (tmp_path / "week2.csv").write_bytes(b"")
    assert weekly.scan_employee_weeks(spark, str(tmp_path)).count() == 1


QUOTED = [
    ("Bo", 1, "plain"),
    ("Cy", 2, "two\nlines"),
    ("Di", 3, 'a ""quoted"" word, and\n\nblank\n'),
    ("Ed", 4, "x" * 300 + "\n" + "y" * 300),
    ("Fy", 5, ""),
    ("Gi", 6, "\n" * 40),
    ("Hu", 7, "end"),
]


def quoted_file(rows, ends="\n", header='name,"the\nnote",tasks'):
    return "".join(line + ends for line in [header, *(f'{n},"{note}",{k}' for n, k, note in rows)])


def test_line_ends_in_cells_across_blocks(spark, tmp_path):
    many = [(f"{n}{i}", k + i, note) for i in range(30) for n, k, note in QUOTED]
    (tmp_path / "week1.csv").write_text(quoted_file(many))
    (tmp_path / "week2.csv").write_text(quoted_file(QUOTED, header='"tasks","the note","na""me, first"').replace("Bo", "Bo Li"))
    (tmp_path / "week3.csv").write_text(quoted_file([("Jo", 8, "no line end")], header="name,note,tasks"))
    (tmp_path / "week4.csv").write_text("name,tasks\nKa,1\nLo \"Z,2\n")  # never closes
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    want = sorted((n, 1, k) for n, k, _ in many)
    try:
        for size in (1 << 20, 97, 500):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            got = rows(weekly.scan_employee_weeks(spark, str(tmp_path)), "employee", "week", "completed_tasks")
            assert [r for r in got if r[1] == 1] == want
            assert [r for r in got if r[1] > 2] == [("Jo", 3, 8), ("Ka", 4, 1), ("Lo", 4, 2)]
            raw = weekly.scan_raw(spark, str(tmp_path))
            notes = raw.filter("__week_number__ = 1").select("name", "`the\nnote`")
            assert sorted(map(tuple, notes.collect())) == sorted((n, note.replace('""', '"') or None) for n, _, note in many)
            assert raw.filter("__week_number__ = 2").select('na"me, first').count() == len(QUOTED)
            first = keep_first(weekly.scan_employee_weeks(spark, str(tmp_path)).filter("week = 1").withColumn("employee", F.lit("all")), F.col(weekly.ROW_ORDER))
            assert rows(first, "completed_tasks") == [(1,)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_file_is_opened_by_the_driver_or_read_whole(spark, tmp_path):
    (tmp_path / "week1.csv").write_text(quoted_file(QUOTED))
    (tmp_path / "week2.csv").write_text(quoted_file(QUOTED[:1], ends="\r\n", header="name,note,tasks"))
    assert rows(weekly.scan_employee_weeks(spark, str(tmp_path)), "week", "completed_tasks") == sorted([(1, k) for _, k, _ in QUOTED] + [(2, 1)])
    files = weekly.header_groups(spark, weekly.list_files(spark, str(tmp_path)))
    assert {h: (len(f.plain), len(f.spanning), len(f.unclosed)) for h, f in files.items()} == {
        ("name", "the\nnote", "tasks"): (0, 1, 0),
        ("name", "note", "tasks"): (1, 0, 0),
    }


def test_database_options(monkeypatch, spark):
    """No database is started: the reader is replaced, the aliasing is real."""
    seen = {}

    class Reader:
        def option(self, key, value):
            seen[key] = value
            return self

        def load(self):
            return spark.createDataFrame([("Bo Li", 7, 1.1)], "employee STRING, tasks INT, latency DOUBLE")

    class Session:
        class read:
            @staticmethod
            def format(name):
                seen["format"] = name
                return Reader()

    got = rows(
        weekly.read_database(Session, "jdbc:x", "metrics", 4, {"partitionColumn": "id", "numPartitions": 8}),
        "employee", "week", "completed_tasks", "response_time", "source_file",
    )
    assert got == [("Bo", 4, 7, 1.1, "metrics")]
    assert seen["format"] == "jdbc" and seen["numPartitions"] == 8


def test_sample_is_complete():
    assert sum(len(t.splitlines()) for t in WEEKS.values()) == 24


def test_only_csv_files_of_the_folder_count(spark, tmp_path):
    (tmp_path / "notes2024.txt").write_text("name,tasks\nBob,1\n")
    (tmp_path / "week1.csv").write_text("name,tasks\nAnn,1\n")
    assert rows(weekly.scan_employee_weeks(spark, str(tmp_path)), "employee", "week") == [("Ann", 1)]
