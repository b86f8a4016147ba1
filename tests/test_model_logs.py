import base64
import datetime as dt
import hashlib
import json
import os
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import completions as comp
from tidemark.plans import driver_tables as d, registry
from tidemark.schemas import INFERENCE_LOG
from tidemark.sources import telemetry

T0 = datetime(2024, 1, 1)
LABELS = 14


def log(insert_id, second, trace, span, conv="c", inp=None, out=None, name="p/logs/gen_ai.client.inference.operation.details"):
    labels = (conv, "agent", inp, out, None, "10", "20", "stop", None, None, None, None, None, "user")
    at = T0 + timedelta(seconds=second)
    return (name, None, at, at, "INFO", insert_id, trace, span, True, ("r", ("demo", "eu")), labels)


def message(role, index, *texts, data=None, **fields):
    parts = [{"type": "text", "content": t} for t in texts]
    if data:
        parts.append({"type": "blob", "data": base64.b64encode(data).decode(), "mime_type": "image/png", **fields})
    return {"role": role, "index": index, "parts": parts, "unknown": 1}


@pytest.fixture(scope="module")
def view(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("messages") / "b"
    folder.mkdir()

    def put(name, *messages):
        lines = [m if isinstance(m, str) else json.dumps(m) for m in messages]
        (folder / name).write_text("\n".join(lines) + "\n")
        return f"file://{folder}/{name}"

    in1 = put("call1_in.jsonl", message("user", 0, "hello"), "{broken", message("user", 9))
    out1 = put("call1_out.jsonl", message("assistant", 0, "hi", "again", data=b"xyz", name="tool", arguments={"a": [1]}, response={"ok": True}))
    in2 = put("call2_in.jsonl", message("user", 0, "hello"), message("assistant", 1, "hi"), message("user", 2, "more"), message(None, 3, "no role"))
    out2 = put("call2_out.jsonl", message(None, 0, "done"), {"role": "assistant", "index": 1, "parts": None}, {"role": "assistant", "index": 2})
    only_out = put("call3.json", message("assistant", 0, "plain"))
    logs = spark.createDataFrame(
        [
            log("i1", 0, "t1", "s1", inp=in1, out=out1),
            log("i1b", 5, "t1", "s1", inp=in1, out=out1),  # the same span again, later
            log("i2", 10, "t2", "s2", inp=in2, out=out2),
            log("i3", 20, "t3", "s3", conv=None, out=only_out),
            log("i4", 30, "t4", "s4", conv=None, inp=in1),
            log("i5", 30, "t5", "s5", conv=None, inp=in1),  # same time: the lower id stays
            log("i6", 40, "t6", "s6"),
            log("i7", 50, "t7", "s7", inp="file:///nowhere/x_1.jsonl"),
        ],
        INFERENCE_LOG,
    )
    completions, observation = telemetry.read_completions(spark, str(folder))
    result = comp.completions_view(logs, completions, any_scheme=True)
    return spark, str(folder), result.collect(), observation, result


def test_view_rows(view):
    got = {(r.insert_id, r.message_type, r.message_idx, r.part_idx): r for r in view[2]}
    assert set(got) == {
        ("i1b", "input", 0, 0), ("i1b", "output", 0, 0), ("i1b", "output", 0, 1), ("i1b", "output", 0, 2),
        ("i2", "input", 2, 0), ("i2", "output", 0, 0), ("i3", "output", 0, 0), ("i4", "input", 0, 0),
    }
    assert got["i1b", "input", 0, 0].content == "hello" and got["i1b", "input", 0, 0].api_call_id == "call1"
    blob = got["i1b", "output", 0, 2]
    assert blob.data_md5_hex == hashlib.md5(b"xyz").hexdigest() and blob.content is None
    assert (blob.tool_name, json.loads(blob.tool_args), json.loads(blob.tool_response)) == ("tool", {"a": [1]}, {"ok": True})
    assert got["i3", "output", 0, 0].api_call_id is None and got["i3", "output", 0, 0].conversation_id is None
    assert got["i2", "output", 0, 0].role is None
    assert (blob.usage_input_tokens, blob.finish_reasons, blob.user_id, blob.mime_type) == ("10", "stop", "user", "image/png")


def test_view_order_and_columns(view):
    keys = [(r.conversation_id or "", r.timestamp, r.message_type, r.message_idx, r.part_idx) for r in view[2]]
    assert keys == sorted(keys) and view[4].columns == list(comp.VIEW_COLUMNS)


def test_bad_lines(view):
    spark, folder, _, observation, _ = view
    assert telemetry.assert_few_bad(observation) == 1
    with pytest.raises(ValueError):
        telemetry.assert_few_bad(observation, 0)
    with pytest.raises(ValueError):
        telemetry.read_completions(spark, folder, max_bad_records=0, check="count")
    frame, none = telemetry.read_completions(spark, folder, max_bad_records=1, check="count")
    assert none is None and frame.count() == 11


def test_registered_view(view):
    comp.register_view(view[4])
    assert view[0].sql("SELECT count(*) AS n FROM completions_view").first().n == 8


def test_plain_sql_gives_the_same(view):
    """The same rules written once in SQL over the joined parts."""
    spark, folder, got, _, _ = view
    completions, _ = telemetry.read_completions(spark, folder, check="count")
    logs = spark.createDataFrame(
        [log(f"i{i}", i % 7, f"t{i % 5}", f"s{i % 3}", conv=[None, "a", "b"][i % 3],
             inp=f"file://{folder}/call{1 + i % 2}_in.jsonl", out=f"file://{folder}/call{1 + i % 2}_out.jsonl") for i in range(40)],
        INFERENCE_LOG)
    refs = comp.unpivot_refs(comp.log_refs(logs))
    comp.flatten_parts(comp.join_messages(refs, completions, any_scheme=True)).createOrReplaceTempView("flattened")
    expected = spark.sql("""
      WITH a AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, trace, span_id, message_type, role,
          message_idx, part_idx ORDER BY timestamp DESC, insert_id, messages_ref_uri) AS r FROM flattened),
      b AS (SELECT *, CASE WHEN message_type = 'input' THEN row_number() OVER (PARTITION BY conversation_id,
          message_type, role, message_idx, part_idx ORDER BY timestamp, insert_id, messages_ref_uri) ELSE 1 END AS x
        FROM a WHERE r = 1)
      SELECT * FROM b WHERE x = 1 AND NOT (message_type = 'input' AND role = 'assistant')""")
    ours = comp.completions_view(logs, completions, ordered=False, any_scheme=True)
    assert rows(ours) == rows(expected, *comp.VIEW_COLUMNS) and ours.count() > 10


def test_routing(spark):
    logs = spark.createDataFrame(
        [log("a", 0, "t", "s", inp="gs://demo-x/1"), log("b", 0, "t", "s", out="gs://demo-x/1"),
         log("c", 0, "t", "s", inp="gs://other/1"), log("d", 0, "t", "s", inp="gs://demo-x/1", name="p/logs/other")], INFERENCE_LOG)
    assert rows(telemetry.route_inference_logs(logs, "demo-x"), "insertId") == [("a",), ("b",)]


def test_messages_by_day(spark, tmp_path):
    files, logs_path, path = (str(tmp_path / n) for n in ("files", "logs", "messages"))
    os.mkdir(files)
    for k in range(4):
        (tmp_path / "files" / f"call{k}_in.jsonl").write_text(
            f'{{"role": "user", "index": 0, "parts": [{{"type": "text", "content": "hi {k}"}}]}}\n' + "{broken\n" * (k == 2))
    (tmp_path / "files" / "unnamed_in.jsonl").write_text('{"role": "user", "index": 0, "parts": []}\n')
    logs = [log(f"i{k}", 86400 * (k // 2), f"t{k}", "s", conv=f"c{k}", inp=f"gs://b/call{k}_in.jsonl") for k in range(4)]
    telemetry.append_logs(spark.createDataFrame(logs, INFERENCE_LOG), logs_path)
    name = lambda uri: F.regexp_extract(uri, r"([^/]+)$", 1)
    stored = telemetry.read_logs(spark, logs_path)
    refs = comp.unpivot_refs(comp.log_refs(stored))
    with pytest.raises(ValueError, match="more than 0"):
        telemetry.store_messages(spark, files, refs, path, max_bad_records=0, key=name)
    assert [f for f in os.listdir(path) if not f.startswith(("_", "."))] == []
    assert telemetry.store_messages(spark, files, refs, path, max_bad_records=1, key=name) == 1
    messages = telemetry.read_messages(spark, path)
    assert rows(messages, "file_key", "day") == sorted(
        [(f"call{k}_in.jsonl", dt.date(2024, 1, 1 + k // 2)) for k in range(4)] + [("unnamed_in.jsonl", None)], key=repr)
    view = comp.stored_view(stored.filter("day = DATE'2024-01-02'"), messages, name)
    assert rows(view, "insert_id", "content") == [("i2", "hi 2"), ("i3", "hi 3")]
    plan = view._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert len(scans) == 2 and all("2024-01-02" in s for s in scans)
    # Another batch of files is added, none is replaced.
    telemetry.store_messages(spark, files, refs, path, key=name)
    assert telemetry.read_messages(spark, path).count() == 10


def test_days_are_added_to_a_view(spark, tmp_path):
    path = str(tmp_path / "view")
    files = [(f"gs://b/call{k}_{kind}.jsonl", "user" if kind == "in" else "model", i, [("text", f"{kind} {i}")])
             for k in range(6) for kind in ("in", "out") for i in range(k + 1 if kind == "in" else 1)]
    messages = spark.createDataFrame(
        [(f, r, i, [(t, c, None, None, None, None, None, None, None) for t, c in p]) for f, r, i, p in files],
        "file_path STRING, role STRING, index BIGINT, parts ARRAY<STRUCT<type: STRING, content: STRING, mime_type: STRING, "
        "uri: STRING, data: BINARY, id: STRING, name: STRING, arguments: STRING, response: STRING>>")
    logs = [log(f"i{k}{n}", 86400 * (k // 2) + 10 * k + n, f"t{k}", "s", conv=[None, "c"][k % 2], inp=f"gs://b/call{k}_in.jsonl", out=f"gs://b/call{k}_out.jsonl")
            for k in range(6) for n in range(2)]
    frame = spark.createDataFrame(logs, INFERENCE_LOG).withColumn("day", F.to_date("timestamp"))

    def add(day):
        refs = comp.latest_refs(comp.unpivot_refs(comp.log_refs(frame.filter(F.col("day") == day))))
        comp.add_day(spark, comp.join_messages(refs, messages), day, path)

    for day in ("2024-01-01", "2024-01-02", "2024-01-02", "2024-01-03"):
        add(day)
    want = rows(comp.completions_view(frame, messages, ordered=False))
    assert rows(comp.read_days(spark, path)) == want and len(want) == 17
    # Rows of earlier days may be gone: only their keys are read.
    for file in (tmp_path / "view" / "rows" / "day=2024-01-01").glob("*"):
        file.unlink()
    add("2024-01-03")
    assert rows(comp.read_days(spark, path), "insert_id") == [r for r in rows(comp.completions_view(frame, messages), "insert_id") if int(r[0][1]) > 1]
    with pytest.raises(ValueError, match="after"):
        add("2024-01-02")


def test_bundled_message_files(spark, tmp_path):
    """Lines of many message files in one: each belongs to the file it names."""
    files, path = str(tmp_path / "files"), str(tmp_path / "messages")
    os.mkdir(files)
    line = '{"role": "user", "index": 0, "parts": [{"type": "text", "content": "hi %d"}]%s}\n'
    (tmp_path / "files" / "bundle.jsonl").write_text(
        "".join(line % (k, f', "file_path": "gs://b/call{k}_in.jsonl"') for k in range(3)) + line % (3, "") + '{"role": "broken\n')
    name = lambda uri: F.regexp_extract(uri, r"([^/]+)$", 1)
    refs = spark.createDataFrame([("gs://b/call1_in.jsonl", dt.date(2024, 1, 1)), ("gs://b/bundle.jsonl", dt.date(2024, 1, 2))], "messages_ref_uri STRING, day DATE")
    assert telemetry.store_messages(spark, files, refs, path, key=name, bundled=True) == 1
    got = telemetry.read_messages(spark, path).select("file_key", "day", F.col("parts")[0].content.alias("content"))
    assert rows(got, "file_key", "day", "content") == sorted(
        [("bundle.jsonl", dt.date(2024, 1, 2), "hi 3"), ("call0_in.jsonl", None, "hi 0"), ("call1_in.jsonl", dt.date(2024, 1, 1), "hi 1"),
         ("call2_in.jsonl", None, "hi 2")], key=repr)


def test_stored_view_writes_few_files(spark, tmp_path, monkeypatch):
    turns = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t}") for c in range(60, 130) for t in range(4)]
    spark.createDataFrame(turns, "conv_id BIGINT, turn INT, role STRING, text STRING").coalesce(2).write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(registry, "scratch_dir", lambda _, label: str(tmp_path / label))
    got = registry.QUERIES["stored_view_of_one_day"](spark, str(tmp_path))
    logs = d.inference_logs(spark, str(tmp_path)).filter(F.to_date("timestamp") == "2024-01-02")
    want = comp.completions_view(logs, d.completions(spark, str(tmp_path)), any_scheme=True)
    columns = [c for c in comp.VIEW_COLUMNS if c != "timestamp"]
    assert rows(got, *columns) == rows(want, *columns) and got.count() > 50
    assert len([f for _, _, names in os.walk(tmp_path / "files") for f in names if f.startswith("part-")]) < 70


def test_days_added_together(spark, tmp_path):
    """The same rows and keys as days added one by one, also with a day without rows and an added day again."""
    messages = spark.createDataFrame(
        [(f"gs://b/call{k}_in.jsonl", "user", i, [("text", f"in {i}", None, None, None, None, None, None, None)]) for k in range(8) for i in range(k + 1)],
        "file_path STRING, role STRING, index BIGINT, parts ARRAY<STRUCT<type: STRING, content: STRING, mime_type: STRING, "
        "uri: STRING, data: BINARY, id: STRING, name: STRING, arguments: STRING, response: STRING>>")
    # Spans are logged again, some on a later day.
    logs = [log(f"i{k}{n}", 86400 * (k // 2 + n // 2) + 10 * k + n, f"t{k}", "s", conv=[None, "c"][k % 2], inp=f"gs://b/call{k}_in.jsonl") for k in range(8) for n in range(3)]
    frame = spark.createDataFrame(logs, INFERENCE_LOG).withColumn("day", F.to_date("timestamp").cast("string"))
    joined = comp.join_messages(comp.latest_refs(comp.unpivot_refs(comp.log_refs(frame)), "day"), messages).cache()
    days = [f"2024-01-0{k}" for k in range(1, 8)]  # the last two have no rows
    one, all_, some = (str(tmp_path / name) for name in ("one", "all", "some"))
    for day in days:
        comp.add_day(spark, joined.filter(F.col("day") == day), day, one)
    comp.add_days(spark, joined, days, all_)
    comp.add_days(spark, joined.filter(F.col("day") <= days[2]), days[:3], some)
    for added in (days[2:6], days[5:]):
        comp.add_days(spark, joined.filter(F.col("day").isin(added)), added, some)
    want = rows(comp.read_days(spark, one))
    assert want == rows(comp.read_days(spark, all_)) == rows(comp.read_days(spark, some)) and len(want) > 8
    for path in (all_, some):
        assert rows(spark.read.parquet(f"{path}/keys")) == rows(spark.read.parquet(f"{one}/keys"))
        with pytest.raises(ValueError, match="after"):
            comp.add_days(spark, joined, days[:2], path)


def test_routes_in_one_scan(spark, tmp_path):
    logs = [log("a", 0, "t", "s", inp="gs://demo-x/1"), log("b", 0, "t", "s", out="gs://demo-x/1"), log("c", 0, "t", "s", name="p/logs/other")]
    entries = spark.createDataFrame(logs, INFERENCE_LOG).withColumn(
        "payload", F.when(F.col("insertId") != "a", '{"log_type": "feedback", "service_name": "engine"}'))
    telemetry.append_logs(entries, str(tmp_path / "in"))
    source = spark.read.parquet(str(tmp_path / "in")).withColumn("payload", F.when(F.col("insertId") != "a", '{"log_type": "feedback", "service_name": "engine"}'))
    routes = {"inference": telemetry.is_inference_log("demo-x"), "feedback": telemetry.is_feedback("engine"), "never": F.lit(None).cast("boolean")}
    routed = telemetry.route_entries(source, routes)
    assert rows(routed, "route", "insertId") == [("feedback", "b"), ("feedback", "c"), ("inference", "a"), ("inference", "b")]
    assert routed._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    telemetry.write_routes(source, routes, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("route=*")) == ["route=feedback", "route=inference"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_logs_by_day(spark, tmp_path):
    path = str(tmp_path / "logs")
    logs = spark.createDataFrame([log("a", 0, "t", "s"), log("b", 86400, "t", "s")], INFERENCE_LOG)
    telemetry.append_logs(logs, path)
    later = telemetry.read_logs(spark, path, F.col("day") >= "2024-01-02")
    assert rows(later, "insertId") == [("b",)]
    assert "PartitionFilters: [isnotnull(day" in later._jdf.queryExecution().toString()


def test_feedback(spark, tmp_path):
    given = spark.createDataFrame([(4.0, "Great response!", "test-user-456", "test-session-456"), (1.0, None, None, None)],
                                  "score DOUBLE, text STRING, user_id STRING, session_id STRING")
    telemetry.append_feedback(telemetry.feedback_rows(given, "engine"), str(tmp_path / "f"))
    got = spark.read.parquet(str(tmp_path / "f")).orderBy("score").collect()
    assert got[1] == (4.0, "Great response!", "feedback", "engine", "test-user-456", "test-session-456")
    assert got[0].text == "" and len(got[0].user_id) == 36 and got[0].user_id != got[0].session_id
    entries = spark.createDataFrame([('{"log_type": "feedback", "service_name": "engine"}',), ('{"log_type": "x"}',), ("bad",)], "payload STRING")
    assert telemetry.route_feedback(entries, "engine").count() == 1
