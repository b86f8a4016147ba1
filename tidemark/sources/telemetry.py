"""Inference logs, stored messages, log routing and feedback."""

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tidemark.schemas import COMPLETION, INFERENCE_LOG, INFERENCE_LOG_COLUMNS
from tidemark.session import drop_dir

MAX_BAD_RECORDS = 1000
INFERENCE_LOG_NAME = "gen_ai.client.inference.operation.details"
_CORRUPT = "_corrupt_record"


def read_logs(spark: SparkSession, path: str, days: Column | None = None) -> DataFrame:
    """Inference logs partitioned by day; ``days`` is a condition on column ``day``."""
    logs = spark.read.schema(f"{INFERENCE_LOG}, day DATE").parquet(path)
    return logs if days is None else logs.filter(days)


def append_logs(logs: DataFrame, path: str) -> None:
    (
        logs.select(*INFERENCE_LOG_COLUMNS)
        .withColumn("day", F.to_date("timestamp"))
        .hint("rebalance", "day")  # else each task writes a file for each of its days
        .write.mode("append")
        .partitionBy("day")
        .parquet(path)
    )


def read_completions(
    spark: SparkSession,
    path: str,
    max_bad_records: int = MAX_BAD_RECORDS,
    check: str = "observe",
    bundled: bool = False,
) -> tuple[DataFrame, Observation | None]:
    """Messages of newline-delimited JSON files, with ``file_path``; bad lines dropped.

    ``bundled`` files hold the lines of many message files: each line names its own in
    ``file_path``, a line that names none belongs to the file it is in.

    ``check="observe"`` counts bad lines while the data is used: call
    :func:`assert_few_bad` after the action.  ``check="count"`` counts them first, in a
    scan of its own, and raises above ``max_bad_records``.
    """
    schema = f"{COMPLETION}, {'file_path STRING, ' if bundled else ''}{_CORRUPT} STRING"
    own = F.col("_metadata.file_path")
    raw = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .option("recursiveFileLookup", "true")
        .json(path)
        .withColumn("file_path", F.coalesce("file_path", own) if bundled else own)
    )
    # Spark refuses to read the bad lines' column alone (a plain count would), so the
    # condition names a second column that adds nothing.
    is_bad = F.concat_ws("", _CORRUPT, F.substring("role", 1, 0)) != ""
    observation = None
    if check == "count":
        _raise_above(raw.filter(is_bad).limit(max_bad_records + 1).count(), max_bad_records)
    else:
        observation = Observation("completions")
        raw = raw.observe(observation, F.count_if(is_bad).alias("bad"))
    return raw.filter(~is_bad).drop(_CORRUPT), observation


def assert_few_bad(observation: Observation, max_bad_records: int = MAX_BAD_RECORDS) -> int:
    """Bad lines seen by the action that ran; raises above the limit."""
    bad = observation.get["bad"]
    _raise_above(bad, max_bad_records)
    return bad


def _raise_above(bad: int, limit: int) -> None:
    if bad > limit:
        raise ValueError(f"more than {limit} malformed message lines")


def store_messages(
    spark: SparkSession,
    files: str,
    refs: DataFrame,
    path: str,
    max_bad_records: int = MAX_BAD_RECORDS,
    key: Callable[[Column], Column] | None = None,
    bundled: bool = False,
) -> int:
    """Puts message files where a view of some days finds them: by the days of the logs that name them.

    ``refs`` (messages_ref_uri, day) are the references of the logs; ``key`` makes of a URI or path
    what both sides agree on.  A message is stored under each day it is named in, one that
    no log names under none.  The write counts malformed lines as it goes; above the limit
    nothing is published and it raises.  Returns their number.  ``bundled`` is that of
    :func:`read_completions`.
    """
    if key is None:
        def key(uri: Column) -> Column:
            return uri

    messages, observation = read_completions(spark, files, bundled=bundled)
    named = refs.select(key(F.col("messages_ref_uri")).alias("file_key"), "day").distinct()
    placed = messages.withColumn("file_key", key(F.col("file_path"))).join(named, "file_key", "left")
    hidden = f"{path.rstrip('/')}/_landing-{uuid.uuid4().hex}"
    placed.hint("rebalance", "day").write.partitionBy("day").parquet(hidden)
    try:
        bad = assert_few_bad(observation, max_bad_records)
        _publish(spark, hidden, path.rstrip("/"))
    finally:
        drop_dir(spark, hidden)
    return bad


def _publish(spark: SparkSession, hidden: str, path: str) -> None:
    """Moves the files of each day to that day's folder."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(hidden)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for day in fs.listStatus(root):
        name = day.getPath().getName()
        if day.isDirectory() and name.startswith("day="):
            target = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            fs.mkdirs(target)
            for file in fs.listStatus(day.getPath()):
                fs.rename(file.getPath(), jvm.org.apache.hadoop.fs.Path(target, file.getPath().getName()))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages as :func:`store_messages` keeps them, with ``file_key`` and ``day``."""
    return spark.read.schema(f"{COMPLETION}, file_path STRING, file_key STRING, day DATE").parquet(path)


def route_entries(entries: DataFrame, routes: Mapping[str, Column]) -> DataFrame:
    """Entries with the ``route`` they take, from one scan: a row for each route whose condition holds.

    An entry may take several routes, or none.
    """
    taken = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in routes.items()]))
    return entries.withColumn("route", F.explode(taken))


def write_routes(entries: DataFrame, routes: Mapping[str, Column], path: str) -> None:
    """Appends entries to the folder of each route they take, in one scan and one write."""
    route_entries(entries, routes).hint("rebalance", "route").write.mode("append").partitionBy("route").parquet(path)


def is_inference_log(project: str) -> Column:
    """Log name of an inference log, and a reference to the project."""
    refs = [F.col(f"labels.gen_ai_{kind}_messages_ref") for kind in ("input", "output")]
    named = [F.coalesce(ref.contains(F.lit(project)), F.lit(False)) for ref in refs]
    return F.col("logName").endswith(f"/logs/{INFERENCE_LOG_NAME}") & (named[0] | named[1])


def is_feedback(service: str) -> Column:
    """Feedback of a service, by its JSON body in ``payload``."""
    doc = F.from_json("payload", "log_type STRING, service_name STRING")
    return (doc.getField("log_type") == "feedback") & (doc.getField("service_name") == service)


def route_inference_logs(entries: DataFrame, project: str) -> DataFrame:
    """Log entries for the inference table: log name, and a reference to the project."""
    return entries.filter(is_inference_log(project))


def route_feedback(entries: DataFrame, service: str) -> DataFrame:
    """Log entries for the feedback table (JSON body in ``payload``)."""
    return entries.filter(is_feedback(service))


def feedback_rows(rows: DataFrame, service: str) -> DataFrame:
    """Feedback with its defaults: empty text, constant type, random ids."""

    def given(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    return rows.select(
        F.col("score").cast("double").alias("score"),
        F.coalesce(given("text"), F.lit("")).alias("text"),
        F.lit("feedback").alias("log_type"),
        F.lit(service).alias("service_name"),
        F.coalesce(given("user_id"), F.uuid()).alias("user_id"),
        F.coalesce(given("session_id"), F.uuid()).alias("session_id"),
    )


def append_feedback(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
