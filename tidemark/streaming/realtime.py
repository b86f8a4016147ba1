"""Realtime scope: evaluate weekly files as they arrive.

The stream watches file arrivals (names only, contents are not read by it) and lands
their rows in a Parquet store, each micro batch under its own partition, so a batch that
is run again replaces its own attempt.  Evaluation is a step of its own over all that
has landed: the stored result does not depend on how arrivals were cut into batches.

Rows and state lie by bucket of the employee's hash, and a journal says which buckets a
batch touched.  An evaluation reads and writes only buckets of batches it hasn't seen, as
long as no later week and no pasted text has come, which concern everybody.  ``compact``
keeps the number of files down.
"""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.timeline import keep_first, max_week_of
from tidemark.plans.weekly_run import employees_due, evaluate, late_frontier, no_responses, write_scope_report
from tidemark.schemas import EMPLOYEE_WEEK
from tidemark.session import drop_dir, scratch_dir
from tidemark.sources import evaluations as state_table, weekly

_ARRIVAL = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def arrivals(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Stream of the paths of new weekly files and pasted texts."""
    return (
        spark.readStream.format("binaryFile")
        .schema(_ARRIVAL)
        .option("pathGlobFilter", "*.{csv,txt}")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
        .select("path")
        .filter(F.col("path").rlike(r"\.csv$|/week=\d+/[^/]*\.txt$"))
    )


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _batches(spark: SparkSession, folder: str) -> list[int]:
    fs, root = _folder(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def land_batch(spark: SparkSession, paths: list[str], batch_id: int, store: str, **reading) -> None:
    """Writes the rows of a batch's files, replacing an earlier attempt, and notes in the journal whom they touch.

    Rows lie by bucket of their employee.  The journal comes last: without it the batch doesn't count.
    """
    store = store.rstrip("/")
    rows = weekly.scan_employee_weeks(spark, "", files=paths, **reading)
    bucketed = rows.withColumn("bucket", state_table.bucket_of(F.col("employee")))
    target = f"{store}/rows/batch={batch_id}"
    bucketed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
    _write_journal(spark, store, batch_id, spark.read.schema(bucketed.schema).parquet(target))


def _write_journal(spark: SparkSession, store: str, batch_id: int, rows: DataFrame) -> None:
    file = F.col(weekly.ROW_ORDER).getField("file")
    (
        rows.groupBy("bucket", "employee", file.alias("file"))
        .agg(F.max("week").alias("week"), F.max(weekly.pasted_at()).alias("pasted"))
        .write.mode("overwrite")
        .parquet(f"{store}/journal/batch={batch_id}")
    )


_JOURNAL = "bucket INT, employee STRING, file STRING, week INT, pasted TIMESTAMP, batch INT"
_EVALUATED = "scope STRING, batch INT, week INT"


def journal(spark: SparkSession, store: str) -> DataFrame | None:
    """(batch, bucket, employee, file, week, pasted) of all that has landed; None if nothing has."""
    folder = f"{store.rstrip('/')}/journal"
    return spark.read.schema(_JOURNAL).parquet(folder) if _batches(spark, folder) else None


def evaluated(spark: SparkSession, store: str) -> DataFrame:
    """(scope, batch, week): batches that are in the state of a scope, and the last week then."""
    fs, root = _folder(spark, path := f"{store.rstrip('/')}/evaluated")
    return spark.read.schema(_EVALUATED).parquet(path) if fs.exists(root) else spark.createDataFrame([], _EVALUATED)


def landed_rows(spark: SparkSession, store: str, buckets: Sequence[int] | None = None) -> DataFrame | None:
    """Rows in the store, less those of replaced weeks; None when nothing has landed.

    With ``buckets`` only the folders of these are read.  Rows of a batch that isn't in the
    journal yet don't count.
    """
    store, noted = store.rstrip("/"), journal(spark, store)
    if noted is None:
        return None
    columns = weekly.scan_employee_weeks(spark, "", files=[]).schema
    schema = T.StructType([*columns.fields, T.StructField("batch", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    batches = _batches(spark, f"{store}/journal")
    rows = spark.read.schema(schema).parquet(f"{store}/rows").filter(F.col("batch").isin(*batches))
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(*buckets))
    return weekly.without_replaced(rows.select(*columns.names), noted.select("file", "pasted"))


def touched_buckets(spark: SparkSession, store: str, scope: str) -> list[int] | None:
    """Buckets a scope has to evaluate; None for all.

    These are the buckets of the batches it hasn't seen.  All are due when a batch brought a later
    week (everybody's timeline grows) or a pasted text (which may take records from anybody).
    """
    noted, seen = journal(spark, store), evaluated(spark, store).filter(F.col("scope") == scope)
    pending = noted.join(F.broadcast(seen.select("batch").distinct()), "batch", "left_anti")
    now = pending.agg(F.max("week").alias("week"), F.max("pasted").alias("pasted"), F.collect_set("bucket").alias("buckets")).first()
    before = seen.agg(F.max("week")).first()[0]
    if now.week is None:
        return []
    if before is None or now.week > before or now.pasted is not None:
        return None
    return sorted(now.buckets)


def evaluate_landed(
    spark: SparkSession,
    store: str,
    state_path: str,
    responses: DataFrame | None = None,
    scope: str = "realtime",
    as_of: dt.datetime | None = None,
    recompute_from: int | None = None,
    max_weeks: int | None = None,
    streak_mode: str = "stored",
    recompute_late: bool = False,
) -> None:
    """Evaluates what the state lacks of all that has landed.

    Only the buckets touched since the scope's last evaluation are read and written, in the
    store and in the state, and in them only employees with something to do are evaluated.
    ``recompute_from`` is about everybody; ``recompute_late`` redoes an employee's weeks from the
    first one on whose record came late.  Cases are searched in the whole state.
    """
    noted = journal(spark, store)
    if noted is None:
        return
    buckets = touched_buckets(spark, store, scope) if recompute_from is None else None
    if buckets == []:
        return
    batches = _batches(spark, f"{store.rstrip('/')}/journal")
    staging = scratch_dir(spark, "landed")
    landed = landed_rows(spark, store, buckets)
    keep_first(landed, F.col(weekly.ROW_ORDER)).drop(weekly.ROW_ORDER).write.parquet(staging)
    records = spark.read.schema(EMPLOYEE_WEEK).parquet(staging)
    weeks = records.select("week") if buckets is None else noted.select("week").union(evaluated(spark, store).select("week"))
    max_week = max_week_of(weeks, max_weeks)
    pool = state_table.read_state(spark, state_path, scope)
    state = pool if buckets is None else state_table.read_state(spark, state_path, scope, buckets)
    redo = late_frontier(records, state, scope) if recompute_late and recompute_from is None else recompute_from
    due = employees_due(records, max_week, state, scope, redo)
    new = evaluate(
        records.join(due, "employee", "left_semi"),
        max_week,
        state,
        no_responses(spark) if responses is None else responses,
        scope,
        as_of or dt.datetime.now(dt.timezone.utc),
        recompute_from=redo,
        streak_mode=streak_mode,
        pool=pool,
    )
    state_table.upsert_state(spark, state_path, new)
    done = spark.createDataFrame([(b,) for b in batches], "batch INT").withColumn("week", max_week)
    done.select(F.lit(scope).alias("scope"), "batch", "week").coalesce(1).write.mode("append").parquet(f"{store.rstrip('/')}/evaluated")
    drop_dir(spark, staging)


def compact(spark: SparkSession, store: str) -> None:
    """Puts the batches that every scope has evaluated into one, a file or few for each bucket.

    The new batch is whole before the old ones go; rows that are there twice if that is cut short
    are the same rows, of which the first counts anyway.  To be called between batches.
    """
    store = store.rstrip("/")
    batches = _batches(spark, f"{store}/journal")
    marks = evaluated(spark, store)
    scopes = marks.select("scope").distinct().count()
    seen = marks.groupBy("batch").agg(F.count_distinct("scope").alias("n"), F.max("week").alias("week")).filter(F.col("n") == scopes)
    old = sorted({r.batch for r in seen.collect()} & set(batches))  # one number a batch
    if len(old) < 2:
        return
    merged = min(0, *old) - 1  # below all batch numbers of the stream
    columns = weekly.scan_employee_weeks(spark, "", files=[]).schema
    schema = T.StructType([*columns.fields, T.StructField("batch", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{store}/rows").filter(F.col("batch").isin(*old)).drop("batch")
    target = f"{store}/rows/batch={merged}"
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
    whole = T.StructType([*columns.fields, T.StructField("bucket", T.IntegerType())])
    _write_journal(spark, store, merged, spark.read.schema(whole).parquet(target))
    again = marks.filter(F.col("batch").isin(*old)).groupBy("scope").agg(F.max("week").alias("week"))
    again.select("scope", F.lit(merged).alias("batch"), "week").coalesce(1).write.mode("append").parquet(f"{store}/evaluated")
    for batch in old:
        drop_dir(spark, f"{store}/journal/batch={batch}")
        drop_dir(spark, f"{store}/rows/batch={batch}")


def start(
    spark: SparkSession,
    folder: str,
    store: str,
    checkpoint: str,
    max_files: int = 1000,
    trigger: dict | None = None,
    **reading,
) -> StreamingQuery:
    """Starts landing files; by default it takes what is there and stops.

    With a lasting ``trigger`` call ``evaluate_landed`` as often as results are wanted.
    ``reading`` goes to ``weekly.scan_employee_weeks``.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        # At most ``max_files`` names per batch.
        paths = sorted(r.path for r in batch.select("path").collect())
        if paths:
            land_batch(spark, paths, batch_id, store, **reading)

    return (
        arrivals(spark, folder, max_files)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run(
    spark: SparkSession,
    folder: str,
    store: str,
    state_path: str,
    checkpoint: str,
    responses: DataFrame | None = None,
    scope: str = "realtime",
    as_of: dt.datetime | None = None,
    recompute_from: int | None = None,
    max_weeks: int | None = None,
    streak_mode: str = "stored",
    max_files: int = 1000,
    report_path: str | None = None,
    **reading,
) -> None:
    """Lands all that is waiting, then evaluates once."""
    start(spark, folder, store, checkpoint, max_files, **reading).awaitTermination()
    evaluate_landed(
        spark, store, state_path, responses, scope, as_of, recompute_from, max_weeks, streak_mode
    )
    if report_path is not None:
        write_scope_report(spark, state_path, scope, report_path)
