"""The evaluation state table and evaluations kept as JSON files."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.cleaning import capitalise, safe_int
from tidemark.functions.model_text import whole_number
from tidemark.schemas import EVALUATION, EVALUATION_COLUMNS, EVALUATION_JSON, SIGNAL_DDL
from tidemark.session import drop_dir, scratch_dir

KEY = ["scope", "employee", "week"]
BUCKETS = 16
_PLACE = ["scope", "bucket", "week"]  # folders of the state
_STORED = f"{EVALUATION}, bucket INT"


def bucket_of(employee: Column) -> Column:
    """Bucket of an employee, in the state and in the store of landed rows."""
    return F.pmod(F.xxhash64(employee), F.lit(BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(root) and any(
        s.getPath().getName().startswith("scope=") for s in fs.listStatus(root)
    )


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVALUATION)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(path)


def read_state(spark: SparkSession, path: str, scope: str | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
    """Stored evaluations, of one scope or of all; empty when nothing is stored yet.

    ``buckets`` limits what is read to the folders of these buckets of employees.
    """
    if not _exists(spark, path):
        return empty_state(spark)
    state = _stored(spark, path)
    if buckets is not None:
        state = state.filter(F.col("bucket").isin(*buckets))
    state = state.select(*EVALUATION_COLUMNS)
    return state if scope is None else state.filter(F.col("scope") == scope)


def upsert_state(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Replaces or adds evaluations by (scope, employee, week).

    The update is computed once, into a staging table in the shared folder, and merged
    there with what is kept; the state is read no more when its files are replaced, and
    a failed replacement leaves the merged rows and says where.  Only the (scope, bucket
    of employees, week) folders that get rows are read, found by a semi-join that prunes
    the scan, and rewritten: an update of one employee touches one folder a week.
    Writers are rebalanced by size: a small folder is one file, a large one as many as
    it needs.
    """
    staging = scratch_dir(spark, "update")
    bucket = bucket_of(F.col("employee")).alias("bucket")
    new.select(*EVALUATION_COLUMNS, bucket).write.parquet(staging)
    new = spark.read.schema(_STORED).parquet(staging)
    if _exists(spark, path):
        # One row a folder: as few as there are scopes, buckets and weeks.
        touched = F.broadcast(new.select(*_PLACE).distinct())
        kept = _stored(spark, path).join(touched, _PLACE, "left_semi").join(new.select(*KEY), KEY, "left_anti")
        merged = scratch_dir(spark, "merged")
        new.unionByName(kept).write.parquet(merged)
        drop_dir(spark, staging)
        new, staging = spark.read.schema(_STORED).parquet(merged), merged
    try:
        (
            new.hint("rebalance", *_PLACE)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*_PLACE)
            .parquet(path)
        )
    except Exception as error:
        raise RuntimeError(f"state not replaced; its touched partitions are whole in {staging}") from error
    drop_dir(spark, staging)


def key_from_file(name: Column) -> tuple[Column, Column]:
    """(employee, week) of ``<name>_week<n>.json``; NULL for any other shape."""
    shape = r"^((?:(?!_week).)*)_week(-?\d+)\.json$"
    fits = name.rlike(shape)
    return (
        F.when(fits, capitalise(F.regexp_extract(name, shape, 1))),
        F.when(fits, F.regexp_extract(name, shape, 2).try_cast("int")),
    )


def parse_evaluations(rows: DataFrame, scope: str) -> DataFrame:
    """Valid EVALUATION rows out of parsed documents with ``file`` and ``written_at``.

    Dropped: documents that do not parse, lack a required field, or have a file name
    of another shape.
    """
    employee, week = key_from_file(F.col("file"))
    signals = F.transform(
        "signals",
        lambda s: F.struct(
            F.when(s.getField("signal_name").isNotNull() & (s.getField("signal_name") != ""), "signal")
            .otherwise("gap")
            .alias("kind"),
            F.coalesce(
                F.nullif(s.getField("signal_name"), F.lit("")), s.getField("signal"), F.lit("Unknown")
            ).alias("signal_name"),
            s.getField("weeks_detected").alias("weeks_detected"),
            s.getField("severity").alias("severity"),
            s.getField("details").alias("details"),
        ),
    )
    required = (
        F.col("_corrupt_record").isNull()
        & F.col("score").isNotNull()
        & F.col("classification").isNotNull()
        & F.col("rationale").isNotNull()
    )
    return (
        rows.filter(required)
        .withColumns({"employee": employee, "week": week})
        .filter(F.col("week").isNotNull())
        .select(
            F.lit(scope).alias("scope"),
            "employee",
            "week",
            whole_number(F.col("score")).alias("score"),
            "classification",
            "rationale",
            safe_int(F.col("healthy_streak"), 0).alias("healthy_streak"),
            signals.cast(f"ARRAY<{SIGNAL_DDL}>").alias("signals"),
            "briefing",
            F.when(F.col("rationale").contains("[Local ML Fallback"), "case")
            .when(F.col("rationale").startswith("Evaluation could not be completed"), "default")
            .otherwise("model")
            .alias("origin"),
            F.col("written_at").alias("evaluated_at"),
        )
    )


def read_evaluation_files(spark: SparkSession, folder: str, scope: str = "main") -> DataFrame:
    """EVALUATION rows of a folder with one JSON document per (employee, week)."""
    docs = (
        spark.read.schema(EVALUATION_JSON)
        .option("multiLine", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(f"{folder.rstrip('/')}/*.json")
        .select(
            "*",
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_modification_time").alias("written_at"),
        )
    )
    return parse_evaluations(docs, scope)
