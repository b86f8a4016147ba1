"""Weekly metric files with varying headers, and the other ways rows arrive.

The driver lists the files; tasks find their first records, of which each different one comes
back once, and all files laid out alike are then read in one scan.  No data row passes
through the driver and it opens no file.
"""

import csv
import io
import logging
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidemark import constants as C
from tidemark.functions.cleaning import (
    capitalise,
    cell_or_default,
    first_token,
    safe_double,
    safe_int,
    strip,
)
from tidemark.schemas import EMPLOYEE_WEEK
from tidemark.sources import csv_records
from tidemark.sources.csv_records import FileKinds

logger = logging.getLogger(__name__)

_CSV_OPTIONS = {"header": "true", "escape": '"', "enforceSchema": "true", "mode": "PERMISSIVE"}
ROW_ORDER = "_row_order"


# --- header resolution ----------------------------------------------------------


def _squeezed(name: str) -> str:
    return re.sub(r"[_\- ]", "", name.strip().lower())


def _exact(headers: Sequence[str], aliases: Sequence[str]) -> str | None:
    wanted = {_squeezed(a) for a in aliases}
    return next((h for h in headers if h and _squeezed(h) in wanted), None)


def _similar(headers: Sequence[str], aliases: Sequence[str]) -> str | None:
    is_hours = "hours" in aliases or "weekly_hours" in aliases
    lowered = [a.strip().lower() for a in aliases]
    for header in filter(None, headers):
        h = header.strip().lower()
        if is_hours and "after" in h:
            continue
        if any(a in h or h in a for a in lowered):
            return header
    return None


def resolve_headers(
    headers: Sequence[str],
    aliases: Mapping[str, Sequence[str]] = C.COLUMN_ALIASES,
    strict_parity: bool = False,
) -> dict[str, str | None]:
    """Header of each metric: same letters first, else one name inside the other.

    By default a column serves one metric only, exact matches first, so a latency
    column cannot become the hours.  ``strict_parity`` resolves each metric alone.
    """
    if strict_parity:
        return {m: _exact(headers, a) or _similar(headers, a) for m, a in aliases.items()}
    bound: dict[str, str | None] = {}
    for metric, names in aliases.items():
        bound[metric] = _exact([h for h in headers if h not in bound.values()], names)
    for metric, names in aliases.items():
        if bound[metric] is None:
            free = [h for h in headers if h not in bound.values()]
            bound[metric] = _similar(free, names)
    return bound


def header_value(headers: Sequence[str], aliases: Sequence[str], default: str = "") -> Column:
    """Cell of the header one alias list resolves to, or the default when empty."""
    header = _exact(headers, aliases) or _similar(headers, aliases)
    return F.lit(default) if header is None else cell_or_default(F.col(f"`{header}`"), default)


# --- typed rows -----------------------------------------------------------------


def to_employee_week(
    rows: DataFrame,
    cells: Mapping[str, Column | None],
    week: Column,
    source_file: Column,
    missing_as_null: bool = False,
    employee_key: Column | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Rows in the EMPLOYEE_WEEK schema out of text cells per metric.

    Counts and response time default to 0 (NULL with ``missing_as_null``), hours,
    accuracy and sentiment to NULL.  ``employee_key`` replaces the first name as key.
    """
    absent = F.lit(None).cast("string")

    def cell(metric: str) -> Column:
        value = cells.get(metric)
        return absent if value is None else F.nullif(value, F.lit(""))

    zero = None if missing_as_null else 0
    return rows.select(
        (first_token(cell("name")) if employee_key is None else employee_key).alias("employee"),
        week.cast("int").alias("week"),
        safe_int(cell("tasks_completed"), zero).alias("completed_tasks"),
        safe_double(cell("avg_response_time"), zero).alias("response_time"),
        safe_int(cell("after_hours_logins"), zero).alias("after_hours_logins"),
        safe_int(cell("sick_days"), zero).alias("sick_days"),
        safe_int(cell("weekly_hours")).alias("weekly_hours"),
        safe_int(cell("task_accuracy")).alias("task_accuracy"),
        capitalise(cell("sentiment")).alias("sentiment"),
        source_file.alias("source_file"),
        *extra,
    )


def alias_table(
    rows: DataFrame,
    week: Column,
    source_file: Column | None = None,
    aliases: Mapping[str, Sequence[str]] = C.COLUMN_ALIASES,
    strict_parity: bool = False,
    ignore: Sequence[str] = ("week",),
    **options,
) -> DataFrame:
    """EMPLOYEE_WEEK rows from any table whose columns go by accepted spellings.

    ``ignore`` names columns that are no metric.
    """
    headers = [c for c in rows.columns if c not in ignore]
    bound = resolve_headers(headers, aliases, strict_parity)
    cells = {m: None if h is None else F.col(f"`{h}`").cast("string") for m, h in bound.items()}
    source = F.lit("") if source_file is None else source_file
    return to_employee_week(rows, cells, week, source, **options)


# --- files ----------------------------------------------------------------------


def week_from_stem(stem: Column) -> Column:
    """All digits of a file stem as one number, 1 without digits."""
    return F.coalesce(F.regexp_replace(stem, r"\D", "").try_cast("int"), F.lit(1))


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Data files, sorted; [] without folder: ``*.csv`` of the folder, and what was landed in its ``week=N`` folders.

    A pasted text (``.txt``) replaces the files of its week that are older.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found: list[tuple[str, str, int]] = []
    pasted: dict[str, int] = {}
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and re.fullmatch(r"week=\d+", name):
            logical, inner, ends = name.replace("=", "") + ".csv", fs.listStatus(status.getPath()), (".csv", ".txt")
        else:
            logical, inner, ends = name, [status] if status.isFile() else [], (".csv",)
        for part in inner:
            path, landed = part.getPath(), part.getModificationTime()
            if path.getName().endswith(ends) and path.getName()[0] not in "._":
                found.append((path.toString(), logical, landed))
                if path.getName().endswith(".txt"):
                    pasted[logical] = max(landed, pasted.get(logical, 0))
    return sorted(path for path, logical, landed in found if landed >= pasted.get(logical, 0))


def _parsed(header: str) -> tuple[str, ...]:
    """Column names of a first record; none where it cannot be read."""
    try:
        return tuple(next(csv.reader(io.StringIO(header, newline="")), ()))
    except csv.Error as error:
        logger.warning("files skipped, header not readable: %s", type(error).__name__)
        return ()


def header_groups(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], FileKinds]:
    """Files by header; the first records are found by tasks."""
    groups: dict[tuple[str, ...], FileKinds] = {}
    for first, files in csv_records.headers(spark, paths).items():
        if header := _parsed(first):
            groups.setdefault(header, FileKinds()).add(files)
    return groups


def _cells(spark: SparkSession, schema: T.StructType, files: FileKinds, multi_line: bool) -> list[DataFrame]:
    """Cells c0.. of files laid out alike, with path, landed, block and row of each record."""
    place = [
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("landed"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ]
    found = []
    plain = files.plain if multi_line else files.plain + files.spanning + files.unclosed
    for paths, whole in ((plain, False), (files.unclosed if multi_line else [], True)):
        if paths:
            reader = spark.read.options(**_CSV_OPTIONS, multiLine=whole).schema(schema)
            found.append(reader.csv(paths).select(*schema.names, *place))
    if multi_line and files.spanning:
        options = {"escape": '"', "mode": "PERMISSIVE"}
        rows = csv_records.records(spark, files.spanning)
        cells = F.from_csv("text", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
        found.append(rows.withColumn("cells", cells).select("cells.*", "path", "landed", "block", "row"))
    return found


def _scan_group(spark: SparkSession, header: tuple[str, ...], files: FileKinds, multi_line: bool) -> DataFrame:
    """All-text rows of the files that share a header, with week, file and row order.

    Columns are read by position, so repeated names are safe; the last one counts.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    raw, *more = _cells(spark, schema, files, multi_line)
    for rows in more:
        raw = raw.union(rows)
    path = F.col("path")
    folder_week = F.nullif(F.regexp_extract(path, r"/week=(\d+)/[^/]*$", 1), F.lit(""))
    name = F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))
    logical = F.coalesce(F.concat(F.lit("week"), folder_week, F.lit(".csv")), name)
    position = {h: i for i, h in enumerate(header) if h}
    return raw.select(
        *[F.col(f"c{i}").alias(h) for h, i in position.items()],
        week_from_stem(F.regexp_replace(logical, r"\.[^.]*$", "")).alias("__week_number__"),
        logical.alias("__source_file__"),
        F.struct(logical.alias("file"), "landed", name.alias("part"), "block", "row").alias(ROW_ORDER),
    )


def scan_raw(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame | None:
    """Union of all files with their own column names plus week and file; None if empty."""
    groups = header_groups(spark, list_files(spark, folder))
    union = None
    for header, files in groups.items():
        rows = _scan_group(spark, header, files, multi_line)
        union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
    return union


def _layout(header: Sequence[str], strict: bool, strict_parity: bool) -> tuple:
    """Column positions of each metric, so that files spelled differently but laid out
    alike are read in one scan.  Of a repeated name the last column counts."""
    position = {h: i for i, h in enumerate(header) if h}
    if strict:
        return tuple(
            (metric, tuple(position[a] for a in spellings if a in position))
            for metric, spellings in C.STRICT_COLUMNS.items()
        )
    bound = resolve_headers(list(position), strict_parity=strict_parity)
    return tuple((m, () if h is None else (position[h],)) for m, h in bound.items())


def empty_employee_weeks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EMPLOYEE_WEEK)


def scan_employee_weeks(
    spark: SparkSession,
    folder: str,
    strict: bool = False,
    strict_parity: bool = False,
    target_week: int | None = None,
    missing_as_null: bool = False,
    multi_line: bool = True,
    files: Sequence[str] | None = None,
    full_names: bool = False,
) -> DataFrame:
    """EMPLOYEE_WEEK rows of every weekly file, with the row order in ``_row_order``.

    ``folder`` is any path Spark can read, object stores included.  ``strict`` takes the
    exact column set only (no hours, accuracy, sentiment; empty cells fall through to
    the next spelling).  ``target_week`` overrides the week of the file name.
    Line ends inside quotes are part of a cell, and big files split all the same;
    ``multi_line=False`` takes every line for a record.
    ``full_names`` keeps people apart who share a first name.
    """
    paths = list_files(spark, folder) if files is None else list(files)
    layouts: dict[tuple, FileKinds] = {}
    for header, group in header_groups(spark, paths).items():
        layout = (len(header), _layout(header, strict, strict_parity))
        layouts.setdefault(layout, FileKinds()).add(group)
    union = None
    for (width, places), group in layouts.items():
        raw = _scan_group(spark, tuple(f"c{i}" for i in range(width)), group, multi_line)
        cells = {
            metric: F.coalesce(*[F.nullif(F.col(f"c{i}"), F.lit("")) for i in found]) if found else None
            for metric, found in places
        }
        week = F.col("__week_number__") if target_week is None else F.lit(target_week)
        key = None
        if full_names and cells["name"] is not None:
            key = F.coalesce(F.nullif(strip(cells["name"]), F.lit("")), F.lit("Unknown"))
        rows = to_employee_week(
            raw, cells, week, F.col("__source_file__"), missing_as_null, key, extra=(ROW_ORDER,)
        )
        union = rows if union is None else union.unionByName(rows)
    if union is None:
        order = "STRUCT<file: STRING, landed: TIMESTAMP, part: STRING, block: BIGINT, row: BIGINT>"
        return empty_employee_weeks(spark).withColumn(ROW_ORDER, F.lit(None).cast(order))
    return union


def pasted_at() -> Column:
    """When a scanned row arrived, if it came with a pasted text."""
    order = F.col(ROW_ORDER)
    return F.when(order.getField("part").endswith(".txt"), order.getField("landed"))


def without_replaced(rows: DataFrame, pasted: DataFrame | None = None) -> DataFrame:
    """Scanned rows of several arrivals, less those that a later pasted text replaced.

    ``pasted`` (file, pasted) says when texts were pasted, if ``rows`` doesn't hold them all.
    """
    file, landed = F.col(ROW_ORDER).getField("file"), F.col(ROW_ORDER).getField("landed")
    if pasted is None:
        pasted = rows.select(file.alias("file"), pasted_at().alias("pasted"))
    last = (
        pasted.filter(F.col("pasted").isNotNull())
        .groupBy(F.col("file").alias("_file"))
        .agg(F.max("pasted").alias("_pasted"))
    )
    return rows.join(last, (file == F.col("_file")) & (landed < F.col("_pasted")), "left_anti")


def input_problem(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> str | None:
    """What keeps a run from starting, in words, or None when there is data."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return f"Data folder '{folder}' does not exist. Please create it and add weekly CSV files."
    if not list_files(spark, folder):
        return f"No CSV files found in {folder}. Run stopped."
    if rows is not None and rows.isEmpty():
        return "No valid employee data found in CSV files."
    return None


# --- other arrivals -------------------------------------------------------------


def land_csv_text(pasted: DataFrame, folder: str) -> None:
    """Writes pasted CSV texts (week, seq, csv_content) as that week's file, replacing it.

    ``seq`` is the order of arrival: of several texts for a week the last one counts.
    """
    texts = pasted.groupBy("week").agg(F.max_by("csv_content", "seq").alias("value"))
    (
        texts.select("week", F.regexp_replace("value", r"(?U)^\s+|\s+\z", "").alias("value"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("week")
        .text(folder)
    )


def append_rows(rows: DataFrame, folder: str) -> None:
    """Appends metric rows (any accepted spellings plus ``week``) to their week.

    Files are sized by the data (adaptive rebalancing), each with its own header.
    """
    (
        rows.hint("rebalance", "week")
        .write.mode("append")
        .option("header", "true")
        .option("escape", '"')
        .partitionBy("week")
        .csv(folder)
    )


def read_database(
    spark: SparkSession,
    url: str,
    table: str,
    target_week: int,
    partition: Mapping[str, str | int] | None = None,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """EMPLOYEE_WEEK rows of a database table, all in ``target_week``.

    ``partition`` (partitionColumn, lowerBound, upperBound, numPartitions) makes the
    read parallel; without it one task reads the table.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for key, value in {**(partition or {}), **(properties or {})}.items():
        reader = reader.option(key, value)
    return alias_table(reader.load(), F.lit(target_week), F.lit(table))
