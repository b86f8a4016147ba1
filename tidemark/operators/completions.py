"""One row per conversation message part, out of inference logs and stored messages.

Shuffles, in order: the join on the file URI, the first-copy rule within a span, the
first-copy rule across traces, and the final sort if asked for.  Each of the two rules
is a ``row_number() = 1`` filter, which Spark also applies before the shuffle, so a hot
group (all logs without a conversation id, say) leaves every map task as one row per
key.  Output rows keep their trace and span in the second key: they are never gathered
per conversation.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

VIEW_COLUMNS = (
    "timestamp",
    "insert_id",
    "trace",
    "span_id",
    "conversation_id",
    "api_call_id",
    "message_type",
    "role",
    "message_idx",
    "part_idx",
    "content",
    "part_type",
    "tool_name",
    "tool_args",
    "tool_response",
    "usage_input_tokens",
    "usage_output_tokens",
    "agent_name",
    "finish_reasons",
    "user_id",
    "uri",
    "mime_type",
    "data_md5_hex",
    "messages_ref_uri",
)
VIEW_ORDER = ("conversation_id", "timestamp", "message_type", "message_idx", "part_idx")
_MESSAGE_KEY = ("conversation_id", "message_type", "role", "message_idx", "part_idx")
_TIE_BREAK = ("insert_id", "messages_ref_uri")


def log_refs(logs: DataFrame) -> DataFrame:
    """Flat log rows that point to at least one message file."""
    labels = {
        "conversation_id": "gen_ai_conversation_id",
        "input_ref": "gen_ai_input_messages_ref",
        "output_ref": "gen_ai_output_messages_ref",
        "usage_input_tokens": "gen_ai_usage_input_tokens",
        "usage_output_tokens": "gen_ai_usage_output_tokens",
        "agent_name": "gen_ai_agent_name",
        "finish_reasons": "gen_ai_response_finish_reasons",
        "user_id": "user_id",
    }
    return logs.select(
        F.col("insertId").alias("insert_id"),
        "timestamp",
        "trace",
        F.col("spanId").alias("span_id"),
        *[F.col(f"labels.{label}").alias(name) for name, label in labels.items()],
        *(["day"] if "day" in logs.columns else []),
    ).filter(F.col("input_ref").isNotNull() | F.col("output_ref").isNotNull())


def unpivot_refs(refs: DataFrame) -> DataFrame:
    """One row per reference, from one scan of the logs."""
    both = F.array(
        *[
            F.struct(F.lit(kind).alias("message_type"), F.col(ref).alias("messages_ref_uri"))
            for kind, ref in (("input", "input_ref"), ("output", "output_ref"))
        ]
    )
    kept = [c for c in refs.columns if c not in ("input_ref", "output_ref")]
    return (
        refs.select(*kept, F.explode(both).alias("ref"))
        .select(*kept, "ref.message_type", "ref.messages_ref_uri")
        .filter(F.col("messages_ref_uri").isNotNull())
    )


def file_key(uri: Column) -> Column:
    """Bucket and path of a URI, whatever the scheme it is read with."""
    return F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:/+|^/+", "")


def api_call_id(uri: Column) -> Column:
    """File stem up to the first underscore; NULL for a file that is not ``.jsonl``."""
    stem = F.nullif(F.regexp_extract(uri, r"/([^/]+)\.jsonl", 1), F.lit(""))
    return F.substring_index(stem, "_", 1)


def latest_refs(refs: DataFrame, *within: str) -> DataFrame:
    """Drops repeated logs of one span and file before the join, ``within`` a day, say.

    They carry the same messages, so the rule within a span would keep the latest one
    for every part anyway.
    """
    keys = (*within, "conversation_id", "trace", "span_id", "message_type", "messages_ref_uri")
    newest_first = W.partitionBy(*keys).orderBy(F.desc("timestamp"), "insert_id")
    return (
        refs.withColumn("_copy", F.row_number().over(newest_first))
        .filter("_copy = 1")
        .drop("_copy")
    )


def join_messages(refs: DataFrame, completions: DataFrame, any_scheme: bool = False) -> DataFrame:
    """References with the messages of their file.  ``completions`` has ``file_path``.

    The whole URI must be equal; ``any_scheme`` compares bucket and path only, for files
    that are read by another scheme than was logged.
    """
    key = file_key if any_scheme else (lambda uri: uri)
    messages = completions.select(
        key(F.col("file_path")).alias("_file"),
        "role",
        "parts",
        F.col("index").alias("message_idx"),
    )
    return (
        refs.withColumn("_file", key(F.col("messages_ref_uri")))
        .join(messages, "_file")
        .drop("_file")
        .withColumn("api_call_id", api_call_id(F.col("messages_ref_uri")))
    )


def join_stored_messages(refs: DataFrame, messages: DataFrame, key: Callable[[Column], Column] = lambda uri: uri) -> DataFrame:
    """References (with their ``day``) and the messages stored by day and file key.

    The day is part of the join, so a condition on the logs' days prunes the messages' folders too.
    """
    stored = messages.select("day", "file_key", "role", "parts", F.col("index").alias("message_idx"))
    return (
        refs.withColumn("file_key", key(F.col("messages_ref_uri")))
        .join(stored, ["day", "file_key"])
        .drop("file_key", "day")
        .withColumn("api_call_id", api_call_id(F.col("messages_ref_uri")))
    )


def flatten_parts(joined: DataFrame) -> DataFrame:
    """One row per message part; messages without parts give none."""
    kept = [c for c in joined.columns if c != "parts"]
    return joined.select(*kept, F.posexplode("parts").alias("part_idx", "part")).select(
        *kept,
        "part_idx",
        F.col("part.type").alias("part_type"),
        "part.content",
        "part.uri",
        "part.mime_type",
        F.md5("part.data").alias("data_md5_hex"),
        F.col("part.name").alias("tool_name"),
        F.col("part.arguments").alias("tool_args"),
        F.col("part.response").alias("tool_response"),
    )


def latest_in_span(parts: DataFrame, *within: str) -> DataFrame:
    """Latest copy of each part within a trace and span."""
    copies = W.partitionBy(*within, "trace", "span_id", *_MESSAGE_KEY).orderBy(
        F.desc("timestamp"), *_TIE_BREAK
    )
    return (
        parts.withColumn("_copy", F.row_number().over(copies)).filter("_copy = 1").drop("_copy")
    )


def first_across_traces(parts: DataFrame, *first: str) -> DataFrame:
    """Earliest copy of each input part in a conversation, by ``first`` and time; every output part."""
    is_output = F.col("message_type") == "output"
    own = parts.withColumns(
        {
            "_out_trace": F.when(is_output, F.struct("trace", "span_id")),
        }
    )
    copies = W.partitionBy(*_MESSAGE_KEY, "_out_trace").orderBy(*first, "timestamp", *_TIE_BREAK)
    return (
        own.withColumn("_copy", F.row_number().over(copies))
        .filter("_copy = 1")
        .drop("_copy", "_out_trace")
    )


def without_echoes(parts: DataFrame) -> DataFrame:
    """Drops assistant messages repeated as input; an input without a role goes too."""
    return parts.filter(~((F.col("message_type") == "input") & (F.col("role") == "assistant")))


def completions_view(logs: DataFrame, completions: DataFrame, ordered: bool = True, any_scheme: bool = False) -> DataFrame:
    """The joined, deduplicated view in its published column order."""
    refs = latest_refs(unpivot_refs(log_refs(logs)))
    return _view(join_messages(refs, completions, any_scheme), ordered)


def stored_view(logs: DataFrame, messages: DataFrame, key: Callable[[Column], Column] = lambda uri: uri, ordered: bool = True) -> DataFrame:
    """The view over logs and messages that are both stored by day."""
    refs = latest_refs(unpivot_refs(log_refs(logs)))
    return _view(join_stored_messages(refs, messages, key), ordered)


def _view(joined: DataFrame, ordered: bool) -> DataFrame:
    parts = flatten_parts(joined)
    rows = without_echoes(first_across_traces(latest_in_span(parts))).select(*VIEW_COLUMNS)
    return rows.orderBy(*[F.asc_nulls_first(c) for c in VIEW_ORDER]) if ordered else rows


def part_key(parts: DataFrame) -> Column:
    """128 bits that stand for a part: its message key and, for outputs, its trace and span."""
    own = F.when(F.col("message_type") == "output", F.struct("trace", "span_id"))
    return F.unhex(F.md5(F.to_json(F.struct(*_MESSAGE_KEY, own.alias("own")))))


def add_day(spark: SparkSession, joined: DataFrame, day: str, path: str) -> None:
    """Adds the references and messages of one day to a stored view, see :func:`add_days`."""
    add_days(spark, joined.withColumn("day", F.lit(day)), [day], path)


def add_days(spark: SparkSession, joined: DataFrame, days: Sequence[str], path: str) -> None:
    """Adds the references and messages of ``days``, by their column ``day``, to a stored view.

    What is stored is the same whether days are added together or one by one: each is
    deduplicated by itself, then against all before.  Of rows of the days added, the earliest day's stays;
    the rows of days stored earlier are not read: a table of their part keys (16 bytes each, by day) says
    which parts are known, and the first copy is the earlier one.  Days are added in
    their order; one that is added again replaces its own rows.  A span that is logged again on a
    later day keeps the rows it has.
    """
    path, days = path.rstrip("/"), sorted(days)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/keys")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    known = sorted(s.getPath().getName().removeprefix("day=") for s in fs.listStatus(root) if s.isDirectory()) if fs.exists(root) else []
    if known and days[0] < known[-1]:
        raise ValueError(f"day {days[0]} comes after {known[-1]} was added")
    parts = latest_in_span(flatten_parts(joined.withColumn("day", F.col("day").cast("string"))), "day")
    new = first_across_traces(parts, "day").withColumn("part_key", part_key(parts))
    if any(day < days[0] for day in known):
        seen = spark.read.schema("part_key BINARY, day STRING").parquet(f"{path}/keys").filter(F.col("day") < days[0])
        new = new.join(seen.select("part_key"), "part_key", "left_anti")
    folders = [jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/day={day}") for day in days for kind in ("keys", "rows")]
    for folder in folders:
        fs.delete(folder, True)
    # A file without rows keeps the schema where all days are empty.
    spark.createDataFrame([], new.drop("day").schema).coalesce(1).write.parquet(f"{path}/rows/day={days[0]}")
    # The rows are computed once; the keys are taken from what was written, and come last.
    new.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(f"{path}/rows")
    written = spark.read.schema("part_key BINARY, day STRING").parquet(f"{path}/rows").filter(F.col("day").isin(days))
    written.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(f"{path}/keys")
    for folder in folders:
        fs.mkdirs(folder)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The view over all days that were added."""
    return without_echoes(spark.read.parquet(f"{path.rstrip('/')}/rows")).select(*VIEW_COLUMNS)


def register_view(view: DataFrame, name: str = "completions_view") -> DataFrame:
    view.createOrReplaceTempView(name)
    return view
