"""Records of quoted CSV files that still split into blocks.

A line end inside quotes belongs to its cell, so a record may span lines and blocks.  Every
file is read as physical lines, block by block.  A line with an odd number of quotes opens or
closes a cell; whether a block starts within a cell follows from the quotes of the blocks
before it (one number a block, summed up per file).  Lines are then put together between
their borders.  Only files that have such lines at all go that way; the others are read as
they are, one line a record.  No file is read by a single task because of its quotes, but
those whose quotes never close, which only a parser of the whole file can make sense of.
"""

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


@dataclass
class FileKinds:
    """Files by what their quotes ask for."""

    plain: list[str] = field(default_factory=list)
    spanning: list[str] = field(default_factory=list)
    unclosed: list[str] = field(default_factory=list)

    def add(self, other: "FileKinds") -> None:
        self.plain += other.plain
        self.spanning += other.spanning
        self.unclosed += other.unclosed


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.text(list(paths)).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("landed"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"),
    )


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, FileKinds]:
    """First record of the files, as text, and the files that share it.

    One pass of tasks over all files: a row per file is all that leaves it, and the first
    records come back once each.  Files without a first line are left out.
    """
    if not paths:
        return {}
    files = _lines(spark, paths).groupBy("path").agg(
        F.sum("quotes").alias("quotes"),
        F.sum(F.col("quotes") % 2).alias("odd"),
        F.min(F.when(F.col("block") == 0, F.struct("row", "value"))).getField("value").alias("first"),
        F.min(F.when(F.col("block") == 0, F.struct("row", "quotes"))).getField("quotes").alias("first_quotes"),
    )
    kind = F.when(F.col("odd") == 0, "plain").when(F.col("quotes") % 2 == 0, "spanning").otherwise("unclosed")
    name = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    rows = files.select("first", kind.alias("kind"), (F.col("first_quotes") % 2 == 1).alias("long"), name.alias("name"))
    groups = rows.groupBy("first", "kind", "long").agg(F.collect_list("name").alias("names")).collect()
    found: dict[str, FileKinds] = {}

    def add(header: str, kind: str, names: Sequence[str]) -> None:
        if header:
            getattr(found.setdefault(header, FileKinds()), kind).extend(sorted(names))

    for row in groups:
        if not row["long"] or row["kind"] == "unclosed":
            add(row["first"], row["kind"], row["names"])
    # First records that span lines themselves.
    long = [n for row in groups if row["long"] and row["kind"] == "spanning" for n in row["names"]]
    if long:
        firsts = records(spark, long, with_header=True).filter("header")
        name = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
        for row in firsts.groupBy("text").agg(F.collect_list(name).alias("names")).collect():
            add(row["text"], "spanning", row["names"])
    return found


def records(spark: SparkSession, paths: Sequence[str], with_header: bool = False) -> DataFrame:
    """path, landed, block, row, text of every record, in files whose quotes close; blank ones are left out.

    ``block`` and ``row`` are those of its first line.  The first record of a file is dropped,
    or marked in ``header`` with ``with_header``.
    """
    lines = _lines(spark, paths)
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = lines.groupBy("path", "block").agg(F.sum("quotes").alias("n"))
    parity = blocks.select("path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2).alias("carried"))
    in_block = W.partitionBy("path", "block").orderBy("row")
    earlier = F.coalesce(F.sum("quotes").over(in_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = lines.join(parity, ["path", "block"]).withColumn("opens", (F.col("carried") + earlier) % 2 == 0)
    placed = starts.withColumn("nth", F.sum(F.col("opens").cast("int")).over(in_block.rowsBetween(W.unboundedPreceding, 0)))
    header = (F.col("block") == 0) & (F.col("nth") == 1)
    whole = F.col("opens") & (F.col("quotes") % 2 == 0)
    single = placed.filter(whole).select("path", "landed", "block", "row", F.col("value").alias("text"), header.alias("header"))

    # Lines of records that span several: those before the first border of a block belong to the
    # last record that began in an earlier block.
    parts = placed.filter(~whole)
    last = placed.groupBy("path", "block").agg(F.max("nth").alias("records"))
    began = F.last(F.when(F.col("records") > 0, F.struct("block", "records")), ignorenulls=True).over(before)
    owner = last.select("path", "block", began.alias("began"))
    keyed = parts.join(owner, ["path", "block"]).withColumns(
        {
            "key": F.when(F.col("nth") == 0, F.col("began.block")).otherwise(F.col("block")),
            "number": F.when(F.col("nth") == 0, F.col("began.records")).otherwise(F.col("nth")),
        }
    )
    ordered = F.sort_array(F.collect_list(F.struct("block", "row", "value")))
    spanning = (
        keyed.groupBy("path", "key", "number")
        .agg(F.any_value("landed").alias("landed"), ordered.alias("lines"))
        .select(
            "path",
            "landed",
            F.col("key").alias("block"),
            F.col("lines")[0]["row"].alias("row"),
            F.array_join(F.transform("lines", lambda line: line["value"]), "\n").alias("text"),
            ((F.col("key") == 0) & (F.col("number") == 1)).alias("header"),
        )
    )
    both = single.union(spanning).filter(F.trim("text") != "")
    return both if with_header else both.filter(~F.col("header")).drop("header")
