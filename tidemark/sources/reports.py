"""Text report sink."""

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

TITLES = ((1, "TEAM SUMMARY"), (2, "INDIVIDUAL RISK CARDS"), (3, "STORED EVALUATIONS"))


def write_report(lines: DataFrame, path: str, summary: str | None = None) -> None:
    """Writes (section, employee, ord, line) rows as text parts in report order.

    A range sort orders the lines over all part files; reading the parts by name gives
    the report.  ``summary`` is the run's closing text, written last.
    """
    spark = lines.sparkSession
    titles = spark.createDataFrame(
        [(n, "", -1, t) for n, t in TITLES] + ([(9, "", 0, summary)] if summary else []),
        "section INT, employee STRING, ord INT, line STRING",
    )
    (
        lines.select("section", "employee", "ord", "line")
        .unionByName(titles)
        .orderBy("section", "employee", "ord")
        .select(F.col("line").alias("value"))
        .write.mode("overwrite")
        .text(path)
    )


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a report, numbered from 1 in the order of its parts.

    Lines are counted by block of a file; only the blocks, which are few, are put in order.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    blocks = lines.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    placed = blocks.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    numbered = lines.join(placed, ["file", "block"])
    return numbered.select((F.col("before") + F.col("row") - F.col("first") + 1).alias("n"), "line")
