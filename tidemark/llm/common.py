"""Shared helpers: tables, words, the shared folder, hash splits."""

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the word definition: [^\x20\x09-\x0D]+
WORD_GAP = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; none for null.  ``bytes.split()`` is the same in Python."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else; ``bytes.lower()`` is the same in Python."""
    return F.translate(text, _UPPER, _UPPER.lower())


def held_out(doc_id: Column, modulus: int) -> Column:
    """Rows never learned from: crc32 of the id as text leaves remainder 2; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 2, F.lit(False))


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, the folder all executors share.

    Where it is unset, a local master gets a temporary folder and a cluster an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-llm-')}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Cuts lineage: writes a frame to the shared folder and reads it back."""
    spark = frame.sparkSession
    path = shared_dir(spark, label)
    frame.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of frames that are no longer used."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
