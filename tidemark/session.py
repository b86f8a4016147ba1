"""Session helper and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the plans are written for.  The first two let AQE size partitions and
# split skewed join partitions; the third lets a join on (employee, week) reuse a
# partitioning by employee instead of shuffling again.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "tidemark", master: str | None = None, **conf: str):
    """Start a session with the recommended settings plus ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder the session names.

    ``spark.checkpoint.dir`` is the shared folder of the cluster; without it a cluster
    gets an error, and a local session a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder this library wrote."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
