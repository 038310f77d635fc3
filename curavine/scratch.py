"""Written intermediates: tables that cut lineage and that later reads find unchanged."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder of this application for intermediates, below the one that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting uses a folder of the machine; elsewhere a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/curavine-scratch"
    return f"{base.rstrip('/')}/curavine-tables-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the scratch folder, for what is not written as a table; it goes when the driver's JVM ends."""
    root = scratch_dir(spark)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the scratch folder, read again: it outlives lost executors, and goes when the driver's JVM ends."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
