"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row keys of a scan; the name is unlikely to clash with an input column.
ROW_KEY = "__row_key"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    The cluster names it in spark.checkpoint.dir. Only a local session without that setting gets a
    folder of its own; elsewhere a missing setting is an error, as a machine's folder isn't shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/curavine-scratch"
    return f"{base.rstrip('/')}/curavine-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder, in parts by a column if one is given, and read it back: its lineage ends there.

    The files outlive lost executors and go when the driver's JVM ends.
    """
    spark = df.sparkSession
    root = scratch_dir(spark)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(root)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialise() wrote, once nothing reads it any more."""
    sc = df.sparkSession.sparkContext
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/curavine-" in name:
            path = sc._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def with_row_key(df: DataFrame) -> DataFrame:
    """Number the rows. The numbers hold within one job only: another scan of the same files may number them otherwise."""
    return df.withColumn(ROW_KEY, F.monotonically_increasing_id())


def numbered(df: DataFrame, name: str = "numbered") -> DataFrame:
    """df with row keys, as a written table: every later read, by whatever executors, finds the same keys."""
    return materialise(with_row_key(df), name)


def small_batches(batches, rows: int = 1024):
    """Arrow batches in slices: what Python holds of one at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_of_id(col: str | Column) -> Column:
    """CRC-32 of a decimal id; a null id counts as the empty string (CRC 0)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label every node of the edges with the smallest node that it can reach.

    Alternating large-star and small-star steps; each round is one aggregation with map-side
    combine and one join for each of the two, and is written to the shared folder. Only a count and
    a checksum reach the driver. Returns (node, component); no edges give no rows.
    """
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    e = materialise(e, "edges")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        # small star: the smaller neighbours of a node are tied to the smallest of them
        large = large.where("lo < hi").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(
            F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("m").alias("lo"), "hi"))).alias("e")
        )
        new = materialise(small.select("e.*").where("lo < hi").distinct(), "edges")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        discard(e)
        e = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())
