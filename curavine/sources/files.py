"""JSON lines, JSON documents, crawl packages and a keyed store, through Spark's readers and writers only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.upsert import last_per_key, upsert


def _empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """Rows of a JSON-lines file; blank lines don't count, a missing file is empty.

    A broken line stops the read, or, if tolerant, is left out.
    """
    if not exists(spark, path):
        return _empty(spark, schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of the first line of each file that isn't JSON; blank lines don't count as lines.

    A file may be read in many splits. Lines are counted within their split, and the counts of the splits before are
    added: one aggregation, whose rows are splits, and one running sum over a file's splits.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value", F.monotonically_increasing_id().alias("id"))
    bad = F.when(F.try_parse_json("value").isNull(), F.struct("id", F.substring("value", 1, 200).alias("text")))
    splits = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.min(bad).alias("bad"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    line = before + F.col("bad.id") - F.col("first") + 1
    found = splits.withColumn("line", line).where("bad is not null")
    return found.groupBy("file").agg(F.min(F.struct("line", "bad.text")).alias("b")).select("file", "b.*")


def read_checked_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_lines, but a broken line is an error at once that names its file and line."""
    if not exists(spark, path):
        return _empty(spark, schema)
    first = broken_lines(spark, path).orderBy("file").first()
    if first is not None:
        raise ValueError(f"invalid JSON at {first.file}:{first.line}: {first.text}")
    return read_lines(spark, path, schema)


def read_lines_in_order(spark: SparkSession, path: str, schema: str, order: str = "ord") -> DataFrame:
    """As read_lines, with each row's place in the file. The lines are one row each of a text source, so the
    file's byte order is their order: partitions are numbered by it.
    """
    if not exists(spark, path):
        return _empty(spark, f"{schema}, {order} long")
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.monotonically_increasing_id().alias(order))
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), order)
    return parsed.select("r.*", order)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def ensure(spark: SparkSession, path: str, default: DataFrame) -> None:
    """Write the default where nothing is there yet."""
    if not exists(spark, path):
        write_lines(default, path)


def read_document(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """A JSON document; a broken or missing one is an error, or, if optional, no rows."""
    try:
        df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if not optional else "DROPMALFORMED").json(path)
    except AnalysisException:
        if not optional:
            raise
        return _empty(spark, schema)
    return df


def write_document(df: DataFrame, path: str, **fields) -> None:
    """One JSON document whose fields are given columns; df must be a single row."""
    df.select(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


#: State of a crawl: its domains, and what has been processed of archives and documents.
CRAWL_STATE = (
    "schemaVersion int, domains map<string,struct<lastCrawledAt:string,lastStatus:string,failures:int,blockReason:string,nextCrawlAfter:string>>, "
    "commonCrawl struct<processedIndexes:array<string>>, pdf struct<processedUrls:array<string>>, updatedAt string"
)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The crawl's state, one row: what the document lacks has its default; a missing or broken one is all defaults."""
    kept = read_document(spark, path, CRAWL_STATE, optional=True).limit(1)
    row = spark.range(1).select().join(kept, how="left")
    default = {c.name: F.lit(None).cast(c.dataType) for c in kept.schema}
    default |= {"schemaVersion": F.lit(1), "domains": F.map_from_arrays(F.array(), F.array()).cast(kept.schema["domains"].dataType)}
    for outer, inner in (("commonCrawl", "processedIndexes"), ("pdf", "processedUrls")):
        default[outer] = F.struct(F.coalesce(F.col(outer)[inner], F.array().cast("array<string>")).alias(inner))
    nested = lambda c: default[c] if c in ("commonCrawl", "pdf") else F.coalesce(F.col(c), default[c])
    return row.select(*(nested(c).alias(c) for c in kept.columns))


def write_state(state: DataFrame, path: str) -> None:
    """Writes the state of a crawl with the time of writing; state is a single row and must not be read from path itself."""
    fields = {c: F.col(c) for c in state.columns} | {"updatedAt": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")}
    write_document(state, path, **fields)


def entries(df: DataFrame, column: str, key: str = "domain") -> DataFrame:
    """A map of structs as a table of its keys."""
    return df.select(F.explode(column).alias(key, "__v")).select(key, "__v.*")


def package(df: DataFrame, nested: str) -> DataFrame:
    """Rows of a nested array, with the package's version, time and source."""
    return df.select("version", "generatedAt", "source", F.posexplode(nested).alias("place", "__r")).select("version", "generatedAt", "source", "place", "__r.*")


class Store:
    """A keyed document store: one folder of Parquet for each version, the last one counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id"):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def _version(self) -> int:
        n = -1
        while exists(self.spark, f"{self.path}/v{n + 1}/_SUCCESS"):
            n += 1
        return n

    def all(self) -> DataFrame:
        n = self._version()
        return _empty(self.spark, self.schema) if n < 0 else self.spark.read.schema(self.schema).parquet(f"{self.path}/v{n}")

    def _write(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{self._version() + 1}")

    def put(self, rows: DataFrame, order: str | None = None) -> None:
        """Insert or replace by key; of repeated keys the last by order is kept, or, without an order, any one."""
        own = rows.dropDuplicates([self.key]) if order is None else last_per_key(rows, self.key, order)
        own = own.select(*self.all().columns)
        self._write(self.all().join(own.select(self.key), self.key, "left_anti").unionByName(own))

    def delete(self, keys: DataFrame) -> None:
        self._write(self.all().join(keys, self.key, "left_anti"))

    def clear(self) -> None:
        self._write(_empty(self.spark, self.schema))

    def merge(self, rows: DataFrame, order: str) -> None:
        self._write(upsert(self.all(), rows, self.key, order).select(*self.all().columns))
