"""A review pass over pictures as a stream: batches of any size, a budget of questions that is kept between them, and a restart where it stopped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text
from ..operators.curate import kept_after
from ..sources.files import exists
from .crawl_gate import ByBatch


def _best(rows: DataFrame, by: str) -> DataFrame:
    """The first priority and place of each; numbers alone are grouped first, as tasks can hash those."""
    each = rows.groupBy(by, "__priority").agg(F.min("__place").alias("__place"))
    return each.groupBy(by).agg(F.min(F.struct("__priority", F.isnull("__place"), "__place")).alias("__at"))


def first_keys(rows: DataFrame, most: int) -> DataFrame:
    """The keys (__key) that come first by their rows' least (__priority, __place), places that are null last, and then by key.

    Keys are dealt out to slices, many more than are wanted. The bests of different slices are those of different keys, so
    as many keys as are wanted come no later than as many of the slices do, and rows after those needn't be grouped by key.
    So tasks hold and send a number of rows that goes with what is wanted, not with the table.
    """
    slices = _best(rows.withColumn("__slice", F.pmod(F.xxhash64("__key"), F.lit(16 * max(1, most)))), "__slice").orderBy("__at").limit(most)
    end = slices.agg(F.when(F.count(F.lit(1)) == most, F.max("__at")).alias("__end"))
    near = rows.crossJoin(F.broadcast(end)).where(F.col("__end").isNull() | (F.struct("__priority", F.isnull("__place"), "__place") <= F.col("__end")))
    return _best(near, "__key").orderBy("__at", "__key").limit(most).select("__key")


def with_budget(pictures: DataFrame, number: int, folder: str, key: str, order: str, priority: Column, most: int, run: str = "all") -> DataFrame:
    """Adds asked to a stream's batch of this number: whether the model is asked about a picture, within the run's budget of questions.

    priority is null for pictures that need no question; lower ones come first within a batch, then by order, a
    number. Repeats of a key in a batch are asked about once. What is asked about is kept in the folder by batches, so
    a restart knows what has been asked before, and a batch that comes again decides as it did. The batch is read three
    times; only the keys that are asked about, which the budget bounds, come together in one task.
    """
    spark, asked = pictures.sparkSession, f"{folder}/asked"
    before = spark.read.schema("run string, __key string, __batch bigint").parquet(asked).where((F.col("run") == run) & (F.col("__batch") < number)).count() if exists(spark, asked) else 0
    rows = pictures.withColumns({"__key": text(key), "__priority": F.when(text(key) != "", priority).cast("int")})
    wanted = rows.where("__priority is not null").select("__key", "__priority", F.col(order).alias("__place"))
    own = f"{asked}/__batch={number}"
    first_keys(wanted, max(0, most - before)).select(F.lit(run).alias("run"), "__key").write.mode("overwrite").parquet(own)
    first = spark.read.schema("__key string").parquet(own).withColumn("__first", F.lit(True))
    return rows.join(first, "__key", "left").withColumn("asked", F.expr("__priority is not null and __first is not null")).drop("__key", "__priority", "__first")


def review_stream(pictures: DataFrame, answers: DataFrame, key: str, order: str, priority: Column, checked: Column, was_plan: Column, hard_reject: Column, most: int, least: float = 0.65, keep_unchecked: bool = True) -> ByBatch:
    """The review pass on a stream, for run_available: adds asked, is_plan, confidence and kept.

    answers (key, is_plan, confidence) is a table of the model's answers, which is joined to each batch. With a
    folder, a pass that is stopped and goes on decides as one that isn't.
    """

    def reviewed(rows: DataFrame) -> DataFrame:
        j = rows.join(answers, key, "left")
        return j.withColumn("kept", kept_after(F.col("asked") & F.col("is_plan").isNotNull(), checked, was_plan, hard_reject, least, keep_unchecked))

    rows = lambda batch, number, folder: reviewed(with_budget(batch, number, folder, key, order, F.when(~checked, priority), most))
    return ByBatch(pictures, rows, reviewed(pictures.withColumn("asked", F.lit(False))).schema)
