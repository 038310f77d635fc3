"""Running numbers and sums within keys of any size.

A window over a key is one task, whatever the key's share of the rows. Here rows are dealt out by ranges of key and
order, so that a large key takes up as many tasks as its rows need. A first pass numbers the rows within their range
and writes them; the second adds, for each range and key, what the ranges before have of the key. That is one row for
each key and range, so the prefix sums over them see no more rows of a key than there are ranges.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

_ROW, _RANGE = "__run_row", "__run_range"


def _ordered(df: DataFrame, keys: list[str], order: list[Column | str], ranges: int | None) -> DataFrame:
    """df sorted by keys and order in written ranges: adds the number of the range, and one of the row that grows within it."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    # the number's upper bits are the partition's, which is the range's, as ranges are dealt out by number
    own = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(_ROW, F.monotonically_increasing_id())
    return written(own.withColumn(_RANGE, F.shiftright(_ROW, 33)), "running")


def _joined(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """What is known of a range and key beside each of its rows; null keys are keys, too."""
    named = known.select(F.col(_RANGE).alias("__run_r"), *(F.col(k).alias(f"__run_k{i}") for i, k in enumerate(keys)), *(c for c in known.columns if c not in (_RANGE, *keys)))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__run_k{i}")) for i, k in enumerate(keys)), F.col(_RANGE) == F.col("__run_r"))
    return rows.join(named, same).drop("__run_r", *(f"__run_k{i}" for i in range(len(keys))))


def _before(keys: list[str], value: str) -> Column:
    """The sum of a value over the earlier ranges of a key."""
    w = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def numbered_within(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "number", ranges: int | None = None) -> DataFrame:
    """Adds each row's number, from 1, among the rows of the same keys by order; without keys, among all rows.

    Rows of equal keys and order are numbered in any order. No more than one range of a key, of which there are
    as many as shuffle partitions, meets in a task.
    """
    rows = _ordered(df, keys, order, ranges)
    known = rows.groupBy(_RANGE, *keys).agg(F.count(F.lit(1)).alias("__run_n"), F.min(_ROW).alias("__run_first"))
    known = known.withColumn("__run_base", _before(keys, "__run_n")).drop("__run_n")
    out = _joined(rows, known, keys).withColumn(name, F.col(_ROW) - F.col("__run_first") + F.col("__run_base") + 1)
    return out.drop(_ROW, _RANGE, "__run_first", "__run_base")


def running_sums(df: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """Adds, for each name, the sum of a whole number over the rows of the same keys up to this one, by order.

    Null counts as 0. Rows of equal keys and order are taken in any order.
    """
    values = {f"__run_v{i}": F.coalesce(c.cast("long"), F.lit(0)) for i, c in enumerate(sums.values())}
    rows = _ordered(df.withColumns(values), keys, order, ranges)
    known = rows.groupBy(_RANGE, *keys).agg(*(F.sum(v).alias(v) for v in values))
    known = known.withColumns({f"__run_b{i}": _before(keys, v) for i, v in enumerate(values)}).drop(*values)
    w = Window.partitionBy(_RANGE, *keys).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, 0)
    out = _joined(rows.withColumns({v: F.sum(v).over(w) for v in values}), known, keys)
    out = out.withColumns({name: F.col(v) + F.col(f"__run_b{i}") for i, (name, v) in enumerate(zip(sums, values))})
    return out.drop(_ROW, _RANGE, *values, *(f"__run_b{i}" for i in range(len(values))))
