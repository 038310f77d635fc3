"""Operators by key: first-wins, best-of, capped and interleaved rows, set operations.

Order matters to most: they take an ordinal column, as a DataFrame has no order of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import numbered_within, running_sums


def _keep(df: DataFrame, rank: Column, limit: int) -> DataFrame:
    return df.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank")


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str], by_blank: bool = True) -> DataFrame:
    """The first row of each key. by_blank=False keeps every row whose first key is null or empty."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if by_blank:
        return _keep(df, rank, 1)
    blank = F.coalesce(F.col(keys[0]).cast("string"), F.lit("")) == ""  # these rows are never brought together
    return _keep(df.where(~blank), rank, 1).unionByName(df.where(blank))


def arg_max_first(df: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """The row of the highest score of each key; of equal scores the first by order."""
    return keep_first(df, keys, [F.col(score).desc_nulls_last(), F.col(order)])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """At most n rows of each key."""
    return _keep(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), n)


def seen_before(df: DataFrame, key: str, order: str, name: str = "seen") -> DataFrame:
    """Adds the number of earlier rows of the same key, which may hold any share of the rows."""
    return numbered_within(df, [key], [order], name).withColumn(name, F.col(name) - 1)


def interleave(df: DataFrame, key: str, order: str, name: str = "position") -> DataFrame:
    """Adds the position of each row when keys take turns, in the order in which they first occur.

    A row's turn is its number within its key, and its position its number by turn and by its key's first row.
    """
    own = numbered_within(df, [key], [order], "__turn")
    firsts = df.groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__first"))
    own = own.join(firsts, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    return numbered_within(own, [], ["__turn", "__first"], name).drop("__turn", "__first")


def first_accepted(df: DataFrame, key: str, order: str, accepted: str) -> DataFrame:
    """Rows up to the first accepted one of their key; rows without a key all stay."""
    firsts = df.where(F.col(accepted) & (F.coalesce(F.col(key), F.lit("")) != "")).groupBy(key).agg(F.min(order).alias("__first"))
    joined = df.join(firsts, key, "left").where(F.col("__first").isNull() | (F.col(order) <= F.col("__first")))
    return joined.select(*df.columns)


def islands(df: DataFrame, sequence: str, step: str, name: str = "island") -> DataFrame:
    """Adds the start of the run that a numbered row belongs to: its number less its step within the run."""
    return df.withColumn(name, F.col(sequence) - (F.col(step) - 1))


def running_count(df: DataFrame, keys: list[str], order: str, condition: Column, name: str) -> DataFrame:
    """Adds the number of rows up to this one, within the keys, that meet the condition."""
    return running_sums(df, keys, [order], {name: condition.cast("int")})


def union_first(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union by key in which the left side's rows win, and earlier rows win within a side."""
    both = left.withColumn("__side", F.lit(0)).unionByName(right.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, keys, [F.col("__side"), F.col(order)]).drop("__side")


def except_keys(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_anti")


def nested_first(df: DataFrame, items: str, key, owner_order: str) -> DataFrame:
    """Array items whose key occurs in an earlier row, or earlier in the row, go; rows left without items go too."""
    flat = df.select("*", F.posexplode(items).alias("__at", "__item")).withColumn("__key", key(F.col("__item")))
    flat = keep_first(flat, ["__key"], [F.col(owner_order), F.col("__at")])
    kept = flat.groupBy(owner_order).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__item"))), lambda s: s["__item"]).alias(items))
    return df.drop(items).join(kept, owner_order)


def rotate(df: DataFrame, index: str, start: int, batch: int, size: int) -> DataFrame:
    """The batch of rows from a start on, over the end to the beginning, with their turn."""
    return df.withColumn("turn", F.pmod(F.col(index) - F.lit(start), F.lit(size))).where(F.col("turn") < batch)


def paged(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Rows of a page with their rank; pages beyond the ends give the nearest page.

    The rank is a global order: the rows wanted are cut off by a limit before they are ranked.
    """
    total = df.count()
    last = max(1, -(-total // size))
    page = min(max(page, 1), last)
    first = (page - 1) * size
    rows = df.orderBy(*order).limit(first + size)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") > first)


def seeded_sample(df: DataFrame, n: int, *key: str, seed: str = "sample") -> DataFrame:
    """n rows in an order drawn from the MD5 of the seed and their keys, joined by bars: the same on every run, and in other engines."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key)).cast("binary")), *key).limit(n)
