"""Upserts and merges by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.meta import better


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key at the place of its first; rows without a key go."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    first = F.min(order).over(Window.partitionBy(key))
    rows = df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return rows.withColumns({"__rank": F.row_number().over(w), "__first": first}).where("__rank = 1").withColumn(order, F.col("__first")).drop("__rank", "__first")


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "id", order: str = "ord", first_seen: str | None = "first_seen", last_seen: str | None = "last_seen") -> DataFrame:
    """Incoming rows folded into the stored ones, in order.

    Later filled values win, but first_seen keeps the earliest filled one and last_seen the greatest. Stored
    repeats of a key are replaced, not merged. The result has the order of first occurrence, stored rows
    first. One aggregation with map-side combine; no row is ever compared with another.
    """
    both = last_per_key(stored, key, order).withColumn("__side", F.lit(0)).unionByName(incoming.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    both = both.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").withColumn("__at", F.struct("__side", order))
    agg = []
    for c in stored.columns:
        if c in (key, order):
            continue
        if c == first_seen:
            agg.append(F.min_by(c, F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col("__at"))).alias(c))
        elif c == last_seen:
            agg.append(F.max(F.nullif(F.col(c), F.lit(""))).alias(c))
        else:
            agg.append(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__at"))).alias(c))
    out = both.groupBy(key).agg(F.min("__at").alias("__at"), *agg)
    return out.select(key, *[c for c in stored.columns if c not in (key, order)], F.col("__at")["__side"].alias("side"), F.col("__at")[order].alias(order))


def counts(stored: DataFrame, result: DataFrame) -> DataFrame:
    """One row: rows before, rows after, rows added (none if there are fewer)."""
    before, after = stored.agg(F.count(F.lit(1)).alias("before")), result.agg(F.count(F.lit(1)).alias("after"))
    return before.crossJoin(after).withColumn("added", F.greatest(F.lit(0), F.col("after") - F.col("before")))


def write_counted(stored: DataFrame, incoming: DataFrame, write: Callable[[DataFrame], None], key: str = "id", order: str = "ord") -> dict[str, int]:
    """Upsert and write: numbers of rows before, after and added, counted as the rows go by, without another scan.

    write has to run the job, once. Rows that a lost executor made before are counted again with their task.
    """
    before, after = Observation("stored"), Observation("written")
    n = F.count(F.lit(1)).alias("n")
    write(upsert(stored.observe(before, n), incoming, key, order).observe(after, n))
    was, now = before.get["n"], after.get["n"]
    return {"before": was, "after": now, "added": max(0, now - was)}


def better_scalar(current: Column, incoming: Column) -> Column:
    """The current value unless it is null or empty."""
    return F.coalesce(F.when(current.cast("string") != "", current), incoming)


def merge_accepted(stored: DataFrame, incoming: DataFrame, key: str, facts: list[str], confidence: str, taken: list[str]) -> DataFrame:
    """Full outer merge: facts by better(), taken columns from the side of higher confidence, the rest stays.

    The stored side wins ties; last_seen is the greatest and status the incoming one.
    """
    a, b = stored.alias("a"), incoming.alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    higher = F.col(f"a.{key}").isNull() | (F.col(f"b.{confidence}") > F.coalesce(F.col(f"a.{confidence}"), F.lit(-1.0)))
    out = []
    for c in stored.columns:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c == "last_seen":
            v = F.greatest(x, y)
        elif c == "status":
            v = F.coalesce(y, x)
        elif c in facts:
            v = better(x, y)
        elif c == confidence or c in taken:
            v = F.when(higher, y).otherwise(x)
        else:
            v = F.coalesce(x, y)
        out.append(v.alias(c))
    return j.select(*out)


def replace_or_merge(stored: DataFrame, incoming: DataFrame, key: str, order: str, replace: bool) -> DataFrame:
    """An import: either the incoming rows alone, or both with the incoming ones winning; the last of a key counts."""
    if replace:
        return last_per_key(incoming, key, order)
    both = stored.withColumn("__side", F.lit(0)).unionByName(incoming.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    return last_per_key(both.withColumn("__at", F.struct("__side", order)), key, "__at").drop("__side", "__at")
