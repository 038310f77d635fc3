"""Faceted search: a filter object becomes one predicate that reaches the scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ci


@dataclass
class Filters:
    """What to look for; empty values ask for nothing, "all" is every value."""

    keyword: str = ""
    equals: dict[str, str] = field(default_factory=dict)
    ranges: dict[str, tuple[object, object]] = field(default_factory=dict)
    contains: dict[str, str] = field(default_factory=dict)
    flags: dict[str, bool] = field(default_factory=dict)
    has_item: dict[tuple[str, str], str] = field(default_factory=dict)
    tag: str = ""


def bound(x: object) -> float | None:
    """A bound as a number; None if it isn't one."""
    try:
        return float(str(x).strip()) if str(x).strip() else None
    except ValueError:
        return None


def in_range(x: Column, low: object, high: object) -> Column:
    """Inclusive range; a missing value is out as soon as one bound is a number.

    The condition is then null, which a filter treats as false: so it can be pushed down to the scan.
    """
    lo, hi = bound(low), bound(high)
    if lo is None and hi is None:
        return F.lit(True)
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (x >= lo)
    if hi is not None:
        ok = ok & (x <= hi)
    return ok


def predicate(f: Filters, keyword_columns: list[str], tags: str | None = None, unsupported: list[str] = ()) -> Column:
    """All of the filter's conditions. Conditions on columns named as unsupported can't be met by any row."""
    out = F.lit(True)
    if f.keyword.strip():
        hit = F.lit(False)
        for c in keyword_columns:
            hit = hit | contains_ci(c, f.keyword)
        if tags:
            hit = hit | F.exists(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: contains_ci(t, f.keyword))
        out = out & hit
    for c, v in f.equals.items():
        if v and v != "all":
            out = out & (F.lit(False) if c in unsupported else F.col(c) == v)
    for c, (lo, hi) in f.ranges.items():
        if c in unsupported:
            out = out & F.lit(bound(lo) is None and bound(hi) is None)
        else:
            out = out & in_range(F.col(c), lo, hi)
    for c, v in f.contains.items():
        if v.strip():
            out = out & contains_ci(c, v)
    for c, v in f.flags.items():
        if v:
            out = out & (F.lit(False) if c in unsupported else F.coalesce(F.col(c), F.lit(False)))
    for (c, kind), want in f.has_item.items():
        if want in ("with", "without"):
            kinds = F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<kind:string>>")), lambda i: i["kind"])
            there = F.array_contains(kinds, kind)
            out = out & (there if want == "with" else ~there)
    if f.tag.strip() and tags:
        out = out & F.exists(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: contains_ci(t, f.tag))
    elif f.tag.strip():
        out = out & F.lit(False)
    return out


def search(df: DataFrame, f: Filters, keyword_columns: list[str], tags: str | None = None, unsupported: list[str] = ()) -> DataFrame:
    return df.where(predicate(f, keyword_columns, tags, unsupported))


def facet(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Distinct filled values in the order of their code points."""
    return df.select(value.alias(name)).where((F.col(name).isNotNull()) & (F.col(name) != "")).distinct().orderBy(name)


#: Orders of a result list; the ordinal makes each total.
def order_by(kind: str, time: str, source: Column, layout: Column, title: Column, ordinal: str, collation: str = "ja") -> list[Column]:
    """newest (the default), oldest, source or layout; texts by the collation, rows without layout last."""
    end = F.col(ordinal).asc()
    if kind == "oldest":
        return [F.col(time).asc(), end]
    if kind == "source":
        return [F.collate(F.coalesce(F.nullif(source, F.lit("")), title), collation).asc(), end]
    if kind == "layout":
        return [F.collate(F.concat(F.coalesce(F.nullif(layout, F.lit("")), F.lit("zzz")), title), collation).asc(), end]
    return [F.col(time).desc(), end]


def same_entity(a: DataFrame, b: DataFrame, a_id: str, b_id: str, a_urls: Column, b_urls: Column, a_pair: list[str], b_pair: list[str], b_order: str) -> DataFrame:
    """(a_id, b_id): for each row of a the first of b that shares a URL or agrees on the pair of columns.

    The disjunction is two equi-joins whose matches are united, not a comparison of all with all.
    """
    by_url = a.select(a_id, F.explode(a_urls).alias("u")).where("u != ''").join(b.select(b_id, b_order, F.explode(b_urls).alias("u")).where("u != ''"), "u").select(a_id, b_id, b_order)
    on = [F.col(x) == F.col(y) for x, y in zip(a_pair, b_pair)]
    by_pair = a.select(a_id, *a_pair).join(b.select(b_id, b_order, *b_pair), on).where(F.col(a_pair[0]) != "").select(a_id, b_id, b_order)
    both = by_url.union(by_pair)
    return both.groupBy(a_id).agg(F.min(F.struct(b_order, b_id)).alias("m")).select(a_id, F.col("m")[b_id].alias(b_id))


def in_given_order(df: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of a short list of ids, with their place in it; unknown ids give no row."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i,) for i in [ids]], f"ids array<{df.schema[key].dataType.simpleString()}>").select(F.posexplode("ids").alias("place", key))
    return df.join(F.broadcast(wanted), key)  # a list that a caller wrote out


def compare_list(chosen: list, item: object) -> list:
    """Ids to compare after one was clicked: a second click takes it out, and only the last two stay."""
    return [c for c in chosen if c != item] if item in chosen else [*chosen[-1:], item]
