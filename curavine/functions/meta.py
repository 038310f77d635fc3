"""Facts from texts around a picture: each from the first source that has it, with that source's confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import collapse_space, text

#: Confidences of the sources, in the order in which they are asked.
SOURCES = [("near-image-text", 0.92), ("same-card-text", 0.82), ("page-title", 0.58), ("page-text", 0.4)]


def _texts(title: Column | str, near: Column | str, page: Column | str, alt: Column | str) -> list[Column]:
    return [collapse_space(F.concat_ws(" ", text(alt), text(near))), collapse_space(near), collapse_space(title), collapse_space(F.substring(text(page), 1, 6000))]


def _first(texts: list[Column], value, kind: str) -> Column:
    """struct<value,confidence,source> of the first text that gives a value; null, 0 and null if none does."""
    found = [F.nullif(value(t), F.lit("")) if kind == "string" else value(t) for t in texts]
    none = F.struct(F.lit(None).cast(kind).alias("value"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("source"))
    return F.coalesce(*(F.when(v.isNotNull(), F.struct(v.cast(kind).alias("value"), F.lit(c).alias("confidence"), F.lit(n).alias("source"))) for v, (n, c) in zip(found, SOURCES)), none)


def layout(t: Column) -> Column:
    """Rooms of a dwelling such as 3LDK; empty if a single-storey word comes first."""
    return F.upper(F.regexp_extract(t, "(?iu)" + rules.LAYOUT, 1))


def area(pattern: str):
    def of(t: Column) -> Column:
        number, unit = F.regexp_extract(t, "(?iu)" + pattern, 2).try_cast("double"), F.regexp_extract(t, "(?iu)" + pattern, 3)
        return F.when(unit == "坪", F.floor(number * rules.TSUBO_SQM * 100 + 0.5) / 100).otherwise(number)

    return of


def floors(t: Column) -> Column:
    f = F.regexp_extract(t, "(?iu)" + rules.FLOORS_TEXT, 1)
    return F.when(f.rlike("平屋|1階|一階"), "平屋").when(f.rlike("2階|二階"), "2階建て").when(f.rlike("3階|三階"), "3階建て").otherwise(f)


def direction(t: Column) -> Column:
    return F.concat(F.regexp_extract(t, rules.DIRECTION, 1), F.regexp_extract(t, rules.DIRECTION, 2))


def price(t: Column) -> Column:
    digits = F.concat(F.regexp_extract(t, rules.PRICE, 1), F.regexp_extract(t, rules.PRICE, 2))
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def extract(title: Column | str, near: Column | str, page: Column | str, alt: Column | str) -> Column:
    t = _texts(title, near, page, alt)
    return F.struct(
        _first(t, layout, "string").alias("layout"), _first(t, area(rules.AREA_FLOOR), "double").alias("total_floor_area"), _first(t, area(rules.AREA_SITE), "double").alias("site_area"),
        _first(t, floors, "string").alias("floors"), _first(t, direction, "string").alias("entrance_direction"), _first(t, price, "double").alias("price"),
    )


def better(current: Column, incoming: Column) -> Column:
    """Of two facts the filled one; of two filled ones that of higher confidence, the current one on a tie."""
    filled = lambda s: s.isNotNull() & s["value"].isNotNull()
    return F.when(~filled(current), incoming).when(filled(incoming) & (incoming["confidence"] > current["confidence"]), incoming).otherwise(current)


def company(t: Column | str) -> Column:
    """The maker that a page names; empty if it names none."""
    return F.regexp_extract(text(t), "(?U)" + rules.COMPANY, 1)
