"""Projections between records: defaults, display rows, nested filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.score import matches, when_first
from ..functions.text import area_to_tsubo, first_filled, text
from ..functions.url import image_key


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Null and blank values become the defaults; columns that aren't there are made."""
    out = {}
    for c, v in defaults.items():
        if c not in df.columns:
            out[c] = F.lit(v)
        elif isinstance(v, str):
            out[c] = F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(v))
        else:
            out[c] = F.coalesce(F.col(c), F.lit(v))
    return df.withColumns(out)


def to_property(df: DataFrame, tag: str) -> DataFrame:
    """A found plan as a library record: tsubo from the area, favourite, tagged."""
    return df.withColumns({"tsubo": area_to_tsubo("area"), "favourite": F.lit(True), "tags": F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit(tag))))})


def filter_nested(df: DataFrame, images: str, keep, count: str = "n_images") -> DataFrame:
    """Keeps the array's items that meet the predicate; rows left without any go."""
    return df.withColumn(images, F.filter(images, keep)).withColumn(count, F.size(images)).where(F.col(count) > 0)


def strong_only(images: Column, signal) -> Column:
    """If any item has strong evidence of a plan, only such items, else all."""
    strong = lambda i: matches(signal(i), rules.STRONG_EVIDENCE)
    return F.when(F.exists(images, strong), F.filter(images, strong)).otherwise(images)


def shown(accepted: Column, hard_reject: Column, checked_negative: Column, needs_review: Column, model: Column, strong: Column) -> Column:
    """Whether a picture is shown, by the first rule that applies."""
    return F.when(accepted, True).when(hard_reject, False).when(checked_negative, False).when(needs_review, False).when(model >= 0.65, True).otherwise(strong)


def labels(df: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """One row per filled value: key, place, label, value."""
    items = F.array(*(F.struct(F.lit(n).alias("label"), text(c).alias("value")) for n, c in columns.items()))
    return df.select(F.col(key), F.posexplode(items).alias("place", "i")).select(key, "place", "i.*").where("value != ''")


def badges(*pairs: tuple[Column, str]) -> Column:
    """The names of the conditions that hold."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in pairs)))


def source_name(*cols: Column | str) -> Column:
    return F.coalesce(first_filled(*cols), F.lit(""))


def image_total(df: DataFrame, images: str, least_one: bool = False) -> DataFrame:
    """One row: pictures of all rows, each row counting for one at least if so asked."""
    n = F.coalesce(F.size(images), F.lit(0))
    return df.agg(F.sum(F.greatest(F.lit(1), n) if least_one else n).alias("images"))


def parse_answer(answer: Column | str) -> Column:
    """struct<is_plan,confidence,reason> of a model's answer: JSON, or the first braces in it; nothing else counts."""
    body = text(answer)
    v = F.coalesce(F.try_parse_json(body), F.try_parse_json(F.regexp_extract(body, r"(?s)\{.*\}", 0)))
    confidence = F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(0.0))
    return F.struct(
        F.coalesce(F.try_variant_get(v, "$.isFloorplan", "boolean"), F.lit(False)).alias("is_plan"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)).alias("confidence"),
        F.substring(F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit("")), 1, 500).alias("reason"),
    )


def totals(df: DataFrame, conditions: dict[str, Column], *more: Column) -> DataFrame:
    """One row: how many rows meet each condition, and further aggregates; a null condition isn't met."""
    return df.agg(*(F.count_if(c).alias(n) for n, c in conditions.items()), *more)


def spread(left: Column, right: Column) -> Column:
    """The entries of two maps; those of the right one count, null values too. A null map has no entries."""
    none = lambda m: F.map_filter(m, lambda k, v: F.lit(False))
    a, b = F.coalesce(left, none(right)), F.coalesce(right, none(left))
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def without_fields(items: Column, *names: str) -> Column:
    """An array's structs without these fields."""
    return F.transform(items, lambda i: i.dropFields(*names))


def by_kind(images: Column, most: int = 12) -> Column:
    """The first pictures by kind; those of one kind keep their order, unknown kinds come last."""
    kinds = F.array(*map(F.lit, rules.KIND_ORDER))
    rank = lambda i: F.coalesce(F.nullif(F.array_position(kinds, i["kind"]), F.lit(0)), F.lit(len(rules.KIND_ORDER) + 1))
    placed = F.array_sort(F.transform(images, lambda i, at: F.struct(rank(i).alias("rank"), at.alias("at"))))
    return F.transform(F.slice(placed, 1, most), lambda s: images[s["at"]])


def candidate_view(df: DataFrame, has_plan: str, time: str, images: str, most: int = 12) -> DataFrame:
    """Candidates with a plan first, then the newest; each with its first pictures by kind."""
    return df.withColumn(images, by_kind(F.col(images), most)).orderBy(F.coalesce(F.col(has_plan), F.lit(False)).desc(), F.col(time).desc())


def collected(candidates: DataFrame, images: str = "images", key=lambda i: image_key(i["url"])) -> DataFrame:
    """Found plans as items to show: one for each candidate with plan pictures.

    candidates: id, title, source, company, layout, floors and images (id, url, data_url, thumbnail_url, alt,
    kind). Of pictures with one key the first stays and the first of all is the item's own. Layout and floors
    come from titles before the candidate's fields; the source stands in for a missing company. Other columns stay.
    """
    shown = lambda i: first_filled(i["data_url"], i["thumbnail_url"], i["url"])
    plans = F.filter(images, lambda i: (i["kind"] == "floorplan") & shown(i).isNotNull())
    out = candidates.withColumn("__plans", plans).withColumn("__keys", F.transform("__plans", key))
    first = F.filter("__plans", lambda i, at: F.array_position("__keys", F.try_element_at("__keys", at + 1)) == at + 1)
    named = lambda i: F.coalesce(first_filled(i["alt"], "title"), F.lit(rules.COLLECTED_TITLE))
    item = lambda i: F.struct(i["id"].alias("id"), named(i).alias("title"), shown(i).alias("image_url"), i["url"].alias("image_link"))
    out = out.withColumn(images, F.transform(first, item)).where(F.size(images) > 0)
    out = out.withColumn("title", F.coalesce(first_filled("title", F.element_at(images, 1)["title"]), F.lit(rules.COLLECTED_TITLE)))
    signal = F.concat_ws(" ", "title", F.array_join(F.transform(images, lambda i: i["title"]), " "), text("layout"), text("floors"))
    layout = F.upper(F.regexp_replace(F.regexp_extract(signal, "(?i)" + rules.LAYOUT_PAGE, 1), r"\s+", ""))
    floors = when_first([(signal.rlike(p), F.lit(v)) for p, v in rules.COLLECTED_FLOORS], "")
    return out.withColumns({
        "image_url": F.element_at(images, 1)["image_url"], "image_link": F.element_at(images, 1)["image_link"],
        "layout": F.coalesce(first_filled(layout, "layout"), F.lit("")), "floors": F.coalesce(first_filled(floors, "floors"), F.lit("")),
        "company": F.coalesce(first_filled("company", "source"), F.lit("")),
    }).drop("__plans", "__keys")
