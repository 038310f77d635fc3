"""Grouping of pictures into plans, and the public feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.score import matches, when_first
from ..functions.text import area_to_tsubo, collapse_space, text
from ..functions.url import without_query


def floor_order(signal: Column) -> Column:
    """1, 1.5, 2 or 3 by the first rule that matches, else 9."""
    return when_first([(F.coalesce(signal.rlike("(?U)" + p), F.lit(False)), F.lit(v)) for v, p in rules.FLOORS], 9.0)


def split_key(url: Column | str) -> Column:
    """A plan picture's URL without what tells its floor; empty if nothing does or it isn't a plan's."""
    plain = without_query(url)
    out = plain
    for pattern, to in rules.FLOOR_PARTS:
        out = F.regexp_replace(out, "(?iu)" + pattern, to)
    ok = (out != plain) & out.rlike(r"(?i)\.(?:jpe?g|png|webp|gif)$") & matches(out, rules.PLAN_FILE)
    return F.when(ok, out).otherwise("")


def group_key(id_: str, domain: str, page: str, image: str, title: str, alt: str, layout: str, area: str) -> Column:
    """Key of the plan that a picture belongs to: by its file, its number on a page or the page's layout and area,
    its page and file, its page, or alone."""
    floor = floor_order(F.concat_ws(" ", text(title), text(alt), text(image)))
    page_url, image_url = without_query(page), without_query(image)
    of_floor = (page_url != "") & (floor < 9)
    number = F.regexp_extract(image_url, "(?i)" + rules.SEQUENCE_FILE, 2).try_cast("long")
    start = number - F.when(floor == 1.5, 1).otherwise(F.greatest(F.lit(0), F.floor(floor) - 1))
    sequence = F.concat(page_url, F.lit(":sfc-"), F.regexp_extract(image_url, "(?i)" + rules.SEQUENCE_FILE, 1), F.lit("-"), start.cast("string"))
    filled = lambda c, otherwise: F.coalesce(F.nullif(c, F.lit("")), F.lit(otherwise))
    size = F.when(F.coalesce(F.col(area).cast("double"), F.lit(0.0)) != 0, F.format_string("%.2f", F.col(area).cast("double")))
    base = plain_title(filled_first(title, alt))
    by_layout = F.concat_ws(":", page_url, filled(text(layout), "layout-unknown"), filled(size, "area-unknown"), filled(base, "floorplan"))
    own_page = F.concat_ws(":", page_url, F.nullif(F.regexp_extract(image_url, "(?i)" + rules.PLAN_PAGE[1], 1), F.lit("")))
    key = lambda kind, k: F.when(F.coalesce(k, F.lit("")) != "", F.concat_ws(":", F.lit(kind), text(domain), k))
    return F.coalesce(
        key("image", split_key(image)), key("sequence", F.when(of_floor & number.isNotNull(), sequence)), key("sequence", F.when(of_floor & page_url.rlike("(?i)" + rules.LAYOUT_PAGE_GROUP), by_layout)),
        key("page-image", F.when(page_url.rlike("(?i)" + rules.PLAN_PAGE[0]) & image_url.rlike("(?i)" + rules.PLAN_PAGE[1]), own_page)),
        key("detail-page", F.when(of_floor & page_url.rlike("(?i)" + rules.DETAIL_PAGE), page_url)), F.concat(F.lit("record:"), F.col(id_).cast("string")),
    )


def filled_first(*cols: str) -> Column:
    """The first text that isn't empty, else the empty text."""
    return F.coalesce(*(F.nullif(text(c), F.lit("")) for c in cols), F.lit(""))


def plain_title(x: Column | str) -> Column:
    """A title without the words for a floor or a picture's number."""
    out = collapse_space(x)
    for pattern, to in rules.TITLE_PARTS:
        out = F.regexp_replace(out, "(?U)" + pattern, to)
    return collapse_space(out)


def group_plans(records: DataFrame) -> DataFrame:
    """One row per plan: group_id, title, layout, area, tsubo, floors, images, n_images, fetched_at.

    records: id, domain, page_url, image_url, title, alt, layout, area, floors, last_seen. Images are in the order of floors, then
    URLs; layout, area and floors are the lowest floor's, or inferred from the group's texts and floors. The
    title of several pictures is the first proper one, without its floor, of the lowest floor's title, alt text,
    caption and page title and then of the others' titles; caption and page_title may be missing.
    """
    for c in ("caption", "page_title"):
        records = records if c in records.columns else records.withColumn(c, F.lit(""))
    r = records.withColumn("key", group_key("id", "domain", "page_url", "image_url", "title", "alt", "layout", "area"))
    floor = floor_order(F.concat_ws(" ", text("title"), text("alt"), text("image_url")))
    one = F.struct(floor.alias("floor"), text("image_url").alias("url"), "id", text("title").alias("title"), text("alt").alias("alt"), "layout", "area", "floors", text("last_seen").alias("last_seen"), text("caption").alias("caption"), text("page_title").alias("page_title"))
    g = r.groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("m"), F.count(F.lit(1)).alias("n_images"))
    head = F.col("m")[0]
    words = F.array_join(F.transform("m", lambda i: F.concat_ws(" ", i["title"], i["alt"])), " ")
    found = F.array_distinct(F.transform("m", lambda i: i["floor"]))
    has = lambda v: F.array_contains(found, F.lit(v))
    floors = when_first(
        [(words.contains("平屋"), F.lit("平屋")), (has(3.0), F.lit("3階建て")), (has(1.5), F.lit("1.5階建て")), (has(1.0) & has(2.0), F.lit("2階建")), (matches(words, "3階|三階|3F"), F.lit("3階建て")), (matches(words, "2階|二階|2F"), F.lit("2階建"))], ""
    )
    loose = F.upper(F.regexp_replace(F.regexp_extract(words, "(?iu)" + rules.LAYOUT_LOOSE, 0), r"\s+", ""))
    tried = F.concat(F.array(*(head[c] for c in ("title", "alt", "caption", "page_title"))), F.transform("m", lambda i: i["title"]))
    titles = F.filter(F.transform(tried, lambda t: F.trim(F.regexp_replace(plain_title(t), r"\s*[｜|].*$", ""))), lambda t: (t != "") & ~t.rlike("(?i)" + rules.GENERIC_TITLE))
    default = F.lit("間取り図")
    return g.select(
        F.when(F.col("n_images") > 1, F.concat(F.lit("group:"), "key")).otherwise(head["id"].cast("string")).alias("group_id"),
        F.when(F.col("n_images") == 1, F.coalesce(F.nullif(head["title"], F.lit("")), default)).otherwise(F.coalesce(F.try_element_at(titles, F.lit(1)), F.nullif(plain_title(head["page_title"]), F.lit("")), default)).alias("title"),
        F.coalesce(F.nullif(head["layout"], F.lit("")), loose).alias("layout"), head["area"].alias("area"), area_to_tsubo(head["area"]).alias("tsubo"),
        F.coalesce(F.nullif(head["floors"], F.lit("")), floors).alias("floors"), F.transform("m", lambda i: i["url"]).alias("images"), "n_images",
        F.array_max(F.transform("m", lambda i: F.nullif(i["last_seen"], F.lit("")))).alias("fetched_at"),
    )


def companions(images: DataFrame, group: str, url: str, second: str, first: str) -> DataFrame:
    """First-floor pictures that second-floor ones imply and the group lacks; second and first are file endings."""
    made = images.where(F.col(url).rlike(second)).select(group, F.regexp_replace(url, second, first).alias(url)).distinct()
    known = images.select(F.col(group).alias("__g"), without_query(url).alias("__u"))
    return made.join(known, (F.col(group) == F.col("__g")) & (without_query(url) == F.col("__u")), "left_anti")


def feed_stats(records: DataFrame, plans: DataFrame, domain: str) -> DataFrame:
    """One row: records, plans, plans of several images, and a map of records by domain."""
    by = records.groupBy(F.coalesce(F.nullif(F.col(domain), F.lit("")), F.lit("unknown")).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    by = by.agg(F.sum("n").alias("accepted"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("d", "n")))).alias("domains"))
    return by.crossJoin(plans.agg(F.count(F.lit(1)).alias("plans"), F.count_if(F.col("n_images") > 1).alias("multi_image")))
