"""From candidates to accepted records: a model's answers with all their flags, the order of promotion, the route, and crawls' logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import score as SC
from ..functions.text import _c, text
from ..functions.url import parts
from . import curate, keys


def model_review(answer: Column | str) -> Column:
    """struct<status,category,is_plan,top_down,room_labels,walls,rooms,confidence,reason> of a model's answer.

    The answer is JSON, or has it from its first brace to its last. status is unchecked for a null answer, error for
    one without a category, else checked. A flag is set by a JSON true only; confidence is between 0 and 1.
    """
    body = text(answer)
    v = F.coalesce(F.try_parse_json(body), F.try_parse_json(F.regexp_extract(body, r"(?s)\{.*\}", 0)))
    get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    flag = lambda name: (F.coalesce(F.schema_of_variant(get(name, "variant")), F.lit("")) == "BOOLEAN") & F.coalesce(get(name, "boolean"), F.lit(False))
    category = F.coalesce(get("category", "string"), F.lit(""))
    known = ~category.isin("", "false", "0")
    confidence = F.coalesce(F.nanvl(get("confidence", "double"), F.lit(0.0)), F.lit(0.0))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(_c(answer).isNull(), "unchecked").when(known, "checked").otherwise("error").alias("status"), F.when(known, category).otherwise("other").alias("category"),
        *((known & flag(name)).alias(short) for name, short in (("isFloorplan", "is_plan"), ("isTopDownPlan", "top_down"), ("hasRoomLabels", "room_labels"), ("hasWallsOrRoomBoundaries", "walls"))),
        F.when(known, F.slice(F.coalesce(get("visibleRooms", "array<string>"), none), 1, 20)).otherwise(none).alias("rooms"),
        F.when(known, F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence))).otherwise(0.0).alias("confidence"), F.when(known, F.substring(F.coalesce(get("reason", "string"), F.lit("")), 1, 400)).otherwise("").alias("reason"),
    )


def fully_positive(review: Column | str) -> Column:
    """Whether a review says all that an accepted plan needs: checked, the category, a plan, seen from above, with walls."""
    r = _c(review)
    return (r["status"] == "checked") & (r["category"] == "floorplan") & r["is_plan"] & r["top_down"] & r["walls"]


def promote(candidates: DataFrame, url: str = "image_url", alt: str = "alt", caption: str = "caption", title: str = "title", review: str = "review", visual: str = "visual", hard_rejects: str = "hard_rejects") -> DataFrame:
    """Adds confidence, route (accept, review or reject) and reason.

    visual is the score of the picture's own words, hard_rejects the list of what rules it out. Accepted are only
    pictures with a fully positive review, enough confidence, nothing against them and words that speak for a plan.
    """
    full, checked = fully_positive(review), F.col(f"{review}.status") == "checked"
    own = F.lower(F.concat_ws(" ", parts(url)["file"], text(alt), text(caption)))
    strong = SC.matches(own, rules.CONFIDENCE_EVIDENCE)
    rows = candidates.withColumn("confidence", SC.final_confidence(checked, full, strong, F.col(f"{review}.confidence"), F.col(visual)))
    evidence = SC.acceptance_evidence(url, alt, caption, title, F.col(visual))
    hard = F.coalesce(F.size(hard_rejects), F.lit(0)) > 0
    return curate.route(rows, visual, "confidence", checked, F.col(f"{review}.is_plan"), hard, evidence, F.col(f"{review}.status") != "unchecked", full)


def with_errors(candidates: DataFrame, domain: str, status: Column, name: str = "errors") -> DataFrame:
    """Adds how many candidates of the same domain ended in an error; none is 0."""
    known = curate.error_counts(candidates.withColumn("__d", text(domain)), "__d", status).withColumnRenamed("errors", name)
    return candidates.withColumn("__d", text(domain)).join(known, "__d", "left").drop("__d").withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long"))


def promotion_order(candidates: DataFrame, order: str, domain: str = "domain", url: str = "image_url", alt: str = "alt", caption: str = "caption", title: str = "title", document: str = "pdf_url", status: str = "model_status", visual: str = "visual") -> DataFrame:
    """Adds errors, seen, priority and place: the order in which candidates are looked at, from 1; equal priorities go by order.

    What speaks for a plan raises the priority; rejected words, errors of the domain, a checked answer, documents and
    earlier candidates of the domain lower it.
    """
    rows = with_errors(candidates, domain, F.coalesce(F.col(status), F.lit("")))
    rows = keys.seen_before(rows.withColumn("__d", text(domain)), "__d", order).drop("__d")
    own = F.lower(F.concat_ws(" ", parts(url)["file"], text(alt), text(caption)))
    name = F.lower(text(title))
    every = F.lower(F.concat_ws(" ", text(url), own, name))
    explicit = SC.matches(own, rules.PROMOTION_PLAN) | ((F.length(name) <= 60) & SC.matches(name, rules.PROMOTION_TITLE)) | ((F.length(name) <= 110) & SC.matches(name, rules.TITLE_EVIDENCE))
    pdf = (text(document) != "") | text(url).rlike(r"(?i)\.pdf(?:$|[?#])")
    value = SC.priority(F.col(visual), explicit, SC.matches(every, rules.PROMOTION_DENY), F.col("errors"), F.coalesce(F.col(status) == "checked", F.lit(False)), pdf, F.col("seen"))
    ranked = rows.withColumn("priority", value)
    return keys.numbered_within(ranked, [], [F.col("priority").desc(), F.col(order)], "place")


def merge_logs(base: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """The logs (id, created, site, url, message and more) of two crawls, each entry once: by id, or without one by all of these."""
    own = F.concat_ws(":", *(text(c) for c in ("created", "site", "url", "message")))
    both = base.withColumn("__side", F.lit(0)).unionByName(incoming.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("__key", F.when(text("id") != "", F.concat(F.lit("i"), text("id"))).otherwise(F.concat(F.lit("k"), own)))
    return keys.keep_first(both, ["__key"], ["__side", order]).drop("__key", "__side")


def shown_picture(image: Column, stage: str) -> Column:
    """Whether a picture of a candidate (url, thumbnail_url, alt, title) is not ruled out by the words of a stage: view or merge."""
    path = F.lower(F.coalesce(F.try_url_decode(F.regexp_extract(text(image["url"]), r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)), text(image["url"])))
    words = F.concat_ws(" ", *(text(image[c]) for c in ("url", "thumbnail_url", "alt", "title")), path)
    return ~SC.matches(words, rules.STAGE_REJECTS[stage]) & ~SC.matches(words, rules.ROOM_LABEL)
