"""The whole curation run: candidates are scored, routed, cleaned, grouped into plans and counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import score as SC
from ..functions.text import text
from ..functions.url import image_key, parts
from ..operators import curate, keys, plans


@dataclass
class Result:
    accepted: DataFrame
    rejected: DataFrame
    review: DataFrame
    plans: DataFrame
    stats: DataFrame


def curated(candidates: DataFrame, accepted: DataFrame, rejected: DataFrame) -> Result:
    """One run over candidates that aren't known yet.

    candidates: id, ord, domain, page_url, image_url, title, alt, near, width, height, model_status,
    model_category, model_plan, model_top_down, model_walls, model_confidence, layout, area, floors, last_seen, and content_hash if it is known. accepted and rejected: id, image_url of
    earlier runs. Everything is one plan of DataFrame operations; nothing is collected.
    """
    if "content_hash" not in candidates.columns:
        candidates = candidates.withColumn("content_hash", F.lit(None).cast("string"))
    new = curate.admit(candidates, rejected, accepted, "id", "image_url", "image_url")
    full, own = SC.signal("image_url", "alt", "title", "near"), SC.signal("image_url", "alt", "title")
    new = new.withColumn("v", SC.visual(full, own, "width", "height")).withColumn("visual", F.col("v.score"))
    checked = F.coalesce(F.col("model_status") == "checked", F.lit(False))
    said = lambda c: F.coalesce(F.col(c), F.lit(False))
    positive = said("model_plan")
    # an accepted plan needs all of the answer's flags, not only that it is one
    full = checked & F.coalesce(F.col("model_category") == "floorplan", F.lit(False)) & positive & said("model_top_down") & said("model_walls")
    strong = SC.matches(F.lower(F.concat_ws(" ", parts("image_url")["file"], text("alt"))), SC.rules.CONFIDENCE_EVIDENCE)
    new = new.withColumn("confidence", SC.final_confidence(checked, full, strong, F.coalesce("model_confidence", F.lit(0.0)), F.col("visual")))
    new = new.withColumn("evidence", SC.acceptance_evidence("image_url", "alt", F.lit(""), "title", F.col("visual")))
    routed = curate.route(new, "visual", "confidence", checked, positive, F.size("v.hard_rejects") > 0, F.col("evidence"), F.coalesce(F.col("model_status"), F.lit("unchecked")) != "unchecked", full)
    routed = routed.withColumn("url_key", image_key("image_url"))
    routed = keys.first_accepted(routed.withColumn("ok", F.col("route") == "accept"), "url_key", "ord", "ok")
    good = routed.where("route = 'accept'").withColumn("score", SC.record_score("image_url", "width", "height")).withColumn("own", curate.cleanup_reason("image_url", "alt", "title", "width", "height"))
    cleaned = curate.clean(good, "id", "ord", "url_key", "content_hash", "score", "own")
    kept = cleaned.where("kept")
    out = routed.where("route = 'reject'").select("id", "image_url", "domain", "reason").unionByName(cleaned.where("not kept").select("id", "image_url", "domain", F.col("why").alias("reason")))
    review = routed.where("route = 'review'").select("id", "image_url", "domain", "visual", "confidence", "reason")
    kinds = candidates.select("domain", F.lit("candidate").alias("kind")).unionByName(kept.select("domain", F.lit("accepted").alias("kind")))
    kinds = kinds.unionByName(out.select("domain", F.lit("rejected").alias("kind"))).unionByName(review.select("domain", F.lit("review").alias("kind")))
    columns = ["id", "domain", "page_url", "image_url", "title", "alt", "layout", "area", "floors", "last_seen"]
    return Result(kept.select(*columns, "confidence"), out, review, plans.group_plans(kept.select(*columns)), curate.source_quality(kinds, "domain", "kind"))
