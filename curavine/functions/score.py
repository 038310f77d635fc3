"""Rule scores of picture candidates."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import _c, collapse_space, once, text
from .url import decode, without_tracking


def matches(x: Column, pattern: str) -> Column:
    """Case-insensitive match, full-width letters among them; false for null."""
    return F.coalesce(x.rlike("(?iu)" + pattern), F.lit(False))


def when_first(rows: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first condition that holds."""
    out = F.when(rows[0][0], rows[0][1])
    for condition, value in rows[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def small_or_banner(width: Column | str, height: Column | str) -> Column:
    """Too small or too long a picture; false where a side isn't known."""
    w, h = F.coalesce(_c(width).cast("double"), F.lit(0.0)), F.coalesce(_c(height).cast("double"), F.lit(0.0))
    ratio = w / F.greatest(h, F.lit(1.0))
    return (w != 0) & (h != 0) & ((w < rules.SMALL_WIDTH) | (h < rules.SMALL_HEIGHT) | (ratio > rules.WIDE) | (ratio < rules.NARROW))


def signal(*cols: Column | str) -> Column:
    """The filled texts joined by spaces, URLs among them in their key form."""
    shown = [once(text(c), lambda t: F.when(t.rlike("(?i)^https?:"), without_tracking(t)).otherwise(t)) for c in cols]
    return collapse_space(F.array_join(F.filter(F.array(*shown), lambda s: s != ""), " "))


def visual(full: Column, own: Column, width: Column | str, height: Column | str) -> Column:
    """struct<score,token_score,photo_score,hard_rejects,category> from the full and the picture's own signal."""
    w, h = F.coalesce(_c(width).cast("double"), F.lit(0.0)), F.coalesce(_c(height).cast("double"), F.lit(0.0))
    known, ratio = (w != 0) & (h != 0), w / F.greatest(h, F.lit(1.0))
    small = F.when(known & ((w < rules.SMALL_WIDTH) | (h < rules.SMALL_HEIGHT)), 0.3).otherwise(0.0)
    banner = F.when(known & ((ratio > rules.WIDE) | (ratio < rules.NARROW)), 0.35).otherwise(0.0)

    def hits(own: Column) -> Column:
        evidence = reduce(lambda a, b: a | b, [matches(own, p) for p in rules.PLAN_TOKENS])
        found = F.array_compact(F.array(*(F.when(matches(own, p), F.lit(p)) for p, _ in rules.HARD_REJECTS)))
        spared = F.array(*(F.lit(p) for p, s in rules.HARD_REJECTS if s))
        return F.when(evidence, F.array_except(found, spared)).otherwise(found)

    def scored(full: Column, rejects: Column) -> Column:
        tokens = reduce(add, [F.when(matches(full, p), 0.18).otherwise(0.0) for p in rules.PLAN_TOKENS])
        context = F.when(matches(full, rules.PAGE_CONTEXT), 0.12).otherwise(0.0)
        generic = F.when(matches(full, rules.GENERIC_FILE), 0.08).otherwise(0.0)
        category = F.when(F.size(rejects) > 0, when_first([(matches(full, p), F.lit(name)) for name, p in rules.REJECT_CATEGORIES], "other")).otherwise("unknown")
        photo = F.when(F.size(rejects) > 0, 0.9).when(matches(full, rules.ROOM_PHOTO), 0.55).otherwise(0.15)
        score = once(tokens, lambda t: F.struct(clamp(F.lit(0.25) + t + context - small - banner - generic - F.size(rejects) * 0.35).alias("score"), clamp(t).alias("token_score")))
        return once(score, lambda s: F.struct(s["score"].alias("score"), s["token_score"].alias("token_score"), photo.alias("photo_score"), rejects.alias("hard_rejects"), category.alias("category")))

    both = F.struct(full.alias("full"), once(own, hits).alias("rejects"))
    return once(both, lambda b: scored(b["full"], b["rejects"]))


def final_confidence(checked: Column, all_flags: Column, strong: Column, model: Column, visual_score: Column) -> Column:
    """Confidence from a model's and the visual score; without a checked answer at most 0.84."""
    weighted = clamp(model * 0.8 + visual_score * 0.2)
    raised = F.greatest(weighted, F.least(F.lit(0.97), model * 0.92 + visual_score * 0.08 + 0.02))
    return F.when(checked, F.when(all_flags & strong, raised).otherwise(weighted)).otherwise(F.least(F.lit(0.84), visual_score))


def priority(visual_score: Column, explicit: Column, denied: Column, errors: Column, checked: Column, pdf: Column, seen: Column) -> Column:
    """Order of candidates for review: high first; domains that were seen often or failed come later."""
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    return visual_score + part(explicit, 0.35) - part(denied, 0.6) - F.least(F.lit(1.0), errors * 0.3) - part(checked, 0.4) - part(pdf, 1.0) - F.least(F.lit(0.35), seen * 0.03)


def record_score(url: Column | str, width: Column | str, height: Column | str) -> Column:
    """Which of several records of one picture to prefer: large ones named as plans."""
    u = F.lower(decode(url))
    w, h = F.coalesce(_c(width).cast("double"), F.lit(0.0)), F.coalesce(_c(height).cast("double"), F.lit(0.0))
    return (
        F.least(F.lit(30.0), w * h / 50000) + F.when(matches(u, r"layout|madori|floor[-_]?plan|floorplan|drawing|間取り|平面図|図面"), 50.0).otherwise(0.0)
        - F.when(matches(u, r"_s\.(?:jpe?g|png|webp)(?:$|[?#])"), 40.0).otherwise(0.0) - F.when(small_or_banner(width, height), 60.0).otherwise(0.0)
    )


def photo_only_title(title: Column | str) -> Column:
    t = F.lower(text(title))
    return (t != "") & matches(t, rules.PHOTO_TITLE) & ~matches(t, rules.PLAN_TITLE)


def acceptance_evidence(url: Column | str, alt: Column | str, caption: Column | str, title: Column | str, score: Column, overrides: list[tuple[str, str, float]] = ()) -> Column:
    """Whether a picture's names speak for a plan.

    overrides are (site pattern, file pattern, least score): on such a site only these files count. They come
    before rules.SITE_EVIDENCE, which has what is known of single sites.
    """
    from .url import looks_like_image, parts

    given = F.struct(text(url).alias("url"), parts(url)["file"].alias("file"), F.lower(text(title)).alias("title"), F.lower(F.concat_ws(" ", parts(url)["file"], text(alt), text(caption))).alias("own"), score.alias("score"))
    return once(given, lambda g: _evidence(g, overrides, looks_like_image))


def _evidence(g: Column, overrides, looks_like_image) -> Column:
    url, file, title, own, score = (g[k] for k in ("url", "file", "title", "own", "score"))
    signals = {"all": F.lower(F.concat_ws(" ", url, own, title)), "file": file, "title": title, "short title": F.when(F.length(title) <= 110, title)}
    strong = matches(own, rules.STRONG_EVIDENCE)
    steps = [(~looks_like_image(url), F.lit(False)), (matches(signals["all"], rules.SIGNAL_DENY), F.lit(False)), (matches(signals["all"], "gallery|photo") & ~strong, F.lit(False)), (photo_only_title(title), F.lit(False))]
    steps += [(matches(signals["all"], site), matches(file, name) & (score >= least)) for site, name, least in overrides]
    general = when_first([(strong, F.lit(True)), (matches(signals["short title"], rules.TITLE_EVIDENCE) & (score >= 0.55) & ~matches(file, rules.GENERIC_PHOTO), F.lit(True))], False)

    def verdict(checks, otherwise) -> Column:
        return when_first([(matches(signals[part], pattern) & (score >= least), F.lit(then)) for part, pattern, least, then in checks], F.lit(otherwise).cast("boolean"))

    # a row without a verdict is null, and the next one decides
    of_sites = [F.when(matches(signals[part], pattern), verdict(checks, otherwise)) for part, pattern, checks, otherwise in rules.SITE_EVIDENCE]
    return when_first(steps, F.coalesce(*of_sites, general))


def picture_kind(alt: Column | str, url: Column | str, outside: Column | None = None) -> Column:
    """floorplan, exterior, interior, sitePlan or other; outside tells pictures of plans that aren't floor plans."""
    words = F.concat_ws(" ", text(alt), decode(url))
    first = [(outside, F.lit("exterior"))] if outside is not None else []
    return when_first([*first, (matches(words, rules.STRONG_EVIDENCE), F.lit("floorplan")), *((matches(words, p), F.lit(k)) for k, p in rules.KINDS)], "other")


def picture_score(alt: Column | str, url: Column | str, kind: Column) -> Column:
    """How likely a picture of a page is what is looked for, by its kind and words."""
    words = F.concat_ws(" ", text(alt), decode(url))
    out = when_first([(kind == k, F.lit(v)) for k, v in rules.KIND_SCORES.items()], 0)
    for pattern, w in rules.WORD_SCORES:
        out = out + F.when(matches(words, pattern), w).otherwise(0)
    return out
