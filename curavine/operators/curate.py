"""Routing of candidates, cleanup of accepted records, validation and source statistics."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.score import matches, photo_only_title, record_score, small_or_banner, when_first
from ..functions.text import first_filled, once, ratio3, text
from ..functions.url import IMAGE_EXTENSION, decode, image_key, looks_like_image, parts
from .convert import filter_nested
from .keys import keep_first


def route(df: DataFrame, visual: str, confidence: str, checked: Column, positive: Column, hard_reject: Column, evidence: Column, status_open: Column, full_flags: Column,
          accept: float = rules.ACCEPT, review: float = rules.REVIEW, least_visual: float = rules.VISUAL) -> DataFrame:
    """Adds route (accept, review or reject) and reason, each row by the first rule that applies."""
    low = F.col(confidence) >= review
    steps = [
        (hard_reject, F.struct(F.lit("reject").alias("route"), F.lit("hard-reject").alias("reason"))),
        (checked & ~positive, F.struct(F.lit("reject").alias("route"), F.lit("not-a-plan").alias("reason"))),
        (checked & full_flags & (F.col(confidence) >= accept) & evidence, F.struct(F.lit("accept").alias("route"), F.lit("").alias("reason"))),
        (low | (F.col(visual) >= least_visual) | evidence | status_open, F.struct(F.lit("review").alias("route"), F.when(checked, "uncertain").otherwise("unchecked-or-visual-only").alias("reason"))),
    ]
    return df.select("*", when_first(steps, F.struct(F.lit("reject").alias("route"), F.lit("low-confidence").alias("reason"))).alias("__r")).select(*df.columns, "__r.*")


def touch(stored: DataFrame, seen: DataFrame, key: str, column: str, at: Column) -> DataFrame:
    """Sets a column of the stored rows whose key was seen; the others stay as they are."""
    hits = seen.select(F.col(key)).distinct().withColumn("__hit", F.lit(True))
    return stored.join(hits, key, "left").withColumn(column, F.when(F.col("__hit"), at).otherwise(F.col(column))).drop("__hit")


def admit(candidates: DataFrame, rejected: DataFrame, accepted: DataFrame, key: str, url: str, accepted_url: str, reconsider: bool = False) -> DataFrame:
    """Candidates that are neither rejected nor accepted, by id or by the key of their picture's URL."""
    rows = candidates.where(text(url) != "")
    if not reconsider:
        rows = rows.join(rejected.select(key), key, "left_anti")
    rows = rows.join(accepted.select(key), key, "left_anti")
    urls = accepted.select(image_key(accepted_url).alias("__url")).where("__url != ''")
    return rows.withColumn("__url", image_key(url)).join(urls, "__url", "left_anti").drop("__url")


def only(candidates: DataFrame, site: str = "", pattern: str = "", domain_column: str = "source_domain", url_column: str = "image_url") -> DataFrame:
    """Candidates of one site, and of URLs that match a pattern; empty means any."""
    out = candidates
    if site:
        out = out.where(F.regexp_replace(F.lower(text(domain_column)), r"^www\.", "") == site.lower().removeprefix("www."))
    return out.where(matches(text(url_column), pattern)) if pattern else out


def cleanup_reason(url: str, alt: str, title: str, width: str, height: str) -> Column:
    """Why an accepted record has to go; empty if it may stay."""
    u = F.lower(decode(url))
    given = F.struct(u.alias("url"), F.element_at(F.split(u, "[/?#]"), 1).alias("head"), parts(url)["file"].alias("file"), text(url).alias("raw"), F.lower(text(title)).alias("title"), F.lower(text(alt)).alias("alt"), small_or_banner(width, height).alias("small"))

    def reason(g: Column) -> Column:
        signals = {"all": F.concat_ws(" ", g["title"], g["url"], F.lower(g["raw"]), g["alt"]), **{k: g[k] for k in ("url", "head", "file", "raw", "title")}}
        strong = matches(F.concat_ws(" ", g["head"], g["alt"]), rules.CLEAN_FILE) | matches(g["url"], rules.PLAN_UPLOADS + "|" + rules.CLEAN_URL)
        named = {
            "strong": strong | matches(g["title"], "^平屋の間取り$") | ((F.length(g["title"]) <= 110) & matches(g["title"], rules.CLEAN_TITLE)),
            "file evidence": matches(g["file"], rules.CLEAN_FILE), "photo-only title": photo_only_title(g["title"]),
        }
        holds = lambda x: named[x] if isinstance(x, str) else matches(signals[x[0]], x[1])
        steps = [(reduce(and_, map(holds, hit)) & ~reduce(or_, map(holds, saved), F.lit(False)), F.lit(name)) for name, hit, saved in rules.CLEANUP]
        picture = looks_like_image(g["raw"]) & (F.lower(g["raw"]).rlike(rf"\.(?:{IMAGE_EXTENSION})(?:$|[?#])") | F.lower(g["raw"]).rlike("/(?:image|img|uploads|wp-content|madori|plan|floor|drawing)/"))
        return when_first([(g["small"], F.lit("small-or-banner-image")), *steps, (~picture, F.lit("non-image-url"))], "")

    return once(given, reason)


def clean(records: DataFrame, key: str, order: str, url_key: str, content_hash: str, score: str, reason: str) -> DataFrame:
    """Adds kept and why. A row is kept if it has no reason of its own, is the preferred one of its content
    hash, and is the first such row of its URL key. A URL repeat is named before a hash repeat, that before
    the row's own reason. Rows without a hash or a URL key aren't repeats. The preferred and first rows come
    from aggregations, so that no hash or URL key has to fit into a task.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    rows = records.withColumns({"__hashed": named(content_hash), "__url": named(url_key)})
    # rows without a hash or a URL key look for one that is never there, each for another, so that they don't meet in one task
    look = lambda has, c: F.when(F.col(has), F.col(c).cast("string")).otherwise(F.xxhash64(key, order).cast("string"))
    by_hash = rows.where("__hashed").withColumn("__place", F.struct(F.col(score).isNull(), -F.col(score), F.col(order)))
    best = by_hash.groupBy(F.col(content_hash).cast("string").alias("__h")).agg(F.min_by(key, "__place").alias("__best")).withColumn("__is", F.lit(True))
    out = rows.withColumn("__look", look("__hashed", content_hash)).join(best, (F.col("__look") == F.col("__h")) & (F.col("__hashed") == F.col("__is")), "left").drop("__h", "__is", "__look")
    out = out.withColumn("__own", F.when(F.col("__hashed") & (F.col("__best") != F.col(key)), "duplicate-hash").otherwise(F.col(reason)))
    firsts = out.where("__url and __own = ''").groupBy(F.col(url_key).cast("string").alias("__u")).agg(F.min(order).alias("__before")).withColumn("__is", F.lit(True))
    out = out.withColumn("__look", look("__url", url_key)).join(firsts, (F.col("__look") == F.col("__u")) & (F.col("__url") == F.col("__is")), "left")
    repeat = F.coalesce(F.col("__before") < F.col(order), F.lit(False))
    out = out.withColumn("why", F.when(repeat, "duplicate-url").otherwise(F.col("__own"))).withColumn("kept", F.col("why") == "")
    return out.drop("__hashed", "__url", "__best", "__own", "__u", "__is", "__look", "__before")


def preferred(records: DataFrame, url: str, width: str, height: str, name: str = "score") -> DataFrame:
    return records.withColumn(name, record_score(url, width, height))


def validate(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """One row for each violation: key, check."""
    hits = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    return df.select(F.col(key), F.explode(hits).alias("check"))


def source_quality(kinds: DataFrame, domain: str, kind: str, states: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """Counts of candidates, accepted, rejected and review rows of each domain, with rate and quality.

    One aggregation over the union of the four kinds; a missing domain counts as unknown. states adds its
    columns; last_crawled_at is taken from the statistics of the run before where the state has none.
    """
    d = F.coalesce(F.nullif(F.col(domain), F.lit("")), F.lit("unknown")).alias("domain")
    n = lambda k: F.count_if(F.col(kind) == k)
    out = kinds.groupBy(d).agg(n("candidate").alias("candidates"), n("accepted").alias("accepted"), n("rejected").alias("rejected"), n("review").alias("review"))
    out = out.withColumn("rate", ratio3(F.col("accepted"), F.col("candidates")))
    out = out.withColumn("quality", quality(F.col("rate"), F.col("accepted")))
    if states is not None:
        out = out.join(states, "domain", "left")
    if before is not None:
        own = F.nullif(F.col("last_crawled_at"), F.lit("")) if states is not None else F.lit(None)
        out = out.join(before.select("domain", F.col("last_crawled_at").alias("__before")), "domain", "left")
        out = out.withColumn("last_crawled_at", F.coalesce(own, F.col("__before"))).drop("__before")
    return out


def quality(rate: Column, accepted: Column) -> Column:
    return F.when((rate >= rules.QUALITY_HIGH) & (accepted >= rules.QUALITY_HIGH_COUNT), "high").when(rate >= rules.QUALITY_MEDIUM, "medium").otherwise("low")


def error_counts(df: DataFrame, domain: str, status: Column) -> DataFrame:
    return df.where(status == "error").groupBy(domain).agg(F.count(F.lit(1)).alias("errors"))


def route_documents(candidates: DataFrame, processed: DataFrame, key: str, document: str, picture: str, order: list[Column | str], most: int) -> tuple[DataFrame, DataFrame]:
    """(rows for review, URLs that are processed now) of the first candidates that lead to documents not processed before.

    A candidate's document is its own, or else its picture if that is a PDF file. What has no address on the web is
    processed, but not reviewed. processed has a column url. Adds document, reason and note to the rows for review;
    most is the number of documents of one run.
    """
    own = F.coalesce(F.nullif(text(document), F.lit("")), F.when(text(picture).rlike(r"(?i)\.pdf(?:$|[?#])"), text(picture)))
    rows = candidates.withColumn("__document", own).where("__document is not null")
    rows = rows.join(processed.select(F.col("url").alias("__document")).distinct(), "__document", "left_anti").orderBy(*order).limit(most)
    reason, note = F.lit("pdf-rendering-not-enabled"), F.lit("PDF page rendering is optional. Route pages through visual/Ollama classification before acceptance.")
    review = rows.where(F.col("__document").rlike(r"(?i)^https?://")).withColumns({document: F.col("__document"), "reason": reason, "note": note, "status": F.lit("review")})
    return review.drop("__document"), rows.select(F.col("__document").alias("url")).distinct()


def review_budget(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The rows that come first; how many may be asked about is a budget of the run."""
    return df.orderBy(*order).limit(most)


def next_state(state: DataFrame, outcomes: DataFrame, now: Column, hours: dict[str, int], default_hours: int = 24) -> DataFrame:
    """State of each domain after its outcome (domain, ok, reason).

    Success clears failures and the reason; a stop adds a failure and a time before which the domain is left
    alone, by its reason. Domains without an outcome keep their state; last_crawled_at is the time now.
    """
    j = state.join(outcomes.withColumnRenamed("domain", "__d"), F.col("domain") == F.col("__d"), "full_outer")
    wait = when_first([(F.col("reason") == r, F.lit(h)) for r, h in hours.items()] or [(F.lit(False), F.lit(0))], default_hours)
    stopped = F.col("ok").isNotNull() & ~F.col("ok")
    fails = F.coalesce(F.col("failures"), F.lit(0))
    return j.select(
        F.coalesce("domain", "__d").alias("domain"), F.when(F.col("ok"), 0).when(stopped, fails + 1).otherwise(fails).alias("failures"),
        F.when(F.col("ok"), "ok").when(stopped, "stopped").otherwise(F.col("last_status")).alias("last_status"),
        F.when(F.col("ok"), F.lit(None)).when(stopped, F.col("reason")).otherwise(F.col("block_reason")).alias("block_reason"),
        F.when(F.col("ok"), F.lit(None)).when(stopped, now + F.make_interval(hours=wait)).otherwise(F.col("next_crawl_after")).alias("next_crawl_after"),
        F.when(F.col("ok").isNotNull(), now).otherwise(F.col("last_crawled_at")).alias("last_crawled_at"),
    )


def due(state: DataFrame, now: Column, column: str = "next_crawl_after") -> DataFrame:
    return state.where(F.col(column).isNull() | (F.col(column) <= now))


def block_page(markup: Column | str) -> Column:
    """captcha, login or denied for a page that stands in for another, else null."""
    from ..functions.text import strip_html

    start = F.lower(F.substring(strip_html(markup), 1, rules.BLOCK_PAGE_CHARS))
    return when_first([(start.rlike(p), F.lit(n)) for n, p in rules.BLOCK_PAGES], F.lit(None))


def crawl_gate(enabled: Column, url: Column, portal: Column, acknowledged: Column, stores_images: Column) -> Column:
    """Why a site isn't crawled; null if it is."""
    return when_first([(~enabled, F.lit("disabled")), (url == "", F.lit("no-url")), (portal & ~acknowledged, F.lit("portal-not-acknowledged")), (portal & stores_images, F.lit("portal-stores-images"))], F.lit(None))


def review_keys(images: DataFrame, key: str, order: str, checked: Column, asked: Column, hard_reject: Column, strong: Column, most: int) -> DataFrame:
    """Keys of the pictures that a model is asked about: wanted ones first, then strong, other and rejected ones."""
    rank = F.when(asked, 0).when(hard_reject, 5).when(strong, 1).otherwise(2)
    rows = images.where(~checked & (text(key) != ""))
    return rows.select(key, rank.alias("priority"), order).orderBy("priority", order).limit(most).select(key).distinct()


def review_pass(images: DataFrame, budget: DataFrame, answers: DataFrame, key: str, checked: Column, was_plan: Column, hard_reject: Column, least: float = 0.65, keep_unchecked: bool = True) -> DataFrame:
    """Adds kept after a model's answers (key, is_plan, confidence): checked pictures stay unless they were none.

    Pictures beyond the budget, or without an answer, stay if unchecked ones may; answered ones stay if the
    answer is sure enough and nothing rules them out.
    """
    j = images.join(budget.select(key).withColumn("__in", F.lit(True)), key, "left").join(answers, key, "left")
    answered = F.coalesce(F.col("__in"), F.lit(False)) & F.col("is_plan").isNotNull()
    return j.withColumn("kept", kept_after(answered, checked, was_plan, hard_reject, least, keep_unchecked)).drop("__in")


def kept_after(answered: Column, checked: Column, was_plan: Column, hard_reject: Column, least: float, keep_unchecked: bool) -> Column:
    """Whether a picture stays after a review with the answer (is_plan, confidence), if it is answered."""
    good = F.col("is_plan") & (F.col("confidence") >= least) & ~hard_reject
    return F.when(checked, F.coalesce(was_plan, F.lit(True))).when(answered, good).otherwise(F.lit(keep_unchecked))


def past_answer(status: Column, is_plan: Column, category: Column, confidence: Column, reason: Column) -> Column:
    """struct<status,category,is_plan,full> of an answer of any age; old ones without a category count as full by their reason."""
    old = category.isNull() & F.coalesce(status == "checked", F.lit(True)) & is_plan & (confidence >= 0.9)
    full = old & matches(reason, r"top[- ]?view|top[- ]?down|floor plan|architectural drawing")
    known = F.coalesce(status, F.when(is_plan.isNotNull(), "checked"), F.lit("unchecked"))
    return F.struct(known.alias("status"), F.coalesce(category, F.when(is_plan, "floorplan").otherwise("other")).alias("category"), F.coalesce(is_plan, F.lit(False)).alias("is_plan"), F.coalesce(full, F.lit(False)).alias("full"))


def advance(state: DataFrame, done: int, size: int, run: Column, most: int = 120) -> DataFrame:
    """A rotation's next index and rounds after a run, and its history cut to the last runs."""
    end = F.col("next_index") + done
    history = F.concat(F.col("runs"), F.array(run))
    return state.withColumns({
        "completed_rounds": F.col("completed_rounds") + F.floor(end / size).cast("int"), "next_index": F.pmod(end, F.lit(size)).cast("int"),
        "runs": F.slice(history, F.greatest(F.lit(1), F.size(history) - most + 1), F.lit(most)),
    })


def with_review(candidates: DataFrame, review: DataFrame, key: str, column: str, order: Column | str) -> DataFrame:
    """The candidates' column, and where it is null that of the last review row of their key."""
    last = review.groupBy(key).agg(F.max_by(column, order).alias("__review"))
    return candidates.join(last, key, "left").withColumn(column, F.coalesce(column, "__review")).drop("__review")


def with_site(candidates: DataFrame, sites: DataFrame, key: str, source: str, name: str, order: str) -> DataFrame:
    """The candidates' source, trimmed, and where it is empty the name of the first site of their key; else empty."""
    first = sites.groupBy(key).agg(F.min_by(name, order).alias("__name"))
    own = F.regexp_replace(text(source), r"(?U)^\s+|\s+$", "")
    return candidates.join(first, key, "left").withColumn(source, F.coalesce(first_filled(own, "__name"), F.lit(""))).drop("__name")


def merge_crawls(base: DataFrame, incoming: DataFrame, images: str, page: str, order: str, keep) -> DataFrame:
    """Two crawls as one: pictures without a URL or that aren't to be kept go, and so do rows left without any.

    Of rows with the same page and first picture the first stays, base rows before incoming ones. Adds n_images.
    """
    both = base.withColumn("__side", F.lit(0)).unionByName(incoming.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    both = filter_nested(both, images, lambda i: (text(i["url"]) != "") & keep(i))
    both = both.withColumn("__key", F.concat_ws(":", text(page), F.element_at(images, 1)["url"]))
    return keep_first(both, ["__key"], ["__side", order]).drop("__key", "__side")
