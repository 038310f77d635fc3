"""URL functions. Invalid URLs never raise; each function says what it makes of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import rules
from . import weburl
from .text import _c, once, text

#: Parameters that say where a visitor came from.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "yclid"]
_HTTP = r"(?i)^https?://[^\s/?#]+"


def decode(x: Column | str) -> Column:
    """Percent-decoded text, + as it is; the text itself where an escape is malformed."""
    return F.coalesce(F.try_url_decode(F.replace(text(x), F.lit("+"), F.lit("%2B"))), text(x))


def host(x: Column | str) -> Column:
    """Lower-case host name without user, port and a final dot; empty if it isn't an absolute URL."""
    return F.lower(F.regexp_extract(text(x), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def domain(x: Column | str) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(host(x), r"^www\.", "")


def path(x: Column | str) -> Column:
    """Path of an absolute URL, / if it has none or isn't one."""
    p = F.regexp_extract(text(x), r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def path_query(x: Column | str) -> Column:
    return F.concat(path(x), F.regexp_extract(text(x), r"^[^?#]*(\?[^#]*)?", 1))


def without_tracking(x: Column | str) -> Column:
    """URL key: fragment and tracking parameters gone, decoded, one final slash gone, lower case.

    What isn't an http(s) URL, or holds a malformed escape, is only trimmed and lower-cased.
    """

    def key(raw: Column) -> Column:
        bare = F.regexp_replace(raw, "#.*$", "")
        query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING) & (p != ""))
        base = F.regexp_replace(bare, r"\?.*$", "")
        # a host alone has / as its path
        base = F.when(base.rlike(_HTTP + "$"), F.concat(base, F.lit("/"))).otherwise(base)
        joined = once(query, lambda q: F.when(F.size(q) > 0, F.concat(base, F.lit("?"), F.array_join(q, "&"))).otherwise(base))
        decoded = F.try_url_decode(F.replace(joined, F.lit("+"), F.lit("%2B")))
        return F.when(raw.rlike(_HTTP), F.lower(F.regexp_replace(decoded, "/$", "")))

    return once(text(x), lambda raw: F.coalesce(key(raw), F.lower(F.trim(raw))))


def without_fragment(x: Column | str) -> Column:
    """An http(s) URL without its fragment; empty for anything else."""
    return F.when(text(x).rlike(_HTTP), F.regexp_replace(text(x), "#.*$", "")).otherwise("")


def without_query(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(text(x), "[?#].*$", ""))


#: Fixed value: file extensions of pictures.
IMAGE_EXTENSION = "jpe?g|png|webp|gif"


def image_key(x: Column | str) -> Column:
    """Key under which sizes of one picture meet: decoded, lower case, without query and -WxH suffix."""
    bare = F.regexp_replace(F.lower(F.trim(decode(x))), "[?#].*$", "")
    return F.regexp_replace(bare, rf"(?i)-\d+x\d+(?=\.(?:{IMAGE_EXTENSION})$)", "")


def site_key(x: Column | str, rules: list[tuple[str, str]]) -> Column:
    """The first rule (pattern, replacement) that matches the decoded URL makes the key; else image_key."""
    out = image_key(x)
    for pattern, to in reversed(rules):
        found = F.regexp_extract(decode(x), pattern, 0)
        out = F.when(found != "", F.lower(F.regexp_replace(found, pattern, to))).otherwise(out)
    return out


def parts(x: Column | str) -> Column:
    """struct<path,file,parent>: decoded lower-case path, its last and its last but one part."""
    p = F.lower(decode(path(x)))
    names = F.filter(F.split(p, "/"), lambda s: s != "")
    at = lambda k: F.coalesce(F.try_element_at(names, F.lit(k)), F.lit(""))
    return F.struct(p.alias("path"), at(-1).alias("file"), at(-2).alias("parent"))


def host_suffixes(x: Column | str) -> Column:
    """The host and each parent domain of it: what a block list may name to hit it."""
    names = F.split(host(x), r"\.")
    return F.when(host(x) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    )


def parent_url(x: Column | str) -> Column:
    """The folder of a file's URL; other URLs without query and fragment."""
    bare = F.regexp_replace(text(x), "[?#].*$", "")
    return F.when(bare.rlike(_HTTP + r".*/[^/]+\.[A-Za-z0-9]{2,5}$"), F.regexp_replace(bare, "[^/]+$", "")).otherwise(bare)


def index_queries(x: Column | str) -> Column:
    """Prefix queries of an archive index for a site: with and without www."""
    d, p = domain(x), F.regexp_replace(path(x), r"[^/]*$", "")
    return F.when(d == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(d, p, F.lit("*")), F.concat(F.lit("www."), d, p, F.lit("*"))))


@F.pandas_udf(StringType())
def resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    """Absolute URL of a link on a page; empty where there is none or it isn't http(s)."""

    return pd.Series([weburl.absolute(u, b) for b, u in zip(base, link)])


def standard(x: Column | str) -> Column:
    """The address of a URL by the URL Standard, so that all ways of writing an international host meet; what isn't one stays as it is.

    Only URLs that could change by it go through Python: those with other than plain characters, a port, user or dots.
    """
    plain = text(x).rlike(r"^https?://[a-z][a-z0-9-]*(?:\.[a-z][a-z0-9-]*)+/(?:[A-Za-z0-9_~/?=&,;+%-]|(?<![/.%2eE])\.)*$")
    asked = F.when(~plain, text(x))
    return F.coalesce(F.nullif(weburl.web_address(asked, F.lit(None).cast("string")), F.lit("")), text(x))


def unwrap(x: Column | str, hops: int = 3) -> Column:
    """Target of a search engine's redirect (parameters uddg, url, q, and u with a base64url after a1)."""
    out = text(x)
    for _ in range(hops):
        target = F.regexp_extract(out, r"[?&](?:uddg|url|q|imgurl)=(https?(?:%3A|:)[^&#]*)", 1)
        packed = F.regexp_extract(out, r"[?&]u=a1([A-Za-z0-9_-]+)", 1)
        padded = F.rpad(F.translate(packed, "-_", "+/"), (F.ceil(F.length(packed) / 4) * 4).cast("int"), "=")
        opened = F.try_to_binary(padded, F.lit("base64")).cast("string")
        out = F.when(target != "", decode(target)).when(F.coalesce(opened, F.lit("")).rlike(_HTTP), opened).otherwise(out)
    return out


def looks_like_image(x: Column | str) -> Column:
    """An http(s) URL with a picture's extension or in a folder of pictures that isn't a tracker's."""
    v = F.lower(text(x))
    named = v.rlike(rf"\.(?:{IMAGE_EXTENSION})(?:$|[?#])") | v.rlike("/(?:image|img|photo|uploads|wp-content|madori|plan|floor|drawing)/")
    return v.rlike("^https?://") & ~v.rlike(r"facebook\.com|tr\.line\.me|tag\.gif|google-analytics|googletagmanager|tracking|pixel|/tr(?:\?|/)") & named


def deny_then_allow(x: Column | str, deny: str, allow: str) -> Column:
    """Relevance: a URL that the first pattern hits is out, whatever the second says."""
    return ~text(x).rlike(deny) & text(x).rlike(allow)


def allow_then_deny(x: Column | str, first: str, deny: str, allow: str) -> Column:
    """Relevance with an exception: what the first pattern hits is in before the others are asked."""
    return text(x).rlike(first) | deny_then_allow(x, deny, allow)


def pattern_score(x: Column | str, weights: list[tuple[str, float]], base: float = 0.0) -> Column:
    """base plus the weight of each pattern that the text matches."""
    out = F.lit(float(base))
    for pattern, w in weights:
        out = out + F.when(text(x).rlike(pattern), F.lit(float(w))).otherwise(F.lit(0.0))
    return out


def url_score(url: Column | str, step: str, title: Column | str | None = None, mime: Column | str | None = None) -> Column:
    """Score of a URL for a step of discovery (a key of rules.URL_SCORES).

    "archive" and "search" look at the decoded text. search takes the title before the URL too; archive adds
    to the score of pictures, told by MIME type or extension. Null counts as empty.
    """
    named = url if title is None or step != "search" else F.concat_ws(" ", text(title), text(url))
    signal = decode(named) if step in ("archive", "search") else text(url)
    score = once(signal, lambda s: pattern_score(s, rules.URL_SCORES[step]))
    if step != "archive":
        return score
    picture = once(signal, lambda s: s.rlike(rf"(?i)\.(?:{IMAGE_EXTENSION})(?:[?#].*)?$"))
    if mime is not None:
        picture = picture | text(mime).rlike("(?i)^image/")
    return score + F.when(picture, float(rules.ARCHIVE_PICTURE_SCORE)).otherwise(0.0)


def priority(url: Column | str) -> Column:
    """Whether a URL is one to visit first; an unwanted folder rules it out, and so does an empty URL."""
    return deny_then_allow(url, "(?i)" + "|".join(rules.LOW_PRIORITY_URLS), "(?i)" + "|".join(rules.PRIORITY_URLS))


def priority_sitemap(url: Column | str) -> Column:
    return text(url).rlike("(?i)" + rules.PRIORITY_SITEMAP)
