"""Pictures in markup and in bytes. Python, as neither enclosing elements nor file headers are within SQL's reach."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructType

from .. import rules
from . import markup, weburl

#: Between the pictures of a srcset. A comma within a URL, as of an image server's options, parts nothing.
_NEXT = re.compile(r",\s+|,(?=https?:|\.{0,2}/)|(?:(?<=\d[wx])|(?<=\.(?:jpg|png|gif))|(?<=\.(?:jpeg|webp))),", re.I)
#: Elements that hold a picture's context, from the most to the least telling, and the longest that counts; else so much around it.
ENCLOSING, LONGEST, AROUND = ("figure", "article", "li", "section", "div"), 8000, 1200
#: Attributes of an img element that name one picture each, in this order.
LAZY = ("src", "data-src", "data-original", "data-lazy-src", "data-srcset", "data-large_image", "data-bg", "data-background-image")


def _struct(**fields) -> StructType:
    """Types as objects: a module may be imported before there is a session."""
    out = StructType()
    for name, kind in fields.items():
        out.add(name, kind)
    return out


_TEXT, _INT, _FLAG, _SHARE = StringType(), IntegerType(), BooleanType(), DoubleType()
_PICTURE = _struct(position=_INT, url=_TEXT, found_in=_TEXT, alt=_TEXT, width=_INT, height=_INT, caption=_TEXT, near=_TEXT, page_title=_TEXT)
_FEATURES = _struct(
    white=_SHARE, dark=_SHARE, vivid=_SHARE, grey=_SHARE, light=_SHARE, colourful=_SHARE, banner_like=_FLAG, plan_like=_FLAG, photo_like=_FLAG, hard_reject=_FLAG, reason=_TEXT,
)


def _spaced(text: str) -> str:
    return " ".join(text.split())


def _srcset(value: str) -> list[tuple[str, str]]:
    """(URL, descriptor) of a srcset's pictures; data URLs, whose commas are their own, are left out."""
    parts = [p.split() for p in _NEXT.split(re.sub(r"(?i)(?:^|(?<=[\s,]))data:\S*(?:\s+[\d.]+[wx])?", "", value))]
    return [(p[0].strip(","), p[1] if len(p) > 1 else "") for p in parts if p and p[0].strip(",")]


def _contexts(page: str) -> Iterator[tuple[str, int, str, list[tuple[str, int, int]]]]:
    """(element, place, tag, blocks) of the img and source elements: each block reaches from the last opening tag of an
    enclosing kind before the picture to the first closing one behind it, both found in the one pass over the tags.
    """
    last: dict[str, int] = {}
    waiting: dict[str, list[dict]] = {name: [] for name in ENCLOSING}
    found, begun = [], []
    for tag in markup.tags(page, ("img", "source", *ENCLOSING)):
        if begun and begun[0].end <= tag.start:  # tags that no picture stands in
            last.update((t.name, t.start) for t in begun)
            begun = []
        if tag.name in waiting:
            if not tag.closing:
                begun.append(tag)
            elif tag.end - tag.start == len(tag.name) + 3:
                for blocks in waiting[tag.name]:
                    blocks[tag.name] = blocks[tag.name][0], tag.end
                waiting[tag.name] = []
        elif not tag.closing:
            blocks = {name: (start, None) for name, start in last.items()}
            for name in last:
                waiting[name].append(blocks)
            found.append((tag.name, tag.start, page[tag.start : tag.end], blocks))
    for name, start, raw, blocks in found:
        yield name, start, raw, [(k, *blocks[k]) for k in ENCLOSING if k in blocks and blocks[k][1] is not None and blocks[k][1] - blocks[k][0] <= LONGEST]


def pictures(page: str | None, page_url: str | None = None) -> Iterator[tuple]:
    """(position, url, found_in, alt, width, height, caption, near, page_title) of a page's pictures, each address once.

    Pictures are those of img elements, by LAZY and srcset, of source elements and of url() in styles, in this order;
    data and script addresses are none. Without a page_url, addresses stay as they are written. The caption is
    that of a figure around the picture. near is the text of the closest block that isn't too long, or of what stands
    around the picture, with caption, alt, surroundings and the page's title.
    """
    page, seen, texts = page or "", set(), {}
    base = weburl.parse(page_url) if page_url else None
    title = _spaced(markup.content(page, "title"))
    first: dict[str, int] = {}

    def around(raw: str, at: int) -> str:
        at = first.setdefault(raw, at)  # the first that is written alike
        return markup.without_tags(page[max(0, at - AROUND) : at + len(raw) + AROUND])

    def address(link: str) -> str:
        if re.match("data:|javascript:|#", link, re.I):
            return ""
        if page_url is None:
            return link
        found = weburl.parse(link, base)
        return found.href() if found else ""

    def block(start: int, end: int, kind: str) -> tuple[str, str]:
        if (start, end) not in texts:
            own = page[start:end]
            texts[start, end] = _spaced(markup.without_tags(own)), _spaced(markup.content(own, "figcaption")) if kind == "figure" else ""
        return texts[start, end]

    def each() -> Iterator[tuple]:
        later = []
        for name, at, raw, blocks in _contexts(page):
            attrs = markup.attributes(raw)
            where = around(raw, at)
            near, caption = block(blocks[0][1], blocks[0][2], blocks[0][0]) if blocks else (_spaced(where), "")
            size = lambda k: int(attrs[k]) if attrs.get(k, "").isdecimal() and len(attrs[k]) < 10 else None  # noqa: B023, E731
            if name == "source":
                later += [(link, "picture-source", "", None, None, caption, near, where) for link, _ in _srcset(attrs.get("srcset") or attrs.get("data-srcset", ""))]
                continue
            links = [(attrs[k].split()[0], k) for k in LAZY if k != "data-srcset" and attrs.get(k, "").split()]
            links += [(link, k) for k in ("data-srcset", "srcset") for link, _ in _srcset(attrs.get(k, ""))]
            for link, k in sorted(links, key=lambda x: (*LAZY, "srcset").index(x[1])):
                yield link, k, _spaced(attrs.get("alt", "")), size("width"), size("height"), caption, near, where
        yield from later
        for at, link in markup.style_urls(page):
            where = around(page[at : at + len(link) + 5], at)
            yield link, "css-background", "", None, None, "", _spaced(where), where

    for link, found_in, alt, width, height, caption, near, where in each():
        url = address(link)
        if url and url not in seen:
            seen.add(url)
            yield len(seen), url, found_in, alt, width, height, caption, _spaced(" ".join(filter(None, (near, caption, alt, where, title)))), title


def document_links(page: str | None, page_url: str | None = None) -> Iterator[tuple]:
    """(position, url, label) of the links to PDF files whose address or label speaks of plans or catalogues."""
    page, base, n = page or "", weburl.parse(page_url) if page_url else None, 0
    for tag, end, _ in markup.elements(page, "a", lambda raw: len(raw) > 3):
        link = markup.attributes(page[tag.start : tag.end]).get("href", "")
        found = weburl.parse(link, base) if link and not re.match("data:|javascript:|#", link, re.I) else None
        url, label = found.href() if found else "", _spaced(markup.without_tags(page[tag.end : end]))
        if re.search(r"\.pdf(?:$|[?#])", url, re.I) and _has(rules.DOCUMENT, f"{url} {label}"):
            n += 1
            yield n, url, label


@F.udtf(returnType=_struct(position=_INT, url=_TEXT, label=_TEXT))
class DocumentLinks:
    """Table function over a page's markup and URL."""

    def eval(self, page: str, page_url: str | None = None):
        yield from document_links(page, page_url)


@F.udtf(returnType=_PICTURE)
class HtmlPictures:
    """Table function over a page's markup and, for absolute addresses, its URL."""

    def eval(self, page: str, page_url: str | None = None):
        yield from pictures(page, page_url)


_CRAWLED = _struct(position=_INT, url=_TEXT, kind=_TEXT, alt=_TEXT, review=_FLAG, score=_INT)
#: Attributes of an img element that the crawl takes a picture's URL from, in this order.
CRAWLED = (
    "src", "data-src", "data-original", "data-lazy", "data-lazy-src", "data-original-src", "data-bg", "data-background", "data-bg-src", "data-lazy-background", "data-src-mobile",
    "data-src-pc",
)
_IMAGE_URL = re.compile(r"\.(?:png|jpe?g|webp|gif)(?:[?#].*)?$", re.I)
_HREF = re.compile(r"href\s*=\s*([\"']?)([^\"'\s>]+)\1", re.I)
_STYLE_FILE = re.compile(r"\.(?:png|jpe?g|webp|gif)(?:\?.+)?$", re.I)
_QUOTED_FILE = re.compile(r"(?:(?:https?:)?//|/|\.\.?/).+?\.(?:png|jpe?g|webp|gif)(?:\?.*)?$", re.I)


def _has(pattern: str, value: str) -> bool:
    return re.search(pattern, value, re.I) is not None


def _number(value: str | None) -> float:
    try:
        return float(value or 0)
    except ValueError:
        return 0.0


def article_thumbnail(signal: str) -> bool:
    return _has(rules.ARTICLE_URL, signal) and _has(rules.ARTICLE_TITLE, signal) and not _has(rules.ARTICLE_PLAN, signal)


def _strong(alt: str, file: str, parent: str) -> bool:
    if _has(rules.PLAN_ALT, alt) or all(_has(p, alt) for p in rules.PLAN_ALT_PAIR):
        return True
    own = f"{alt} {file}"
    return _has(rules.CRAWL_PLAN_FILE, own) or (_has(rules.PLAN_FOLDER[0], f"{parent}/{file}") and _has(rules.PLAN_FOLDER[1], own))


def _outside(signal: str) -> bool:
    feature = _has(rules.FEATURE_PICTURE, signal) and not _has(rules.FEATURE_PLAN, signal)
    return _has(rules.SITE_PHOTO + r"\.(?:jpe?g|png|webp)", signal) or feature or _has(rules.OUTSIDE, signal)


def _address(link: str, base: weburl.Url | None, web_only: bool) -> str:
    """The address of a link as the crawl has it: fragments and data aren't fetched."""
    if not link or link.startswith("#"):
        return ""
    found = weburl.parse(link, base)
    return found.href() if found and found.scheme != "data" and (found.scheme in ("http", "https") or not web_only) else ""


def _written(page: str, tail: str) -> Iterator[tuple[str, str, float, float, int | None, bool]]:
    """(link, alt, width, height, content index, literal) of all that looks like a picture, in the order in which it counts.

    Sources: og:image or twitter:image, img and source elements with their lazy-loading attributes, links to picture
    files, url() of styles and quoted picture files, as in scripts. tail follows the words for pictures without any.
    """
    rank = lambda d: _number(d[:-1]) * (1000 if d[-1:] in "xX" else 1)
    widest = lambda value: [url for url, _ in sorted(_srcset(value), key=lambda p: -rank(p[1]))]
    content, own, later = 0, [], []
    shown = markup.meta(page, "og:image") or markup.meta(page, "twitter:image")
    yield shown, "OG" + tail, 0, 0, None, False
    for tag in markup.tags(page, ("img", "source")):
        if tag.closing:
            continue
        a = {k: markup.decoded(v) for k, v in markup.attributes(page[tag.start : tag.end]).items()}
        if tag.name == "source":
            later += [(link, a.get("alt") or a.get("title") or "", 0, 0, None, False) for link in widest(a.get("srcset") or a.get("data-srcset") or "")]
            continue
        alt = next((a[k] for k in ("alt", "title", "aria-label", "class", "id") if a.get(k)), "")
        width, height, index = _number(a.get("width")), _number(a.get("height")), None
        if width >= rules.CRAWL_CONTENT_SIZE[0] or height >= rules.CRAWL_CONTENT_SIZE[1] or _has("wp-image|content|main|floor|plan|madori", alt):
            index, content = content, content + 1
        own += [(link, alt, width, height, index, False) for link in (*(a.get(k, "") for k in CRAWLED), *widest(a.get("srcset", "")), *widest(a.get("data-srcset", "")))]
    yield from own
    yield from later
    for tag, end, _ in markup.elements(page, "a", _HREF.search):
        href = markup.decoded(_HREF.search(page, tag.start, tag.end)[2])
        if _IMAGE_URL.search(href):
            yield href, markup.plain(page[tag.end : end]), 0, 0, None, False
    for _, link in markup.style_urls(page):
        if _STYLE_FILE.search(link):
            yield link, _BACKGROUND[tail], 0, 0, None, False
    used = -1
    for at, link in markup.quoted(page):
        if at > used and _QUOTED_FILE.match(link):
            yield link, markup.plain(page[max(0, at - 240) : at + 320]), 0, 0, content, True
            content += 1
            used = at + len(link) + 1  # its second quote isn't the first of another


#: What stands in for a missing alt text of a page's own and of a background picture, in the crawl and in archived pages.
_BACKGROUND = {"画像": "背景画像", " image": "background image"}


def page_title(page: str) -> str:
    """The first title of a page that isn't empty: those for sharing, the first heading, its own."""
    titles = (markup.meta(page, "og:title"), markup.meta(page, "twitter:title"), markup.content(page, "h1"), markup.content(page, "title"))
    return next((t for t in (_spaced(markup.decoded(x)) for x in titles) if t), "")


def _shown(url: str, width: float, height: float, literal: bool) -> bool:
    """Whether a picture looks like part of a page's content."""
    large = width >= rules.CRAWL_CONTENT_SIZE[0] or height >= rules.CRAWL_CONTENT_SIZE[1]
    return bool(_IMAGE_URL.search(url)) and not _has(rules.NO_CONTENT_URL, url) and (_has(rules.CONTENT_URL, url) or large or literal)


def crawled_pictures(page: str | None, page_url: str, contextual: bool = False, loose: bool = False, most: int | None = None) -> list[tuple]:
    """(position, url, kind, alt, review, score) of a page's pictures as the crawl sees them, the best score first.

    Each URL counts once. Decorative pictures, article thumbnails and photos labelled as rooms are left out.
    contextual lets the first content picture of a page about plans be one if its names say so; loose does so for
    early content pictures of such pages without the names and marks them for review. most keeps the best ones only.
    """
    page, found, seen, base = page or "", [], set(), weburl.parse(page_url or "")
    about = f"{page_title(page)} {page_url} {_spaced(markup.decoded(markup.plain(page)))[: rules.CRAWL_PAGE_CHARS]}"
    contextual, loose = contextual and _has(rules.CRAWL_PAGE, about), loose and _has(rules.CRAWL_EXPLICIT_PAGE, about)
    for link, alt, width, height, index, literal in _written(page, "画像"):
        url = _address(link, base, False)
        if not url or url in seen:
            continue
        alt = markup.decoded(alt)
        path = [p for p in unquote(urlsplit(url).path).split("/") if p]
        file, parent = (path[-1] if path else ""), (path[-2] if len(path) > 1 else "")
        signal = f"{alt} {'/'.join(path[-3:])}"
        if _has(rules.ROOM_LABEL, signal):
            continue
        strong = _strong(alt, file, parent)
        kind = "other"
        if not article_thumbnail(signal):
            kind = "exterior" if _outside(signal) else "floorplan" if strong else next((k for k, p in rules.KINDS if _has(p, signal)), "other")
        shown, review = _shown(url, width, height, literal), False
        if kind == "other" and shown and contextual and index == 0 and strong and (not alt.strip() or _has(rules.GENERIC_ALT, alt)):
            kind = "floorplan"
        if kind == "other" and shown and loose and (index or 0) <= rules.LAST_LOOSE and (_has(rules.CRAWL_PLAN, signal) or not _has(rules.PHOTO_SIGNAL, signal)):
            kind, review = "floorplan", True
        if _has(r"\.svg(?:\?|$)", url) or article_thumbnail(signal) or _has(rules.DECORATIVE, signal):
            continue
        seen.add(url)
        score = rules.KIND_SCORES.get(kind, 0) + sum(w for p, w in rules.WORD_SCORES if _has(p, signal)) + (rules.LOOSE_SCORE if review else 0)
        found.append((url, kind, alt, review, score))
    return [(i + 1, *f) for i, f in enumerate(sorted(found, key=lambda f: -f[4])[:most])]


def archived_pictures(page: str | None, page_url: str, loose: bool = False, most: int | None = 40) -> list[tuple]:
    """(position, url, kind, alt, review, score) of an archived page's pictures of plans, the best score first.

    A picture counts if its alt text, file or folder names a plan; loose also lets early content pictures of pages
    about plans in, but for photos, and marks those for review whose words don't tell of one. Pictures without an alt
    text have the page's title.
    """
    page, found, seen, base = page or "", [], set(), weburl.parse(page_url or "")
    title = page_title(page)
    text = _spaced(markup.decoded(markup.plain(page)))[: rules.ARCHIVED_PAGE_CHARS]
    about = _has(rules.ARCHIVED_PAGE, f"{title} {text} {page_url}")
    loose = loose and _has(rules.CRAWL_EXPLICIT_PAGE, f"{title} {page_url} {text}")
    for link, alt, width, height, index, literal in _written(page, " image"):
        url = _address(link, base, True)
        if not url or url in seen or re.fullmatch("undefined|null", link, re.I) or not _IMAGE_URL.search(url):
            continue
        whole = unquote(urlsplit(url).path)
        path = [p for p in whole.split("/") if p]
        signal = f"{alt} {whole} "[:18000]
        if _has(rules.ROOM_LABEL, signal):
            continue
        named = _strong(alt, path[-1] if path else "", path[-2] if len(path) > 1 else "")
        early = loose and _shown(url, width, height, literal) and (index or 0) <= rules.LAST_LOOSE
        if not named and (not early or (_has(rules.PHOTO_SIGNAL, signal) and not _has(rules.CRAWL_PLAN, signal))):
            continue
        spared = _has(rules.ARCHIVED_SPARED, signal)
        if _has(r"\.svg(?:\?|$)", signal) or _has(rules.ARCHIVED_DECORATIVE, signal) or (_has(rules.ARCHIVED_OUTSIDE, signal) and not spared):
            continue
        seen.add(url)
        review = early and not (about and named) and not any(_has(p, signal) for p in rules.ARCHIVED_PLAN)
        score = (rules.ARCHIVED_LOOSE_SCORE if early else 0) + sum(w for p, w in rules.ARCHIVED_WORD_SCORES if _has(p, signal))
        found.append((url, "floorplan", _spaced(markup.decoded(alt or title or "floorplan candidate")), review, score))
    return [(i + 1, *f) for i, f in enumerate(sorted(found, key=lambda f: -f[4])[:most])]


@F.udtf(returnType=_CRAWLED)
class CrawledPictures:
    """Table function over a page's markup and URL."""

    def eval(self, page: str, page_url: str, contextual: bool = False, loose: bool = False):
        yield from crawled_pictures(page, page_url or "", contextual, loose)


@F.udtf(returnType=_CRAWLED)
class ArchivedPictures:
    """Table function over an archived page's markup and URL."""

    def eval(self, page: str, page_url: str, loose: bool = False):
        yield from archived_pictures(page, page_url or "", loose)


def dimensions(data: bytes | None) -> tuple[int | None, int | None, str | None]:
    """Width, height and format from the header of a PNG, GIF, JPEG or WebP file; nulls for anything else."""
    none = None, None, None
    if not data or len(data) < 12:
        return none
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return (*struct.unpack(">II", data[16:24]), "png") if len(data) >= 24 else none
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return *struct.unpack("<HH", data[6:10]), "gif"
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            kind = data[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h, "jpeg"
            at += 2 if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD8 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        return none
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        if data[12:16] == b"VP8 " and len(data) >= 30:
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF, "webp"
        if data[12:16] == b"VP8L" and len(data) >= 25:
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "webp"
        if data[12:16] == b"VP8X" and len(data) >= 30:
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1, "webp"
    return none


@F.pandas_udf(_struct(width=IntegerType(), height=IntegerType(), format=StringType()))
def image_size(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dimensions(x) for x in data], columns=["width", "height", "format"]).astype({"width": "Int32", "height": "Int32"})


def pixel_features(width: int | None, height: int | None, rgba: bytes | None) -> dict:
    """Shares of white, dark, vivid, grey and light pixels, sampled by stride, and what they suggest."""
    names = ("white", "dark", "vivid", "grey", "light", "colourful")
    out = dict.fromkeys(names, 0.0) | {"banner_like": False, "plan_like": False, "photo_like": False, "hard_reject": True, "reason": "unreadable"}
    if not width or not height or not rgba or len(rgba) < 4 * width * height:
        return out
    px = np.frombuffer(rgba, np.uint8, 4 * width * height).reshape(height, width, 4)[:: max(1, height // 96), :: max(1, width // 96)].reshape(-1, 4)
    rgb = px[px[:, 3] >= rules.TRANSPARENT, :3] / 255.0
    luma, high, low = rgb @ np.array([0.2126, 0.7152, 0.0722]), rgb.max(axis=1, initial=0), rgb.min(axis=1, initial=1)
    sat = np.divide(high - low, high, out=np.zeros_like(high), where=high > 0)
    n = max(1, len(rgb))
    r, g, b = rgb.T
    sums = (
        ((luma > rules.WHITE_LUMA) & (sat < rules.WHITE_SATURATION)).sum(), (luma < rules.DARK_LUMA).sum(), ((sat > rules.VIVID_SATURATION) & (luma > rules.VIVID_LUMA)).sum(),
        (sat < rules.GREY_SATURATION).sum(), ((luma > rules.LIGHT_LUMA) & (sat > rules.LIGHT_SATURATION)).sum(), (abs(r - g) + abs(g - b) + abs(b - r)).sum() / 3,
    )
    white, dark, vivid, grey, light, colourful = shares = [float(s) / n for s in sums]
    ratio, p = width / height, rules.PHOTO_PAIRS
    banner = ratio > rules.WIDE or ratio < rules.NARROW
    plan = white > rules.PLAN_WHITE and grey > rules.PLAN_GREY and vivid < rules.PLAN_VIVID and dark > rules.PLAN_DARK and not banner
    photo = (vivid > p["vivid"] and white < p["not_white"]) or (colourful > p["colourful"] and light > p["light"]) or (white < p["little_white"] and vivid > p["some_vivid"])
    small = width < rules.LEAST_PIXELS[0] or height < rules.LEAST_PIXELS[1]
    reason = "small" if small else "banner" if banner else "photo" if photo and not plan else ""
    rounded = {k: float(np.floor(v * 10000 + 0.5) / 10000) for k, v in zip(names, shares)}
    return out | rounded | {"banner_like": banner, "plan_like": plan, "photo_like": photo, "hard_reject": bool(reason), "reason": reason}


@F.pandas_udf(_FEATURES)
def byte_features(width: pd.Series, height: pd.Series, rgba: pd.Series) -> pd.DataFrame:
    known = lambda x: None if pd.isna(x) else int(x)
    return pd.DataFrame([pixel_features(known(w), known(h), b) for w, h, b in zip(width, height, rgba)])
