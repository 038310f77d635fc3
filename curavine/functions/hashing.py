"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, collapse_space, text
from .url import without_tracking


def stable_id(*parts: Column | str) -> Column:
    """SHA-256 of the parts that are filled, joined by |."""
    filled = F.filter(F.array(*(text(p) for p in parts)), lambda p: p != "")
    return F.sha2(F.array_join(filled, "|"), 256)


def weak_hash(image_url: Column | str, thumbnail_url: Column | str, alt: Column | str, title: Column | str) -> Column:
    """16 hex digits that tell pictures of the same place and text alike; empty parts keep their place."""
    joined = F.concat_ws("|", without_tracking(image_url), without_tracking(thumbnail_url), collapse_space(alt), collapse_space(title))
    return F.substring(F.sha2(joined, 256), 1, 16)


def short_sha1(x: Column | str, digits: int = 16) -> Column:
    return F.substring(F.sha1(text(x).cast("binary")), 1, digits)


def picture_id(image_url: Column | str, page_url: Column | str, pdf_url: Column | str, pdf_page: Column | str) -> Column:
    """Identifier of a picture found on a page or on a page of a document."""
    return stable_id(without_tracking(image_url), without_tracking(page_url), pdf_url, _c(pdf_page).cast("string"))
