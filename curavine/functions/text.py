"""Text functions. All stay in the JVM; null inputs count as empty unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, make) -> Column:
    """make(value), where value is computed once however often make uses it.

    A column that an expression names several times is otherwise written out, and computed, as often.
    """
    return F.transform(F.array(value), make)[0]


def text(x: Column | str) -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit(""))


def first_filled(*cols: Column | str) -> Column:
    """The first value that is neither null nor an empty string, else null."""
    return F.coalesce(*(F.nullif(_c(c).cast("string"), F.lit("")) for c in cols))


def collapse_space(x: Column | str) -> Column:
    """Runs of white space, the ideographic and no-break spaces among it, become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text(x), r"(?U)[\s﻿]+", " "))


#: Character references and what they stand for, in the order of replacement.
REFERENCES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]


def decode_references(x: Column | str) -> Column:
    out = text(x)
    for name, char in REFERENCES:
        out = F.regexp_replace(out, f"(?i){name}", char.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def strip_tags(x: Column | str) -> Column:
    return F.regexp_replace(text(x), "<[^>]+>", " ")


def strip_html(x: Column | str) -> Column:
    """Plain text of markup: scripts, styles and tags become spaces, references are decoded, space collapsed."""
    out = F.regexp_replace(text(x), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return collapse_space(decode_references(strip_tags(out)))


def tag_text(x: Column | str, tag: str) -> Column:
    """Plain text of the first element of this name; empty if there is none."""
    return strip_html(F.regexp_extract(text(x), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))


def meta_content(x: Column | str, name: str) -> Column:
    """content of the meta element of this name or property, with its attributes in either order."""
    q, body = "[\"']", "([^\"']*)"
    a = F.regexp_extract(text(x), rf"(?is)<meta[^>]+(?:name|property)={q}{name}{q}[^>]+content={q}{body}{q}", 1)
    b = F.regexp_extract(text(x), rf"(?is)<meta[^>]+content={q}{body}{q}[^>]+(?:name|property)={q}{name}{q}", 1)
    return F.trim(decode_references(F.when(a != "", a).otherwise(b)))


def attributes(tag: Column | str) -> Column:
    """Map of a tag's quoted attributes with lower-case names; of repeated ones the last counts."""
    pattern = r"([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    names = F.transform(F.regexp_extract_all(text(tag), F.lit(pattern), F.lit(1)), F.lower)
    values = F.transform(
        F.arrays_zip(F.regexp_extract_all(text(tag), F.lit(pattern), F.lit(2)).alias("a"), F.regexp_extract_all(text(tag), F.lit(pattern), F.lit(3)).alias("b")),
        lambda z: decode_references(F.concat(z["a"], z["b"])),
    )
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    # later attributes replace earlier ones of the same name
    kept = F.filter(pairs, lambda p, i: ~F.exists(F.slice(names, i + 2, F.size(names)), lambda n: n == p["k"]))
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(p["k"], p["v"])))


def srcset(x: Column | str) -> Column:
    """array<struct<url,size>> of a srcset, the widest first; a density counts a thousand for each 1x."""
    parts = F.filter(F.transform(F.split(text(x), r",\s+|,(?=https?:|/)"), lambda p: F.trim(p)), lambda p: p != "")

    def entry(p: Column) -> Column:
        size = F.regexp_extract(p, r"\s([0-9.]+)([wx])$", 1)
        factor = F.when(F.regexp_extract(p, r"\s([0-9.]+)([wx])$", 2) == "x", 1000.0).otherwise(1.0)
        return F.struct((-F.coalesce(size.try_cast("double") * factor, F.lit(0.0))).alias("order"), F.regexp_extract(p, r"^(\S+)", 1).alias("url"))

    return F.transform(F.array_sort(F.transform(parts, entry)), lambda e: F.struct(e["url"].alias("url"), (-e["order"]).alias("size")))


def links(x: Column | str) -> Column:
    """array<struct<href,anchor>> of a page's links, in page order."""
    pattern = F.lit(r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>")
    both = F.arrays_zip(F.regexp_extract_all(text(x), pattern, F.lit(1)).alias("h"), F.regexp_extract_all(text(x), pattern, F.lit(2)).alias("t"))
    return F.transform(both, lambda z: F.struct(F.trim(decode_references(z["h"])).alias("href"), collapse_space(decode_references(strip_tags(z["t"]))).alias("anchor")))


def pdf_links(x: Column | str) -> Column:
    """Distinct link targets whose path ends in .pdf."""
    found = F.regexp_extract_all(text(x), F.lit(r"(?i)href\s*=\s*[\"']([^\"']+\.pdf(?:[?#][^\"']*)?)[\"']"), F.lit(1))
    return F.array_distinct(F.transform(found, decode_references))


def contains_ci(x: Column | str, keyword: Column | str) -> Column:
    """Whether x holds the trimmed keyword, as it is, whatever the case; keyword is text, not a pattern."""
    word = F.lit(keyword.strip()) if isinstance(keyword, str) else F.trim(keyword)
    return F.contains(F.lower(text(x)), F.lower(word))


def snippet(x: Column | str, length: int = 500) -> Column:
    return F.substring(collapse_space(x), 1, length)


def parse_tags(x: Column | str) -> Column:
    """Tags between commas (Latin or ideographic), line ends and number signs, trimmed, none empty."""
    return F.filter(F.transform(F.split(text(x), "[,\\n、#]+"), lambda t: collapse_space(t)), lambda t: t != "")


def join_tags(x: Column | str) -> Column:
    return F.array_join(_c(x), ", ")


def safe_filename(x: Column | str, length: int = 80) -> Column:
    """A title that can name a file: reserved characters become underscores."""
    return F.substring(collapse_space(F.regexp_replace(text(x), r'[\\/:*?"<>|]+', "_")), 1, length)


def area_to_tsubo(x: Column | str) -> Column:
    """Square metres in tsubo, to two places, halves up; null for null, zero and NaN."""
    area = _c(x).cast("double")
    return F.when((area != 0) & ~F.isnan(area), F.floor(area / F.lit(3.305785) * 100 + 0.5) / 100)


def ratio3(part: Column, whole: Column) -> Column:
    """part / whole to three places, halves up, in whole numbers; 0 where whole is 0."""
    return F.when(whole > 0, F.floor((2000 * part + whole) / (2 * F.nullif(whole, F.lit(0)))) / F.lit(1000.0)).otherwise(F.lit(0.0))


def grid(n: Column | str) -> Column:
    """struct<columns,rows> for n pictures on a printed page: at most three in a row."""
    n = F.greatest(_c(n), F.lit(1))
    columns = F.when(n <= 1, 1).when(n <= 4, 2).otherwise(3)
    return F.struct(columns.alias("columns"), F.ceil(n / columns).cast("int").alias("rows"))


def day(x: Column | str) -> Column:
    """Date of an ISO time as yyyy/MM/dd; empty where it isn't one."""
    return F.coalesce(F.date_format(F.try_to_timestamp(_c(x).cast("string")), "yyyy/MM/dd"), F.lit(""))


def grouped_number(x: Column | str, digits: int = 0) -> Column:
    return F.coalesce(F.format_number(_c(x).cast("double"), digits), F.lit(""))
