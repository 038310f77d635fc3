"""Sitemaps and their indexes through Spark's XML reader: one row per url or sitemap element, however large a file is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.text import text
from ..functions.url import priority, priority_sitemap

_IMAGE = ArrayType(StructType([StructField("image:loc", StringType())]))
_URL = StructType([StructField("loc", StringType()), StructField("lastmod", StringType()), StructField("image:image", _IMAGE)])
_CHILD = StructType([StructField("loc", StringType()), StructField("lastmod", StringType())])


def _rows(reader, path: str, tag: str, schema: StructType) -> DataFrame:
    # attributes of loc make it a structure: its text is what counts, and so they are left out
    options = {"rowTag": tag, "excludeAttribute": True, "ignoreSurroundingSpaces": True, "mode": "PERMISSIVE"}
    return reader.format("xml").options(**options).schema(schema).load(path).withColumn("sitemap", F.col("_metadata.file_path"))


def _urls(rows: DataFrame) -> DataFrame:
    images = F.filter(F.transform("image:image", lambda i: F.trim(i["image:loc"])), lambda u: F.coalesce(u, F.lit("")) != "")
    none = F.array().cast("array<string>")
    return rows.select("sitemap", F.trim("loc").alias("loc"), F.nullif(F.trim("lastmod"), F.lit("")).alias("lastmod"), F.coalesce(images, none).alias("images")).where("loc <> ''")


def _children(rows: DataFrame) -> DataFrame:
    return rows.select("sitemap", F.trim("loc").alias("loc"), F.nullif(F.trim("lastmod"), F.lit("")).alias("lastmod")).where("loc <> ''")


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """(sitemap, loc, lastmod, images) of the url elements of sitemap files; sitemap is the file. Elements without a loc are left out."""
    return _urls(_rows(spark.read, path, "url", _URL))


def read_children(spark: SparkSession, path: str) -> DataFrame:
    """(sitemap, loc, lastmod) of the sitemap elements of index files."""
    return _children(_rows(spark.read, path, "sitemap", _CHILD))


def stream_urls(spark: SparkSession, path: str) -> DataFrame:
    """The rows of read_urls as files come in."""
    return _urls(_rows(spark.readStream, path, "url", _URL))


def first_children(children: DataFrame, index: str, order: Column | str, most: int = 20) -> DataFrame:
    """The sitemaps of an index that are worth reading, the first so many of each; the others don't count for the number.

    children has the columns loc and, to tell the indexes apart and to order their rows, index and order.
    """
    rows = children.where(priority_sitemap("loc"))
    rank = F.row_number().over(Window.partitionBy(index).orderBy(order))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def tree(children: DataFrame, urls: DataFrame, loc: str = "loc") -> DataFrame:
    """URLs of the children of an index: rows of urls (sitemap, loc, lastmod, images) whose sitemap is one of them.

    Each has its own lastmod, or else its child's. URLs count that are on the way to pages with plans, or show pictures.
    """
    own = children.select(F.col(loc).alias("sitemap"), F.col("lastmod").alias("__lastmod")).dropDuplicates(["sitemap"])
    rows = urls.join(own, "sitemap").withColumn("lastmod", F.coalesce("lastmod", "__lastmod")).drop("__lastmod")
    return rows.where(priority("loc") | (F.size("images") > 0))


def write_urls(rows: DataFrame, path: str, parts: str | None = None) -> None:
    """Rows (loc, lastmod, images) as sitemap files, one or more for each value of a column if one is given."""
    images = F.when(F.size("images") > 0, F.transform("images", lambda u: F.struct(u.alias("image:loc"))))
    out = rows.select(F.col("loc"), F.col("lastmod"), images.alias("image:image"), *([parts] if parts else []))
    writer = out.write.format("xml").options(rowTag="url", rootTag="urlset", validateName=False, declaration="version='1.0' encoding='UTF-8'")
    (writer.partitionBy(parts) if parts else writer).save(path)


def write_children(rows: DataFrame, path: str) -> None:
    """Rows (loc, lastmod) as an index file for each partition."""
    rows.select("loc", "lastmod").write.format("xml").options(rowTag="sitemap", rootTag="sitemapindex").save(path)


def in_text(body: Column | str) -> Column:
    """array<struct<loc,lastmod>> of the sitemap elements in a text, also where it isn't well-formed."""
    blocks = F.regexp_extract_all(text(body), F.lit(r"(?is)<sitemap\b.*?</sitemap>"), F.lit(0))
    one = lambda b, tag: F.trim(F.regexp_extract(b, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))
    found = F.transform(blocks, lambda b: F.struct(one(b, "loc").alias("loc"), F.nullif(one(b, "lastmod"), F.lit("")).alias("lastmod")))
    return F.filter(found, lambda c: c["loc"] != "")
