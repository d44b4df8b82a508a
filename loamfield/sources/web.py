"""Web pages and delimited text as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: href of a link, in double quotes, single quotes or none; tags and attributes in any case.
LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
HEADING = r"(?s)<h[1-6][^>]*>(.*?)</h[1-6]>"
TAG = r"<[^>]*>"


def href(value: Column) -> Column:
    """What stands in an attribute, without its quotes."""
    return F.trim(F.regexp_replace(value, "^[\"']|[\"']$", ""))


def bare_url(url: Column) -> Column:
    """Without its fragment and final slashes."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def links(pages: DataFrame) -> DataFrame:
    """page_id, target, n: links of each page, without fragments and final slashes."""
    got = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("t"))
    target = bare_url(href(F.col("t")))
    return got.select("page_id", target.alias("target")).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


def headings(pages: DataFrame) -> DataFrame:
    """page_id, place (from 0), heading without tags."""
    got = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(HEADING), F.lit(1))).alias("place", "h"))
    return got.select("page_id", "place", F.trim(F.regexp_replace("h", TAG, "")).alias("heading"))


def row_text(df: DataFrame) -> Column:
    """A row as ``name: value | name: value``."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns])


def files(spark, path: str, extensions: list[str] | None = None) -> DataFrame:
    """path, etag, length, content of files below a folder on any store; extensions compare without case."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if extensions and extensions != ["*"]:
        df = df.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([e.lower() for e in extensions]))
    return df.select("path", F.concat_ws(":", F.unix_micros("modificationTime"), "length").alias("etag"), "length", "content")
