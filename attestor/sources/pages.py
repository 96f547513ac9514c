"""Shredding pages, site maps and feeds with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content isn't text (fixed values).
SKIPPED = ("script", "style", "noscript", "svg", "canvas", "template", "form")


def page_text(html: Column) -> Column:
    """The text of a page: skipped elements, comments and tags removed, white space collapsed."""
    names = "|".join(SKIPPED)
    for pattern in (rf"(?is)<({names})\b[^>]*>.*?</({names})\s*>", "(?s)<!--.*?-->", "(?s)<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(F.regexp_replace(html, r"\s+", " "))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def headings(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1)), page_text)


def links(html: Column) -> Column:
    """The href of each anchor, in order."""
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*\bhref\s*=\s*\"([^\"]*)\""), F.lit(1))


def feed_links(html: Column) -> Column:
    """The href of each alternate link."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*\brel\s*=\s*\"alternate\"[^>]*>"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_extract(x, r"(?i)\bhref\s*=\s*\"([^\"]*)\"", 1))


def between(html: Column, start: str, end: str) -> Column:
    """What stands between the first match of start and the next match of end."""
    return F.regexp_extract(html, f"(?is){start}(.*?){end}", 1)


def _each(payload: Column, name: str) -> Column:
    return F.xpath(payload, F.lit(f"//*[local-name()='{name}']/text()"))


def shred_sitemap(df: DataFrame, payload: str) -> DataFrame:
    """A row (loc, lastmod) for each url of site-map payloads; name spaces don't matter."""
    p = F.col(payload)
    items = F.arrays_zip(_each(p, "loc").alias("loc"), _each(p, "lastmod").alias("lastmod"))
    return df.select("*", F.explode(items).alias("item")).select(*df.columns, "item.loc", "item.lastmod").drop(payload)


def shred_feed(df: DataFrame, payload: str) -> DataFrame:
    """A row (title, link, published) for each item of RSS or entry of Atom payloads, name spaces aside."""
    items = F.regexp_extract_all(F.col(payload), F.lit(r"(?is)<(?:\w+:)?(?:item|entry)\b[^>]*>.*?</(?:\w+:)?(?:item|entry)>"), F.lit(0))

    def field(name: str) -> Column:
        inner = F.regexp_extract("__item", rf"(?is)<(?:\w+:)?{name}\b[^>]*>(.*?)</(?:\w+:)?{name}>", 1)
        return F.nullif(F.trim(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), F.lit(""))

    href = F.nullif(F.regexp_extract("__item", r"(?is)<(?:\w+:)?link\b[^>]*\bhref\s*=\s*[\"']([^\"']*)", 1), F.lit(""))
    return df.withColumn("__item", F.explode(items)).select(*[c for c in df.columns if c != payload], field("title").alias("title"), F.coalesce(field("link"), href).alias("link"), F.coalesce(field("pubDate"), field("published"), field("updated")).alias("published"))
