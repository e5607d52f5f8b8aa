"""Web pages: main text, result lists, caches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import text as X

#: Elements without running text, and elements that end a line.
SKIPPED = {"script", "style", "noscript", "svg", "canvas", "nav", "footer", "header"}
BLOCKS = {"p", "div", "section", "article", "li", "h1", "h2", "h3", "tr"}


class Reader(HTMLParser):
    """Collects running text; what is inside skipped elements is left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in SKIPPED
        if tag in BLOCKS and not self.depth:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.depth = max(0, self.depth - 1)
        elif tag in BLOCKS and not self.depth:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


@F.pandas_udf(T.StringType())
def main_text(pages: pd.Series) -> pd.Series:
    """Running text of HTML pages, one line per block; null for null."""

    def read(html):
        if html is None:
            return None
        reader = Reader()
        reader.feed(html)
        lines = (" ".join(x.split()) for x in "".join(reader.parts).split("\n"))
        return "\n".join(x for x in lines if x)

    return pages.map(read, na_action="ignore")


def page_title(html: str | Column) -> Column:
    """The first title element, collapsed; null if there is none."""
    found = X.strip_tags(F.regexp_extract(X.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(found != "", found)


def charset(content_type: Column, head: Column) -> Column:
    """The encoding named by the header, else by a meta tag, else utf-8."""
    named = [F.lower(F.regexp_extract(c, r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", 1)) for c in (content_type, head)]
    return F.coalesce(*[F.when(n != "", n) for n in named], F.lit("utf-8"))


def results(pages: DataFrame, html: str, limit: int = 10) -> DataFrame:
    """Adds place, url, title of the links of result pages: unwrapped, without noise, each canonical address once per page, at most ``limit`` (a report's length)."""
    link = r"(?is)<a\s[^>]*?href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(link), F.lit(1)).alias("url"), F.regexp_extract_all(html, F.lit(link), F.lit(2)).alias("title"))
    rows = pages.withColumn("page", F.monotonically_increasing_id()).select("*", F.posexplode(pairs).alias("pos", "link"))
    rows = rows.withColumn("url", X.unwrap_url("link.url")).withColumn("title", X.strip_tags("link.title")).where(~X.is_noise_url("url") & (F.col("title") != ""))
    first = rows.withColumn("key", X.canonical_url("url")).groupBy("page", "key").agg(F.min_by(F.struct("pos", "url", "title"), "pos").alias("x"))
    best = first.groupBy("page").agg(F.slice(F.array_sort(F.collect_list("x")), 1, limit).alias("x"))
    return best.select("page", F.posexplode("x").alias("place", "r")).select("page", (F.col("place") + 1).alias("place"), "r.url", "r.title")


def cached(keys: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Adds value and hit: what the cache (key, value, stored_at) holds under the hash of ``key``, if it is young enough; a ttl of 0 turns it off."""
    fresh = cache.where((F.unix_micros(now) - F.unix_micros("stored_at") <= ttl_seconds * 1_000_000) & (F.lit(ttl_seconds) > 0))
    newest = fresh.groupBy(F.sha2("key", 256).alias("h")).agg(F.max_by("value", "stored_at").alias("value"))
    return keys.withColumn("h", F.sha2("key", 256)).join(newest, "h", "left").withColumn("hit", F.col("value").isNotNull()).drop("h")
