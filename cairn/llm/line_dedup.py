"""Line dedup by site-relative frequency (DataFrame functions only).

A line's ratio is the number of pages of its host that contain it over the host's
pages.  Lines above ``max_ratio`` are boilerplate and dropped from every page of
the host.  A line counts once a page and without surrounding spaces; blank lines
are kept.  A line must be on at least ``min_pages`` pages, two by default, since on a
host of few pages a single page is above any ratio.

Counting shuffles a 64-bit hash for each distinct line of a page, summed before
the shuffle, so a line that is on a third of all pages is one row a task.  Since a
page has its ratio's worth of lines, a host has at most (lines a page) /
``max_ratio`` boilerplate lines.  The lists are written to a small table, so that
Spark knows its size: below its broadcast threshold pages are filtered where they
are read, above it they are joined by host, where large hosts can be split.  Lines
are filtered inside the row; pages are never taken apart and put together again.

With ``unlike_pages`` copies prove nothing: a line counts once for each distinct text,
and only on pages of which lines above the ratio make up less than ``MOSTLY`` of the
characters.  Furniture stands beside content of a page's own; on a copy, exact or
near, most lines are repeated, however large its group.  For this, pages are counted
from a stored table of their lines' hashes and lengths.  A page that would lose all
its lines keeps its text.

Defined results: a null text stays null and counts as a page without lines; a
null host is a host; every input row is returned once, repeated rows too; an
empty table gives an empty result; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stored
from .runtime import fresh

MAX_RATIO = 0.03
MIN_PAGES = 2
#: Pages with so large a share of repeated lines are taken for copies.
MOSTLY = 0.25


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def boilerplate(pages: DataFrame, *, text: str = "text", host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, unlike_pages: bool = False) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines."""
    if unlike_pages:
        return _of_unlike_pages(pages, text, host, max_ratio, min_pages)
    slim = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = slim.groupBy("host").agg(F.count("*").alias("pages"))
    hashes = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col("text")), _trimmed), lambda x: x != ""), lambda x: F.xxhash64(x)))
    counted = slim.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    t = totals.select(F.col("host").alias("t_host"), "pages")
    common = counted.join(t, counted.host.eqNullSafe(t.t_host)).filter(F.col("n") > F.col("pages") * float(max_ratio))
    return common.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def _of_unlike_pages(pages: DataFrame, text: str, host: str, max_ratio: float, min_pages: int) -> DataFrame:
    stored = Stored(pages.sparkSession)
    lines = F.filter(F.transform(_lines(F.col(text)), _trimmed), lambda x: x != "")
    page = pages.select(F.col(host).alias("host"), F.xxhash64(text).alias("page"), F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).alias("size"))).alias("found"))
    distinct = stored.put(page.groupBy("host", "page").agg(F.first("found").alias("found")), "distinct-pages")
    totals = distinct.groupBy(F.col("host").alias("t_host")).agg(F.count("*").alias("pages"))

    def above(seen: DataFrame) -> DataFrame:
        counted = seen.select("host", F.explode(F.array_distinct("line")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
        common = counted.join(totals, counted.host.eqNullSafe(totals.t_host)).filter(F.col("n") > F.col("pages") * float(max_ratio))
        return common.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("lines"))

    repeated = stored.put(above(distinct.select("host", F.col("found.line").alias("line"))), "repeated").select(F.col("host").alias("r_host"), "lines")
    near = distinct.join(repeated, F.col("host").eqNullSafe(F.col("r_host")))
    again = F.filter("found", lambda x: F.array_contains(F.col("lines"), x["line"]))
    size = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda n, x: n + x["size"])
    own = near.withColumn("again", again).filter(size("again") < size("found") * MOSTLY)
    return above(own.select("host", F.col("again.line").alias("line")))


def drop_boilerplate(pages: DataFrame, *, text: str = "text", host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, unlike_pages: bool = False, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """The pages with boilerplate lines dropped from ``text``; the named counts are added if asked for."""
    found = boilerplate(pages, text=text, host=host, max_ratio=max_ratio, min_pages=min_pages, unlike_pages=unlike_pages)
    found = Stored(pages.sparkSession).put(found, "boilerplate")
    key, lines = fresh(pages, "boiler_host"), fresh(pages, "boiler_lines")
    found = found.select(F.col("host").alias(key), F.col("lines").alias(lines))
    joined = pages.join(found, F.col(host).eqNullSafe(F.col(key)), "left")
    parts = _lines(F.col(text))
    kept = F.filter(parts, lambda x: ~F.array_contains(F.col(lines), F.xxhash64(_trimmed(x))) | (_trimmed(x) == ""))
    has = F.col(lines).isNotNull() & F.col(text).isNotNull()
    if unlike_pages:
        has &= F.exists(kept, lambda x: _trimmed(x) != "")
    cleaned = F.when(has, F.array_join(kept, "\n")).otherwise(F.col(text))
    counts = []
    if n_lines:
        counts.append(F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("bigint").alias(n_lines))
    if n_dropped:
        counts.append(F.when(has, F.size(parts) - F.size(kept)).otherwise(0).cast("bigint").alias(n_dropped))
    return joined.select(*[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in pages.columns], *counts)
