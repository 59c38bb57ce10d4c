"""Main text of web pages by page differencing between nearest URLs, with page structure.

Every page is paired with the page of the same host whose URL path is nearest (the
neighbour in path order with the longer common beginning).  Their text lines are aligned
by a longest common subsequence, and lines that both share are deleted: they belong to the
site, not to the page.

Structure corrects what differencing cannot see.  Lines in menus, headers, footers,
sidebars, notices, adverts and forms are dropped whether shared or not, since many sites
vary them by page; and lines inside an article element are kept even if the neighbour
holds them too, since articles quote each other.  Differencing decides all other lines, on
pages with and without an article element: those a page has for itself stay, so text that
follows a closed article is not lost.  Where a page has lines in marked regions only, as
when a marked element wraps all of it, the marks mean nothing and differencing decides
them too.  Reader comments always go.

Cases: null html has an empty text; pages without url are paired among themselves; the
only page of a host loses no shared lines, but if it has an article element that alone is
its text, as nothing tells which other lines are the site's; pages of a host with equal lines stand for each
other and are not paired, whatever their ids and urls; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logdistill.llm.common import numbered, stage
from logdistill.llm.markup import ARTICLE, AROUND, OTHER, blocks, common_lines

BETWEEN = "\n\n"
# Measured bytes of differences up to which they are broadcast to the pages.
DIFFERENCE_BYTES = 64 << 20


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def place_of(url: str | None) -> tuple[str, str]:
    """Host and path (with query) of a url; urls that cannot be split are all path."""
    if url is None:
        return "", ""
    try:
        parts = urlsplit(url)
        return (parts.hostname or "").lower(), parts.path + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        return "", url


def parsed(pages: DataFrame) -> DataFrame:
    """(key, page_id, url, host, path, lines, regions, hashes); ``key`` names host and lines."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                found = [blocks("" if h is None else h) for h in part["html"]]
                places = [place_of(u) for u in part["url"]]
                yield pd.DataFrame(
                    {
                        "page_id": part["page_id"], "url": part["url"],
                        "host": [h for h, _ in places], "path": [p for _, p in places],
                        "lines": [[t for t, _ in f] for f in found],
                        "regions": [[r for _, r in f] for f in found],
                        "hashes": [[line_hash(t) for t, _ in f] for f in found],
                    }
                )

    return pages.select(F.col("page_id").cast("string"), "url", "html").mapInPandas(
        parse,
        "page_id string, url string, host string, path string, lines array<string>, "
        "regions array<int>, hashes array<long>",
    ).withColumn("key", F.xxhash64("host", "hashes"))


def shared_lines(pages: DataFrame) -> DataFrame:
    """(key, shared): places of the lines that a page has in common with its nearest page.

    Pages of a host with equal lines are one, at the first of their paths, so the nearest
    page is never a copy.  Pages of a host are put in path order by distributed numbering, and neighbours meet in
    an equal join on that number, so a host of any size is spread over all tasks.
    """
    narrow = pages.groupBy("key").agg(
        F.first("host").alias("host"), F.min("path").alias("path"), F.first("hashes").alias("hashes")
    )
    ordered = numbered(narrow, ["host", "path", "key"], "at", "page-order")
    names = ["host", "path", "hashes"]
    before = ordered.select((F.col("at") + 1).alias("at"), *[F.col(n).alias(f"b_{n}") for n in names])
    behind = ordered.select((F.col("at") - 1).alias("at"), *[F.col(n).alias(f"n_{n}") for n in names])
    met = ordered.join(before, "at", "left").join(behind, "at", "left")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def closeness(path: str, other: str) -> int:
            n = 0
            while n < len(path) and n < len(other) and path[n] == other[n]:
                n += 1
            return n

        for batch in batches:
            keys, shared = [], []
            for r in batch.itertuples(index=False):
                near = [
                    (closeness(r.path, path), lines)
                    for host, path, lines in ((r.b_host, r.b_path, r.b_hashes), (r.n_host, r.n_path, r.n_hashes))
                    if host is not None and host == r.host
                ]
                if near:
                    other = max(near, key=lambda x: x[0])[1]
                    keys.append(r.key)
                    shared.append(common_lines(list(r.hashes), list(other)))
            yield pd.DataFrame({"key": pd.Series(keys, dtype="int64"), "shared": pd.Series(shared, dtype=object)})

    return met.mapInPandas(align, "key long, shared array<int>")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    read = stage(parsed(pages.select("page_id", "url", "html")), "parsed-pages")
    shared = shared_lines(read)
    article, other = F.array_contains("regions", ARTICLE), F.array_contains("regions", OTHER)
    # Pages of marked and article lines need no difference carried to them.
    open_pages = read.where((other | ~article) & (F.size("regions") > 0))
    decided = stage(shared.join(open_pages.select("key").distinct(), "key", "left_semi"), "shared-lines")
    size = decided.agg(F.sum(F.size("shared") * 4 + 40)).first()[0] or 0
    if size <= DIFFERENCE_BYTES:
        decided = F.broadcast(decided)
    differs = F.col("shared").isNotNull()

    def may_stay(place: Column) -> Column:
        region = F.get("regions", place)
        beside = (region == ARTICLE) | ((region == OTHER) & differs)
        return F.when(article, beside).when(other, region == OTHER).otherwise(region == AROUND)

    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("lines"), F.lit(1)) - 1), may_stay)
    shared_places = F.filter(
        F.coalesce("shared", F.array().cast("array<int>")), lambda i: F.get("regions", i) != ARTICLE
    )
    # Places differ, so a set difference by hash drops the shared ones whatever their number.
    kept = F.array_except(places, shared_places)
    text = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), BETWEEN)
    return (
        read.join(decided, "key", "left")
        .select(F.col("page_id").cast("long").alias("page_id"), "url", text.alias("text"))
        .withColumn("n_chars", F.char_length("text").cast("long"))
    )
