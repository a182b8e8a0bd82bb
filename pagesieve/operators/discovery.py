"""Addresses of pages from feeds, sitemaps and robots files, in rounds of fetching.

A round is one job whatever the number of sites: what a site still has to ask for is a row, and what it needs no more is
taken out by anti joins. ``fetch`` turns a DataFrame (url) into one (url, html) of what could be fetched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import base_url, domain
from .lineage import cut

Fetch = Callable[[DataFrame], DataFrame]
#: Sitemaps that are read of one site, at most.
MAX_SITEMAPS = 10_000
#: Where news of a domain in a language are listed as a feed.
NEWS = "https://news.google.com/rss/search?q=site:{domain}&hl={language}&scoring=n&num=100"


def flat(rows: DataFrame, function: Callable[[dict], Iterable[tuple]], schema: str) -> DataFrame:
    """What ``function`` makes of each row, a dictionary: any number of rows of ``schema``."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [found for row in batch.to_pylist() for found in function(row)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], field.type) for i, field in enumerate(arrow)], schema=arrow)

    return rows.mapInArrow(kernel, schema)


def _fetched(wanted: DataFrame, fetch: Fetch, at: str) -> DataFrame:
    """``wanted`` with the ``html`` behind its column ``at``; each address is fetched once, and rows without an answer go."""
    pages = cut(fetch(wanted.select(F.col(at).alias("url")).distinct()).where("html IS NOT NULL").select(F.col("url").alias(at), "html").dropDuplicates([at]))
    return wanted.join(pages, at)


# ---- feeds ---------------------------------------------------------------------------------------------------------------------


def discover_feeds(pages: DataFrame, *, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(url, link): links that feeds among the pages list, resolved and filtered by the kernel."""

    def entries(row: dict) -> Iterator[tuple]:
        from ..kernel import urls as U
        from ..kernel.discovery import feed_links

        if row["html"] and row["url"]:
            for link in feed_links(row["html"], U.base_url(row["url"]), row["url"]):
                yield row["url"], link

    return flat(pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")), entries, "url string, link string")


def _narrowed(links: DataFrame) -> DataFrame:
    """Of an address below a site only links that hold it, and feeds of third parties; a homepage takes all."""
    below = F.length("url") > F.length("base") + 2
    return links.where(~below | F.contains("link", F.col("url")) | F.rlike("link", F.lit("feedburner|feedproxy")))


def find_feeds(start: DataFrame, fetch: Fetch, *, language: str | None = None, external: bool = False, news: str | None = NEWS, url_col: str = "url") -> DataFrame:
    """(url, link): pages that feeds list, for each address in ``start``.

    An address may be that of a feed, or of a page that names feeds. If it can't be fetched, the homepage of its site is asked
    instead. Of addresses without any link, ``news`` is asked for the domain, if a ``language`` is given. Null and invalid
    addresses give nothing.
    """
    # The address that was given, and the one to be asked in its place.
    sites = cut(start.select(F.col(url_col).alias("given")).where("given IS NOT NULL").distinct().select("given", F.col("given").alias("url"), base_url("given").alias("base")).where("base <> ''"))

    def told(row: dict) -> Iterator[tuple]:
        from ..kernel.discovery import feed_links, feeds_of_page

        links = feed_links(row["html"], row["base"], row["url"], external=external, language=language)
        for link in links or feeds_of_page(row["html"], row["base"], row["url"]):
            yield row["given"], row["url"], row["base"], link, not links

    def listed(row: dict) -> Iterator[tuple]:
        from ..kernel.discovery import feed_links

        for link in feed_links(row["html"], row["base"], row["url"], external=external, language=language):
            yield row["given"], row["url"], row["base"], link

    columns = "given string, url string, base string, link string"

    def asked(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(links, sites that could be fetched)"""
        pages = cut(_fetched(sites, fetch, "url"))
        found = cut(flat(pages, told, f"{columns}, is_feed boolean"))
        feeds = found.where("is_feed").select("given", "url", "base", F.col("link").alias("feed"))
        entries = flat(_fetched(feeds, fetch, "feed").select("given", "url", "base", "html"), listed, columns)
        return cut(found.where("NOT is_feed").drop("is_feed").withColumn("narrow", F.lit(False)).unionByName(entries.withColumn("narrow", F.lit(True)))), pages.select("given")

    links, reached = asked(sites)
    lost = sites.join(reached, "given", "left_anti").where(F.rtrim(F.col("url"), F.lit("/")) != F.col("base"))
    homes = cut(lost.select("given", F.col("base").alias("url"), "base"))
    if not homes.isEmpty():
        links = links.unionByName(asked(homes)[0])
    if news and language:
        before, after = news.replace("{language}", language).split("{domain}")
        feed = F.concat(F.lit(before), domain("base"), F.lit(after)).alias("feed")
        silent = cut(sites.join(links.select("given").distinct(), "given", "left_anti").select("given", "url", "base", feed))
        if not silent.isEmpty():
            more = flat(_fetched(silent, fetch, "feed").select("given", "url", "base", "html"), listed, columns)
            links = links.unionByName(more.withColumn("narrow", F.lit(True)))
    kept = links.where(~F.col("narrow")).unionByName(_narrowed(links.where("narrow")))
    return kept.select(F.col("given").alias("url"), "link").distinct()


# ---- sitemaps ------------------------------------------------------------------------------------------------------------------


def _walk(todo: DataFrame, fetch: Fetch, language: str | None, external: bool, max_sitemaps: int) -> DataFrame:
    """(given, base, map, link): pages listed by the sitemaps in ``todo`` (given, base, map) and by all that are nested in them.

    Goes on until no new sitemap turns up or every site has had ``max_sitemaps``. Lineage is cut each round, and one flag a round reaches the driver.
    """

    def entries(row: dict) -> Iterator[tuple]:
        from ..kernel.discovery import sitemap_links

        for nested, links in enumerate(sitemap_links(row["map"], row["html"], row["base"], external=external, language=language)):
            for link in links:
                yield row["given"], row["base"], row["map"], link, bool(nested)

    seen, found = None, None
    todo = cut(todo.distinct())
    while not todo.isEmpty():
        seen = todo if seen is None else cut(seen.unionByName(todo))
        listed = cut(flat(_fetched(todo, fetch, "map").select("given", "base", "map", "html"), entries, "given string, base string, map string, link string, nested boolean"))
        pages = listed.where("NOT nested").drop("nested")
        found = pages if found is None else found.unionByName(pages)
        new = listed.where("nested").select("given", "base", F.col("link").alias("map")).distinct().join(seen, ["given", "base", "map"], "left_anti")
        had = seen.groupBy("given").agg(F.count("*").alias("had"))
        at = F.row_number().over(Window.partitionBy("given").orderBy("map"))
        todo = cut(new.join(had, "given").withColumn("at", at).where(F.col("at") + F.col("had") <= max_sitemaps).select("given", "base", "map"))
    return found if found is not None else todo.select("given", "base", "map", F.col("map").alias("link")).limit(0)


def discover_sitemaps(start: DataFrame, fetch: Fetch, *, language: str | None = None, external: bool = False, max_sitemaps: int = MAX_SITEMAPS) -> DataFrame:
    """(url, link): pages listed by the sitemaps in ``start`` (url) and by those nested in them, with the sitemap that lists them."""
    todo = start.select(F.col("url").alias("map")).where("map IS NOT NULL").select(base_url("map").alias("given"), base_url("map").alias("base"), "map").where("base <> ''")
    return _walk(todo, fetch, language, external, max_sitemaps).select(F.col("map").alias("url"), "link").distinct()


def robots_files(bases: DataFrame, fetch: Fetch) -> DataFrame:
    """(base, html): robots files of the sites in ``bases`` (base), as far as they have one."""
    asked = bases.select("base").distinct().withColumn("robots", F.concat("base", F.lit("/robots.txt")))
    return _fetched(asked, fetch, "robots").select("base", "html")


def find_sitemap_links(start: DataFrame, fetch: Fetch, *, language: str | None = None, external: bool = False, max_sitemaps: int = MAX_SITEMAPS, live: Callable[[DataFrame], DataFrame] | None = None, url_col: str = "url") -> DataFrame:
    """(url, link): pages that sitemaps list, for each address in ``start``.

    An address that looks like a sitemap is read as one. For any other one the site's robots file names the sitemaps, or else the usual
    places are tried; of an address below a site only links that hold it are kept. With ``live``, which tells the reachable ones of
    some addresses (url), sites that don't answer are left out.
    """
    from ..kernel.discovery import SITEMAP_GUESSES

    sites = cut(start.select(F.col(url_col).alias("given")).where("given IS NOT NULL").distinct().select("given", base_url("given").alias("base")).where("base <> ''"))
    if live is not None:
        sites = cut(sites.join(live(sites.select(F.col("base").alias("url")).distinct()).select(F.col("url").alias("base")).distinct(), "base", "left_semi"))
    is_map = F.rlike("given", F.lit(r"(?:\.gz|sitemap|\.xml)$"))

    def named(row: dict) -> Iterator[tuple]:
        from ..kernel.discovery import robots_sitemaps

        for link in robots_sitemaps(row["html"], row["base"]):
            yield row["base"], link

    told = cut(flat(robots_files(sites.where(~is_map), fetch), named, "base string, map string"))
    silent = sites.where(~is_map).join(told.select("base").distinct(), "base", "left_anti")
    guesses = silent.select("given", "base", F.explode(F.array(*[F.concat("base", F.lit(f"/{g}")) for g in SITEMAP_GUESSES])).alias("map"))
    todo = sites.where(is_map).select("given", "base", F.col("given").alias("map")).unionByName(sites.where(~is_map).join(told, "base").select("given", "base", "map")).unionByName(guesses)
    links = _walk(todo, fetch, language, external, max_sitemaps).withColumn("url", F.col("given"))
    given_map = F.rlike("given", F.lit(r"(?:\.gz|sitemap|\.xml)$"))
    kept = links.where(given_map).unionByName(_narrowed(links.where(~given_map)))
    return kept.select("url", "link").distinct()


# ---- robots --------------------------------------------------------------------------------------------------------------------

RULES = "base string, rules array<struct<path:string,allow:boolean>>, delay double"


def robots_rules(robots: DataFrame) -> DataFrame:
    """(base, rules, delay) of robots files (base, html): what holds for any robot, in the order of the file, and the seconds between fetches."""

    def parsed(row: dict) -> Iterator[tuple]:
        from ..kernel.discovery import robots_rules as parse

        rules = parse(row["html"], f"{row['base']}/robots.txt")
        if rules is not None:
            lines = rules.default_entry.rulelines if rules.default_entry else []
            delay = rules.crawl_delay("*")
            yield row["base"], [{"path": line.path, "allow": line.allowance} for line in lines], None if delay is None else float(delay)

    return flat(robots, parsed, RULES)


def site_rules(start: DataFrame, fetch: Fetch, *, url_col: str = "url") -> DataFrame:
    """The rules of the sites of all addresses in ``start``, from their robots files."""
    return cut(robots_rules(robots_files(start.select(base_url(url_col).alias("base")).where("base <> ''"), fetch)))


def allowed_by(rules: Column, url: Column) -> Column:
    """Whether the first of ``rules`` that fits the address allows it; without one it is allowed."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^#]*)", 1)
    fitting = F.filter(rules, lambda r: (r["path"] == "*") | F.startswith(path, r["path"]))
    return F.coalesce(F.get(fitting, F.lit(0))["allow"], F.lit(True))
