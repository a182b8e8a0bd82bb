"""URLs across pages: filters, politeness, crawl rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import domain, host, stripped_url
from ..functions.pages import page_links
from .blocks import numbered
from .discovery import Fetch, allowed_by, flat, site_rules
from .lineage import cut

MAX_KNOWN, MAX_SEEN = 100_000, 10


def without_blacklisted(urls: DataFrame, blacklist: DataFrame | None = None, filters: Sequence[str] = (), *, url_col: str = "url", blacklist_col: str = "url") -> DataFrame:
    """Distinct ``urls`` that are not on the blacklist (scheme and trailing slash aside) and hold one of ``filters``, if there are any.

    The join has no hint: Spark broadcasts a blacklist that its size statistics show to be small, and sorts a large one.
    """
    out = urls.where(F.col(url_col).isNotNull()).dropDuplicates([url_col])
    if filters:
        hit = F.lit(False)
        for f in filters:
            hit = hit | F.col(url_col).contains(f)
        out = out.where(hit)
    if blacklist is not None:
        bad = blacklist.select(stripped_url(blacklist_col).alias("__bad")).where("__bad IS NOT NULL").distinct()
        out = out.join(bad, stripped_url(url_col) == F.col("__bad"), "left_anti")
    return out


def host_counts(urls: DataFrame, *, url_col: str = "url") -> DataFrame:
    return urls.groupBy(host(url_col).alias("host")).agg(F.count("*").alias("urls"), F.countDistinct(url_col).alias("distinct_urls"))


def fetch_rounds(urls: DataFrame, *, url_col: str = "url", order_by: Sequence[str] = (), sleep_time: float = 5.0, rules: DataFrame | None = None) -> DataFrame:
    """``urls`` with ``round`` and ``not_before`` (seconds from the start): one URL per host and round, ``sleep_time`` apart, or as the site's ``rules`` ask.

    The URLs of a large host are numbered in as many tasks as they fill.
    """
    names = [*urls.columns, "host", "round"]
    out = numbered(urls.withColumn("host", host(url_col)), F.col("host"), tuple(order_by or (url_col,)), "round").withColumn("round", F.col("round") - 1).select(*names)
    pause = F.lit(float(sleep_time))
    if rules is None:
        return out.withColumn("not_before", F.col("round") * pause)
    delays = rules.where("delay IS NOT NULL").groupBy(host("base").alias("host")).agg(F.max("delay").alias("delay"))
    return out.join(delays, "host", "left").withColumn("not_before", F.col("round") * F.coalesce("delay", pause)).select(*names, "not_before")


def without_found_domains(inputs: DataFrame, found: DataFrame, *, url_col: str = "url") -> DataFrame:
    """Input URLs of domains for which nothing has been found yet."""
    done = found.select(domain(url_col).alias("__domain")).where("__domain IS NOT NULL").distinct()
    return inputs.join(done, domain(url_col) == F.col("__domain"), "left_anti")


NAVIGATION = r"(?i)/(?:archives?|auth[eo]r|blog|category|categories|kat|categoria|page|pages?|schlagwort|seite|tags?|themen?|thema|topics?|user)/|/page/[0-9]+|\?p=[0-9]+|\?page="
NOT_CRAWLABLE = r"(?i)/(?:login|signin|sign-in|signup|register|cart|checkout|wp-admin|wp-login)(?:\.php)?(?:/|$|\?)"


def frontier_step(frontier: DataFrame, pages: DataFrame, rules: DataFrame | None = None, *, language: str | None = None, detect=None, prune: Sequence[str] = ()) -> DataFrame:
    """The next frontier (url, base, reference, visited, depth, is_nav) after ``pages`` (url, html) were fetched.

    Links stay within their reference, are not known yet, and are allowed by ``rules`` (base, rules). With a ``language``, links that tell
    another one are left out, and so are those of pages that ``detect`` finds to be in another one; ``prune`` names what is cut out of pages first.
    """
    fetched = pages.select("url").distinct().withColumn("__fetched", F.lit(True))
    marked = frontier.join(fetched, "url", "left").withColumn("visited", F.col("visited") | F.coalesce("__fetched", F.lit(False))).drop("__fetched")
    found = page_links("html", "url", external=False, language=language, detect=detect, prune=tuple(prune))
    links = pages.join(frontier.select("url", "base", "reference", "depth"), "url").select("base", "reference", (F.col("depth") + 1).alias("depth"), F.explode(found).alias("url"))
    if rules is not None:
        links = links.join(rules.select("base", "rules"), "base", "left").where(allowed_by(F.col("rules"), F.col("url"))).drop("rules")
    new = (
        links.where(F.contains(F.col("url"), F.col("reference")) & ~F.rlike("url", F.lit(NOT_CRAWLABLE)))
        .groupBy("url")
        .agg(F.min("base").alias("base"), F.min("reference").alias("reference"), F.min("depth").alias("depth"))
        .join(frontier.select("url"), "url", "left_anti")
        .select("url", "base", "reference", F.lit(False).alias("visited"), "depth", F.rlike("url", F.lit(NAVIGATION)).alias("is_nav"))
    )
    return marked.select("url", "base", "reference", "visited", "depth", "is_nav").unionByName(new)


def followed_redirects(pages: DataFrame, fetch: Fetch) -> DataFrame:
    """(url, html, moved): pages with a refresh element become the page behind it, whose address is ``moved``; without an answer they go."""

    def target(row: dict):
        from ..kernel import urls as U
        from ..kernel.discovery import refresh_target

        yield row["url"], row["html"], refresh_target(row["html"], U.base_url(row["url"])) if row["html"] else None

    told = cut(flat(pages.select("url", "html"), target, "url string, html string, moved string"))
    away = told.where("moved IS NOT NULL").select("url", "moved")
    behind = fetch(away.select(F.col("moved").alias("url")).distinct()).where("html IS NOT NULL").select(F.col("url").alias("moved"), "html").dropDuplicates(["moved"])
    return told.where("moved IS NULL").unionByName(away.join(behind, "moved").select("url", "html", "moved"))


def crawl(
    start: DataFrame,
    fetch: Fetch,
    *,
    max_rounds: int = MAX_SEEN,
    per_host: int = 1,
    max_known: int = MAX_KNOWN,
    rules: DataFrame | None = None,
    ask_robots: bool = False,
    known: DataFrame | None = None,
    language: str | None = None,
    detect=None,
    prune: Sequence[str] = (),
) -> DataFrame:
    """The frontier after rounds of: pick ``per_host`` unvisited URLs of each site (navigation first), fetch, add their links.

    A site of which ``max_known`` URLs are known after a round gets no further one; the others go on. ``rules`` (base, rules) are those of
    robots files; with ``ask_robots`` the files are fetched. A start page that a refresh element moves is replaced by the one behind it, whose address joins the
    frontier. URLs in ``known`` count as visited. Null and invalid addresses are left out. Each round is written to the checkpoint folder.
    """
    if ask_robots and rules is None:
        rules = site_rules(start, fetch)
    reference = F.when(F.length("url") - F.length(F.replace("url", F.lit("/"), F.lit(""))) >= 3, F.regexp_replace("url", r"/[^/]*$", "")).otherwise(F.col("url"))
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    frontier = start.select("url").where("url IS NOT NULL").distinct().select("url", base.alias("base"), reference.alias("reference"), F.lit(False).alias("visited"), F.lit(0).alias("depth"), F.lit(False).alias("is_nav")).where("base <> ''")
    if known is not None:
        before = known.select("url").where("url IS NOT NULL").distinct()
        old = before.join(frontier.select("url"), "url", "left_anti").select("url", base.alias("base"), reference.alias("reference"), F.lit(True).alias("visited"), F.lit(0).alias("depth"), F.lit(False).alias("is_nav"))
        frontier = frontier.join(before, "url", "left_anti").unionByName(old).unionByName(frontier.join(before, "url", "left_semi").withColumn("visited", F.lit(True)))
    frontier = cut(frontier)
    going = None  # sites with URLs to visit and room for more
    for round_ in range(max_rounds):
        own = Window.partitionBy("base").orderBy(F.desc("is_nav"), "depth", "url")
        todo = frontier.where(~F.col("visited")).withColumn("__at", F.row_number().over(own)).where(F.col("__at") <= per_host).select("base", "url")
        todo = (todo if going is None else todo.join(going, "base", "left_semi")).select("url")
        fetched = cut(fetch(todo).where("html IS NOT NULL").select("url", "html"))  # read twice, fetched once
        if round_ == 0:
            followed = cut(followed_redirects(fetched, fetch))
            homes = followed.where("moved IS NOT NULL").join(frontier.select("url", "base", "reference"), "url").select(F.col("moved").alias("url"), "base", "reference").join(frontier.select("url"), "url", "left_anti").dropDuplicates(["url"])
            gone = fetched.join(followed.select("url"), "url", "left_anti").select("url", F.lit("").alias("html"))
            frontier = frontier.unionByName(homes.select("url", "base", "reference", F.lit(False).alias("visited"), F.lit(0).alias("depth"), F.lit(False).alias("is_nav")))
            fetched = followed.select("url", "html").unionByName(gone)
        frontier = cut(frontier_step(frontier, fetched, rules, language=language, detect=detect, prune=prune))
        going = frontier.groupBy("base").agg(F.count("*").alias("known"), F.count_if(~F.col("visited")).alias("left")).where((F.col("known") < max_known) & (F.col("left") > 0)).select("base")
        if going.isEmpty():
            break
    return frontier
