"""Command line: ``python -m pagesieve.cli`` (or spark-submit). Modes: files, tables, URL lists, sitemaps, feeds, crawls, probes."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.pages import extract_pages, html_to_text
from .kernel.fallback import guess_language
from .kernel.options import FORMATS, Options, read_config
from .operators import extract_deduplicated
from .operators.crawl import crawl, without_blacklisted, without_found_domains
from .operators.discovery import find_feeds, find_sitemap_links
from .operators.lineage import cut
from .sources import fetch_pages, read_html_files, read_pages, read_url_list, register, write_documents, write_files, write_raw_pages

VERSION = "1.0"
#: Where earlier copies of pages are found.
ARCHIVE = "https://web.archive.org/web/20/"

SHORTHANDS = ("csv", "html", "json", "markdown", "xml", "xmltei")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagesieve", description="Clean text and metadata of web pages, at scale.")
    source = p.add_argument_group("input").add_mutually_exclusive_group()
    source.add_argument("--input-dir", help="directory of HTML files")
    source.add_argument("--input-table", help="Parquet table with url and html")
    source.add_argument("--input-file", help="file with one URL per line")
    source.add_argument("-u", "--url", help="one URL")
    mode = p.add_argument_group("discovery").add_mutually_exclusive_group()
    for name in ("feed", "sitemap", "crawl", "explore", "probe"):
        mode.add_argument(f"--{name}", action="store_true")
    p.add_argument("--blacklist", help="file of URLs to leave out")
    p.add_argument("--url-filter", nargs="+", default=[], help="keep URLs that hold one of these")
    p.add_argument("--list", action="store_true", help="print URLs instead of processing them")
    p.add_argument("--archived", action="store_true", help="ask an archive for pages that can't be fetched")
    p.add_argument("--parallel", type=int, help="partitions to fetch in")
    p.add_argument("-v", "--verbose", action="count", default=0, help="print a line about pages without text (-vv: about all)")
    p.add_argument("--version", action="version", version=f"%(prog)s {VERSION}")
    p.add_argument("--fixtures", help="JSON file of canned answers, instead of the network")
    out = p.add_argument_group("output")
    out.add_argument("-o", "--output-dir")
    out.add_argument("--backup-dir", help="compressed copy of the pages")
    out.add_argument("--files", action="store_true", help="one file for each document instead of a table")
    out.add_argument("--keep-dirs", action="store_true", help="one file for each document, named like its input file")
    out.add_argument("--output-format", choices=[f for f in FORMATS if f != "python"], default="txt")
    for name in SHORTHANDS:
        out.add_argument(f"--{name}", action="store_true", help=f"shorthand of --output-format {name}")
    how = p.add_argument_group("extraction")
    for name in ("fast", "precision", "recall", "formatting", "links", "images", "no-comments", "no-tables", "with-metadata", "only-with-metadata", "deduplicate", "validate-tei"):
        how.add_argument(f"--{name}", action="store_true")
    how.add_argument("--target-language")
    how.add_argument("--prune-xpath", nargs="+", default=[], help="elements to cut out of pages first")
    how.add_argument("--earliest-date")
    how.add_argument("--latest-date")
    how.add_argument("--config-file")
    p.add_argument("--rounds", type=int, default=10, help="rounds of a crawl")
    p.add_argument("--sleep-time", type=float, default=None)
    return p


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    args = parser().parse_args(argv)
    for name in SHORTHANDS:
        if getattr(args, name):
            args.output_format = name
    modes = [m for m in ("feed", "sitemap", "crawl", "explore", "probe") if getattr(args, m)]
    if modes and not (args.input_file or args.url):
        parser().error(f"--{modes[0]} needs --input-file or --url")
    if args.validate_tei and args.output_format != "xmltei":
        parser().error("--validate-tei goes with --output-format xmltei")
    if args.keep_dirs and not (args.input_dir and args.output_dir):
        parser().error("--keep-dirs goes with --input-dir and --output-dir")
    if args.files and not args.output_dir:
        parser().error("--files goes with --output-dir")
    if args.precision and args.recall:
        parser().error("choose one of --precision and --recall")
    return args


def options_of(args: argparse.Namespace) -> Options:
    return Options.of(
        output_format=args.output_format,
        favor_precision=args.precision,
        favor_recall=args.recall,
        include_formatting=args.formatting,
        fast=args.fast,
        include_comments=not args.no_comments,
        include_tables=not args.no_tables,
        include_links=args.links,
        include_images=args.images,
        with_metadata=args.with_metadata,
        only_with_metadata=args.only_with_metadata,
        deduplicate=args.deduplicate,
        target_language=args.target_language,
        tei_validation=args.validate_tei,
        prune_xpath=args.prune_xpath,
        date_extraction_params={k: v for k, v in (("earliest", args.earliest_date), ("latest", args.latest_date)) if v},
        **read_config(args.config_file),
    )


def exit_status(errors: int, total: int) -> int:
    """0 without errors, 126 if over 99 % failed, else 1."""
    return 0 if not total or not errors else 126 if errors / total > 0.99 else 1


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    register(spark)
    options = options_of(args)

    fixtures = None
    if args.fixtures:
        with open(args.fixtures, encoding="utf-8") as f:
            fixtures = f.read()

    def fetch(urls: DataFrame) -> DataFrame:
        found = fetch_pages(
            urls,
            partitions=args.parallel,
            fixtures=fixtures,
            sleep_time=args.sleep_time if args.sleep_time is not None else options.sleep_time,
            timeout=options.download_timeout,
            max_size=options.max_file_size,
            user_agents="\n".join(options.user_agents),
            cookie=options.cookie,
        )
        return found.where("html IS NOT NULL").select("url", "html")

    def live(urls: DataFrame) -> DataFrame:
        return fetch_pages(urls, partitions=args.parallel, fixtures=fixtures, method="HEAD", sleep_time=0, timeout=options.download_timeout).where("is_live").select("url")

    def crawled(start: DataFrame) -> DataFrame:
        return crawl(start, fetch, max_rounds=args.rounds, ask_robots=True, language=args.target_language, detect=guess_language if args.target_language else None, prune=args.prune_xpath).select("url")

    date_col = None
    if args.input_dir:
        pages = read_html_files(spark, args.input_dir).select(F.col("path").alias("url"), "html", "max_date")
        date_col = None if args.latest_date else "max_date"
    elif args.input_table:
        pages = read_pages(spark, args.input_table).select("url", "html")
    else:
        if args.input_file:
            urls = read_url_list(spark, args.input_file).select("url")
        elif args.url:
            urls = spark.createDataFrame([(args.url,)], "url string")
        else:
            pages = spark.createDataFrame([(None, sys.stdin.read())], "url string, html string")
            urls = None
        if urls is not None:
            bad = read_url_list(spark, args.blacklist).select("url") if args.blacklist else None
            urls = without_blacklisted(urls, bad, args.url_filter)
            if args.crawl:
                urls = crawled(urls)
            elif args.feed or args.sitemap or args.explore:
                found = []
                if args.feed or args.explore:
                    found.append(find_feeds(urls, fetch, language=args.target_language))
                if args.sitemap or args.explore:
                    found.append(find_sitemap_links(urls, fetch, language=args.target_language, live=live))
                links = found[0] if len(found) == 1 else found[0].unionByName(found[1])
                rest = without_found_domains(urls, links) if args.explore else None
                urls = links.select(F.col("link").alias("url")).distinct()
                if rest is not None:
                    urls = urls.unionByName(crawled(rest)).distinct()
                urls = without_blacklisted(urls, bad, args.url_filter)
            if args.list or args.crawl and not args.output_dir:
                for r in urls.orderBy("url").toLocalIterator():
                    print(r["url"])
                return 0
            pages = fetch(urls)
            if args.archived:
                pages = cut(pages)
                lost = urls.join(pages.select("url"), "url", "left_anti").select(F.concat(F.lit(ARCHIVE), "url").alias("url"))
                pages = pages.unionByName(fetch(lost).select(F.substr("url", F.lit(len(ARCHIVE) + 1)).alias("url"), "html"))
            if args.probe:
                text = html_to_text("html")
                for r in pages.where((F.length(text) > options.min_extracted_size) & F.rlike(text, F.lit(r"\p{L}"))).select("url").toLocalIterator():
                    print(r["url"])
                return 0
    if args.backup_dir:
        pages = cut(pages)
        write_raw_pages(pages, args.backup_dir)
    if options.dedup:
        found = extract_deduplicated(pages, options, key="url").select("url", "status", F.when(F.col("status") == "ok", F.col("output")).alias("output"), "text")
    else:
        found = extract_pages(pages, options, keep=("url",), fields=("status", "output", "text"), date_col=date_col)
    if args.verbose:
        found = cut(found)
        for r in found.where(F.lit(args.verbose > 1) | F.col("output").isNull()).select("url", "status").toLocalIterator():
            print(r["status"], r["url"], file=sys.stderr)
    if args.output_dir:
        found = cut(found)
        if args.files or args.keep_dirs:
            write_files(found, args.output_dir, args.output_format, source_col="url" if args.keep_dirs else None, root=args.input_dir or "").count()
        else:
            write_documents(found, args.output_dir, args.output_format)
        total, good = found.count(), found.where("status = 'ok'").count()
    else:
        total = good = 0
        for r in found.toLocalIterator():
            total += 1
            if r["output"] is not None:
                good += 1
                print(r["output"])
    return exit_status(total - good, total)


def main(argv: list[str] | None = None) -> int:
    args = parse(argv)
    spark = SparkSession.builder.appName("pagesieve").getOrCreate()
    return run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
