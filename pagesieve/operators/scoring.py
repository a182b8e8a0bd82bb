"""Relational counterparts of the scoring steps, over pages shredded by ``dom_nodes``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

POSITIVE = r"(?i)article|body|content|entry|hentry|main|page|pagination|post|text|blog|story"
NEGATIVE = (
    r"(?i)button|combx|comment|com-|contact|figure|foot|footer|footnote|form|input|masthead|media|meta|outbrain|promo|related|scroll|shoutbox"
    r"|sidebar|sponsor|shopping|tags|tool|widget"
)


def class_weight(*columns: str):
    """25 for a promising class or id, -25 for an unpromising one, summed."""
    total = F.lit(0)
    for c in columns:
        v = F.coalesce(F.col(c), F.lit(""))
        total = total + F.when(F.rlike(v, F.lit(POSITIVE)), 25).otherwise(0) - F.when(F.rlike(v, F.lit(NEGATIVE)), 25).otherwise(0)
    return total


def scored_candidates(nodes: DataFrame, min_text: int = 25) -> DataFrame:
    """(page_id, node_id, score): what paragraphs give to their parents (whole) and grandparents (half), by length and commas, less the share of links.

    ``nodes`` are read several times, so they are computed once and written first.
    """
    nodes = cut(nodes)
    p = nodes.where(F.col("tag").isin("p", "pre", "td") & (F.col("text_len") >= min_text)).select("page_id", F.col("parent_id").alias("up"), (2 + F.col("commas") + F.least(F.col("text_len") / 100, F.lit(3.0))).alias("gain"))
    parents = nodes.select("page_id", F.col("node_id").alias("up"), F.col("parent_id").alias("upper"))
    half = p.join(parents, ["page_id", "up"]).where("upper >= 0").select("page_id", F.col("upper").alias("up"), (F.col("gain") / 2).alias("gain"))
    gains = p.where("up >= 0").unionByName(half).groupBy("page_id", "up").agg(F.sum("gain").alias("gain"))
    tag = (
        F.when(F.col("tag").isin("div", "article"), 5)
        .when(F.col("tag").isin("pre", "td", "blockquote"), 3)
        .when(F.col("tag").isin("address", "ol", "ul", "dl", "dd", "dt", "li", "form", "aside"), -3)
        .when(F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "h6", "th", "header", "footer", "nav"), -5)
        .otherwise(0)
    )
    links = F.col("link_len") / F.greatest(F.col("text_len"), F.lit(1))
    return gains.join(nodes.withColumnRenamed("node_id", "up"), ["page_id", "up"]).select("page_id", F.col("up").alias("node_id"), "tag", ((F.col("gain") + class_weight("class_attr", "id_attr") + tag) * (1 - links)).alias("score"))


def best_candidates(scores: DataFrame) -> DataFrame:
    """The best-scored element of each page; of equal ones the first in the document."""
    best = scores.groupBy("page_id").agg(F.max(F.struct("score", (-F.col("node_id")).alias("first"), "tag")).alias("b"))
    return best.select("page_id", (-F.col("b.first")).alias("node_id"), F.col("b.tag").alias("tag"), F.col("b.score").alias("score"))


def element_link_stats(nodes: DataFrame) -> DataFrame:
    """(page_id, links, link_chars, short_links): anchors that have text, their characters, those under 10."""
    a = nodes.where((F.col("tag") == "a") & (F.col("text_len") > 0))
    return a.groupBy("page_id").agg(F.count("*").alias("links"), F.sum("text_len").cast("long").alias("link_chars"), F.count_if(F.col("text_len") < 10).alias("short_links"))
