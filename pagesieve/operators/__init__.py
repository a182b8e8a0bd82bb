"""Operators across documents: relational steps over pages, blocks and links."""

from .blocks import adjacent_repeats, document_copies, explode_blocks, numbered, repeated_segments, without_adjacent_repeats, without_copies, without_repeated_segments
from .crawl import crawl, fetch_rounds, followed_redirects, frontier_step, host_counts, without_blacklisted, without_found_domains
from .discovery import discover_feeds, discover_sitemaps, find_feeds, find_sitemap_links, robots_files, robots_rules, site_rules
from .evaluation import confusion, segment_hits
from .lineage import cut
from .pages import extract_deduplicated
from .scoring import best_candidates, element_link_stats, scored_candidates

__all__ = [
    "adjacent_repeats", "best_candidates", "confusion", "crawl", "cut", "discover_feeds", "discover_sitemaps", "document_copies", "element_link_stats", "explode_blocks", "extract_deduplicated",
    "fetch_rounds", "find_feeds", "find_sitemap_links", "followed_redirects", "frontier_step", "host_counts", "numbered", "repeated_segments", "robots_files", "robots_rules", "scored_candidates", "segment_hits", "site_rules", "without_adjacent_repeats", "without_blacklisted",
    "without_copies", "without_found_domains", "without_repeated_segments",
]
