"""Names of elements, attribute values and patterns by which parts of a page are told apart."""

from __future__ import annotations

import re
from collections.abc import Callable

from .dom import Node

# ---- fixed values: element names ------------------------------------------------------------------------------------

EMPTY_CUT = frozenset("article b blockquote dd div dt em h1 h2 h3 h4 h5 h6 i li main p pre q section span strong".split())
CLEANED = tuple(
    """aside embed fencedframe footer form head iframe menu object script
    applet audio canvas figure map picture svg video
    area blink button datalist dialog frame frameset fieldset link input ins label legend marquee math menuitem nav noindex
    noscript optgroup option output param progress rp rt rtc select source style track textarea time use""".split()
)
STRIPPED = tuple("abbr acronym address bdi bdo big cite data dfn font hgroup img ins mark meta nobr ruby small tbody template tfoot thead".split())
IMAGE_HOLDERS = frozenset(("figure", "picture", "source"))
REND = {"em": "#i", "i": "#i", "b": "#b", "strong": "#b", "u": "#u", "kbd": "#t", "samp": "#t", "tt": "#t", "var": "#t", "sub": "#sub", "sup": "#sup"}
HTML_OF_REND = {"#i": "i", "#b": "strong", "#u": "u", "#t": "var", "#sub": "sub", "#sup": "sup"}
BLOCKS_OF_TEXT = frozenset(
    """address article aside blockquote br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav
    ol p pre section summary table td th tr ul""".split()
)
TEXT_TAGS = frozenset("blockquote code del head hi lb list p pre quote".split())
CODE_SIGNS = ("{", '("', "('", "\n    ")

# ---- fixed values: thresholds ---------------------------------------------------------------------------------------

MIN_DUPLICATE_LENGTH, DEDUPE_SCAN_CAP, LINK_FARM_RATIO, MAX_SPAN = 50, 200_000, 0.9, 100
ESCALATION_MAX_LENGTH, ESCALATION_PAGE_SHARE, ESCALATION_ACCEPT, ESCALATION_STOPWORDS, STOPWORD_OVERRIDE = 3000, 0.2, 1.5, 2.0, 3

# ---- fixed values: tokens of id and class -----------------------------------------------------------------------------

ARTICLE_ID = re.compile("(?:entry|article|art)-content|article__content|article(?:-|__)?body|articleBody|body-text")
ARTICLE_CLASS = re.compile(
    "post[-_]text|post-body|post-?entry|post[-_]?content|postContent|post_inner_wrapper|article-?text|articleText"
    "|(?:entry|page|text|article|art)-content|article__content|article(?:-|__)?body|articleBody|ArticleContent|body-text|article__container"
)
STORY_ID = re.compile("^primary|story-body")
STORY_CLASS = re.compile(
    "^article |post-bodycopy|story-?content|(?:theme|blog|section|single)-content|single-post|main-column|wpb_text_column|story-body|field-body"
)
MAIN_ID = re.compile("content-main|content-body|contentBody")
MAIN_CLASS = re.compile("content[-_]main|content(?:-|__)body")
DISCARD_BOTH = "^shar|social|viral|newsletter|syndication|tags|sidebar|banner|bread-?crumb|button|author"
DISCARD_ID = re.compile(
    DISCARD_BOTH + "|^(?:jp-|dpsp-content)|bmdh|footer|Footer|share|Share|nav|Nav|menu|related|message-container|premium"
)
DISCARD_CLASS = re.compile(
    DISCARD_BOTH
    + "|^(?:nav|post-nav|ZendeskForm)|subnav|avigation|navbar|navbox|menu|bar"
    + "| ad |-ad-|outbrain|taboola|criteo|paid-?content|widget|footer|Footer|byline|Byline"
    + "|share-|sociable|embedded|embed|tag-list|consent|modal-content|permission|elated|next-|-stories|most-popular"
    + "|meta|rating|attachment|timestamp|user-info|user-profile|-icon|article-infos|message-container|slide|viewport|overlay"
    + "|options|expand|obfuscated|blurred|mol-factbox|yin|zlylin|nfoline"
)
HIDDEN_CLASS = re.compile("^hide-|comments-title|nocomments|-reply-|message|akismet|suggest-links|-hide-|hide-print| hidden| hide|noprint|notloaded")
COMMENTS_ID = re.compile("^(?:[Cc]omment|comol|disqus_thread|dsq-comments)")
COMMENTS_CLASS = re.compile("^[Cc]omment|(?:article|post)-comments")
APPENDED = re.compile("mvp-post-add-(?:box|wrap)|infinite-?scroll")
COOKIE_BANNER = re.compile(
    r"cookie[-_]?(?:banner|bar|consent|law|notice|policy|description)|notice[-_]{0,2}cookie|consent[-_]?(?:banner|manager|sdk)"
    r"|borlabs|cookiebot|cmplz|onetrust|moove[-_]?gdpr",
    re.IGNORECASE,
)

# ---- tests of nodes, made of the values above -------------------------------------------------------------------------

Test = Callable[[Node], bool]
DISCARDABLE = frozenset(("div", "item", "list", "p", "section", "span"))
CONTAINERS = frozenset(("article", "div", "main", "section"))


def first_of(node: Node, *names: str) -> str:
    """The value of the attribute among ``names`` that stands first in the source."""
    return next((v for k, v in node.attrs.items() if k in names), "")


def _article(n: Node) -> bool:
    cls, ident = n.get("class"), n.get("id")
    return cls in ("post", "entry") or n.get("itemprop") == "articleBody" or ident == "articleContent" or bool(ARTICLE_ID.search(ident) or ARTICLE_CLASS.search(cls))


def _story(n: Node) -> bool:
    cls, ident = n.get("class"), n.get("id")
    return (
        n.get("role") == "article"
        or ident in ("article", "story")
        or cls in ("postarea", "art-postcontent", "text", "cell", "story")
        or "fulltext" in cls.lower()
        or bool(STORY_ID.search(ident) or STORY_CLASS.search(cls))
    )


def _content(n: Node) -> bool:
    cls, ident = n.get("class"), n.get("id")
    return (
        "content" in (cls, ident)
        or bool(MAIN_ID.search(ident) or MAIN_CLASS.search(cls))
        or "main-content" in ident.replace("C", "c").replace("M", "m")
        or "main-content" in cls.replace("C", "c").replace("M", "m")
        or "page-content" in cls.replace("C", "c").replace("P", "p")
    )


#: Tests of the container that holds the main text, from the surest on; the first node in the document that passes is taken.
BODY_LADDER: tuple[Test, ...] = (
    lambda n: n.tag in CONTAINERS and _article(n),
    lambda n: n.tag == "article",
    lambda n: n.tag in CONTAINERS and _story(n),
    lambda n: n.tag in CONTAINERS and _content(n),
    lambda n: n.tag == "main" or n.tag in ("article", "div", "section") and any(n.get(a).startswith("main") for a in ("class", "id", "role")),
)
COMMENT_LADDER: tuple[Test, ...] = (
    lambda n: n.tag in ("div", "list", "section") and bool(re.search("comment-?list", first_of(n, "id", "class")) or re.search("comment-page|comments-content|post-comments", n.get("class"))),
    lambda n: n.tag in ("div", "list", "section") and bool(re.search("^comment[s-]", first_of(n, "id", "class")) or re.search("^Comments|article-comments", n.get("class"))),
    lambda n: n.tag in ("div", "list", "section") and bool(re.search("^(?:comol|disqus_thread|dsq-comments)", n.get("id"))),
    lambda n: n.tag in ("div", "section") and (n.get("id").startswith("social") or "comment" in n.get("class")),
)


def is_comments(n: Node) -> bool:
    return n.tag in ("div", "list", "section", "details") and bool(COMMENTS_ID.search(n.get("id")) or COMMENTS_CLASS.search(n.get("class")))


def is_appended(n: Node) -> bool:
    return n.tag in ("div", "section", "aside") and bool(APPENDED.search(n.get("id")) or APPENDED.search(n.get("class")))


def is_boilerplate(n: Node) -> bool:
    return n.tag in DISCARDABLE and bool(n.attrs) and (
        "data-lp-replacement-content" in n.attrs
        or "nav" in n.get("role").replace("N", "n")
        or "MostPopularStories" in n.get("data-component")
        or "cookie" in first_of(n, "id", "class")
        or bool(DISCARD_ID.search(n.get("id")) or DISCARD_CLASS.search(n.get("class")))
    )


def is_hidden(n: Node) -> bool:
    if not n.attrs:
        return False
    style, ident, cls = n.get("style"), n.get("id"), n.get("class")
    return (
        cls == "comments-title"
        or first_of(n, "id", "class").startswith("reply-")
        or "hidden" in first_of(n, "id", "style")
        or "display:none" in style
        or "display: none" in style
        or bool(re.search("reader-comments|akismet", ident))
        or bool(HIDDEN_CLASS.search(cls))
        or n.get("aria-hidden") == "true"
    )


def is_teaser(n: Node) -> bool:
    return n.tag in DISCARDABLE and ("teaser" in n.get("id").replace("T", "t") or "teaser" in n.get("class").replace("T", "t"))


def is_imprecise(n: Node) -> bool:
    if n.tag == "header":
        return True
    first = first_of(n, "id", "class")
    return n.tag in DISCARDABLE and bool(re.search(r"(^|\s)bottom|bottom(\s|$)|(^|\s)link(\s|$)", first) or "border" in n.get("style"))


def is_caption(n: Node) -> bool:
    return n.tag in DISCARDABLE and ("caption" in n.get("id") or "caption" in n.get("class"))


def is_no_comment(n: Node) -> bool:
    return (
        n.tag in ("cite", "quote")
        or n.tag in ("div", "section")
        and n.get("id").startswith("respond")
        or n.get("class") == "comments-title"
        or "display:none" in n.get("style")
        or bool(re.search("comments-title|nocomments|-reply-|message|signin", n.get("class")) or re.search("^reply-|akismet", first_of(n, "id", "class")))
    )


def is_page_furniture(n: Node) -> bool:
    """What the simple extractors drop: margins, scripts, styles and consent banners."""
    return (
        n.tag in ("aside", "fencedframe", "footer", "script", "style", "svg", "template")
        or n.tag == "div"
        and "footer" in first_of(n, "class", "id")
        or bool(n.attrs)
        and bool(COOKIE_BANNER.search(n.get("class")) or COOKIE_BANNER.search(n.get("id")))
    )
