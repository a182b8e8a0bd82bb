"""From the page as parsed to the tree that the extractors read: cleaning, conversion, density tests."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import urljoin

from . import vocab as V
from .dom import Node, rebuilt, without
from .options import Options
from .text import is_image_name, trim


def with_formulas(tree: Node) -> Node:
    """MathML replaced by its LaTeX source between Markdown delimiters."""

    def change(n: Node, kids: list) -> list:
        if n.tag != "math":
            return [Node(n.tag, dict(n.attrs), kids)]
        notes = [a for a in n.below() if a.tag.rpartition(":")[2] == "annotation" and a.get("encoding") == "application/x-tex"]
        latex = trim(notes[0].lead if notes else n.get("alttext"))
        if not latex:
            return []
        return [f"\\[{latex}\\]" if n.get("display") == "block" else f"\\({latex}\\)"]

    return rebuilt(tree, change) if any(n.tag == "math" for n in tree.walk()) else tree


def _dropped(options: Options) -> set[str]:
    names = set(V.CLEANED if options.cleaned is None else options.cleaned)
    if not options.tables:
        names |= {"table", "td", "th", "tr"}
    if options.images:
        names -= V.IMAGE_HOLDERS
    return names


def cleaned(tree: Node, options: Options) -> Node:
    """The tree without navigation, scripts, media, widgets and the like, and without purely presentational elements."""
    tree = with_formulas(tree)
    drop, strip = _dropped(options), set(V.STRIPPED if options.stripped is None else options.stripped)
    if options.images:
        strip.discard("img")
    forms = "form" in drop
    drop.discard("form")

    def change(n: Node, kids: list) -> list:
        tag = n.tag
        if options.tables and (tag == "figure" and any(n.below("table")) or tag == "table" and n.get("role") in ("presentation", "none")):
            tag = "div"
        if tag in strip:
            return kids
        return [Node(tag, dict(n.attrs), kids)]

    plain = rebuilt(tree, change)
    out = without(plain, lambda n: n.tag in drop)
    if options.focus == "recall" and any(plain.below("p")) and not any(out.below("p")):
        out = plain
    if forms and any(out.below("form")):
        total = len(out.text())
        # a form around most of the page is a layout, not a widget
        layout = {id(f) for f in out.below("form") if total and len(f.text()) > total / 2}
        out = rebuilt(out, lambda n, kids: [Node("div" if id(n) in layout else n.tag, dict(n.attrs), kids)])
        out = without(out, lambda n: n.tag == "form")
    return without(out, lambda n: not n.kids and n.tag in V.EMPTY_CUT, keep_text_after=options.focus != "precision")


def _is_code(n: Node) -> bool:
    inner = n.nodes
    return (
        len(inner) == 1
        and inner[0].tag == "span"
        or any(s.get("class").startswith("hljs") for s in n.below("span"))
        or any(sign in n.lead for sign in V.CODE_SIGNS)
    )


def converted(tree: Node, options: Options, base: str | None = None) -> Node:
    """The tree in the vocabulary of the output: p, head, list, item, quote, code, hi, del, lb, ref, graphic, and tables as they are."""

    def change(n: Node, kids: list) -> list:
        tag = n.tag
        if tag == "a":
            if options.links:
                target = n.get("href")
                if target and base:
                    target = urljoin(base, target)
                ref = Node("ref", {"target": target} if target else {}, kids)
                return _images_out(ref) if options.images else [ref]
            return [Node("ref", {}, kids)] if n.inside("div", "li", "p", "table") else kids
        if tag in ("sub", "sup") and not kids:
            return []
        if tag == "strong" and "schema-faq-question" in n.get("class"):
            return [Node("head", {"rend": "h3"}, kids)]
        if tag in V.REND:
            return [Node("hi", {"rend": V.REND[tag]}, kids)] if options.formatting else kids
        if tag in ("ul", "ol", "dl"):
            return [Node("list", {**n.attrs, "rend": tag}, _numbered(kids) if tag == "dl" else kids)]
        if tag in ("li", "dt", "dd"):
            return [Node("item", {**n.attrs, **({"rend": tag} if tag != "li" else {})}, kids)]
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            return [Node("head", {"rend": tag}, kids)]
        if tag in ("br", "hr"):
            return [Node("lb"), *kids]
        if tag == "pre":
            for k in kids:  # names of highlighted tokens tell nothing about the page
                for span in k.walk() if not isinstance(k, str) else ():
                    if span.tag == "span" and span.get("class").startswith("hljs"):
                        span.attrs = {}
            return [Node("code" if _is_code(n) else "quote", dict(n.attrs), kids)]
        if tag in ("blockquote", "q"):
            return [Node("quote", dict(n.attrs), kids)]
        if tag in ("del", "s", "strike"):
            return [Node("del", {"rend": "overstrike"}, kids)]
        if tag == "details":
            return [Node("div", dict(n.attrs), kids)]
        if tag == "summary":
            return [Node("head" if n.inside("details") else tag, dict(n.attrs), kids)]
        if tag == "img":
            return [Node("graphic", dict(n.attrs))] if options.images else []
        return [Node(tag, dict(n.attrs), kids)]

    return rebuilt(tree, change)


def _images_out(ref: Node) -> list:
    """Images inside a link stand after it; a link that held nothing else goes."""
    images = [Node("graphic", dict(g.attrs)) for g in ref.below("graphic")]
    if not images:
        return [ref]
    rest = without(ref, lambda n: n.tag == "graphic")
    return [*([rest] if rest.text().strip() else []), *images]


def _numbered(kids: Iterable) -> list:
    """Terms and descriptions of a list get a common number."""
    at, out = 1, []
    for k in kids:
        if not isinstance(k, str):
            for item in k.walk():
                if item.tag == "item" and item.get("rend") in ("dt", "dd"):
                    kind = item.attrs["rend"]
                    item.attrs["rend"] = f"{kind}-{at}"
                    at += kind == "dd"
        out.append(k)
    return out


def with_backup(tree: Node, *tests: V.Test) -> Node:
    """The tree without the nodes that pass a test, unless that would leave a seventh of its text or less."""
    out = without(tree, lambda n: any(t(n) for t in tests))
    return out if len(out.text()) > len(tree.text()) / 7 else tree


# ---- link density -------------------------------------------------------------------------------------------------------


def link_stats(links: list[Node]) -> tuple[int, int, int, list[str]]:
    """(characters, number, number of short ones, texts) of links that have text."""
    texts = [t for t in (trim(x.text()) for x in links) if t]
    return sum(map(len, texts)), len(texts), sum(len(t) < 10 for t in texts), texts


def _is_listing(links: list[Node]) -> bool:
    return all(x.parent is not None and x.parent.tag == "p" and sum(1 for _ in x.parent.below("ref")) == 1 for x in links)


def mostly_links(n: Node, text: str, precise: bool = False) -> tuple[bool, list[str]]:
    """Whether links dominate a node whose trimmed text is ``text``, and the link texts when it is short but passes."""
    links = list(n.below("ref"))
    if not links or any(n.below("graphic")):
        return False, []
    if len(links) == 1:
        own = len(trim(links[0].text()))
        if own > (10 if precise else 100) and own > 0.9 * len(text):
            return True, []
    last = n.following() is None
    limit = (60 if last else 30) if n.tag == "p" else (300 if last else 100)
    if len(text) < limit:
        size, number, short, texts = link_stats(links)
        dominated = number == 0 or size > 0.8 * len(text) or number > 1 and short > 0.8 * number
        return dominated, texts
    if len(links) > 4:
        size, number, _, texts = link_stats(links)
        if size > V.LINK_FARM_RATIO * len(text) and size < 100 * number and not _is_listing(links):
            return True, texts
    return False, []


def table_of_links(n: Node) -> bool:
    links = list(n.below("ref"))
    size = len(trim(n.text()))
    return bool(links) and size >= 200 and link_stats(links)[0] > (0.8 if size < 1000 else 0.5) * size


def without_link_blocks(tree: Node, tag: str, short_too: bool = False, precise: bool = False) -> Node:
    """The tree without nodes of one tag that links dominate; with ``short_too`` also short ones that hold links in several parts."""
    doomed = set()
    for n in tree.below(tag):
        text = trim(n.text())
        dense, texts = mostly_links(n, text, precise)
        small = short_too and texts and 0 < len(text) < (200 if precise else 100) and len(n.nodes) >= (1 if precise else 3)
        if (dense or small) and not (tag == "p" and n.parent.tag in ("item", "td", "th")):
            doomed.add(id(n))
    return without(tree, lambda n: id(n) in doomed) if doomed else tree


def pruned(tree: Node, options: Options, *, images: bool, tables: bool, teasers: bool = False) -> Node:
    """A content container without its unwanted sections."""
    precise = options.focus == "precision"
    tree = with_backup(tree, V.is_boilerplate, V.is_hidden)
    tests = []
    if not images:
        tests.append(V.is_caption)
    if options.focus != "recall":
        if not teasers:
            tests.append(V.is_teaser)
        if precise:
            tests.append(V.is_imprecise)
    if tests:
        tree = without(tree, lambda n: any(t(n) for t in tests))
    for _ in range(2):
        for tag, short_too in (("div", True), ("list", False), ("p", False)):
            tree = without_link_blocks(tree, tag, short_too, precise)
    if tables or precise:
        tree = without(tree, lambda n: n.tag == "table" and table_of_links(n), keep_text_after=False)
    if precise:
        while tree.nodes and tree.nodes[-1].tag == "head":
            last = tree.nodes[-1]
            tree = Node(tree.tag, tree.attrs, tree.kids[: next(i for i, k in enumerate(tree.kids) if k is last)])
        tree = without_link_blocks(without_link_blocks(tree, "head", precise=True), "quote", precise=True)
    return tree


def image_source(n: Node) -> str | None:
    """The address of an image: data-src, src, or another data-src attribute with an image name."""
    names = ["data-src", "src", *(k for k in n.attrs if k.startswith("data-src"))]
    return next((n.attrs[k] for k in names if k in n.attrs and is_image_name(n.attrs[k])), None)


def selected(tree: Node, expression: str) -> V.Test:
    """A test for a small path language: ``//tag``, ``//*``, ``[@name]``, ``[@name="value"]``, ``[contains(@name, "value")]``, joined by ``|``; ``//comment()`` selects
    nothing, as comments are never kept.
    """
    tests = []
    for part in expression.split("|"):
        if part.strip().lstrip(".") == "//comment()":
            continue  # the parser drops comments
        found = re.fullmatch(r"\s*\.?//(\*|[A-Za-z][\w:-]*)((?:\[[^\]]*\])*)\s*", part)
        if not found:
            raise ValueError(f"unsupported expression: {part.strip()}")
        checks = []
        for condition in re.findall(r"\[([^\]]*)\]", found[2]):
            m = re.fullmatch(r"\s*@([\w:-]+)\s*(?:=\s*(['\"])(.*?)\2)?\s*", condition)
            c = re.fullmatch(r"\s*(contains|starts-with)\(\s*@([\w:-]+)\s*,\s*(['\"])(.*?)\3\s*\)\s*", condition)
            if m:
                checks.append((lambda n, k=m[1], v=m[3]: k in n.attrs if v is None else n.attrs.get(k) == v))
            elif c:
                checks.append((lambda n, f=c[1], k=c[2], v=c[4]: v in n.get(k) if f == "contains" else n.get(k).startswith(v)))
            else:
                raise ValueError(f"unsupported condition: {condition}")
        tests.append((found[1], checks))
    return lambda n: any((tag == "*" or n.tag == tag) and all(c(n) for c in checks) for tag, checks in tests)
