"""A small document tree with mixed content, and a forgiving HTML parser.

``Node.kids`` holds child nodes and text runs in order, so there is no separate notion of a tail: what follows an element is simply
the next kid of its parent. Transformations build new trees instead of editing the old one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset(("script", "style"))
#: Elements whose start ends an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: Open elements that a start tag ends, up to the container that shields them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
#: Elements below which nothing nests any deeper; a page beyond that is flattened.
MAX_DEPTH = 200


class Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, kids: list | None = None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs or {}, [], None
        for kid in kids or ():
            self.add(kid)

    def add(self, kid: Node | str) -> Node | str:
        if isinstance(kid, str):
            if kid and self.kids and isinstance(self.kids[-1], str):
                self.kids[-1] += kid
            elif kid:
                self.kids.append(kid)
        else:
            kid.parent = self
            self.kids.append(kid)
        return kid

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name) or default

    @property
    def nodes(self) -> list[Node]:
        return [k for k in self.kids if not isinstance(k, str)]

    @property
    def lead(self) -> str:
        """Text before the first child node."""
        return self.kids[0] if self.kids and isinstance(self.kids[0], str) else ""

    def walk(self) -> Iterator[Node]:
        """This node and all below it in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(k for k in reversed(node.kids) if not isinstance(k, str))

    def below(self, *tags: str) -> Iterator[Node]:
        """Nodes below this one with one of ``tags`` (any, if none is given)."""
        for node in self.walk():
            if node is not self and (not tags or node.tag in tags):
                yield node

    def texts(self) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            else:
                stack.extend(reversed(item.kids))

    def text(self, glue: str = "") -> str:
        return glue.join(self.texts())

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def inside(self, *tags: str) -> bool:
        return any(a.tag in tags for a in self.ancestors())

    def copy(self) -> Node:
        return Node(self.tag, dict(self.attrs), [k if isinstance(k, str) else k.copy() for k in self.kids])

    def following(self) -> Node | None:
        """The next sibling node."""
        if self.parent is None:
            return None
        after = self.parent.nodes
        at = next(i for i, n in enumerate(after) if n is self)
        return after[at + 1] if at + 1 < len(after) else None

    def __repr__(self) -> str:
        return f"<{self.tag} {self.attrs} {len(self.kids)}>"


def rebuilt(node: Node, change: Callable[[Node, list], list]) -> Node:
    """A new tree: ``change`` gets each node with the new kids of it and returns what takes its place. The root stays."""

    def of(n: Node) -> list:
        kids: list = []
        for k in n.kids:
            kids.extend((k,) if isinstance(k, str) else change(k, of(k)))
        return kids

    return Node(node.tag, dict(node.attrs), of(node))


def without(node: Node, doomed: Callable[[Node], bool], keep_text_after: bool = True) -> Node:
    """A new tree without the nodes that ``doomed`` names. They are tested before anything below them is dropped."""

    def of(n: Node) -> Node:
        out = Node(n.tag, dict(n.attrs))
        skip = False
        for k in n.kids:
            if isinstance(k, str):
                if not skip:
                    out.add(k)
                skip = False
            elif doomed(k):
                skip = not keep_text_after
            else:
                skip = False
                out.add(of(k))
        return out

    return of(node)


def unwrapped(node: Node, *tags: str) -> Node:
    """A new tree in which nodes with one of ``tags`` are replaced by their kids."""
    return rebuilt(node, lambda n, kids: kids if n.tag in tags else [Node(n.tag, dict(n.attrs), kids)])


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.head: Node | None = None
        self.body: Node | None = None
        self.open = [self.root]
        self.elements = 0

    def _into_body(self) -> None:
        if self.body is None:
            self.body = self.root.add(Node("body"))
            self.open = [self.root, self.body]
        elif len(self.open) == 1:
            self.open.append(self.body)

    def _close_to(self, index: int) -> None:
        del self.open[max(index, 1) :]

    def _end_open(self, ended: set[str], shields: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in shields:
                return
            if self.open[i].tag in ended:
                cut = i
                while self.open[cut - 1].tag in ended:
                    cut -= 1
                self._close_to(cut)
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v if v is not None else "")
        self.elements += 1
        if tag == "html":
            self.root.attrs = {**found, **self.root.attrs}
            return
        if tag == "head":
            if self.head is None and self.body is None:
                self.head = self.root.add(Node("head", found))
                self.open = [self.root, self.head]
            return
        if tag == "body":
            if self.body is None:
                self.body = self.root.add(Node("body", found))
                self.open = [self.root, self.body]
            else:
                self.body.attrs = {**found, **self.body.attrs}
            return
        if self.body is None and tag in HEAD_ONLY:
            if self.head is None:
                self.head = self.root.add(Node("head"))
            if len(self.open) == 1:
                self.open.append(self.head)
        elif self.body is None or len(self.open) == 1:
            self._into_body()
        if tag in ENDS_PARAGRAPH:
            self._end_open({"p"}, {"button", "td", "th", "table", "li", "div", "section", "article", "object"} - {"p"})
        if tag in ENDS:
            self._end_open(*ENDS[tag])
        if tag == "a":
            self._end_open({"a"}, {"td", "th", "table", "li", "div", "p"})
        node = Node(tag, found)
        if len(self.open) > MAX_DEPTH:
            self._close_to(MAX_DEPTH)
        self.open[-1].add(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag not in RAW_TEXT | {"div", "p", "span", "a", "li", "html", "body", "head"}:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.handle_starttag("br", [])
            return
        if tag in ("html", "body"):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._close_to(i)
                return
            if self.open[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "div", "section", "article", "body"):
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1] is self.root or self.open[-1] is self.head:
            if data.isspace():
                return
            if self.open[-1] is self.head:
                self.open = [self.root]
            self._into_body()
        self.open[-1].add(data)


def parse(html: str) -> Node | None:
    """The tree of a document (root ``html``), or None if there is no element and no text in it."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    if not builder.elements and not any(t.strip() for t in builder.root.texts()):
        return None
    return builder.root


def fragment(html: str) -> Node:
    """The content of an HTML fragment, in a ``div``."""
    tree = parse(f"<body><div>{html}</div></body>")
    body = body_of(tree) if tree else None
    return Node("div", kids=[k if isinstance(k, str) else k.copy() for k in body.kids]) if body else Node("div")


def body_of(tree: Node) -> Node | None:
    return next((n for n in tree.nodes if n.tag == "body"), None)


def head_of(tree: Node) -> Node | None:
    return next((n for n in tree.nodes if n.tag == "head"), None)


_NAME = re.compile(r"[A-Za-z_][\w.\-]*")


def to_xml(node: Node, void: frozenset | tuple = ()) -> str:
    """Markup without any change of white space. Elements without content are closed at once; ``void`` ones have no end tag."""
    attrs = "".join(f' {k}="{escape(v, quote=True)}"' for k, v in node.attrs.items() if _NAME.fullmatch(k) or k == "xml:lang")
    if node.tag in void:
        return f"<{node.tag}{attrs}>"
    inner = "".join(escape(k, quote=False) if isinstance(k, str) else to_xml(k, void) for k in node.kids)
    return f"<{node.tag}{attrs}>{inner}</{node.tag}>" if inner else f"<{node.tag}{attrs}/>"


_FORBIDDEN = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


def from_xml(text: str) -> Node:
    """The tree that :func:`to_xml` wrote."""
    from xml.etree import ElementTree

    def of(e) -> Node:
        out = Node(e.tag, dict(e.attrib))
        out.add(e.text or "")
        for k in e:
            out.add(of(k))
            out.add(k.tail or "")
        return out

    return of(ElementTree.fromstring(_FORBIDDEN.sub("", text)))


def pretty(node: Node, depth: int = 0, void: frozenset | tuple = ()) -> str:
    """Markup with one line for each element, as long as no text stands beside elements."""
    mixed = any(isinstance(k, str) and k.strip() for k in node.kids)
    pad = "  " * depth
    if mixed or not node.nodes:
        return f"{pad}{to_xml(node, void)}\n"
    attrs = "".join(f' {k}="{escape(v, quote=True)}"' for k, v in node.attrs.items() if _NAME.fullmatch(k))
    return f"{pad}<{node.tag}{attrs}>\n" + "".join(pretty(k, depth + 1, void) for k in node.nodes) + f"{pad}</{node.tag}>\n"


def _joined(one: tuple, other: tuple) -> tuple:
    """Of two adjacent texts, each (length, blank at the start, blank at the end) with white space collapsed and trimmed, that of both."""
    if not one[0] or not other[0]:
        blank = (other if one[0] else one)[1]
        kept = one if one[0] else other
        return (kept[0], kept[1] or blank and not one[0], kept[2] or blank and not other[0]) if kept[0] else (0, one[1] or other[1], one[2] or other[2])
    return one[0] + other[0] + (one[2] or other[1]), one[1], other[2]


def measured(tree: Node) -> list[tuple]:
    """(node_id, parent_id, depth, pos, tag, id, class, text_len, link_len, commas) of each element, from one walk in linear time."""
    rows: list[list] = []

    def visit(n: Node, parent: int, depth: int, pos: int) -> tuple:
        own = len(rows)
        rows.append([own, parent, depth, pos, n.tag, n.attrs.get("id"), n.attrs.get("class")])
        text, links, commas, at = (0, False, False), 0, 0, 0
        for k in n.kids:
            if isinstance(k, str):
                text = _joined(text, (len(" ".join(k.split())), k[:1].isspace(), k[-1:].isspace()))
                commas += k.count(",")
            else:
                inner, linked, more = visit(k, own, depth + 1, at)
                at += 1
                text, commas = _joined(text, inner), commas + more
                links += linked + (inner[0] if k.tag == "a" else 0)
        rows[own] += [text[0], links, commas]
        return text, links, commas

    visit(tree, -1, 0, 0)
    return [tuple(r) for r in rows]
