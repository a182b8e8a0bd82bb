"""The main extractor: picks the container of the content and turns it into a flat body of text blocks."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from . import vocab as V
from .clean import image_source, pruned
from .dom import Node, unwrapped, without
from .options import Options
from .text import has_chars, is_noise, trim

INLINE = frozenset(("hi", "ref", "del", "code"))
ENDS_WITHOUT = frozenset(("head", "ref"))


class BlockReader:
    """Reads a converted container in document order into blocks: p, head, list, quote, code, table, graphic."""

    def __init__(self, options: Options, loose_divs: bool = False, loose_text: bool = False):
        self.options, self.loose_divs, self.loose_text = options, loose_divs, loose_text
        self.blocks: list[Node] = []

    def read(self, node: Node) -> list[Node]:
        run: list | None = [] if self.loose_text else None  # content that counts though it is outside of any block
        with_inline = True
        for kid in node.kids:
            if isinstance(kid, str):
                if run is not None:
                    run.append(kid)
                continue
            if run is not None and with_inline and kid.tag in INLINE and kid.tag != "code":
                run.append(kid)
                continue
            self._paragraph_of(run)
            # text right after a plain paragraph or heading belongs to the content, too
            plain = kid.tag in ("p", "head") and not kid.nodes
            run = [] if kid.tag == "lb" or plain or self.loose_text else None
            with_inline = kid.tag == "lb" or self.loose_text
            if kid.tag != "lb":
                self._block(kid)
        self._paragraph_of(run)
        return self.blocks

    def _paragraph_of(self, parts: list | None) -> None:
        if parts:
            p = self.paragraph(Node("p", {}, [k if isinstance(k, str) else k.copy() for k in parts]))
            if p is not None:
                self.blocks.append(p)

    def _block(self, n: Node) -> None:
        make = {"p": self.paragraph, "head": self.heading, "list": self.list, "quote": self.quote, "code": self.quote}.get(n.tag)
        found = None
        if make:
            found = make(n)
        elif n.tag == "table" and self.options.tables:
            found = self.table(n)
            nested = [t for t in n.below("table") if not any(a.tag == "table" and a is not n for a in _up_to(t, n))]
            if found is not None:
                self.blocks.append(found)
            for t in nested:
                self._block(t)
            return
        elif n.tag == "graphic" and self.options.images:
            found = self.image(n)
        elif n.tag in INLINE:
            found = self.paragraph(Node("p", {}, [n.copy()]))
        elif n.tag == "div" and "w3-code" in n.get("class"):
            found = Node("code", {}, _verbatim(n))
        elif n.tag == "div" and self.loose_divs and has_chars(n.lead):
            self._loose_div(n)
        else:
            self.read(n)
        if found is not None:
            self.blocks.append(found)

    def _loose_div(self, n: Node) -> None:
        """A div that starts with text of its own: runs of inline content become paragraphs between its blocks."""
        run: list = []
        for kid in n.kids:
            if isinstance(kid, str) or kid.tag in INLINE or kid.tag == "lb" or kid.tag == "graphic" and self.options.images:
                run.append(kid)
            else:
                self._paragraph_of(run)
                run = []
                self._block(kid)
        self._paragraph_of(run)

    # ---- inline content -----------------------------------------------------------------------------------------------

    def inline(self, n: Node) -> list:
        """The content of a text element: text, line breaks and carried elements; everything else is read as its text."""
        out = Node("_")
        for kid in n.kids:
            if isinstance(kid, str):
                out.add(kid)
            elif kid.tag == "lb":
                out.add(Node("lb"))
            elif kid.tag == "graphic":
                image = self.image(kid) if self.options.images else None
                if image is not None:
                    out.add(image)
            elif kid.tag == "ref" and not self.options.links:
                for k in self.inline(kid):
                    out.add(k)
            elif kid.tag in INLINE:
                attrs = {k: v for k, v in kid.attrs.items() if k == "target" or k == "rend" and kid.tag == "hi"}
                inner = _verbatim(kid) if kid.tag == "code" else self.inline(kid)
                if inner:
                    out.add(Node(kid.tag, attrs, inner))
            elif kid.tag in ("span", "a"):
                for k in self.inline(kid):
                    out.add(k)
            else:  # blocks inside of text: kept apart by a blank
                if out.kids and not (isinstance(out.kids[-1], str) and out.kids[-1][-1:].isspace()):
                    out.add(" ")
                for k in self.inline(kid):
                    out.add(k)
        return out.kids

    def paragraph(self, n: Node) -> Node | None:
        kids = self.inline(n)
        if all(isinstance(k, str) for k in kids):
            text = trim("".join(kids))
            return Node("p", {}, [text]) if text and (n.nodes or not is_noise(text)) else None
        kids = _ends_trimmed(kids)
        p = Node("p", {}, kids)
        return p if has_chars(p.text()) or any(p.below("graphic")) else None

    def heading(self, n: Node) -> Node | None:
        kids = self.inline(n)
        if all(isinstance(k, str) for k in kids):
            kids = [trim("".join(kids))]
            if not n.nodes and is_noise(kids[0]):
                return None
        out = Node("head", {"rend": n.get("rend")} if n.get("rend") else {}, _ends_trimmed(kids))
        return out if has_chars(out.text()) else None

    def list(self, n: Node) -> Node | None:
        out = Node("list", {"rend": n.attrs["rend"]} if "rend" in n.attrs else {})
        for item in _items(n):
            if isinstance(item, str):  # loose text belongs to the item before it
                if out.kids:
                    _append_text(out.kids[-1], trim(item))
                else:
                    out.add(Node("item", {}, [trim(item)]))
                continue
            made = self._item(item)
            if made is not None:
                out.add(made)
        return out if has_chars(out.text()) or any(out.below("graphic")) else None

    def _item(self, n: Node) -> Node | None:
        out = Node("item", {"rend": n.attrs["rend"]} if "rend" in n.attrs else {})
        flat = Node("_", {}, [])
        for kid in n.kids:
            if not isinstance(kid, str) and kid.tag == "list":
                for k in _ends_trimmed(self.inline(flat)):
                    out.add(k)
                flat = Node("_", {}, [])
                sub = self.list(kid)
                if sub is not None:
                    out.add(sub)
            else:
                flat.add(kid if isinstance(kid, str) else kid.copy())
        kids = self.inline(flat)
        if all(isinstance(k, str) for k in kids):
            kids = [trim("".join(kids))]
            if not n.nodes and is_noise(kids[0]):
                return None
        for k in _ends_trimmed(kids):
            out.add(k)
        return out if has_chars(out.text()) or any(out.below("graphic")) else None

    def quote(self, n: Node) -> Node | None:
        inner = n.nodes
        lone_code = len(inner) == 1 and inner[0].tag == "code" and not trim("".join(k for k in n.kids if isinstance(k, str)))
        if n.tag == "code" or n.get("lang") or lone_code or n.parent is not None and "highlight" in n.parent.get("class"):
            code = Node("code", {}, _verbatim(n))
            return code if has_chars(code.text()) else None
        out, run = Node("quote"), []

        def flush() -> None:
            kids = _ends_trimmed(self.inline(Node("_", {}, [k if isinstance(k, str) else k.copy() for k in run])))
            if any(has_chars(k) if isinstance(k, str) else True for k in kids):
                for k in kids:
                    out.add(k)
            run.clear()

        for kid in n.kids:
            if isinstance(kid, str) or kid.tag in INLINE or kid.tag in ("lb", "graphic", "span"):
                run.append(kid)
                continue
            flush()
            sub = BlockReader(self.options, True).read(Node("_", {}, [kid.copy()]))
            for block in sub:
                for k in block.kids if block.tag == "quote" else [block]:
                    out.add(k)
        flush()
        return out if has_chars(out.text()) else None

    # ---- tables and images ----------------------------------------------------------------------------------------------

    def table(self, n: Node) -> Node | None:
        flat = unwrapped(n, "thead", "tbody", "tfoot")
        rows: list[tuple[list[Node], bool]] = []
        loose: list[Node] = []
        for kid in flat.nodes:
            if kid.tag == "tr":
                if loose:
                    rows.append((loose, False))
                    loose = []
                rows.append(([c for c in kid.nodes if c.tag in ("td", "th")], True))
            elif kid.tag in ("td", "th"):
                loose.append(kid)
        if loose:
            rows.append((loose, False))
        width = min(max((sum(_span(c, "colspan") for c in cells) for cells, whole in rows if whole), default=0), V.MAX_SPAN)
        out = Node("table")
        for caption in (k for k in flat.nodes if k.tag == "caption"):
            text = trim(caption.text(" "))
            if text:
                out.add(_row([_cell([text], True)], width))
        held: dict[int, int] = {}  # columns that a cell of an earlier row still spans
        heads_done = False
        for cells, _ in rows:
            line: list[Node] = []
            has_head = False

            def spanned(line: list[Node] = line) -> None:
                while held.get(len(line)):
                    held[len(line)] -= 1
                    line.append(_cell([]))

            for c in cells:
                spanned()
                head = c.tag == "th" and not heads_done
                has_head |= head
                across, down = _span(c, "colspan"), _span(c, "rowspan")
                for column in range(len(line), len(line) + across) if down > 1 else ():
                    held[column] = down - 1
                line.append(_cell(self._cell_content(c), head))
                line.extend(_cell([], head) for _ in range(across - 1))
            spanned()
            heads_done |= has_head
            if any(c.kids for c in line):
                out.add(_row(line, width))
        return out if out.kids else None

    def _cell_content(self, c: Node) -> list:
        own = without(c, lambda n: n.tag == "table")
        if not own.nodes:
            text = trim(own.text())
            return [text] if text and not is_noise(text) else []
        out = Node("_")
        for kid in own.kids:
            if isinstance(kid, str):
                out.add(kid)
            elif kid.tag == "list" and self.options.focus == "recall":
                made = self.list(kid)
                if made is not None:
                    out.add(made)
            elif kid.tag in INLINE or kid.tag in ("lb", "graphic", "span"):
                for k in self.inline(Node("_", {}, [kid.copy()])):
                    out.add(k)
            else:
                for block in BlockReader(self.options, True).read(Node("_", {}, [kid.copy()])):
                    out.add(block)
        return _ends_trimmed(out.kids)

    def image(self, n: Node) -> Node | None:
        src = image_source(n)
        if src is None:
            return None
        if not src.startswith("http"):
            src = urljoin(self.options.url, src) if self.options.url else re.sub("^//", "http://", src)
        return Node("graphic", {"src": src, **{k: n.get(k) for k in ("alt", "title") if n.get(k)}})


def _up_to(n: Node, top: Node):
    for a in n.ancestors():
        if a is top:
            return
        yield a


def _items(n: Node):
    """Items of a list that are not items of a list inside of it, and loose text between them."""
    for kid in n.kids:
        if isinstance(kid, str):
            if has_chars(kid):
                yield kid
        elif kid.tag == "item":
            yield kid
        elif kid.tag != "list":
            yield from _items(kid)
        else:  # a list directly inside of a list
            yield Node("item", {}, [kid.copy()])


def _append_text(item: Node, text: str) -> None:
    """Adds text to what an item ends with, before a list inside of it."""
    at = next((i for i, k in enumerate(item.kids) if not isinstance(k, str) and k.tag == "list"), len(item.kids))
    if at and isinstance(item.kids[at - 1], str):
        item.kids[at - 1] = f"{item.kids[at - 1]} {text}"
    else:
        item.kids.insert(at, f" {text}" if at else text)


def _verbatim(n: Node) -> list:
    """The text and the line breaks of a code block, as they are."""
    out = Node("_")
    for k in n.kids:
        for piece in [k] if isinstance(k, str) else [Node("lb")] if k.tag == "lb" else _verbatim(k):
            out.add(piece)
    if out.kids and isinstance(out.kids[0], str) and out.kids[0].startswith("\n"):
        out.kids[0] = out.kids[0][1:]
        out.kids = [x for x in out.kids if x != ""]
    return out.kids


def _span(c: Node, name: str) -> int:
    value = c.attrs.get(name, "1")
    return min(int(value), V.MAX_SPAN) if value.isdecimal() else 1


def _cell(kids: list, head: bool = False) -> Node:
    return Node("cell", {"role": "head"} if head else {}, kids)


def _row(cells: list[Node], width: int) -> Node:
    return Node("row", {}, [*cells, *(_cell([]) for _ in range(width - len(cells)))])


def _ends_trimmed(kids: list) -> list:
    """Inline content with blanks for line ends, none at its own ends, and no line break at its end."""
    kids = [k if not isinstance(k, str) else re.sub(r"\s*[^\S ]\s*", " ", k) for k in kids]
    while kids and (kids[-1].isspace() if isinstance(kids[-1], str) else kids[-1].tag == "lb"):
        kids.pop()
    while kids and isinstance(kids[0], str) and kids[0].isspace():
        kids.pop(0)
    if kids and isinstance(kids[0], str):
        kids[0] = kids[0].lstrip()
    if kids and isinstance(kids[-1], str):
        kids[-1] = kids[-1].rstrip()
    return [k for k in kids if k != ""]


def block_text(block: Node) -> str:
    return trim(block.text())


def body_text(body: Node) -> str:
    return " ".join(t for t in body.texts()).strip()


def _paragraph_chars(tree: Node) -> int:
    return sum(len(p.text()) for p in tree.below("p") if not p.inside("p"))


def main_body(tree: Node, options: Options) -> tuple[Node, bool]:
    """(body, whether loose divs counted) of the first step of the ladder that gives more than one text block."""
    body, loose = Node("body"), False
    for test in V.BODY_LADDER:
        found = next((n for n in tree.below() if test(n)), None)
        if found is None:
            continue
        part = pruned(found, options, images=options.images, tables=options.tables)
        if not part.nodes:
            continue
        # the paragraphs of the whole document decide whether divs may count as paragraphs
        chars = _paragraph_chars(tree)
        if not chars or chars < options.min_extracted_size * (1 if options.focus == "precision" else 3):
            loose = True
        for block in BlockReader(options, loose).read(unwrapped(part, "span")):
            body.add(block)
        while body.kids and body.kids[-1].tag in ENDS_WITHOUT:
            body.kids.pop()
        if sum(b.tag != "graphic" for b in body.kids) > 1:
            break
    return body, loose


def _rescued(tree: Node, body: Node, options: Options, loose: bool) -> Node:
    """``body`` with text blocks from anywhere in the document that it lacks."""
    part = pruned(tree, options, images=options.images, tables=options.tables, teasers=options.fast)
    part = unwrapped(part, "span", *(() if options.links else ("a", "ref")))
    wanted = {"code", "p", "quote", *(("table",) if options.tables else ()), *(("div", "lb", "list") if options.focus == "recall" else ())}
    have = [block_text(b) for b in body.kids]
    text, exact = "\n".join(filter(None, have)), set(have)

    def found(n: Node, after: str = ""):
        if n.tag in wanted and n.tag != "div" or n.tag == "div" and ("w3-code" in n.get("class") or "div" in wanted and has_chars(n.lead)):
            yield Node("_", {"class": n.parent.get("class") if n.parent is not None else ""}, [n.copy(), after])
        else:
            for kid, then in zip(n.kids, [*n.kids[1:], ""], strict=False):
                if not isinstance(kid, str):
                    yield from found(kid, then if isinstance(then, str) else "")

    for n in found(part):
        for block in BlockReader(options, loose or options.focus == "recall").read(n):
            own = block_text(block)
            scan = len(text) <= V.DEDUPE_SCAN_CAP
            if own and (own in exact or len(own) > V.MIN_DUPLICATE_LENGTH and scan and own in text):
                continue
            body.add(block)
            exact.add(own)
            if scan:
                text += "\n" + own
    return body


def without_repeats(body: Node) -> Node:
    """``body`` without long blocks that repeat the block before them; ``lead`` on it tells that the first one is also a paragraph."""
    out, previous = Node(body.tag, dict(body.attrs)), None
    for block in body.nodes:
        own = block_text(block)
        if own and own == previous and len(own) > V.MIN_DUPLICATE_LENGTH:
            if len(out.kids) == 1 and block.tag != "head":
                out.attrs["lead"] = "paragraph"
            continue
        previous = own
        out.add(block)
    return out


def content(tree: Node, options: Options) -> tuple[Node, str]:
    """(body, text) of a converted tree. The text still holds repeats, as it is what the page offers that decides on further attempts."""
    body, loose = main_body(tree, options)
    if not body.kids or len(body_text(body)) < options.min_extracted_size:
        body = _rescued(tree, body, options, loose)
    return without_repeats(body), body_text(body)


def comments(tree: Node, options: Options) -> tuple[Node, str, Node]:
    """(comments body, text, tree without the comment section)."""
    body = Node("body")
    for test in V.COMMENT_LADDER:
        found = next((n for n in tree.below() if test(n)), None)
        if found is None:
            continue
        part = unwrapped(without(found, V.is_no_comment), "a", "ref", "span")
        for block in BlockReader(options.but(links=False, images=False)).read(part):
            block.attrs = {}
            body.add(block)
        if body.kids:
            tree = without(tree, lambda n, gone=found: n is gone)
            break
    return body, body_text(body), tree
