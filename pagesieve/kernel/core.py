"""The extraction of one page: from HTML to a record, through a cascade of extractors."""

from __future__ import annotations

import re
from collections.abc import Callable, Container

from . import vocab as V
from .clean import cleaned, converted, selected
from .dom import Node, body_of, from_xml, head_of, parse, to_xml, unwrapped, without
from .extract import block_text, body_text, comments, content
from .fallback import by_stop_words, compared
from .fingerprint import fingerprint
from .metadata import DOCUMENT_FIELDS, clipped, metadata
from .options import Options
from .serialize import serialized, tei_body, tei_faults, to_text
from .simple import all_text, baseline, json_scripts
from .text import acceptable_size, closed_only, decode, looks_dubious, references, repair, single_spaced

_FORUM = re.compile(r'"@type"\s*:\s*(?:"DiscussionForumPosting"|\[[^\]]*"DiscussionForumPosting")')
#: Detects the language of a text; set by the caller that has a model, none by default.
Detector = Callable[[str], str | None]


def load(page: str | bytes | None, single_spaces: bool = False) -> Node | None:
    """The tree of a page, or None if it is not a document."""
    html = decode(page)
    if not html.strip():
        return None
    dubious = looks_dubious(html)
    html = repair(html)
    tree = parse(closed_only(single_spaced(html) if single_spaces else html))
    if tree is None:
        return None
    if dubious and _branches(tree) < 2:
        return None
    return tree


def _branches(tree: Node) -> int:
    """Elements side by side in what was given: a lone element of a fragment counts by its children."""
    body = body_of(tree)
    if body is None or head_of(tree) is not None:
        return len(tree.nodes) + (len(body.nodes) if body else 0)
    loose = any(isinstance(k, str) and k.strip() for k in body.kids)
    return len(body.nodes[0].nodes) if len(body.nodes) == 1 and not loose else len(body.nodes) + loose


def page_language_fits(tree: Node, wanted: str, strict: bool = False) -> bool:
    """What meta elements (and with ``strict`` the html element) say about the language; True if they say nothing."""
    for name, value in (("http-equiv", "content-language"), ("property", "og:locale")):
        found = [n for n in tree.below("meta") if n.get(name) == value and "content" in n.attrs]
        if found:
            return any(wanted in re.split(r"([a-z]{2})", n.get("content").lower()) for n in found)
    if strict and "lang" in tree.attrs:
        return wanted in re.split(r"([a-z]{2})", tree.get("lang").lower())
    return True


def is_forum_thread(tree: Node) -> bool:
    return any(_FORUM.search(s) for s in json_scripts(tree))


def cascade(tree: Node, options: Options, url: str | None = None) -> tuple[Node, str, Node, str, str]:
    """(body, text, comments body, comments text, stage): each extractor is asked only if those before it gave too little."""
    forum = is_forum_thread(tree)
    tree = without(tree, V.is_appended)
    if not options.comments and (options.focus == "precision" or not forum):
        tree = without(tree, V.is_comments)
    backup = cleaned(tree, options)
    ready = converted(backup, options, url)
    notes, notes_text, posts = Node("body"), "", None
    if options.comments:
        notes, notes_text, rest = comments(ready, options)
        if notes_text and forum:  # posts are content here, not comments
            posts, notes, notes_text = notes, Node("body"), ""
        else:
            ready = rest
    if options.focus == "precision" and not forum:
        ready = without(ready, V.is_comments)

    body, text = content(ready, options)
    stage = "main"
    if not options.fast:
        body, text, stage = compared(tree, backup, body, text, options)
    if len(text) < options.min_extracted_size and options.focus != "precision":
        body2, text2 = baseline(tree)
        if len(text2) > len(text) or not options.images or not any(body.below("graphic")):
            body, text, stage, posts = body2, text2, "baseline", None
    if options.focus == "balanced" and 0 < len(text) < V.ESCALATION_MAX_LENGTH and len(text) < V.ESCALATION_PAGE_SHARE * len(all_text(tree)):
        wide = options.but(focus="recall")
        page = tree if forum else without(tree, V.is_comments)
        clean = cleaned(page, wide)
        body2, text2 = content(converted(clean, wide, url), wide)
        body3, text3 = Node("body"), ""
        if not options.fast:
            body2, text2, _ = compared(page, clean, body2, text2, wide)
            body3, text3 = by_stop_words(page, options)
        if len(text3) > len(text2) and len(text3) > V.ESCALATION_STOPWORDS * len(text):
            body, text, stage, posts = body3, text3, "justext_recall", None
        elif len(text2) >= options.min_extracted_size and len(text2) > V.ESCALATION_ACCEPT * len(text):
            body, text, stage, posts = body2, text2, "recall", None
    if posts is not None:
        there = "\n".join(filter(None, map(block_text, body.nodes)))
        missing = [p for p in posts.nodes if (t := block_text(p)) and t not in there]
        if missing:
            for p in missing:
                body.add(p)
            text = body_text(body)
    return body, text, notes, notes_text, stage


def _rejected(status: str) -> dict:
    return {**dict.fromkeys(DOCUMENT_FIELDS), "status": status, "stage": None, "body_text": None, "text_len": None, "comments_len": None, "output": None, "blocks": None}


def extract(page: str | bytes | None, options: Options, *, url: str | None = None, record_id: str | None = None, detect: Detector | None = None, need: Container[str] | None = None) -> dict:
    """The record of one page; ``status`` tells why there is no text, if so. Never raises for bad input.

    With ``need``, fields outside of it may stay empty: what nobody asked for is not computed.
    """
    try:
        with references(options.closed_references):
            return _extract(page, options.but(url=url or options.url), record_id, detect, need)
    except Exception as e:  # noqa: BLE001 a page must not end the job; the status tells, and the stage tells why
        return _rejected("error") | {"stage": f"{type(e).__name__}: {e}"[:200]}


def _extract(page, options: Options, record_id: str | None, detect: Detector | None, need: Container[str] | None = None) -> dict:
    wanted = lambda name: need is None or name in need
    if page is None:
        return _rejected("empty_tree")
    if not acceptable_size(len(page), options.min_file_size, options.max_file_size):
        return _rejected("too_big" if len(page) > options.max_file_size else "too_short")
    tree = load(page, options.single_spaces)
    if tree is None:
        return _rejected("empty_tree")
    if options.lang and (options.fast or detect is None) and not page_language_fits(tree, options.lang):
        return _rejected("wrong_lang")
    doc = dict.fromkeys(DOCUMENT_FIELDS)
    if options.with_metadata:
        doc |= metadata(tree, options.url, options.date_params, options.author_blacklist)
        if doc["url"] in options.url_blacklist:
            return _rejected("blacklisted")
        if options.only_with_metadata and not (doc["date"] and doc["title"] and doc["url"]):
            return _rejected("no_metadata")
    for expression in options.prune:
        tree = without(tree, selected(tree, expression))
    body, text, notes, notes_text, stage = cascade(tree, options, options.url or doc["url"])
    if options.max_tree_size and len(body.nodes) > options.max_tree_size:
        body = unwrapped(body, "hi")
        if len(body.nodes) > options.max_tree_size:
            return _rejected("too_big")
    if len(text) < options.min_output_size and len(notes_text) < options.min_output_comments:
        return _rejected("too_short")
    if options.lang and detect is not None:
        doc["language"] = detect(text if len(text) > len(notes_text) else notes_text)
        if doc["language"] is not None and doc["language"] != options.lang:
            return _rejected("wrong_lang")
    doc["id"] = record_id
    doc["raw_text"] = re.sub("  +", " ", text) if options.single_spaces else text
    if wanted("body"):
        doc["body"] = to_xml(body)
    if options.comments and wanted("commentsbody"):
        doc["commentsbody"] = to_xml(notes)
    if wanted("text"):
        doc["text"] = to_text(body, options.formatting)
    if options.comments and wanted("comments"):
        doc["comments"] = to_text(notes, options.formatting)
    if options.output not in ("txt", "markdown") and (wanted("fingerprint") or wanted("output") and options.output != "python"):
        doc["fingerprint"] = fingerprint(f"{doc['title']} {text}")
    out = None
    if options.output == "xmltei" and options.tei_validation and tei_faults(tei_body(body, "entry")):
        return _rejected("invalid_tei")
    if options.output != "python" and wanted("output"):
        out = serialized(doc, body, notes if options.comments else None, output=options.output, formatting=options.formatting, with_metadata=options.with_metadata)
    doc = clipped(doc)
    return doc | {
        "status": "ok",
        "stage": stage,
        "body_text": _without_title(body) if wanted("body_text") else None,
        "text_len": len(text),
        "comments_len": len(notes_text),
        "output": out,
        "blocks": blocks(body) + blocks(notes, len(body.nodes), True) if wanted("blocks") else None,
    }


def rendered(record: dict, options: Options, drop: Container[int] = ()) -> dict:
    """text, comments, output and text_len of an extracted record again, from its serialized body, without the blocks at the positions in ``drop``."""
    if record.get("body") is None:
        return {"text": None, "comments": None, "output": None, "text_len": None}
    body = from_xml(record["body"])
    body = Node(body.tag, {}, [n for i, n in enumerate(body.nodes) if i not in drop]) if drop else body
    notes = from_xml(record["commentsbody"]) if record.get("commentsbody") else None
    text = body_text(body)
    out = None
    with references(options.closed_references):
        doc = record | {"raw_text": text, "text": to_text(body, options.formatting), "comments": to_text(notes, options.formatting)}
        if options.output != "python":
            doc["fingerprint"] = None if options.output in ("txt", "markdown") else fingerprint(f"{doc.get('title')} {text}")
            out = serialized({k: doc.get(k) for k in DOCUMENT_FIELDS}, body, notes, output=options.output, formatting=options.formatting, with_metadata=options.with_metadata)
    return {"text": doc["text"], "comments": doc["comments"], "output": out, "text_len": len(text)}


def _without_title(body: Node) -> str:
    """The text of the body, blank-separated, without a leading first-level heading (unless it is the first paragraph as well)."""
    nodes = body.nodes
    if nodes and nodes[0].tag == "head" and nodes[0].get("rend") == "h1" and "lead" not in body.attrs:
        nodes = nodes[1:]
    return " ".join(t for t in map(block_text, nodes) if t)


def blocks(body: Node, start: int = 0, is_comment: bool = False) -> list[tuple]:
    """(pos, tag, level, text, is_comment) of each block."""
    return [(start + i, n.tag, int(n.get("rend")[1]) if n.tag == "head" and n.get("rend")[1:2].isdigit() else 0, block_text(n), is_comment) for i, n in enumerate(body.nodes)]
