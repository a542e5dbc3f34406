"""Leaf blocks of an HTML page: runs of text between the borders of block elements, with their ancestors.

A forgiving single pass in the manner of browsers: comments, declarations and the content of scripts, styles and the
like are skipped, `p`, list items, cells and rows close their open kind, a closing tag closes what is open inside it,
an unclosed element reaches to the end of its parent, a tag cut off by the end of the page is dropped.  Character
references are decoded once; white space becomes one space; `br` is white space.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Kinds of elements in HTML.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
HIDDEN = frozenset("audio button canvas datalist head map math noscript object optgroup option select svg template video".split())
#: An opening tag closes an open element of these kinds, up to the nearest of those.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("body caption html table td th".split())

MARKUP = re.compile(r"""<!--(?:>|->|(?s:.*?)(?:--!?>|\Z))|<[!?/](?![a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""")
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Element(NamedTuple):
    tag: str
    names: tuple[str, ...]       # words of class, id and role


class Block(NamedTuple):
    text: str
    path: tuple[Element, ...]    # open block elements, outermost first
    links: int                   # code points inside links


def names_of(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    values = " ".join(m[1] or m[2] or m[3] or "" for m in NAMED.finditer(attributes))
    return tuple(sorted({w.lower() for w in WORDS.findall(html.unescape(values))}))


def blocks_of(page: str | None) -> list[Block]:
    """All leaf blocks with text, in page order."""
    page = page or ""
    out: list[Block] = []
    stack: list[Element] = []
    hidden: list[str] = []
    pieces: list[str] = []
    links = linked = 0

    def end_block() -> None:
        nonlocal links, linked
        if pieces:
            if text := " ".join("".join(pieces).split()):
                out.append(Block(text, tuple(stack), links))
            pieces.clear()
        links = linked = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw and not hidden:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if linked:
                links += len(text.strip())

    def close(kinds: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in kinds:
                end_block()
                del stack[k:]
                return
            if stack[k].tag in until:
                return

    at = 0
    while (lt := page.find("<", at)) >= 0:
        m = MARKUP.match(page, lt)
        if m is None:
            add(page[at : lt + 1])
            at = lt + 1
            continue
        add(page[at:lt])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or m[2] is None and at == len(page) and page[-1] != ">":
            continue
        if m[1] or m[4]:
            if hidden:
                if tag in hidden:
                    del hidden[len(hidden) - 1 - hidden[::-1].index(tag) :]
                continue
            if tag in BLOCK:
                end_block()
                close({tag}, SCOPE - {tag} if tag not in ("html", "body") else frozenset())
            elif tag == "a":
                linked = max(0, linked - 1)
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            found = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = found.start() if found else len(page)
        elif hidden or tag in HIDDEN:
            if tag == "body":
                hidden.clear()
                stack.append(Element(tag, names_of(attributes)))
            elif tag in HIDDEN and not attributes.rstrip().endswith("/"):
                hidden.append(tag)
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCK:
            end_block()
            close({"p"}, SCOPE)
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag not in VOID:
                stack.append(Element(tag, names_of(attributes)))
        elif tag == "a":
            linked = 1
    add(page[at:])
    end_block()
    return out
