"""Leaf blocks of HTML pages: runs of text between block-level tags, with their tag paths.

A lenient reader, in time linear in the page: tags that are never closed end
with their parent, a paragraph ends where a block begins, a closing tag without
an opening one is ignored, and the contents of scripts, styles and the like are
not text.  A tag ends at the first > outside quotes, or at the first > where
quotes never close; a page that ends inside a tag ends before it.  A script or
the like that is never closed ends at the next tag.  Tags inside formulas and
drawings are inside a line.  Below ``DEEPEST`` open elements, further ones are
not told apart from their parent.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Fixed values of HTML: elements inside a line, without content, with raw content, and ended by a following one of the same kind.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark math object q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe".split())
FOREIGN = frozenset(("math", "svg"))
SELF_ENDING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where the search for an element to end stops.
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "p": {"body"}, "option": {"select"}}

#: Elements that a path holds at most.
DEEPEST = 256

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_SPECIAL = re.compile(r"[\"'>]")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass(slots=True)
class Block:
    path: tuple[str, ...]
    text: str
    links: int  # characters inside links


class _Tags:
    """The markup of a page, from left to right.  What was searched for in vain is remembered, so that nothing is searched twice."""

    def __init__(self, page: str):
        self.page, self.end = page, len(page)
        self.hopeless: set[int] = set()  # quotes from which no > follows outside quotes
        self.unclosed: set[str] = set()  # raw elements without a closing tag in the rest of the page

    def _end_of_tag(self, at: int) -> int:
        """Where a tag ends whose name ends at a position; -1 if the page ends before."""
        seen: list[int] = []
        p = at
        while m := _SPECIAL.search(self.page, p):
            if m[0] == ">":
                return m.end()
            if m.start() in self.hopeless:
                break
            seen.append(m.start())
            p = self.page.find(m[0], m.end()) + 1
            if not p:
                break
        self.hopeless.update(seen)
        return self.page.find(">", at) + 1 or -1

    def next(self, at: int) -> tuple[int, int, str, str]:
        """Begin, end, name (with / before it if it closes, "" for comments and the like) and attributes of the next markup; begin and end are the page's end if there is none."""
        page = self.page
        while (begin := page.find("<", at)) >= 0:
            m = _NAME.match(page, begin + 1)
            if m:
                stop = self._end_of_tag(m.end())
                if stop < 0:
                    return begin, self.end, "", ""
                return begin, stop, m[0].lower(), page[m.end() : stop - 1]
            if page.startswith("!--", begin + 1):
                stop = page.find("-->", begin + 4)
                return begin, stop + 3 if stop >= 0 else self.end, "", ""
            if page.startswith(("!", "?"), begin + 1):
                stop = page.find(">", begin)
                return begin, stop + 1 if stop >= 0 else self.end, "", ""
            at = begin + 1
        return self.end, self.end, "", ""

    def after_raw(self, tag: str, at: int) -> int:
        """Where the content and the closing tag of a raw element end."""
        if tag not in self.unclosed:
            stop = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(self.page, at)
            if stop:
                return self.page.find(">", stop.start()) + 1 or self.end
            self.unclosed.add(tag)
        return self.next(at)[0]


def _describe(tag: str, attributes: str) -> str:
    """An element as its tag and the values of class, id and role."""
    if not attributes:
        return tag
    named = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes))
    return f"{tag} {named}" if named else tag


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order; white space in a text is one space, empty blocks are left out."""
    found: list[Block] = []
    tags: list[str] = []
    path: list[str] = []
    parts: list[str] = []
    links = in_link = foreign = at = 0
    end = len(page)
    markup = _Tags(page)
    paths: dict[tuple[str, ...], tuple[str, ...]] = {}  # blocks with equal paths share one

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            own = tuple(path)
            found.append(Block(paths.setdefault(own, own), text, min(links, len(text))))
        parts.clear()
        links = 0

    def close(to: int) -> None:
        nonlocal in_link, foreign
        for t in tags[to:]:
            in_link -= t == "a"
            foreign -= t in FOREIGN
        del tags[to:], path[to:]

    while at < end:
        begin, stop, tag, attributes = markup.next(at)
        if begin > at:
            raw = page[at:begin]
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                links += len(text)
        at = stop
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if tag in tags:
                if tag not in INLINE and not foreign:
                    flush()
                close(len(tags) - 1 - tags[::-1].index(tag))
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                at = markup.after_raw(tag, at)
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE and not foreign:
            flush()
            ends = SELF_ENDING.get(tag)
            scope = SCOPE.get(tag, ())
            for k in range(len(tags) - 1, -1, -1):
                if ends and tags[k] in ends or tags[k] == "p":
                    close(k)
                    break
                if tags[k] in scope or tags[k] not in INLINE and not ends:
                    break
        if tag not in VOID and len(tags) < DEEPEST and not (foreign and attributes.endswith("/")):
            tags.append(tag)
            path.append(_describe(tag, attributes))
            in_link += tag == "a"
            foreign += tag in FOREIGN
    flush()
    return found
