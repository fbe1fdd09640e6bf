"""Elements of a page by simple selectors: tags, classes, ids, attribute tests, and descent."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of HTML: elements without content, and those whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NO_TEXT = frozenset(("script", "style"))


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    parent: Element | None = None
    children: list = field(default_factory=list)

    def text(self) -> str:
        """All text inside, white space as one space."""
        parts: list[str] = []
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in NO_TEXT:
                todo += reversed(x.children)
        return " ".join(" ".join(parts).split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {})
        self.all: list[Element] = []

    def handle_starttag(self, tag, attrs):
        # A row, cell, item or paragraph ends where the next one begins.
        ends = {"tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "li": ("li",), "p": ("p",)}.get(tag, ())
        while self.at.tag in ends:
            self.at = self.at.parent
        element = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(element)
        self.all.append(element)
        if tag not in VOID:
            self.at = element

    def handle_endtag(self, tag):
        x = self.at
        while x.parent is not None and x.tag != tag:
            x = x.parent
        if x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> list[Element]:
    """All elements of a page in order."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.all


_STEP = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+|\[[^\]]+\])*)")


def _fits(e: Element, step: str) -> bool:
    tag, rest = _STEP.fullmatch(step).groups()
    if tag and e.tag != tag.lower():
        return False
    for part in re.findall(r"[.#][\w-]+|\[[^\]]+\]", rest):
        if part[0] == "." and part[1:] not in e.attributes.get("class", "").split():
            return False
        if part[0] == "#" and e.attributes.get("id") != part[1:]:
            return False
        if part[0] == "[":
            name, test, value = re.fullmatch(r"\[\s*([\w-]+)\s*(?:([*^$]?=)\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]", part).groups()
            have = e.attributes.get(name)
            if have is None or test == "=" and have != value or test == "*=" and value not in have or test == "^=" and not have.startswith(value) or test == "$=" and not have.endswith(value):
                return False
    return True


def select(elements: list[Element], selector: str) -> list[Element]:
    """Elements that match a selector; commas give alternatives."""
    out = []
    for e in elements:
        for alternative in selector.split(","):
            steps = alternative.split()
            x, k = e, len(steps) - 1
            if not steps or not _fits(e, steps[-1]):
                continue
            while k and x.parent is not None:
                x = x.parent
                k -= _fits(x, steps[k - 1]) if x.tag else 0
            if not k:
                out.append(e)
                break
    return out


def first_long_text(html: str, selectors: list[str], least: int) -> str:
    """The texts of the first selector whose matches, joined by line ends, have enough bytes; else empty."""
    elements = parse(html)
    for s in selectors:
        text = "\n".join(t for t in (e.text() for e in select(elements, s)) if t)
        if len(text.encode()) >= least:
            return text
    return ""


def body_text(selectors: list[str], least: int = 400):
    """A column function that gives the article body of a page by a site's selectors."""

    @F.pandas_udf(T.StringType())
    def body(html: pd.Series) -> pd.Series:
        return html.map(lambda h: first_long_text(h, selectors, least))

    return body


def table_rows(selector: str):
    """A column function that gives the rows of a table: position, texts of the cells, targets of the links."""
    kind = T.ArrayType(T.StructType().add("row", T.IntegerType()).add("cells", T.ArrayType(T.StringType())).add("links", T.ArrayType(T.StringType())))

    @F.pandas_udf(kind)
    def rows(html: pd.Series) -> pd.Series:
        def one(page):
            out = []
            for i, tr in enumerate(select(parse(page), selector)):
                inside = [tr]
                for x in inside:
                    inside += [c for c in x.children if isinstance(c, Element)]
                out.append({"row": i, "cells": [c.text() for c in inside if c.tag in ("td", "th")], "links": [c.attributes["href"] for c in inside if c.tag == "a" and "href" in c.attributes]})
            return out

        return html.map(one)

    return rows
