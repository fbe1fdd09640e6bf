"""Pages to title, paragraphs and Markdown with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SKIP = {"script", "style", "nav", "head", "footer"}
_PREFIX = {**{f"h{i}": "#" * i + " " for i in range(1, 7)}, "li": "- ", "blockquote": "> "}
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*"}


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.links: list[str] = []
        self.cells = 0

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        elif self.skip:
            return
        elif tag in _PREFIX:
            self.out.append("\n\n" + _PREFIX[tag] if tag != "li" else "\n" + _PREFIX[tag])
        elif tag in ("p", "table", "ul", "ol", "div"):
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in _MARKS:
            self.out.append(_MARKS[tag])
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "tr":
            self.out.append("\n|")
            self.cells = 0

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            return
        elif tag in _MARKS:
            self.out.append(_MARKS[tag])
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("td", "th"):
            self.out.append(" |")
            self.cells += 1
        elif tag in _PREFIX or tag == "p":
            self.out.append("\n\n" if tag != "li" else "")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(" ".join(data.split()) if data.strip() else " " if data else "")
            if data[-1:].isspace() and data.strip():
                self.out.append(" ")


def to_markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    text = re.sub(r"[ \t]+", " ", "".join(parser.out))
    return re.sub(r"\n[ \n]*\n", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


class _Paragraphs(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.paragraphs: list[str] = []
        self.parts: list[str] | None = None
        self.h1: list[str] | None = None
        self.titles = {"h1": "", "title": ""}
        self.in_title: str | None = None
        self.skip = 0

    def flush(self):
        if self.parts is not None:
            self.paragraphs.append(" ".join("".join(self.parts).split()))
        self.parts = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "p":
            self.flush()
            self.parts = []
        elif tag in self.titles:
            self.in_title = tag
        elif tag in ("div", "article", "section", "footer", "nav", "ul", "table"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("p", "div", "article", "section", "footer", "nav", "body"):
            self.flush()
        elif tag == self.in_title:
            self.in_title = None

    def handle_data(self, data):
        if self.skip:
            return
        if self.in_title and not self.titles[self.in_title]:
            self.titles[self.in_title] = " ".join(data.split())
        if self.parts is not None:
            self.parts.append(data)


def paragraph_text(html: str) -> tuple[str, str, float]:
    """Title (h1, else title), paragraphs of over 30 bytes joined by blank lines, and a quality from the number of words."""
    parser = _Paragraphs()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    text = "\n\n".join(p for p in parser.paragraphs if len(p.encode()) > 30)
    return parser.titles["h1"] or parser.titles["title"], text, min(len(text.split()) / 500.0, 1.0)


@F.pandas_udf(T.StringType())
def markdown(html: pd.Series) -> pd.Series:
    return html.map(to_markdown)


@F.pandas_udf(T.StructType().add("title", T.StringType()).add("text", T.StringType()).add("quality", T.FloatType()))
def paragraphs(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([paragraph_text(h) for h in html], columns=["title", "text", "quality"])
