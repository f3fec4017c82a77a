"""HTML pages as Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that hold no text of their own, and those that begin a line.
DROPPED = {"head", "script", "style", "nav", "footer", "aside", "noscript", "button"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "header"}


class _Writer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.dropped: list[str] = []
        self.links: list[tuple[int, str]] = []
        self.lists: list[list] = []
        self.pre = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in DROPPED or (tag == "header" and (a.get("role") == "banner")):
            self.dropped.append(tag)
        if self.dropped:
            return
        if tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1:]) + " ")
        elif tag == "li":
            top = self.lists[-1] if self.lists else ["ul", 0]
            top[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{top[1]}. " if top[0] == "ol" else "- "))
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag in BLOCKS:
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.links.append((len(self.out), a.get("href") or ""))
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")

    def handle_endtag(self, tag):
        if self.dropped:
            if tag in self.dropped:
                while self.dropped.pop() != tag:
                    pass
            return
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag == "pre":
            self.pre = False
            self.out.append("\n```\n\n")
        elif tag in BLOCKS or (tag[0] == "h" and tag[1:].isdigit()):
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.links:
            at, href = self.links.pop()
            label = "".join(self.out[at:]).strip()
            # a permalink is an anchor whose label is a sign or nothing
            self.out[at:] = [] if href.startswith("#") and label in ("", "#", "¶", "§") else [f"[{label}]({href})"] if href else [label]

    def handle_data(self, data):
        if self.dropped:
            return
        if not self.pre:
            data = re.sub(r"\s+", " ", data)
            if not self.out or self.out[-1].endswith(("\n", " ")):
                data = data.lstrip()
        if data:
            self.out.append(data)


def to_markdown(html: str | None) -> str:
    w = _Writer()
    w.feed(html or "")
    w.close()
    text = "".join(w.out)
    lines = [x.rstrip() for x in text.split("\n")]
    out: list[str] = []
    for x in lines:
        if x or (out and out[-1]):
            out.append(x)
    return "\n".join(out).strip()


def markdown(html: Column) -> Column:
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(to_markdown)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(html)
