"""HTML pages: metadata, headings, links, and Markdown of the text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HEADING = r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>"""
LINK_TEXT = r"""(?is)<a\s[^>]*?href\s*=\s*["'][^"']*["'][^>]*>(.*?)</a>"""
META = r"""(?is)<meta\s+name\s*=\s*["']([^"']*)["']\s+content\s*=\s*["']([^"']*)["'][^>]*>"""
LANGUAGE = r"""(?is)<html[^>]*\slang\s*=\s*["']([^"']*)["']"""
IMAGE = r"""(?is)<img\s[^>]*?src\s*=\s*["']([^"']*)["'][^>]*>"""


def bare(fragment: Column) -> Column:
    """Text of a fragment: tags out, white space single, the five entities decoded."""
    c = F.trim(T.replace_all(T.replace_all(fragment, T.HTML_TAG, ""), r"\s+", " "))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def title(html: Column) -> Column:
    return F.nullif(bare(F.regexp_extract(html, TITLE, 1)), F.lit(""))


def language(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, LANGUAGE, 1), F.lit(""))


def headings(html: Column) -> Column:
    """array<struct<level, text>>"""
    levels = F.regexp_extract_all(html, F.lit(HEADING), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit(HEADING), F.lit(2))
    return F.zip_with(levels, texts, lambda a, b: F.struct(a.cast("int").alias("level"), bare(b).alias("text")))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(LINK), F.lit(1))


def images(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(IMAGE), F.lit(1))


def link_type(href: Column) -> Column:
    return (
        F.when(F.startswith(href, F.lit("#")), "anchor")
        .when(F.startswith(href, F.lit("mailto:")), "email")
        .when(F.startswith(href, F.lit("tel:")), "phone")
        .when(href.rlike("^(?i)https?://"), "external")
        .when(href.rlike("^(/|\\.\\.?/|[A-Za-z0-9_-]+([./]|$))") & ~href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "internal")
        .otherwise("other")
    )


class _Markdown(HTMLParser):
    """Block and inline tags as Markdown; scripts, styles and the head's rest left out."""

    SKIP, BLOCK = {"script", "style", "template", "noscript"}, {"p", "div", "section", "article", "nav", "header", "footer", "ul", "ol", "table", "blockquote", "main", "aside", "pre"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipped = 0
        self.hrefs: list[str] = []
        self.lists: list[int] = []
        self.row: list[str] | None = None
        self.rows = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in self.SKIP or tag == "title":
            self.skipped += 1
        elif tag in self.BLOCK:
            self.out.append("\n\n")
            if tag in ("ul", "ol"):
                self.lists.append(0 if tag == "ul" else 1)
            self.rows = 0 if tag == "table" else self.rows
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            depth = max(len(self.lists) - 1, 0)
            mark = f"{self.lists[-1]}. " if self.lists and self.lists[-1] else "- "
            if self.lists and self.lists[-1]:
                self.lists[-1] += 1
            self.out.append("\n" + "  " * depth + mark)
        elif tag == "br":
            self.out.append("\n")
        elif tag == "a":
            self.hrefs.append(a.get("href") or "")
            self.out.append("[")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "tr":
            self.out.append("\n|")
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.out.append(" ")

    def handle_endtag(self, tag):
        if tag in self.SKIP or tag == "title":
            self.skipped = max(0, self.skipped - 1)
        elif tag in self.BLOCK:
            self.out.append("\n\n")
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
        elif tag == "a" and self.hrefs:
            self.out.append(f"]({self.hrefs.pop()})")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag in ("td", "th") and self.row is not None:
            self.out.append(" |")
            self.row.append("")
        elif tag == "tr" and self.row is not None:
            self.rows += 1
            if self.rows == 1:
                self.out.append("\n|" + " --- |" * len(self.row))
            self.row = None
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(" ".join(data.split()) and (" " * data[:1].isspace() + " ".join(data.split()) + " " * data[-1:].isspace()) or " " * bool(data))


def to_markdown(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Markdown()
    p.feed(html)
    p.close()
    lines = [re.sub(r"(?<=\S) {2,}", " ", x).rstrip() for x in "".join(p.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x if x.lstrip().startswith(("-", "1", "2", "3", "4", "5", "6", "7", "8", "9")) else x.strip() for x in lines)).strip()


def markdown(html: Column) -> Column:
    """A parser is needed: nesting is beyond regular expressions."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(to_markdown)

    return run(html)
