"""Stored pages -> one nested row per page.

The parse is the only Python step: the standard library's tokenizer turns markup into a flat list of elements in
document order, each with the range of its descendants and of its text. Everything else is Spark SQL on that row.
Text is kept once per page; elements point into it. Unclosed tags end with the element around them.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
KEPT = {"div", "section", "article", "p", "span", "h1", "h2", "h3", "h4", "h5", "h6", "strong", "b", "em", "a", "table", "tr", "td",
        "th", "ul", "ol", "li", "dl", "dt", "dd", "form", "header", "footer", "nav", "main", "address", "img", "meta", "link", "body"}
ELEMENT = ("struct<seq:int,last:int,parent:int,tag:string,cls:string,ident:string,href:string,prop:string,itemtype:string,"
           "alt:string,content:string,t0:int,t1:int,head:int>")
HEADS = {"h1", "h2", "h3", "h4"}
BARE = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)>")  # tags without attributes, by far the most
BARE_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
PAGES_AT_ONCE = 128  # parsed rows that a worker holds before it hands them over


class _Elements(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.text: list[str] = []
        self.length = 0
        self.open: list[tuple[str, int]] = []  # (tag, row number or -1)
        self.head = -1  # row number of the last heading met

    def updatepos(self, i, j):
        return j  # line numbers are not used

    def parse_starttag(self, i):
        m = BARE.match(self.rawdata, i)
        tag = m and m[1].lower()
        if tag not in KEPT or self.cdata_elem:
            return super().parse_starttag(i)
        self.handle_starttag(tag, [])
        return m.end()

    def parse_endtag(self, i):
        m = BARE_END.match(self.rawdata, i)
        tag = m and m[1].lower()
        if tag not in KEPT or self.cdata_elem:
            return super().parse_endtag(i)
        self.handle_endtag(tag)
        return m.end()

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        row = -1
        if tag in KEPT:
            row = len(self.rows)
            parent = next((r for _, r in reversed(self.open) if r >= 0), -1)
            self.rows.append({"seq": row, "last": row, "parent": parent, "tag": tag, "cls": a.get("class", "").lower(),
                              "ident": a.get("id", "").lower(), "href": a.get("href"), "prop": a.get("itemprop") or a.get("property") or a.get("name"),
                              "itemtype": a.get("itemtype"), "alt": a.get("alt"), "content": a.get("content"),
                              "t0": self.length, "t1": self.length, "head": self.head})
            if tag in HEADS:
                self.head = row
        if tag not in VOID:
            self.open.append((tag, row))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self._close() != tag:
                pass

    def _close(self) -> str:
        tag, row = self.open.pop()
        if row >= 0:
            self.rows[row]["last"], self.rows[row]["t1"] = len(self.rows) - 1, self.length
        return tag

    def handle_data(self, data):
        if not any(t in ("script", "style") for t, _ in self.open[-1:]):
            self.text.append(data)
            self.length += len(data)

    def done(self) -> tuple[str, list[dict]]:
        self.close()
        while self.open:
            self._close()
        return "".join(self.text), self.rows


def parse_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Adds ``text`` and ``elements`` to the kept columns; one output row per input row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), PAGES_AT_ONCE):
                part = pdf.iloc[at : at + PAGES_AT_ONCE]
                texts, elements = [], []
                for h in part[html]:
                    p = _Elements()
                    p.feed(h or "")
                    t, rows = p.done()
                    texts.append(t)
                    elements.append(rows)
                yield part[list(keep)].assign(text=texts, elements=elements)

    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, html).mapInPandas(run, f"{fields}, text string, elements array<{ELEMENT}>")


# ---- reading the nested row -----------------------------------------------------------------

def text_of(e: Column, text: str = "text") -> Column:
    """Trimmed text of an element with single spaces."""
    return F.trim(F.regexp_replace(F.substr(F.col(text), e["t0"] + 1, e["t1"] - e["t0"]), r"\s+", " "))


def inside(e: Column, outer: Column) -> Column:
    return (e["seq"] > outer["seq"]) & (e["seq"] <= outer["last"])


def descendants(outer: Column, elements: str = "elements") -> Column:
    """Elements inside another: they follow it in the list, so this is a slice, not a search over the page."""
    return F.slice(F.col(elements), outer["seq"] + 2, outer["last"] - outer["seq"])


def first_inside(outer: Column, *conditions, elements: str = "elements") -> Column:
    """First descendant meeting the first condition that any descendant meets."""
    found = [F.get(F.filter(descendants(outer, elements), c), F.lit(0)) for c in conditions]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def has_class(e: Column, words: list[str]) -> Column:
    return e["cls"].rlike("|".join(words))


def mailto(e: Column) -> Column:
    """Address of a mailto link, without parameters."""
    return F.trim(F.regexp_extract(e["href"], r"^mailto:([^?]*)", 1))


def absolute_url(href: Column, base: Column) -> Column:
    """Resolve against the page's address; fragments are dropped."""
    h = F.regexp_replace(F.trim(href), "#.*$", "")
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(F.substr(base, F.length(root) + 1), "[?#].*$", ""), "[^/]*$", "")
    folder = F.concat(root, F.when(path == "", F.lit("/")).otherwise(path))
    return (F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), h))
            .when(h.startswith("/"), F.concat(root, h))
            .when(h == "", F.regexp_replace(base, "#.*$", "")).otherwise(F.concat(folder, h)))


# ---- flat elements, read in the JVM without a parse -----------------------------------------

def visible_markup(html: str | Column) -> Column:
    h = F.regexp_replace(F.col(html) if isinstance(html, str) else html, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(F.regexp_replace(h, r"(?is)<script\b[^>]*>.*?</script\s*>", ""), r"(?is)<style\b[^>]*>.*?</style\s*>", "")


def plain(markup: Column) -> Column:
    t = F.regexp_replace(markup, r"<[^>]*>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def page_title(html: str | Column) -> Column:
    return plain(F.regexp_extract(html if isinstance(html, Column) else F.col(html), r"(?is)<title[^>]*>(.*?)</title", 1))


def meta_content(html: str | Column, name: str) -> Column:
    h = html if isinstance(html, Column) else F.col(html)
    v = F.regexp_extract(h, rf'(?is)<meta\s[^>]*(?:name|property)=["\']{name}["\'][^>]*content=["\']([^"\']*)["\']', 1)
    return F.when(v != "", v)


def headings(markup: str | Column, levels: str = "1-6") -> Column:
    m = markup if isinstance(markup, Column) else F.col(markup)
    return F.transform(F.regexp_extract_all(m, F.lit(rf"(?is)<h[{levels}][^>]*>(.*?)</h[{levels}]"), 1), plain)


def links(markup: str | Column) -> Column:
    """Array of (href, text) in document order."""
    m = markup if isinstance(markup, Column) else F.col(markup)
    tags = F.regexp_extract_all(m, F.lit(r"(?is)(<a\s[^>]*href=[^>]*>.*?)</a"), 1)
    return F.transform(tags, lambda x: F.struct(
        F.regexp_extract(x, r'(?is)^<a\s[^>]*href=["\']?([^"\'\s>]*)', 1).alias("href"),
        plain(F.regexp_replace(x, r"(?s)^<[^>]*>", "")).alias("text")))


def json_ld(html: str | Column) -> Column:
    h = html if isinstance(html, Column) else F.col(html)
    return F.regexp_extract_all(h, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script'), 1)
