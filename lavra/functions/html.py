"""Functions on HTML: head data and links as Columns, texts and Markdown in Arrow batches."""

from __future__ import annotations

import html as _html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.functions.text import strip
from lavra.functions.url import normalize_url, resolve

# Where a date of change may stand.
MODIFIED = ("property=\"article:modified_time\"", "name=\"last-modified\"", "name=\"modified\"", "itemprop=\"dateModified\"")
SELECTORS = ("main", "article", "[role=main]", "#main", ".content", "body")
MIN_CONTENT_CHARS = 500
_BLOCKS = frozenset("address article aside blockquote div dl dt dd fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def language(page: Column) -> Column:
    return strip(F.regexp_extract(page, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']([^\"']*)[\"']", 1))


def title(page: Column) -> Column:
    return strip(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


def modified(page: Column) -> Column:
    """The first of four meta elements that has a date; ''."""
    found = []
    for m in MODIFIED:
        name, value = m.split("=")
        element = F.regexp_extract(page, rf"(?i)(<meta\b[^>]*?\b{name}\s*=\s*[\"']?{value.strip(chr(34))}[\"']?[\s/>][^>]*>?)", 1)
        found.append(F.nullif(strip(F.regexp_extract(element, r"(?i)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)), F.lit("")))
    return F.coalesce(*found, F.lit(""))


def canonical(page: Column, url: Column) -> Column:
    """The page's canonical URL, normalized; its own URL without a valid one."""
    element = F.regexp_extract(page, r"(?i)(<link\b[^>]*?\brel\s*=\s*[\"']?canonical\b[^>]*>)", 1)
    href = F.regexp_extract(element, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    # The lambda's variable holds the absolute link, which else would be made again for every use.
    normal = F.transform(F.array(resolve(url, href)), normalize_url)[0]
    return F.when((href == "") | href.isNull(), url).otherwise(F.coalesce(F.nullif(normal, F.lit("")), url))


def links(page: Column, url: Column) -> Column:
    """The distinct normalized links of a page, sorted."""
    quoted = F.regexp_extract_all(page, F.lit(r"(?i)<a\s[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\"'\s>]+)"), F.lit(1))
    hrefs = F.transform(quoted, lambda h: F.regexp_replace(h, "^[\"']|[\"']$", ""))
    absolute = F.transform(hrefs, lambda h: normalize_url(resolve(url, F.replace(h, F.lit("&amp;"), F.lit("&")))))
    return F.array_sort(F.array_distinct(F.filter(absolute, lambda x: x != "")))


_DROP = re.compile(r"<!--.*?-->|<(script|style|noscript)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")


def text_of(page: str | None) -> str:
    """Text nodes one below the other, trimmed, without blank ones, scripts, styles and comments."""
    if not page:
        return ""
    lines = (x.strip() for x in _html.unescape(_TAG.sub("\n", _DROP.sub("", page))).splitlines())
    return "\n".join(x for x in lines if x)


@F.pandas_udf(T.StringType())
def plain_text(pages: pd.Series) -> pd.Series:
    """:func:`text_of` of each page; '' for NULL."""
    return pages.map(text_of)


class _Markdown(HTMLParser):
    """Headings, lists, links, emphasis, code, quotes, rules and tables; other tags only give their text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.href: list[str] = []
        self.skip = self.pre = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        if tag in _BLOCKS and tag != "li":
            self.out.append("\n\n")
        if re.fullmatch("h[1-6]", tag):
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * (len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "* "))
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre += 1
            self.out.append("```\n")
        elif tag == "blockquote":
            self.out.append("> ")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("---\n\n")
        elif tag == "a":
            self.href.append(a.get("href") or "")
            self.out.append("[" if a.get("href") else "")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag in ("td", "th"):
            self.out.append("| ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```")
        elif tag == "a" and self.href:
            href = self.href.pop()
            self.out.append(f"]({href})" if href else "")
        elif tag == "tr":
            self.out.append("|")
        if tag in _BLOCKS and tag != "li":
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def markdown_of(page: str | None, trim_lines: bool = True) -> str:
    if not page:
        return ""
    parser = _Markdown()
    parser.feed(page)
    parser.close()
    text = re.sub(r"(?m)^ +(?=\S)(?![*\d])", "", "".join(parser.out))
    if trim_lines:
        text = re.sub(r"[ \t]+\n", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


@F.pandas_udf(T.StringType())
def to_markdown(pages: pd.Series) -> pd.Series:
    """:func:`markdown_of` of each page; '' for NULL."""
    return pages.map(markdown_of)


class _Regions(HTMLParser):
    """The source of the first element of each selector."""

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=False)
        self.starts = [0]
        for line in source.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))
        self.source, self.open, self.found = source, [], {}

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        a = dict(attrs)
        keys = [k for k, ok in (("main", tag == "main"), ("article", tag == "article"), ("[role=main]", a.get("role") == "main"), ("#main", a.get("id") == "main"), (".content", "content" in (a.get("class") or "").split()), ("body", tag == "body")) if ok and k not in self.found]
        self.open.append((tag, keys, self._at() + len(self.get_starttag_text() or "")))
        for k in keys:
            self.found[k] = ""

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _, _ in self.open):
            while self.open:
                t, keys, start = self.open.pop()
                for k in keys:
                    self.found[k] = self.source[start : self._at()]
                if t == tag:
                    break

    def finish(self) -> dict[str, str]:
        while self.open:
            _, keys, start = self.open.pop()
            for k in keys:
                self.found[k] = self.source[start:]
        return self.found


def main_region(page: str | None) -> str:
    """The first region, in the selectors' order, with 500 characters of text or more; ''. (Readability scoring, which the
    crawler tries before, is replaced by this cascade.)"""
    if not page:
        return ""
    parser = _Regions(page)
    parser.feed(page)
    parser.close()
    found = parser.finish()
    return next((found[s] for s in SELECTORS if s in found and len(text_of(found[s])) >= MIN_CONTENT_CHARS), "")


@F.pandas_udf(T.StringType())
def main_content(pages: pd.Series) -> pd.Series:
    return pages.map(main_region)
