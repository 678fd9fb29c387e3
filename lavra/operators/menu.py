"""Menus and containers of page snapshots, by simple CSS selectors."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lavra.functions.html import text_of
from lavra.functions.url import extension, part, resolve, sanitize

_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[#.][\w-]+|\[[\w-]+(?:=[\"']?[^\]\"']*[\"']?)?\])*)$")
_PART = re.compile(r"([#.])([\w-]+)|\[([\w-]+)(?:=[\"']?([^\]\"']*)[\"']?)?\]")


def read_selector(selector: str) -> list[tuple[str, list[tuple[str, str, str | None]]]]:
    """The steps of a selector: elements with classes, ids and attributes, each below the one before. Others raise."""
    steps = []
    for step in selector.split():
        m = _SIMPLE.match(step)
        if m is None or not step:
            raise ValueError(f"no simple selector: {selector}")
        tests = [("id" if a == "#" else "class", b, None) if a else ("attr", c, d or None) for a, b, c, d in _PART.findall(m.group(2))]
        steps.append(((m.group(1) or "*").lower(), tests))
    if not steps:
        raise ValueError("an empty selector")
    return steps


def _fits(tag: str, attrs: dict[str, str], step) -> bool:
    name, tests = step
    if name not in ("*", tag):
        return False
    for kind, value, wanted in tests:
        if kind == "class" and value not in (attrs.get("class") or "").split():
            return False
        if kind == "id" and attrs.get("id") != value:
            return False
        if kind == "attr" and (value not in attrs or wanted is not None and attrs[value] != wanted):
            return False
    return True


class _Matches(HTMLParser):
    """The inner source of the elements that a selector finds, in the order of their starts."""

    def __init__(self, source: str, selector: str) -> None:
        super().__init__(convert_charrefs=False)
        self.starts = [0]
        for line in source.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))
        self.source, self.steps, self.open, self.found = source, read_selector(selector), [], []

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _selected(self, tag: str, attrs: dict[str, str]) -> bool:
        if not _fits(tag, attrs, self.steps[-1]):
            return False
        left = len(self.steps) - 1
        for t, a, _, _ in reversed(self.open):
            if left and _fits(t, a, self.steps[left - 1]):
                left -= 1
        return not left

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k: v or "" for k, v in attrs}
        place = None
        if self._selected(tag, own):
            place = len(self.found)
            self.found.append("")
        if tag not in _VOID:
            self.open.append((tag, own, place, self._at() + len(self.get_starttag_text() or "")))

    def _end(self, at: int) -> str:
        tag, _, place, start = self.open.pop()
        if place is not None:
            self.found[place] = self.source[start:at]
        return tag

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, *_ in self.open):
            at = self._at()
            while self._end(at) != tag:
                pass

    def result(self) -> list[str]:
        self.feed(self.source)
        self.close()
        while self.open:
            self._end(len(self.source))
        return self.found


@dataclass(frozen=True)
class MenuOptions:
    """What a run over a menu needs; invalid values raise."""

    url: str
    items: str
    content: str
    title: str = ""
    max_items: int = 50_000

    def __post_init__(self) -> None:
        parts = urlsplit(self.url)
        if parts.scheme not in ("http", "https") or not parts.netloc:
            raise ValueError("the address must be an absolute http(s) URL")
        for selector in (self.items, self.content, *([self.title] if self.title else [])):
            read_selector(selector)
        if self.max_items < 1:
            raise ValueError("max_items must be 1 or more")


def select(page: str | None, selector: str) -> list[str]:
    """The inner HTML of the elements that ``selector`` finds."""
    return _Matches(page, selector).result() if page else []


def menu_items(pages: DataFrame, key: str, page: str, selector: str) -> DataFrame:
    """(key, dom_index, label): the elements of a menu with a text that isn't blank; the index counts all that ``selector`` finds."""
    read_selector(selector)

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("dom_index", T.IntegerType()), T.StructField("label", T.StringType())])))
    def items(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(k, label) for k, x in enumerate(select(t, selector)) if (label := text_of(x).strip())])

    return pages.select(key, F.inline(items(page)))


def container(page: Column, selector: str) -> Column:
    """STRUCT<html, text> of the first element that ``selector`` finds; '' without one."""
    read_selector(selector)

    @F.pandas_udf(T.StructType([T.StructField("html", T.StringType()), T.StructField("text", T.StringType())]))
    def first(texts: pd.Series) -> pd.DataFrame:
        found = [next(iter(select(t, selector)), "") for t in texts]
        return pd.DataFrame({"html": found, "text": [text_of(x) for x in found]})

    return first(page)


def item_title(page: Column, selector: str, label: Column) -> Column:
    """The text of the title element, or the item's label where there is none."""
    return F.coalesce(F.nullif(container(page, selector)["text"], F.lit("")), F.trim(label)) if selector else F.trim(label)


def numbered(items: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """``items`` with ``position`` from 1 within ``by``, in the order of ``order``, the first ``most`` of each."""
    if most < 1:
        raise ValueError("most must be 1 or more")
    return items.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("position") <= most)


def linked_pdfs(panels: DataFrame, key: str, url: str, content: str) -> DataFrame:
    """(key, pdf_url, name): the PDFs that a panel links to, with the names under which they are kept: stem, ``__`` and ten digits of the
    URL's SHA-1."""
    hrefs = F.regexp_extract_all(F.col(content), F.lit(r"(?i)<a\s[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    found = panels.select(key, F.explode(F.transform(hrefs, lambda h: resolve(F.col(url), F.replace(h, F.lit("&amp;"), F.lit("&"))))).alias("pdf_url"))
    stem = F.regexp_extract(part(F.col("pdf_url"), 3), r"([^/]*)\.[^./]*$", 1)
    name = F.concat(sanitize(F.coalesce(F.nullif(stem, F.lit("")), F.lit("documento")), 150, False), F.lit("__"), F.substring(F.sha1("pdf_url"), 1, 10), F.lit(".pdf"))
    return found.where(extension(F.col("pdf_url")) == ".pdf").select(key, "pdf_url", name.alias("name"))
