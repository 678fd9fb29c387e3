"""Problem 6: markup of several languages to clean text that keeps headings, lists, code blocks and formulas.

A panel's HTML is read as a tree. Paragraphs pass points for their length and commas to their containers, discounted by link
density; the best container is kept, and of its siblings those that score a part of it or have a paragraph's text with few links. Text that stands in
a container without HTML structure is read line by line as LaTeX, wiki or Markdown.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The tags that are read as HTML.
_BLOCK = "div|section|article|main|aside|nav|header|footer|p|h[1-6]|ul|ol|li|dl|dt|dd|pre|blockquote|table|tbody|thead|tr|td|th|form|hr"
_KNOWN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)\b([^>]*)>(.*?)</\1\s*>|<(/?)({_BLOCK}|br|b|i|u|s|em|strong|span|a|code|small|sub|sup|font|img|kbd|tt|mark)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I | re.S)
_HAS_BLOCK = re.compile(rf"<(?:{_BLOCK})\b[^>]*>", re.I)
_MATH = re.compile(r"\$\$(.+?)\$\$|\\\((.+?)\\\)|\\\[(.+?)\\\]|<math\b[^>]*>(.+?)</math>", re.S)
_DOLLAR = re.compile(r"(?<![\w\\$])\$(?![\s$])([^$\n]+?)(?<![\s\\])\$(?![\w$])")
_LATEX = re.compile(r"\\(?:documentclass|begin\{|(?:sub)*section\*?\{|chapter\*?\{|item\b|textbf\{|emph\{|href\{|texttt\{)")
_WIKI = re.compile(r"^(={1,6})[^=\n].*?\1\s*$|'''?[^'\n]+'''?|\[\[|\{\{|<(?:math|syntaxhighlight|source|nowiki)\b|^#[^\n]*\n#", re.M)
_MARKDOWN = re.compile(r"^(?:#{2,6}\s|```|~~~|={4,}\s*$|-{4,}\s*$|[+-]\s|\d+[.)]\s)|\*\*[^*\n]+\*\*|\]\([^)\n]*\)|\$[^$\n]+\$", re.M)


#: A sibling of the best container is kept from this part of its score on, or with so much text of so low a link density.
SIBLING_SCORE, SIBLING_CHARS, SIBLING_DENSITY = 0.1, 80, 0.25


@dataclass
class Element:
    kind: str
    content: str


@dataclass
class Box:
    """A container: its elements and inner boxes in order, its score, and its text and link lengths."""

    parent: Box | None = None
    parts: list = field(default_factory=list)
    score: float = 0.0
    chars: int = 0
    linked: int = 0

    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


def squeeze(text: str) -> str:
    return " ".join(text.split())


class _Reader:
    def __init__(self) -> None:
        self.root = Box()
        self.box = self.root

    def add(self, kind: str, content: str) -> None:
        content = content.strip("\n") if kind == "code" else squeeze(content)
        if content.strip():
            self.box.parts.append(Element(kind, content))

    def points(self, text: str, linked: int = 0) -> None:
        """A paragraph's points go to its container, half of them to the one around it."""
        n = len(text)
        if not n:
            return
        gain = (1 + text.count(",") + min(n / 100, 3)) * (1 - min(linked / n, 1))
        at, part = self.box, 1.0
        while at is not None:
            at.chars += n
            at.linked += linked
            if part >= 0.5:
                at.score += gain * part
            at, part = at.parent, part / 2

    def formulas(self, text: str, dollars: bool) -> str:
        """Adds the formulas of ``text`` and gives the text with their sources in it."""

        def take(m: re.Match) -> str:
            source = next(g for g in m.groups() if g is not None)
            self.add("formula", source)
            return f" {squeeze(source)} "

        text = _MATH.sub(take, text)
        return _DOLLAR.sub(take, text) if dollars else text

    # -- text without HTML structure ----------------------------------------------------------------------

    def raw(self, text: str) -> None:
        if not text.strip():
            return
        if _LATEX.search(text):
            self.latex(text)
        elif _is_wiki(text):
            self.wiki(text)
        else:
            self.markdown(text)

    def paragraphs(self, lines: list[str]) -> None:
        for part in re.split(r"\n\s*\n", "\n".join(lines)):
            self.points(squeeze(part))

    def latex(self, text: str) -> None:
        text = re.sub(r"(?m)(?<!\\)%.*$", "", re.sub(r"\\begin\{(verbatim|lstlisting|minted)\}(?:\[[^\]]*\]|\{[^}]*\})*(.*?)\\end\{\1\}", self._code, text, flags=re.S))
        text = re.sub(r"\\begin\{(equation|displaymath|math|align|gather|eqnarray)(\*?)\}(.*?)\\end\{\1\2\}", lambda m: (self.add("formula", m.group(3)), " ")[1], text, flags=re.S)
        text = self.formulas(text, True)
        plain, at = [], 0
        for m in re.finditer(r"\\(?:(?:sub)*section|chapter|part|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?\{|\\item\b(?:\[[^\]]*\])?", text):
            if m.start() < at:
                continue
            plain.append(text[at : m.start()])
            if m.group(0).endswith("{"):
                inner, at = _braced(text, m.end())
                self.add("heading", latex_inline(inner))
            else:
                stop = re.compile(r"\\item\b|\\(?:begin|end)\{|\n\s*\n|\Z").search(text, m.end())
                inner, at = text[m.end() : stop.start()], stop.start()
                self.add("item", latex_inline(inner))
            self.points(squeeze(inner))
        plain.append(text[at:])
        self.paragraphs([latex_inline(p) for p in plain])

    def wiki(self, text: str) -> None:
        text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
        text = re.sub(r"<(syntaxhighlight|source|pre)\b[^>]*>(.*?)</\1>", self._code, text, flags=re.S | re.I)
        for _ in range(3):
            text = re.sub(r"\{\{[^{}]*\}\}", "", text)
        text = re.sub(r"\[\[(?:categoria|category|ficheiro|file|imagem|image)\s*:[^\]]*\]\]", "", text, flags=re.I)
        text = self.formulas(text, False)
        plain = []
        for line in text.split("\n"):
            if m := re.match(r"\s*(={1,6})\s*(.*?)\s*\1\s*$", line):
                self.add("heading", wiki_inline(m.group(2)))
            elif m := re.match(r"[*#;:]+\s*(.*)", line):
                self.add("item", wiki_inline(m.group(1)))
                self.points(squeeze(m.group(1)))
            else:
                plain.append(wiki_inline(line))
        self.paragraphs(plain)

    def markdown(self, text: str) -> None:
        text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
        text = re.sub(r"(?ms)^[ ]{0,3}(```+|~~~+)[^\n]*\n(.*?)^[ ]{0,3}\1[`~]*[ \t]*$", self._code, text)
        text = self.formulas(text, True)
        lines, plain, k = text.split("\n"), [], 0
        while k < len(lines):
            line = lines[k]
            below = lines[k + 1] if k + 1 < len(lines) else ""
            if m := re.match(r" {0,3}#{1,6}\s+(.*?)(?:\s+#+)?\s*$", line):
                self.add("heading", markdown_inline(m.group(1)))
            elif line.strip() and re.match(r" {0,3}(=+|-{2,})\s*$", below) and not re.match(r"\s*([*+-]|\d+[.)])\s", line):
                self.add("heading", markdown_inline(line))
                k += 1
            elif m := re.match(r"\s*(?:[*+-]|\d+[.)])\s+(.*)", line):
                item = m.group(1)
                while k + 1 < len(lines) and re.match(r"\s+\S", lines[k + 1]) and not re.match(r"\s*(?:[*+-]|\d+[.)])\s", lines[k + 1]):
                    k += 1
                    item += " " + lines[k].strip()
                self.add("item", markdown_inline(item))
                self.points(squeeze(item))
            else:
                plain.append(markdown_inline(line))
            k += 1
        self.paragraphs(plain)

    def _code(self, m: re.Match) -> str:
        self.add("code", m.group(2))
        return "\n\n"

    # -- HTML ---------------------------------------------------------------------------------------------

    def read(self, source: str) -> None:
        if not _HAS_BLOCK.search(source):
            self.raw(source)
            return
        loose: list[str] = []  # text right in a container
        held: list[str] = []  # text of the open heading, item or paragraph
        open_, linked, in_link, code = "", 0, False, None
        at = 0

        def flush() -> None:
            nonlocal open_, linked
            if open_:
                text = self.formulas(html.unescape("".join(held)), False)
                if open_ == "h":
                    self.add("heading", text)
                elif open_ == "li":
                    self.add("item", text)
                self.points(squeeze(text), linked)
            elif loose:
                self.raw(html.unescape("".join(loose)))
            held.clear()
            loose.clear()
            open_, linked = "", 0

        def put(text: str) -> None:
            nonlocal linked
            if code is not None:
                code.append(text)
            elif open_:
                held.append(text)
                linked += len(text) if in_link else 0
            else:
                loose.append(text)

        for m in _KNOWN.finditer(source):
            put(source[at : m.start()])
            at = m.end()
            if m.group(1):
                if m.group(1).lower() == "script" and "math/tex" in m.group(2).lower():
                    # The place of the formula in its text.
                    put(rf"\({m.group(3)}\)")
                continue
            if not m.group(5):
                continue
            tag, ending = m.group(5).lower(), bool(m.group(4))
            if code is not None:
                if tag == "pre" and ending:
                    self.add("code", html.unescape("".join(code)))
                    code = None
                continue
            if tag == "a":
                in_link = not ending
            elif tag == "br":
                put("\n")
            elif tag == "pre" and not ending:
                flush()
                code = []
            elif re.fullmatch(_BLOCK, tag):
                flush()
                if tag in ("div", "section", "article", "main", "aside", "nav", "header", "footer", "blockquote", "td", "ul", "ol", "table"):
                    if not ending:
                        inner = Box(self.box)
                        self.box.parts.append(inner)
                        self.box = inner
                    elif self.box.parent is not None:
                        self.box = self.box.parent
                elif not ending:
                    open_ = {"p": "p", "li": "li", "dt": "li", "dd": "li"}.get(tag, "h" if tag[0] == "h" and tag != "hr" else "")
        put(source[at:])
        if code is not None:
            self.add("code", html.unescape("".join(code)))
            code = None
        flush()


def _is_wiki(text: str) -> bool:
    return len(_WIKI.findall(text)) > 0 and not re.search(r"(?m)^(?:#{2,6}\s|```|~~~|={4,}\s*$|-{4,}\s*$)|\*\*[^*\n]+\*\*|\]\([^)\n]*\)", text)


def _braced(text: str, at: int) -> tuple[str, int]:
    """The text up to the brace that closes the one before ``at``, and where it goes on."""
    depth = 1
    for k in range(at, len(text)):
        if text[k] in "{}" and text[k - 1] != "\\":
            depth += 1 if text[k] == "{" else -1
            if not depth:
                return text[at:k], k + 1
    return text[at:], len(text)


def latex_inline(text: str) -> str:
    text = re.sub(r"\\href\s*\{[^{}]*\}", "", text)
    text = re.sub(r"\\(?:label|cite|ref|footnote|documentclass|usepackage|begin|end)\*?(?:\[[^\]]*\])?\{[^{}]*\}(?:\[[^\]]*\])?", "", text)
    for _ in range(4):
        text = re.sub(r"\\[a-zA-Z]+\*?\s*\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"(?<!\\)[{}]", "", text)
    text = re.sub(r"\\\\(?:\[[^\]]*\])?", " ", text)
    text = re.sub(r"\\textbackslash\b ?|\\ldots\b", lambda m: "\\" if "back" in m.group(0) else "…", text)
    text = text.replace("~", " ")
    return re.sub(r"\\([#$%&_{}^ ])", r"\1", text)


def wiki_inline(text: str) -> str:
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", text)
    text = re.sub(r"\[\w+://\S+\s+([^\]]+)\]", r"\1", text)
    text = re.sub(r"'{2,5}", "", text)
    return re.sub(r"</?(?:b|i|u|s|small|sub|sup|nowiki|ref|span)\b[^>]*>|<br\s*/?>", " ", text)


_ESCAPED = "\\`*_{}[]()#+-.!$<>~|\"'&"


def markdown_inline(text: str) -> str:
    text = re.sub(r"\\([\\`*_{}\[\]()#+\-.!$<>~|\"'&])", lambda m: chr(0xE000 + _ESCAPED.index(m.group(1))), text)
    text = re.sub(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)", r"\1", text)
    text = re.sub(r"!?\[([^\[\]]*)\]\[[^\[\]]*\]", r"\1", text)
    text = re.sub(r"(`+)(.+?)\1", r"\2", text)
    text = re.sub(r"\*\*(?=\S)(.+?)(?<=\S)\*\*|(?<!\w)__(?=\S)(.+?)(?<=\S)__(?!\w)", lambda m: m.group(1) or m.group(2), text)
    text = re.sub(r"\*(?=[^\s*])([^*\n]*?[^\s*])\*", r"\1", text)
    text = re.sub(r"(?<!\w)_(?=[^\s_])([^_\n]*?[^\s_])_(?!\w)", r"\1", text)
    text = re.sub(r"~~(.+?)~~", r"\1", text)
    text = re.sub(r"</?(?:b|i|u|s|em|strong|span|a|code|small|sub|sup|br)\b[^>]*>", "", text)
    return re.sub("[\ue000-\ue0ff]", lambda m: _ESCAPED[ord(m.group(0)) - 0xE000], text)


def elements(source: str | None) -> list[Element]:
    """The structural elements of a panel, in order: kind 'heading', 'item', 'code' or 'formula'."""
    if not source or not source.strip():
        return []
    reader = _Reader()
    reader.read(source)

    def boxes(box: Box) -> Iterator[Box]:
        yield box
        for p in box.parts:
            if isinstance(p, Box):
                yield from boxes(p)

    best = max(boxes(reader.root), key=lambda b: b.score)
    kept: list[Element] = []

    def keep(box: Box) -> None:
        for p in box.parts:
            if isinstance(p, Element):
                kept.append(p)
            elif p.density() < 0.5:
                keep(p)

    if best.parent is None:
        keep(best)
        return kept
    for p in best.parent.parts:
        if isinstance(p, Element):
            kept.append(p)
        elif p is best or p.score >= SIBLING_SCORE * best.score or (p.chars >= SIBLING_CHARS and p.density() < SIBLING_DENSITY):
            keep(p)
    return kept


def structure(items: DataFrame, key: str = "item_id", text: str = "html") -> DataFrame:
    """(key, element_no, kind, content): the structural elements of each panel.

    ``content`` is the text as a reader sees it; code keeps its line breaks. NULL and empty panels have no rows.
    Keys must be unique BIGINTs; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, e.kind, e.content) for k, t in zip(batch["key"], batch["text"], strict=True) for n, e in enumerate(elements(t))]
            yield pd.DataFrame(rows, columns=["key", "element_no", "kind", "content"])

    own = items.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return own.mapInPandas(run, "key BIGINT, element_no INT, kind STRING, content STRING").withColumnRenamed("key", key)
