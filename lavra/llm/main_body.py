"""Problem 4: the main body of each page, by wrapper induction.

Pages of a host are aligned pair by pair, in groups of bounded size, with simple tree matching; equal subtrees match as they
are. Nodes whose text stays the same in aligned pages are template; containers of headings in which text varies are content
slots. The votes of all pairs are added up over all pages into a wrapper for each host (its slots and its template
texts) and, for texts that many hosts have, one list for all. Then each page is read with its host's wrapper: the title is
the first heading that is no template, the body what its slot holds and is no template. A host whose pages agree in everything
has no slot and no content.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm.dom import Block, Node, Root, parse
from lavra.operators.skew import join_counted
from lavra.session import Scratch

#: Pages of a host are aligned within groups of about so many.
GROUP_PAGES = 48
#: Each page is aligned with so many others of its group.
PAIRS = 3
#: A text is template if so many of the pairs of its pages agree in it, and at least LEAST of them.
SHARE, LEAST = 0.04, 3
#: A template text stands in at least one of so many of the host's pages, so a host has at most as many times the texts of a page.
HOST_PART = 200
#: Hosts with fewer pages can't be aligned; their pages are read from the container of the title heading.
ALIGNED = 4
#: Of child lists with more pairs than this not all rows of the table are kept; those between are computed again.
CELLS = 40_000
#: Against lists of so many children or more, a row of the table is computed at once.
WIDE = 64
# The month names, which stand for any month in a text's signature.
_MONTH = re.compile(r"\b(janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)\b", re.I)
_WORD = re.compile(r"[^\W\d_]{3,}")


@lru_cache(maxsize=1 << 14)
def signature(text: str) -> int:
    """A hash of a block's text; numbers and months count as equal where three words are left besides them."""
    masked = _MONTH.sub("#", re.sub(r"\d+", "0", text))
    if len(_WORD.findall(masked)) < 3:
        masked = text
    return int.from_bytes(hashlib.blake2b(masked.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def mark(root: Node) -> None:
    """Gives each block its signature, and each node its size and hashes of all that is below it and of the labels alone."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(node.children)
    for node in reversed(order):
        for b in node.blocks:
            b.sig = signature(b.text)
        node.size = 1 + sum(c.size for c in node.children)
        node.shape = hash((node.label, tuple(c.shape for c in node.children)))
        node.mark = hash((node.label, tuple(b.sig for b in node.blocks), tuple(c.mark for c in node.children)))


class TreeMatch:
    """The largest order-keeping match of two marked trees with equal labels (simple tree matching).

    The weight of a match depends on the labels alone, so it is computed once for each two shapes.
    """

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], int] = {}

    def weight(self, a: Node, b: Node) -> int:
        if a.label != b.label:
            return 0
        if a.shape == b.shape:
            return a.size
        key = (a.shape, b.shape)
        if key not in self.known:
            self.known[key] = 1 + self._most(a.children, b.children)
        return self.known[key]

    def _most(self, x: list[Node], y: list[Node]) -> int:
        low, end = _same_ends([n.shape for n in x], [n.shape for n in y])
        same = sum(n.size for n in x[:low]) + sum(n.size for n in x[len(x) - end :])
        row = [0]
        for row in self._rows(x[low : len(x) - end], y[low : len(y) - end]):
            pass
        return same + int(row[-1])

    def _children(self, x: list[Node], y: list[Node]) -> list[tuple[Node, Node]]:
        low, end = _same_ends([n.mark for n in x], [n.mark for n in y])
        pairs = [*zip(x[:low], y[:low], strict=True), *zip(x[len(x) - end :], y[len(y) - end :], strict=True)]
        return pairs + self._best(x[low : len(x) - end], y[low : len(y) - end])

    def _rows(self, x: list[Node], y: list[Node], row=None) -> Iterator:
        """The rows of the table of best weights, one for each of ``x``, after ``row``."""
        if len(y) < WIDE:
            row = [0] * (len(y) + 1) if row is None else row
            for p in x:
                above, row = row, [0]
                for j, q in enumerate(y):
                    row.append(max(row[j], above[j + 1], above[j] + self.weight(p, q)))
                yield row
            return
        kinds = {q.shape: q for q in y}
        place = {s: k for k, s in enumerate(kinds)}
        at = np.array([place[q.shape] for q in y])
        weights: dict[int, np.ndarray] = {}
        row = np.zeros(len(y) + 1, dtype=np.int64) if row is None else row
        for p in x:
            if p.shape not in weights:
                weights[p.shape] = np.array([self.weight(p, q) for q in kinds.values()])
            above, row = row, np.zeros(len(y) + 1, dtype=np.int64)
            np.maximum.accumulate(np.maximum(above[1:], above[:-1] + weights[p.shape][at]), out=row[1:])
            yield row

    def _best(self, x: list[Node], y: list[Node]) -> list[tuple[Node, Node]]:
        step = len(x) if len(x) * len(y) <= CELLS else isqrt(len(x)) + 1
        kept = {0: None}
        if step < len(x):
            kept |= {i: row for i, row in enumerate(self._rows(x, y), 1) if i % step == 0}
        pairs, i, j = [], len(x), len(y)
        while i and j:
            low = (i - 1) // step * step
            rows = [[0] * (len(y) + 1) if kept[low] is None else kept[low], *self._rows(x[low:i], y, kept[low])]
            while i > low and j:
                w, here, above = self.weight(x[i - 1], y[j - 1]), rows[i - low], rows[i - low - 1]
                if w and here[j] == above[j - 1] + w:
                    pairs.append((x[i - 1], y[j - 1]))
                    i, j = i - 1, j - 1
                elif here[j] == above[j]:
                    i -= 1
                else:
                    j -= 1
        return pairs

    def pairs(self, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        """The matched nodes; of equal subtrees only the roots."""
        stack = [(a, b)]
        while stack:
            p, q = stack.pop()
            yield p, q
            if p.mark != q.mark:
                stack.extend(self._children(p.children, q.children))


def _same_ends(x: list[int], y: list[int]) -> tuple[int, int]:
    """How many numbers are equal at the start, and of the rest at the end."""
    low, top = 0, min(len(x), len(y))
    while low < top and x[low] == y[low]:
        low += 1
    end = 0
    while end < top - low and x[-1 - end] == y[-1 - end]:
        end += 1
    return low, end


def headings(root: Root, blocks: list[Block]) -> list[Block]:
    """What may be the title heading: every h1, then every lower heading that the page's title begins with."""
    title = " ".join(html.unescape(root.title).split())
    first = [b for b in blocks if b.node.tag == "h1"]
    return first + [b for b in blocks if b.node.tag in ("h2", "h3", "h4") and len(b.text) > 3 and title.startswith(b.text)]


def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas over whole groups (source, group, page_id, html), sorted: votes for texts and for slots.

    Rows: kind 't' (text signature in ``sig``) or 's' (path of a heading's container); pages that have it, pairs that
    agree in it (texts), and the length of text that varies in it (slots).
    """
    for pages in _groups(batches):
        source = pages[0][0]
        read = [parse(h) for _, h in pages]
        heads = [headings(r, b) for r, b in read]
        texts: Counter = Counter()
        agree: Counter = Counter()
        slots: Counter = Counter()
        vary: Counter = Counter()
        for (root, blocks), found in zip(read, heads, strict=True):
            mark(root)
            texts.update({b.sig for b in blocks})
            slots.update({b.node.parent.path for b in found})
        for k in range(len(read)):
            for step in range(1, min(PAIRS, len(read) - 1) + 1):
                other = (k + step * step) % len(read)
                a, b = ([x.text for x in heads[i]] for i in (k, other))
                if other == k or (a and a == b):
                    continue  # the page itself, or the same page crawled twice
                same: set[int] = set()
                for p, q in TreeMatch().pairs(read[k][0], read[other][0]):
                    if p.mark == q.mark:
                        same.update(x.sig for n in _below(p) for x in n.blocks)
                        continue
                    theirs = {x.sig for x in q.blocks}
                    for x in p.blocks:
                        if x.sig in theirs:
                            same.add(x.sig)
                        elif p.parent is not None and p.parent.path in slots:
                            vary[p.parent.path] += len(x.text) - x.linked
                agree.update(same)
        rows = [(source, "t", s, "", n, agree[s], 0) for s, n in texts.items()]
        rows += [(source, "s", 0, p, n, 0, vary[p]) for p, n in slots.items()]
        yield pd.DataFrame(rows, columns=["source", "kind", "sig", "path", "pages", "agree", "length"])


def _below(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        at = stack.pop()
        yield at
        stack.extend(at.children)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[str, str]]]:
    now, pages = None, []
    for batch in batches:
        for source, group, text in zip(batch["source"], batch["group"], batch["html"], strict=True):
            if (source, group) != now:
                if pages:
                    yield pages
                now, pages = (source, group), []
            pages.append((source, text))
    if pages:
        yield pages


def _all_links(root: Node) -> set[int]:
    """The ids of nodes below which all text is link text, give or take separators."""
    sums: dict[int, tuple[int, int]] = {}
    for node in reversed(list(_below(root))):
        chars, linked = sum(len(b.text) for b in node.blocks), sum(b.linked for b in node.blocks)
        for c in node.children:
            chars, linked = chars + sums[id(c)][0], linked + sums[id(c)][1]
        sums[id(node)] = chars, linked
    return {k for k, (chars, linked) in sums.items() if chars and linked >= 0.95 * chars}


def main_blocks(page: str | None, slots: set[str] | None, template) -> list[str]:
    """The texts of the main body's blocks, in order. ``slots`` is NULL for a host that couldn't be aligned."""
    root, blocks = parse(page)
    known = {b.text: signature(b.text) in template for b in blocks}
    found = [b for b in headings(root, blocks) if not known[b.text]]
    head, container = None, None
    if slots is not None:
        for b in found:
            at: Node | None = b.node.parent
            while at is not None and at.path not in slots:
                at = at.parent
            if at is not None:
                head, container = b, at
                break
        if container is None and slots and not found:
            container = next((n for n in _below_in_order(root) if n.path in slots), None)
    if container is None and found and (slots is None or slots):
        # A host that couldn't be aligned, or a layout that it has rarely.
        head, container = found[0], found[0].node.parent
    if container is None:
        return []
    links, inside = _all_links(root), []
    for b in blocks:
        at, held, linky = b.node, False, False
        while at is not None:
            if at is container:
                held = True
                break
            linky = linky or (at.tag in ("ul", "ol", "div", "nav", "section", "aside") and id(at) in links)
            at = at.parent
        if held and not linky and not known[b.text]:
            inside.append(b)
    if head is None and not any(len(b.text) - b.linked >= 80 for b in inside):
        return []  # no running text: a list of links, or a bread crumb in a slot of the same path
    return [b.text for b in inside]


def _below_in_order(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        at = stack.pop()
        yield at
        stack.extend(reversed(at.children))


def extract(shared: list[int]):
    """mapInPandas over groups, each a row with the host's wrapper (no html) and then its pages: (page_id, block_no, block)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = frozenset(shared)
        slots, template = None, common
        for batch in batches:
            rows = []
            for page, text, own, fixed in zip(batch["page_id"], batch["html"], batch["slots"], batch["template"], strict=True):
                if text is None:
                    slots = set(own.tolist()) if own is not None else None
                    template = common.union(fixed.tolist() if fixed is not None else ())
                else:
                    rows += [(page, k, b) for k, b in enumerate(main_blocks(text, slots, template))]
            yield pd.DataFrame(rows, columns=["page_id", "block_no", "block"])

    return run


def main_bodies(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, block): the main body of each page, block by block.

    Pages with NULL or empty html, and pages that are only lists of links, have no rows. Pages of a NULL source are one more
    host. The template texts that all pages share (those of at least 1 % of all hosts, so at most a hundred times those of an average
    host) are the only thing sent to every task. page_id must be unique; other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "pages")
    own = pages.where(F.length("html") > 0).select("page_id", F.coalesce("source", F.lit("")).alias("source"), "html")
    hosts = scratch.write(own.groupBy("source").agg(F.count("*").alias("n")), "hosts")
    parts = F.ceil(F.col("n") / GROUP_PAGES)
    sized = join_counted(own, hosts, ["source"], "n", ["page_id"]).withColumn("group", F.pmod(F.xxhash64("page_id"), parts)).drop("n")
    grouped = sized.repartition("source", "group").sortWithinPartitions("source", "group", "page_id")
    kind = "source STRING, kind STRING, sig BIGINT, path STRING, pages BIGINT, agree BIGINT, length BIGINT"
    counted = grouped.select("source", "group", "html").mapInPandas(votes, kind)
    counted = counted.groupBy("source", "kind", "sig", "path").agg(*[F.sum(c).alias(c) for c in ("pages", "agree", "length")])
    counted = scratch.write(counted.where("kind = 's' OR agree > 0 OR pages > 1"), "votes")
    fixed = (F.col("agree") >= LEAST) & (F.col("agree") >= SHARE * PAIRS * F.col("pages"))
    texts = counted.where("kind = 't'").join(hosts, "source")
    number = hosts.count()
    shared = texts.groupBy("sig").agg(F.count("*").alias("hosts"), F.sum("agree").alias("agree"), F.sum("pages").alias("pages"))
    shared = shared.where((F.col("hosts") >= max(3, number / 100)) & fixed)
    shared = [r.sig for r in shared.select("sig").collect()]
    own_texts = texts.where(fixed & (F.col("pages") * HOST_PART >= F.col("n")))
    templates = own_texts.groupBy("source").agg(F.collect_list("sig").alias("template"))
    # Content slots: containers of headings in which text varies, with a twentieth of the host's headings or more, so at most twenty.
    slots = counted.where("kind = 's'").join(counted.where("kind = 's'").groupBy("source").agg(F.sum("pages").alias("all")), "source")
    slots = slots.where((F.col("pages") >= 0.05 * F.col("all")) & (F.col("length") > 0)).groupBy("source").agg(F.collect_list("path").alias("slots"))
    wrappers = hosts.join(templates, "source", "left").join(slots, "source", "left")
    none = F.array().cast("array<string>")
    wrappers = wrappers.withColumn("slots", F.when(F.col("n") >= ALIGNED, F.coalesce("slots", none)))
    wrappers = scratch.write(wrappers.select("source", "slots", "template", parts.alias("parts")), "wrappers")
    # Each group of a host's pages comes with the wrapper once, before its pages.
    firsts = wrappers.select(
        "source", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("group"), F.lit(None).cast("bigint").alias("page_id"), F.lit(None).cast("string").alias("html"), "slots", "template"
    )
    pages_of = sized.select("source", "group", F.col("page_id").cast("bigint").alias("page_id"), "html", F.lit(None).cast("array<string>").alias("slots"), F.lit(None).cast("array<bigint>").alias("template"))
    read = firsts.union(pages_of).repartition("source", "group").sortWithinPartitions("source", "group", F.col("html").isNotNull(), "page_id")
    read = read.select(F.coalesce("page_id", F.lit(-1)).alias("page_id"), "html", "slots", "template")
    return read.mapInPandas(extract(shared), "page_id BIGINT, block_no INT, block STRING")
