"""A small tolerant HTML parser: block tree, text blocks and links. Pure Python, one pass."""

from __future__ import annotations

import html as _html
import re

# Which tags do what.
INLINE = frozenset("a abbr b big cite em font i label mark q s small span strong sub sup time tt u".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template title svg iframe select textarea".split())
# A start tag of the key ends open elements of the value, up to the nearest of the stops.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"})}
P_ENDERS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<![^>]*>|<\?[^>]*>|[^<]+|<", re.S)
_CLASS = re.compile(r"""\b(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


#: Elements below so many others count as children of the last one, so trees stay flat enough for recursion; no text is lost.
MOST_DEPTH = 120


class Node:
    __slots__ = ("label", "tag", "parent", "children", "blocks", "path", "depth", "mark", "shape", "size")

    def __init__(self, tag: str, label: str, parent: Node | None):
        self.tag, self.label, self.parent = tag, label, parent
        self.children: list[Node] = []
        self.blocks: list[Block] = []
        self.path = f"{parent.path}/{label}" if parent else label
        self.depth = parent.depth + 1 if parent else 0
        self.mark, self.shape, self.size = 0, 0, 1


class Block:
    """A run of text: collapsed text, the part of it in links, and the block-level element around it."""

    __slots__ = ("text", "linked", "node", "sig")

    def __init__(self, text: str, linked: int, node: Node):
        self.text, self.linked, self.node, self.sig = text, linked, node, 0


class Root(Node):
    """The page; ``title`` is the text of its title element."""

    __slots__ = ("title",)


def parse(source: str | None) -> tuple[Root, list[Block]]:
    """The root of the tree of block-level elements and all text blocks in order; a NULL text is an empty page."""
    root = Root("", "", None)
    root.title = ""
    node, blocks = root, []
    text: list[str] = []
    linked: list[str] = []
    in_link = breaks = 0
    skipping = ""

    def close() -> None:
        nonlocal breaks
        breaks = 0
        if text:
            whole = " ".join(_html.unescape("".join(text)).split())
            if whole:
                part = " ".join(_html.unescape("".join(linked)).split())
                block = Block(whole, len(part), node)
                node.blocks.append(block)
                blocks.append(block)
            text.clear()
            linked.clear()

    for m in _TOKEN.finditer(source or ""):
        tag = m.group(2)
        if tag is None:
            piece = m.group(0)
            if skipping or (piece[:2] in ("<!", "<?")):
                if skipping == "title":
                    root.title += piece
                continue
            if breaks and not piece.isspace():
                breaks = 0
            text.append(piece)
            if in_link:
                linked.append(piece)
            continue
        tag, ending = tag.lower(), bool(m.group(1))
        if skipping:
            if ending and tag == skipping:
                skipping = ""
            continue
        if tag in SKIP:
            if not ending:
                close()
                skipping = tag
            continue
        if tag == "br":
            breaks += 1
            text.append(" ")
            if breaks >= 2:
                close()
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if ending else 1
                linked.append(" ")
            continue
        close()
        in_link = 0 if tag != "img" else in_link
        if tag in VOID:
            continue
        if ending:
            at = node
            while at is not None and at.tag != tag:
                at = at.parent
            if at is not None and at.parent is not None:
                node = at.parent
            continue
        if tag in P_ENDERS and node.tag == "p":
            node = node.parent
        if tag in ENDS:
            ends, stops = ENDS[tag]
            at = node
            while at is not None and at.tag not in ends and at.tag not in stops:
                at = at.parent
            if at is not None and at.tag in ends:
                node = at.parent
        label = tag
        for name, *values in _CLASS.findall(m.group(3)):
            value = re.sub(r"\d+", "0", next((v for v in values if v), ""))
            label += ("." if name.lower() == "class" else "#") + value
        if node.depth >= MOST_DEPTH:
            node = node.parent
        child = Node(tag, label, node)
        node.children.append(child)
        node = child
    close()
    return root, blocks
