"""Splitting oversized texts at natural boundaries by packing their structure tree.

A text becomes a tree: sections by heading level, blocks between blank lines (fenced
code is one block), list items by indentation, lines, sentences, words, single characters.
Only nodes that do not fit are opened; what they were opened into is merged again bottom-up,
neighbour with neighbour, as long as it fits.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 200
#: A piece before the last has at least this part of the room, if some cut allows it.
LEAST = 0.1
HEADING = re.compile(r"(#{1,6})[ \t]+\S")
UNDERLINE = re.compile(r"(=+|-+)[ \t]*\r?$")
ITEM = re.compile(r"^([ \t]*)(?:[-*+]|\d+[.)])[ \t]+", re.MULTILINE)
LINE = re.compile("\n")
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+")
WORD = re.compile(r"\s+")


@dataclass
class Node:
    kind: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    number: int = 0
    level: int = 0


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of the blocks: runs of lines parted by lines of white space, blank lines inside fences not parting."""
    found: list[tuple[int, int]] = []
    start, fenced, pos = -1, False, 0
    for line in text.split("\n"):
        end = pos + len(line)
        if line.startswith("```"):
            fenced = not fenced
            if start < 0:
                start = pos
        elif not line.strip() and not fenced:
            if start >= 0:
                found.append((start, pos))
                start = -1
        elif start < 0 and line.strip():
            start = pos
        pos = end + 1
    if start >= 0:
        found.append((start, len(text)))
    return found


def tree(text: str) -> Node:
    """The structure of a text down to its blocks; opened blocks get their parts on demand."""
    root = Node("root", 0, len(text))
    spans = blocks(text)
    path = [root]
    for n, (start, end) in enumerate(spans, 1):
        upto = spans[n][0] if n < len(spans) else len(text)
        node = Node("block", 0 if n == 1 else start, upto, number=n)
        first, _, rest = text[start:end].partition("\n")
        level = 0
        if m := HEADING.match(first):
            level = len(m[1])
        elif first.strip() and not first.startswith("```") and (m := UNDERLINE.match(rest.partition("\n")[0])):
            level = 1 if m[1][0] == "=" else 2
        if level:
            while path[-1].level >= level:
                path.pop()
            section = Node("section", node.start, node.end, level=level)
            path[-1].children.append(section)
            path.append(section)
        path[-1].children.append(node)
        for open_ in path:
            open_.end = node.end
    root.end = len(text)
    return root


def _items(text: str, block: Node) -> list[Node]:
    """The list items of a block as a tree by indentation, and what stands before the first; empty without two items."""
    found = [(m.start(), len(m[1].expandtabs(4))) for m in ITEM.finditer(text, block.start, block.end)]
    if len(found) < 2 or text.startswith("```", block.start):
        return []
    top = Node("block", block.start, block.end)
    path = [(-1, top)]
    for at, indent in found:
        while path[-1][0] >= indent:
            path.pop()[1].end = at
        parent = path[-1][1]
        if not parent.children and at > parent.start:
            parent.children.append(Node("item", parent.start, at))
        item = Node("item", at, block.end)
        parent.children.append(item)
        path.append((indent, item))
    return top.children


BOUNDARIES = {"item": LINE, "line": SENTENCE, "sentence": WORD}
BELOW = {"block": "item", "item": "line", "line": "sentence", "sentence": "word"}


def _parts(node: Node, text: str, room: int) -> list[Node]:
    """What a node that does not fit is opened into."""
    if node.kind == "word":  # nothing natural is left
        return [Node("char", a, min(a + room, node.end)) for a in range(node.start, node.end, room)]
    children = node.children or (_items(text, node) if node.kind == "block" else [])
    if children:
        return children
    kind = "item" if node.kind == "block" else node.kind
    edges = [x for m in BOUNDARIES[kind].finditer(text, node.start, node.end) if node.start < (x := m.end()) < node.end]
    edges = [node.start, *edges, node.end]
    return [Node(BELOW[kind], x, y) for x, y in zip(edges, edges[1:])]


def _merged(spans: list[tuple[int, int]], fits) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and fits(out[-1][0], b):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _cut_between(text: str, starts: list[int], low: int, high: int) -> int:
    """The most natural offset in [low, high] to cut at, of equal ones the nearest to the middle."""
    middle = (low + high) / 2
    inside = starts[bisect_left(starts, low) : bisect_right(starts, high)]
    for pattern in (None, LINE, SENTENCE, WORD):
        if pattern is not None:
            inside = [x for m in pattern.finditer(text, max(0, low - 1), high) if low <= (x := m.end()) <= high]
        if inside:
            return min(inside, key=lambda x: abs(x - middle))
    return int(middle)


def pack(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int]], list[Node]]:
    """Spans that part the text, and the nodes that had to be opened, in the order of opening.

    The first span has at most limit characters, the others overlap fewer, so that with the
    overlap before them they keep the limit: a node of a size between both is opened too
    unless it begins the text.
    """
    room = limit - overlap
    fits = lambda a, b: b - a <= (limit if a == 0 else room)
    root, opened = tree(text), []
    done: list[tuple[int, int]] = []
    frames: list[tuple[Iterator[Node], list[tuple[int, int]]]] = [(iter([root]), done)]
    while frames:  # post-order with an own stack, as lists may be nested to any depth
        children, spans = frames[-1]
        node = next(children, None)
        if node is None:
            frames.pop()
            if frames:
                frames[-1][1].extend(_merged(spans, fits))
        elif fits(node.start, node.end):
            spans.append((node.start, node.end))
        else:
            opened.append(node)
            frames.append((iter(_parts(node, text, room)), []))
    # Small pieces that fit neither neighbour share with the next one.
    starts = [a for a, _ in blocks(text)]
    least = int(LEAST * room)
    for n in range(len(done) - 1):
        (a, b), (_, d) = done[n], done[n + 1]
        if b - a < least:
            low, high = max(a + least, d - room), min(d - 1, a + (limit if a == 0 else room), d - least)
            if low <= high:
                cut = _cut_between(text, starts, low, high)
                done[n], done[n + 1] = (a, cut), (cut, d)
    return done, opened


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of the pieces; each but the first begins overlap characters before the end of the one before."""
    body = text.strip()
    if len(body) <= limit:
        return [(0, len(body))] if body else []
    return [(max(0, a - overlap), b) for a, b in pack(body, limit, overlap)[0]]


def oversized(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Of the nodes the packer opened those that exceed the limit without white space at their ends: 0 for the whole text, n for its n-th block."""
    body = text.strip()
    if len(body) <= limit:
        return []
    opened = [x for x in pack(body, limit, overlap)[1] if x.kind in ("root", "block")]
    return sorted(x.number for x in opened if len(body[x.start : x.end].strip()) > limit)


def _long(rows: DataFrame, limit: int) -> DataFrame:
    """Only these rows reach Python: the others are at most limit characters before trimming."""
    return rows.filter(F.length("text") > limit)


def split_texts(rows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """seq, section, piece_no, n_pieces, begins, text of every piece of each text over the limit.

    Texts of at most limit characters (trimmed), null and empty texts give no rows. begins
    is the offset in the trimmed text; leaving out each piece's overlap restores that text.
    Equal rows give equal pieces each. limit must exceed overlap.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for seq, section, text in zip(pdf["seq"], pdf["section"], pdf["text"]):
                body = text.strip()
                if len(body) > limit:
                    spans = pieces(body, limit, overlap)
                    out += [(seq, section, n, len(spans), a, body[a:b]) for n, (a, b) in enumerate(spans, 1)]
            yield pd.DataFrame(out, columns=["seq", "section", "piece_no", "n_pieces", "begins", "text"])

    return _long(rows, limit).select("seq", "section", "text").mapInPandas(cut, "seq long, section string, piece_no int, n_pieces int, begins int, text string")


def oversized_nodes(rows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """seq, block_no of the texts (0) and blocks (n, from 1) over the limit, trimmed, that the packer of split_texts had to open.

    Every block over the limit is among them. Null, empty and shorter texts give no rows, equal rows the same each.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(seq, n) for seq, text in zip(pdf["seq"], pdf["text"]) for n in oversized(text, limit, overlap)]
            yield pd.DataFrame(out, columns=["seq", "block_no"])

    return _long(rows, limit).select("seq", "text").mapInPandas(find, "seq long, block_no long")
