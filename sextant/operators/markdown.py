"""Markdown sections: a block reader for the CommonMark subset that decides sections.

Read are ATX and setext headings, fenced and indented code, lists, block quotes, rules
and paragraphs; inline marks are dropped from the text. Headings inside lists and quotes
do not part sections.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
BULLET = re.compile(r" {0,3}(?:[-*+]|\d{1,9}[.)])(?:[ \t]+|$)")
INLINE = (
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"),
    (re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"),
    (re.compile(r"<(https?://[^>\s]+)>"), r"\1"),
    (re.compile(r"(`+)(.+?)\1"), r"\2"),
    (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), r"\2"),
    (re.compile(r"(?<![\w*])\*(?=\S)(.+?)(?<=\S)\*(?![\w*])"), r"\1"),
    (re.compile(r"(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)"), r"\1"),
    (re.compile(r"\\([!-/:-@\[-`{-~])"), r"\1"),
)


def inline(text: str) -> str:
    for pattern, put in INLINE:
        text = pattern.sub(put, text)
    return text


def nodes(content: str) -> list[tuple[str, str]]:
    """Top-level blocks as (kind, text): heading or other."""
    out: list[tuple[str, str]] = []
    para: list[str] = []
    lines = content.replace("\r\n", "\n").replace("\r", "\n").split("\n")

    def flush() -> None:
        if para:
            out.append(("paragraph", inline("\n".join(x.strip() for x in para))))
            para.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        fence = FENCE.match(line)
        if fence and not (fence[1][0] == "`" and "`" in fence[2]):
            flush()
            mark, body = fence[1], []
            i += 1
            while i < len(lines) and not re.match(r" {0,3}%s{%d,}[ \t]*$" % (re.escape(mark[0]), len(mark)), lines[i]):
                body.append(lines[i])
                i += 1
            out.append(("code", "\n".join(body)))
        elif m := ATX.match(line):
            flush()
            out.append(("heading", inline((m[2] or "").strip())))
        elif para and SETEXT.match(line):
            text = inline("\n".join(x.strip() for x in para))
            para.clear()
            out.append(("heading", text))
        elif RULE.match(line):
            flush()
            out.append(("rule", ""))
        elif BULLET.match(line) and not (para and not BULLET.match(line)[0].strip()):
            flush()
            items = []
            while i < len(lines) and (BULLET.match(lines[i]) or lines[i].startswith(("  ", "\t")) or (not lines[i].strip() and i + 1 < len(lines) and (BULLET.match(lines[i + 1]) or lines[i + 1].startswith(("  ", "\t")))) or lines[i].strip() and items and items[-1].strip() and not ATX.match(lines[i]) and not FENCE.match(lines[i])):
                items.append(lines[i])
                i += 1
            out.append(("list", inline("\n".join(BULLET.sub("", x).strip() for x in items if x.strip()))))
            continue
        elif line.lstrip().startswith(">") and len(line) - len(line.lstrip()) <= 3:
            flush()
            quoted = []
            while i < len(lines) and lines[i].strip():
                quoted.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                i += 1
            out.append(("quote", inline("\n".join(quoted))))
            continue
        elif not para and line.startswith(("    ", "\t")) and line.strip():
            body = []
            while i < len(lines) and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                body.append(lines[i][4:] if lines[i].startswith("    ") else lines[i][1:])
                i += 1
            out.append(("code", "\n".join(body).rstrip("\n")))
            continue
        elif not line.strip():
            flush()
        else:
            para.append(line)
        i += 1
    flush()
    return out


def sections(content: str | None) -> list[tuple[str | None, str]]:
    """(heading, text) of each section; a preamble has heading None; blank ones are dropped.

    Without any section that has text there is one (None, whole text).
    """
    found: list[tuple[str | None, list[str]]] = []
    blocks = nodes(content or "")
    for kind, text in blocks:
        if kind == "heading":
            found.append((text, []))
        elif found:
            found[-1][1].append(text)
        else:
            found.append((None, [text]))
    out = [(h, "\n\n".join(b).strip()) for h, b in found]
    out = [(h, t) for h, t in out if t]
    return out or [(None, "\n\n".join(t for _, t in blocks).strip())]


def pack(text: str, most: int = 4000) -> list[str]:
    """Texts of at most most characters whole, longer ones packed greedily from paragraphs; a longer paragraph stays whole."""
    if len(text) <= most:
        return [text]
    out, current = [], ""
    for p in re.split(r"\n\n+", text):
        if current and len(current) + len(p) + 2 > most:
            out.append(current.strip())
            current = ""
        current = f"{current}\n\n{p}" if current else p
    if current:
        out.append(current.strip())
    return out


def packed(rows: DataFrame, most: int = 4000) -> DataFrame:
    """seq, part, text: the packed pieces of each (seq, text), from part 0; null texts give none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(seq, n, piece) for seq, text in zip(pdf["seq"], pdf["text"]) for n, piece in enumerate(pack(text, most))], columns=["seq", "part", "text"])

    return rows.filter("text is not null").select("seq", "text").mapInPandas(work, "seq long, part int, text string")


def slug(heading: str | None) -> str:
    if heading is None or not heading.strip():
        return "body"
    return re.sub(r"^-|-$", "", re.sub(r"[^a-z0-9]+", "-", heading.lower()))
