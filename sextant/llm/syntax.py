"""Source files that do not parse: lexers with pushdown stacks, one per language.

Every lexer reads the text once, keeps a stack of open delimiters (and for Python the
indentation), and names the first fault: unterminated_literal, unbalanced_delimiter,
premature_end, merge_conflict, bad_literal, stray_character, nesting (deeper than a parser
of the language follows) or grammar. JSON and Java are decided by these automata alone. YAML
and Python files that their lexers let pass then get an exact check by the YAML event parser
and the interpreter's own grammar.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm import java_grammar
from sextant.llm.java_grammar import CLOSES, MARKER, Rejected

try:
    import yaml
except ImportError:  # then only the YAML lexer decides
    yaml = None

# File extensions and the language each one names.
EXTENSIONS = {"java": "java", "yaml": "yaml", "yml": "yaml", "json": "json", "py": "python", "md": "markdown", "markdown": "markdown"}
# Other spellings of the language labels.
LABELS = {"java": "java", "yaml": "yaml", "yml": "yaml", "json": "json", "python": "python", "py": "python", "python3": "python", "md": "markdown", "markdown": "markdown"}


def language(path: Column, label: Column) -> Column:
    """The language of a row: what the extension of its path names, else its label, else null."""

    def lookup(key: Column, names: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key]

    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(lookup(extension, EXTENSIONS), lookup(F.lower(F.trim(label)), LABELS))


# ---------------------------------------------------------------- JSON
JSON_TOKEN = re.compile(
    r"[ \t\n\r]*(?:(?P<mark>[{}\[\],:])"
    r'|(?P<str>"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*")'
    r"|(?P<num>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![0-9A-Za-z_.+-])"
    r"|(?P<name>(?:true|false|null)(?![0-9A-Za-z_])))"
)


def check_json(text: str) -> tuple[str, int] | None:
    stack: list[str] = []
    state, pos = "value", 0
    while True:
        m = JSON_TOKEN.match(text, pos)
        if m is None:
            at = pos + len(text[pos:]) - len(text[pos:].lstrip(" \t\n\r"))
            if at == len(text):
                return None if state == "end" else ("premature_end", at)
            if text[at] == '"':
                return "unterminated_literal", at
            return ("merge_conflict" if MARKER.match(text, at) else "stray_character"), at
        tok, kind, at, pos = m.group(m.lastgroup), m.lastgroup, m.start(m.lastgroup), m.end()
        if kind != "mark":
            if state in ("key", "key or end") and kind == "str":
                state = "colon"
            elif state in ("value", "value or end"):
                state = "more" if stack else "end"
            else:
                return "grammar", at
        elif tok in "{[":
            if state not in ("value", "value or end"):
                return "grammar", at
            stack.append(tok)
            state = "key or end" if tok == "{" else "value or end"
        elif tok in "}]":
            if not stack or stack[-1] != CLOSES[tok]:
                return "unbalanced_delimiter", at
            if state not in ("more", "key or end", "value or end"):
                return "grammar", at
            stack.pop()
            state = "more" if stack else "end"
        elif tok == ":" and state == "colon":
            state = "value"
        elif tok == "," and state == "more":
            state = "key" if stack[-1] == "{" else "value"
        else:
            return "grammar", at


# ---------------------------------------------------------------- Python
PY_STRING = re.compile(r"([rRbBuUfF]{0,2})('''|\"\"\"|'|\")")
PY_PLAIN = re.compile(r"[^\W\d]\w*|[0-9][\w.]*|[^\S\n]+|[^\s\w'\"#()\[\]{}\\\n]+")


def _py_string(text: str, pos: int, quote: str, formatted: bool) -> int:
    """The offset behind a string whose body begins at pos; f-string fields are read as code."""
    n = len(text)
    while pos < n:
        ch = text[pos]
        if ch == "\\":
            pos += 2
        elif text.startswith(quote, pos):
            return pos + len(quote)
        elif ch == "\n" and len(quote) == 1:
            break
        elif formatted and ch == "{":
            pos = pos + 2 if text.startswith("{{", pos) else _py_field(text, pos + 1, quote)
        else:
            pos += 1
    raise Rejected("unterminated_literal", min(pos, n))


def _py_field(text: str, pos: int, quote: str) -> int:
    """The offset behind a replacement field; its format part may hold fields again."""
    stack: list[str] = []
    while pos < len(text):
        ch = text[pos]
        if ch in "([{":
            stack.append(ch)
            pos += 1
        elif ch in ")]}":
            if not stack:
                if ch == "}":
                    return pos + 1
                raise Rejected("unbalanced_delimiter", pos)
            if stack.pop() != CLOSES[ch]:
                raise Rejected("unbalanced_delimiter", pos)
            pos += 1
        elif ch in "'\"":
            m = PY_STRING.match(text, pos)
            pos = _py_string(text, m.end(), m[2], False)
        elif (m := PY_STRING.match(text, pos)) and m[1] and not (text[pos - 1].isalnum() or text[pos - 1] == "_"):
            pos = _py_string(text, m.end(), m[2], "f" in m[1].lower())
        elif ch == ":" and not stack:
            pos += 1
            while pos < len(text) and text[pos] != "}":
                if text.startswith(quote, pos):
                    raise Rejected("unterminated_literal", pos)
                pos = _py_field(text, pos + 1, quote) if text[pos] == "{" else pos + 1
            if pos < len(text):
                return pos + 1
        else:
            pos += 1
    raise Rejected("unterminated_literal", len(text))


PY_INDENT = re.compile(r"[ \t\f]*")
PY_HEADER = re.compile(r"(?:async[ \t]+)?def[ \t]+[^\W\d]\w*[ \t]*(?![(\[\w \t\\])|class[ \t]+[^\W\d]\w*[ \t]*(?![(\[:\w \t\\])")


def _python_lexer(text: str) -> None:
    stack: list[tuple[str, int]] = []
    indents = [(0, 0)]  # columns with tabs to the next eighth, and with tabs as one
    pos, n, fresh, last = 0, len(text), True, ""
    while pos < n:
        if fresh and MARKER.match(text, pos):  # no line of a statement or between brackets begins so
            raise Rejected("merge_conflict", pos)
        if fresh and not stack:
            line = PY_INDENT.match(text, pos)
            body = text[line.end() : line.end() + 1]
            if body and body not in "#\n\r":
                space = line.group().rpartition("\f")[2]
                width = len(space.expandtabs(8)), len(space)
                if width[0] > indents[-1][0]:
                    if last != ":" or width[1] <= indents[-1][1]:
                        raise Rejected("grammar", pos)
                    indents.append(width)
                else:
                    while width[0] < indents[-1][0]:
                        indents.pop()
                    if width != indents[-1]:
                        raise Rejected("unbalanced_delimiter", pos)
                if PY_HEADER.match(text, line.end()):
                    raise Rejected("grammar", line.end())
            pos, fresh = line.end(), False
            continue
        fresh = False
        ch = text[pos]
        if ch == "#":
            end = text.find("\n", pos)
            pos = n if end < 0 else end
        elif ch == "\n":
            pos, fresh = pos + 1, True
        elif ch == "\\":
            pos += 3 if text.startswith("\\\r\n", pos) else 2
        elif m := PY_STRING.match(text, pos):
            pos, last = _py_string(text, m.end(), m[2], "f" in m[1].lower()), '"'
        elif ch in "([{":
            stack.append((ch, pos))
            pos, last = pos + 1, ch
        elif ch in ")]}":
            if not stack or stack.pop()[0] != CLOSES[ch]:
                raise Rejected("unbalanced_delimiter", pos)
            pos, last = pos + 1, ch
        elif m := PY_PLAIN.match(text, pos):
            pos = m.end()
            if not m.group().isspace():
                last = m.group()[-1]
        else:
            pos += 1
    if stack:
        raise Rejected("premature_end", stack[-1][1])
    if last == ":":
        raise Rejected("premature_end", n)


def check_python(text: str) -> tuple[str, int] | None:
    body = text[1:] if text.startswith("﻿") else text
    try:
        _python_lexer(body.replace("\r\n", "\n"))
    except Rejected as fault:
        return fault.reason, fault.offset
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(body)
    except (SyntaxError, ValueError) as fault:
        return "grammar", int(getattr(fault, "offset", 0) or 0)
    except (RecursionError, MemoryError):  # the interpreter refuses such a file
        return "nesting", 0
    return None


# ---------------------------------------------------------------- YAML
YAML_VALUE = re.compile(r"(?:[^\S\n]*(?:-[ \t]+|\?[ \t]+|[^\s:#'\"\[\]{},&*!|>%@`-][^:#\n'\"]*:[ \t]+|(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\n]|'')*')[ \t]*:[ \t]+))*[ \t]*")


# A line at the margin that begins an entry of a block collection, and one that is a document's start or end.
YAML_ENTRY = re.compile(r"[-?](?=[ \t\r\n]|$)|(?![\s#'\"\[\]{}&*!|>%@`,?-]|---|\.\.\.)[^\n#]*?:(?=[ \t\r\n]|$)")
YAML_DOCUMENT = re.compile(r"(?:---|\.\.\.)(?=\s|$)")
YAML_KEY = re.compile(r"[^\n]*:(?:[ \t\r\n]|$)")


def _yaml_lexer(text: str) -> None:
    """Quoted scalars and flow collections that stand where a value begins; block scalars are skipped by indentation.

    While a block collection is open at the margin, a conflict marker there can only be a key, which ends with a colon.
    """
    pos, n, entries = 0, len(text), False
    while pos < n:
        if YAML_DOCUMENT.match(text, pos):
            entries = False
        elif entries and MARKER.match(text, pos) and not YAML_KEY.match(text, pos):
            raise Rejected("merge_conflict", pos)
        elif YAML_ENTRY.match(text, pos):
            entries = True
        head = YAML_VALUE.match(text, pos)
        at = head.end()
        line_end = text.find("\n", at)
        line_end = n if line_end < 0 else line_end
        ch = text[at : at + 1]
        if ch in ("|", ">") and re.match(r"[|>][0-9+-]{0,2}[ \t]*(?:#.*)?\r?$", text[at:line_end]):
            indent = len(text[pos:at]) - len(text[pos:at].lstrip(" "))
            pos = line_end + 1
            while pos < n:
                end = text.find("\n", pos)
                end = n if end < 0 else end
                line = text[pos:end]
                if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
                    break
                pos = end + 1
            continue
        if ch in ('"', "'"):
            pos = _yaml_quoted(text, at)
        elif ch in ("[", "{"):
            pos = _yaml_flow(text, at)
        else:
            pos = at
        end = text.find("\n", pos)
        pos = n if end < 0 else end + 1


def _yaml_quoted(text: str, at: int) -> int:
    m = re.compile(r'"(?:[^"\\]|\\.)*"' if text[at] == '"' else r"'(?:[^']|'')*'", re.DOTALL).match(text, at)
    if m is None:
        raise Rejected("unterminated_literal", at)
    return m.end()


def _yaml_flow(text: str, at: int) -> int:
    stack, pos, before = [], at, " "
    while pos < len(text):
        ch = text[pos]
        if ch in "[{":
            stack.append(ch)
        elif ch in "]}":
            if stack.pop() != CLOSES[ch]:
                raise Rejected("unbalanced_delimiter", pos)
            if not stack:
                return pos + 1
        elif ch in "'\"" and before in " \t\n[{,:":
            pos = _yaml_quoted(text, pos)
            before = '"'
            continue
        elif ch == "#" and before in " \t\n":
            end = text.find("\n", pos)
            pos = len(text) if end < 0 else end
            continue
        before = ch
        pos += 1
    raise Rejected("premature_end", at)


def check_yaml(text: str) -> tuple[str, int] | None:
    try:
        _yaml_lexer(text)
    except Rejected as fault:
        return fault.reason, fault.offset
    if yaml is None:
        return None
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    try:
        for _ in yaml.parse(text, Loader=loader):
            pass
    except yaml.YAMLError as fault:
        mark = getattr(fault, "problem_mark", None)
        at = mark.index if mark is not None else 0
        return ("merge_conflict" if MARKER.search(text) else "grammar"), at
    return None


CHECKS = {"java": java_grammar.check, "json": check_json, "yaml": check_yaml, "python": check_python}


def check(lang: str | None, text: str | None) -> tuple[str, int] | None:
    """None if text is valid in lang, always so for Markdown, unknown languages and null."""
    if text is None or lang not in CHECKS:
        return None
    try:
        return CHECKS[lang](text)
    except RecursionError:
        return "nesting", 0


def parse_faults(files: DataFrame) -> DataFrame:
    """One row per row of files: file_id, repo, path, lang (of the extension), valid, reason, offset.

    Null content and languages without a lexer: valid is null. An empty text is valid
    Java, YAML and Python and invalid JSON. Every row is judged alone, so copies get
    the same verdict each; other columns of files are left out. An empty table gives none.
    """
    typed = files.select("file_id", "repo", "path", language(F.col("path"), F.col("lang")).alias("lang"), "content")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            faults = [check(a, b) for a, b in zip(pdf["lang"], pdf["content"])]
            known = [a in CHECKS or a == "markdown" for a in pdf["lang"]]
            has = pdf["content"].notna()
            out = pdf[["file_id", "repo", "path", "lang"]].copy()
            out["valid"] = pd.Series([(f is None) if k and h else None for f, k, h in zip(faults, known, has)], dtype="object")
            out["reason"] = pd.Series([f[0] if f else None for f in faults], dtype="object")
            out["offset"] = pd.Series([f[1] if f else None for f in faults], dtype="Int64")
            yield out

    return typed.mapInPandas(judge, "file_id long, repo string, path string, lang string, valid boolean, reason string, offset long")


def fault_rates(files: DataFrame) -> DataFrame:
    """Per repo and lang: files judged, files at fault, and their rate. Partial sums precede the shuffle, so a hot repo costs nothing more."""
    return (
        parse_faults(files)
        .filter(F.col("valid").isNotNull())
        .groupBy("repo", "lang")
        .agg(F.count("*").alias("files"), F.sum((~F.col("valid")).cast("long")).alias("invalid"))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )
