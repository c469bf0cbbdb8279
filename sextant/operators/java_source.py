"""Structure of Java sources: types, constructors, methods, annotations, comments and calls.

One pass makes tokens and matches delimiters; declarations are then recognised by their
shape. Bodies keep their source text. A file whose delimiters do not match gives nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r'(?P<doc>/\*\*(?!/).*?\*/)|(?P<skip>/\*.*?\*/|//[^\n]*|\s+)|(?P<text>""".*?(?<!\\)"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')'
    r"|(?P<word>(?:[^\W\d]|\$)[\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>->|::|\.\.\.|.)",
    re.DOTALL,
)
OPENING, CLOSING = "([{", {")": "(", "]": "[", "}": "{"}
# Modifiers, and words before "(" that are no calls.
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed non".split())
NOT_CALLS = frozenset("if for while switch catch synchronized try return new super this assert throw else do case".split())


@dataclass
class Annotation:
    name: str
    text: str | None  # what stands between the parentheses


@dataclass
class Method:
    name: str
    types: list[str]
    declaration: str
    doc: str | None
    annotations: list[Annotation]
    body: str
    calls: list[str]


@dataclass
class Type:
    name: str
    kind: str
    doc: str | None
    annotations: list[Annotation]
    source: str
    constructors: list[list[str]] = field(default_factory=list)
    methods: list[Method] = field(default_factory=list)


class Source:
    def __init__(self, text: str):
        self.text = text
        self.tokens: list[tuple[str, str, int]] = []
        self.match: dict[int, int] = {}
        self.opener: dict[int, int] = {}
        open_: list[int] = []
        for m in TOKEN.finditer(text):
            if m.lastgroup == "skip":
                continue
            tok, n = m.group(), len(self.tokens)
            if m.lastgroup == "sign" and tok in OPENING:
                open_.append(n)
            elif m.lastgroup == "sign" and tok in CLOSING:
                if not open_ or self.tokens[open_[-1]][1] != CLOSING[tok]:
                    raise ValueError("delimiters do not match")
                self.opener[n] = open_.pop()
                self.match[self.opener[n]] = n
            self.tokens.append((m.lastgroup, tok, m.start()))
        if open_:
            raise ValueError("delimiters do not match")

    def word(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def span(self, a: int, b: int) -> str:
        """Source text of tokens a to b, the last one included."""
        return self.text[self.tokens[a][2] : self.tokens[b][2] + len(self.tokens[b][1])]

    def angle(self, i: int) -> int:
        """Index of the > that closes the < at i."""
        depth = 0
        while i < len(self.tokens):
            depth += {"<": 1, ">": -1}.get(self.word(i), 0)
            if depth == 0:
                return i
            i += 1
        raise ValueError("type arguments do not end")

    def spelled(self, a: int, b: int) -> str:
        """Tokens a to b - 1 as a type is spelled: no blanks but after commas and around bounds."""
        out = ""
        for i in range(a, b):
            kind, tok, _ = self.tokens[i]
            if kind == "doc":
                continue
            if tok == ",":
                out += ", "
            elif out and kind == "word" and (out[-1].isalnum() or out[-1] in "_$?>]"):
                out += " " + tok
            elif tok == "&":
                out += " & "
            else:
                out += tok
        return out.strip()

    # -- declarations
    def prefix(self, i: int) -> tuple[int, str | None, list[Annotation], list[str]]:
        """Comment, annotations and modifiers from i on; the index behind them."""
        doc, notes, mods = None, [], []
        while i < len(self.tokens):
            kind, tok, _ = self.tokens[i]
            if kind == "doc":
                doc = tok if not notes and not mods else doc or tok
                i += 1
            elif tok == "@" and self.word(i + 1) != "interface":
                i += 1
                name = self.word(i)
                while self.word(i + 1) == ".":
                    i += 2
                    name = self.word(i)
                text = None
                if self.word(i + 1) == "(":
                    end = self.match[i + 1]
                    text = self.span(i + 2, end - 1) if end > i + 2 else ""
                    i = end
                notes.append(Annotation(name, text))
                i += 1
            elif tok in MODIFIERS and self.word(i + 1) not in ("(", "=", "."):
                if tok == "non" and self.word(i + 1) == "-":
                    i += 2
                mods.append(tok)
                i += 1
            else:
                break
        return i, doc, notes, mods

    def parameters(self, i: int) -> list[tuple[str, str]]:
        """(type, name) of the parameters in the parentheses opened at i."""
        out, a, end = [], i + 1, self.match[i]
        while a < end:
            a, _, _, _ = self.prefix(a)
            b = a
            while b < end and self.word(b) != ",":
                b = self.angle(b) + 1 if self.word(b) == "<" else self.match[b] + 1 if b in self.match else b + 1
            name_at = b - 1
            while self.word(name_at) in "[]":
                name_at -= 1
            dims = "[]" * sum(self.word(x) == "[" for x in range(name_at, b))
            if self.word(name_at) != "this":
                out.append((self.spelled(a, name_at) + dims, self.word(name_at)))
            a = b + 1
        return out

    def types(self) -> tuple[str, list[Type]]:
        package = re.search(r"^[ \t]*package\s+(\w+(?:\s*\.\s*\w+)*)\s*;", self.text, re.MULTILINE)
        found: list[Type] = []
        self.declarations(0, len(self.tokens), None, found)
        return re.sub(r"\s", "", package[1]) if package else "", found

    def declarations(self, i: int, end: int, owner: Type | None, found: list[Type]) -> None:
        while i < end:
            start = i
            i, doc, notes, mods = self.prefix(i)
            if i >= end:
                return
            tok = self.word(i)
            if tok in ("class", "interface", "enum", "record") and self.tokens[i + 1][0] == "word" or tok == "@":
                at = i + (2 if tok == "@" else 1)
                brace = at
                while self.word(brace) != "{":
                    brace = self.match[brace] + 1 if brace in self.match else brace + 1
                    if brace >= end:
                        return
                kind = {"interface": "Interface", "class": "Class"}.get(tok, "")
                node = Type(self.word(at), kind, doc, notes, self.span(start, self.match[brace]))
                if kind:
                    found.append(node)
                inner = brace + 1
                if tok == "enum":  # the constants are water
                    while inner < self.match[brace] and self.word(inner) != ";":
                        inner = self.match[inner] + 1 if inner in self.match else inner + 1
                self.declarations(inner, self.match[brace], node, found)
                i = self.match[brace] + 1
            elif tok == "{":
                i = self.match[i] + 1
            elif owner is None:
                i += 1
            else:
                i = self.member(i, end, owner, doc, notes, mods)

    def member(self, i: int, end: int, owner: Type, doc: str | None, notes: list[Annotation], mods: list[str]) -> int:
        begin = i
        generic = ""
        if self.word(i) == "<":
            stop = self.angle(i)
            generic = self.spelled(i, stop + 1) + " "
            i = stop + 1
        a = i
        while i < end and self.word(i) not in ("(", ";", "=", "{"):
            i = self.angle(i) + 1 if self.word(i) == "<" else self.match[i] + 1 if i in self.match else i + 1
        if i >= end or self.word(i) != "(" or i == a:
            while i < end and self.word(i) != ";":  # a field
                i = self.match[i] + 1 if i in self.match else i + 1
            return max(i + 1, begin + 1)
        name, close = self.word(i - 1), self.match[i]
        params = self.parameters(i)
        k = close + 1
        while k < end and self.word(k) not in ("{", ";"):
            k = self.match[k] + 1 if k in self.match else k + 1
        stop = self.match[k] if self.word(k) == "{" else k
        if a == i - 1 and name == owner.name:
            owner.constructors.append([t for t, _ in params])
        elif a < i - 1:
            throws = ""
            if self.word(close + 1) == "throws":
                throws = " throws " + self.spelled(close + 2, k)
            shown = [m for m in mods if m in ("public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "default", "strictfp") and m in ("static", "final", "abstract", "native", "synchronized", "default", "strictfp", "public", "protected", "private")]
            lead = " ".join(shown)
            declaration = f"{lead + ' ' if lead else ''}{generic}{self.spelled(a, i - 1)} {name}({', '.join(f'{t} {n}' for t, n in params)}){throws}"
            body = self.span(k, stop) if self.word(k) == "{" else ""
            owner.methods.append(Method(name, [t for t, _ in params], declaration, doc, notes, body, self.calls(k, stop) if body else []))
        return stop + 1

    def calls(self, a: int, b: int) -> list[str]:
        """Text of every call in tokens a to b: the name with the expression it is called on."""
        out = []
        for i in range(a, b):
            if self.word(i) != "(" or self.tokens[i - 1][0] != "word" or self.word(i - 1) in NOT_CALLS:
                continue
            start = i - 1
            if self.word(start - 1) == "new" or self.word(start - 1) == "@":
                continue
            while self.word(start - 1) == ".":
                start -= 2
                if self.word(start) in (")", "]"):
                    start = self.opener[start]
                    if self.tokens[start - 1][0] == "word" and self.word(start - 1) not in NOT_CALLS:
                        start -= 1
            if self.word(start - 1) == "new":
                start -= 1
            out.append(" ".join(self.span(start, i - 1).split()).replace(" .", ".").replace(". ", "."))
        return out


def comment_text(doc: str | None) -> str | None:
    """A documentation comment without its marks."""
    if doc is None:
        return None
    lines = [re.sub(r"^\s*\*? ?", "", x) for x in doc[3:-2].split("\n")]
    return "\n".join(x.rstrip() for x in lines).strip()


def parse(text: str | None) -> tuple[str, list[Type]] | None:
    try:
        return Source(text or "").types()
    except (ValueError, IndexError, KeyError, StopIteration, RecursionError):
        return None
