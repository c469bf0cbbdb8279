"""Functions paired with their documentation, read by island grammars.

Per language only documentation, annotations, signatures and balanced bodies are
parsed; everything between is water and skipped. A second part judges whether a
documentation comment tells anything beyond the names it documents.
"""

from __future__ import annotations

import ast
import re
import textwrap
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Island:
    owner: str
    name: str
    signature: str
    doc: str | None
    code: str


# ---------------------------------------------------------------- Java-like languages
WATER = re.compile(
    r"(?P<doc>/\*\*(?!/).*?\*/)|(?P<skip>//[^\n]*|/\*.*?\*/|\"\"\".*?(?<!\\)\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<open>[({\[])|(?P<close>[)}\]])|(?P<end>;)|(?P<type>\b(?:class|interface|enum|record|@interface)\s+(?P<tname>[^\W\d]\w*))",
    re.DOTALL,
)
HEAD = re.compile(r"(?:(?<=[\s>\])?])|^)(?P<name>[^\W\d][\w$]*)\s*$")
NOT_A_METHOD = frozenset("if for while switch catch synchronized try return new else do assert throw case super this".split())
PACKAGE = re.compile(r"^[ \t]*package\s+([\w.]+)\s*;?", re.MULTILINE)


def _matches(text: str) -> dict[int, int]:
    """For each delimiter that is closed the offset behind its closing one, in one pass with a stack."""
    found: dict[int, int] = {}
    stack: list[int] = []
    for m in WATER.finditer(text):
        if m["open"]:
            stack.append(m.start())
        elif m["close"] and stack:
            found[stack.pop()] = m.end()
    return found


def _unannotated(text: str) -> str:
    """A declaration without the annotations before it."""
    while m := re.match(r"\s*@[\w.]+\s*", text):
        stop = _matches(text).get(m.end(), len(text)) if text[m.end() : m.end() + 1] == "(" else m.end()
        text = text[stop:]
    return text


def java_islands(text: str) -> list[Island]:
    """Methods and constructors of all types of a file, with the comment right before each."""
    package, closed = PACKAGE.search(text), _matches(text)
    found: list[Island] = []
    owners: list[tuple[str, int]] = []  # type names and the offset where their bodies end
    doc, begin, pos = None, 0, 0
    while m := WATER.search(text, pos):
        pos = m.end()
        while owners and owners[-1][1] <= m.start():
            owners.pop()
        if m["doc"]:
            doc, begin = m["doc"], pos
        elif m["skip"]:
            continue
        elif m["type"]:
            brace = text.find("{", pos)
            if m["type"].startswith("record") and "(" in text[pos:brace]:
                brace = text.find("{", closed.get(text.find("(", pos), pos))
            stop = closed.get(brace, -1)
            if stop > 0:
                owners.append((m["tname"], stop))
                pos = brace + 1
            doc, begin = None, pos
        elif m["end"] or m["close"]:
            doc, begin = None, pos
        elif m["open"] == "(":
            stop = closed.get(m.start(), -1)
            if stop < 0:
                begin = pos
                continue
            head = re.sub(r"/\*.*?\*/|//[^\n]*", " ", text[begin : m.start()], flags=re.DOTALL)
            name = HEAD.search(head)
            if not owners or name is None or name["name"] in NOT_A_METHOD or head.rstrip().endswith("@" + name["name"]) or "=" in re.sub(r"\([^)]*\)", "", head):
                pos = stop  # an annotation's arguments, or an expression
                continue
            tail = re.compile(r"\s*(?:\[\s*\]\s*)*(?:throws\s+[\w.,\s<>]+?)?\s*(?P<kind>[{;]|default\b)").match(text, stop)
            if tail is None:
                pos = stop
                continue
            until = closed.get(tail.start("kind"), -1) if tail["kind"] == "{" else text.find(";", stop) + 1
            until = until if until > 0 else len(text)
            signature = " ".join(_unannotated(head + text[m.start() : tail.start("kind")]).split())
            owner = ".".join(x for x, _ in owners)
            if package:
                owner = f"{package[1]}.{owner}"
            found.append(Island(owner, name["name"], signature, doc, text[begin:until].strip()))
            doc, begin, pos = None, until, until
        elif m["open"] == "{":  # an initializer or array: water
            stop = closed.get(m.start(), -1)
            pos = stop if stop > 0 else pos
            doc, begin = None, pos
        elif m["open"] == "[":
            continue
    return found


# ---------------------------------------------------------------- Python
PY_DEF = re.compile(r"^(?P<indent>[ \t]*)(?:async[ \t]+)?(?P<kind>def|class)[ \t]+(?P<name>[^\W\d]\w*)", re.MULTILINE)
PY_SKIP = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<colon>:)", re.DOTALL)
PY_DOC = re.compile(r"\s*(?P<raw>[rRuU]?(?P<q>\"\"\"|'''|\"|')(?P<body>.*?)(?<!\\)(?P=q))", re.DOTALL)


def python_islands(text: str) -> list[Island]:
    """Functions and methods with their docstrings; the body is what is indented deeper."""
    found: list[Island] = []
    strings = [(m.start(), m.end()) for m in re.finditer(r"\"\"\".*?\"\"\"|'''.*?'''", text, re.DOTALL)]
    begins = [a for a, _ in strings]

    def inside(at: int) -> bool:
        n = bisect_left(begins, at) - 1
        return n >= 0 and at < strings[n][1]

    owners: list[tuple[int, str]] = []
    for m in PY_DEF.finditer(text):
        if inside(m.start()):
            continue
        indent = len(m["indent"].expandtabs(8))
        while owners and owners[-1][0] >= indent:
            owners.pop()
        depth, colon = 0, -1
        for k in PY_SKIP.finditer(text, m.end()):
            depth += bool(k["open"]) - bool(k["close"])
            if k["colon"] and depth == 0:
                colon = k.end()
                break
        if colon < 0:
            continue
        owner = ".".join(x for _, x in owners)
        owners.append((indent, m["name"]))
        if m["kind"] == "class":
            continue
        stop = colon
        for line in re.compile(r"[^\n]*\n?").finditer(text, text.find("\n", colon) + 1 or len(text)):
            body = line.group()
            if not body:
                break
            if body.strip() and not inside(line.start()) and len(body.expandtabs(8)) - len(body.expandtabs(8).lstrip()) <= indent:
                break
            stop = line.end()
        quoted = PY_DOC.match(text, colon)
        doc = None
        if quoted:
            try:
                doc = ast.literal_eval(quoted["raw"])
            except (SyntaxError, ValueError):
                doc = quoted["body"]
        signature = " ".join(text[m.start() : colon - 1].split())
        found.append(Island(owner, m["name"], signature, doc, textwrap.dedent(text[m.start() : max(stop, colon)]).rstrip()))
    return found


GRAMMARS = {"java": java_islands, "python": python_islands}

# ---------------------------------------------------------------- does a comment inform?
TAG = re.compile(r"^[ \t]*@(\w+)\b", re.MULTILINE)
# What a comment's clause may consist of without telling anything.
PLACEHOLDER = re.compile(
    r"(?:(?:todo|fixme|xxx+|tbd|tba|tbc|wip|hack)\b[\s:.!-]*)?(?:(?:please\s+)?(?:add|write|insert|put|fill\s+in|needs?|missing|no|without|lacks?|to\s+be|describe|document|undocumented|not)?\s*(?:any\s+|a\s+|the\s+|your\s+|yet\s+)*(?:doc(?:s|umentation|ument(?:ed)?)?|javadoc|description|comment|describe|described|documented|written|done|defined|provided|available|later|here|text|summary|implementation|determined|filled\s+in|supplied|this|it|method|function)(?:\s+(?:available|provided|yet|here|goes|needed|required|given|missing|later|follows|pending|to|be|added|done|in|this|it|method|function|text|comment|description|documentation))*)?[\s.!:-]*"
    r"|undocumented|n/?a|none|nil|null|nothing|empty|unknown|test|foo|bar|lorem ipsum.*|same|ditto|see above|as above|placeholder|stub|dummy|revisit|work in progress|to do|(?:needs? |for )?review|implement(?: me)?|fix ?me|fix later|revisit(?: this)?(?: later)?|remove(?: me)?|check(?: this)?|clean ?up",
    re.IGNORECASE,
)
GENERATOR = re.compile(
    r"(?:todo\b[\s:]*)?(?:this\s+(?:\w+\s+){0,3}(?:is|was|has\s+been)\s+)?(?:auto(?:matically)?[\s-]*)?generated\b.*|do\s+not\s+(?:edit|modify|change|touch)\b.*|(?:todo\b[\s:]*)?auto-?generated\b.*|created\s+(?:by|with|on|using|from)\b.*|(?:default|empty)?\s*(?:method|constructor|getter|setter)\s+stub|\(?non-javadoc\)?.*",
    re.IGNORECASE,
)
REFERENCE = re.compile(
    r"\(?(?:please\s+)?(?:see|cf\.?|refer\s+to|compare|siehe|vgl\.?|voir|v[ée]ase|ver|vedi|veja|zie|inherited\s+(?:from|documentation)|documented\s+(?:in|at)|documentation\s+(?:is\s+)?(?:in|inherited)|inherit(?:s|ed)?\s+(?:docs?|documentation|javadoc)|copied\s+from|same\s+as|specified\s+by|overrides?|overridden\s+from|inheritdoc)\b(?P<rest>.*)\)?",
    re.IGNORECASE | re.DOTALL,
)
ADMIN = re.compile(r"(?:authors?|written\s+by|since|version|rev(?:ision)?|date|created|last\s+(?:modified|changed|updated)|copyright|\(c\)|license[d]?|ticket|issue|deprecated|obsolete|internal|internal\s+use\s+only|api)\b[\s:.]*[\w.,:/@<>()-]*(?:\s+[\d.:/-]+\w*)?[\s.!]*", re.IGNORECASE)
ADMIN_TAGS = frozenset("author since version see date created link inheritdoc inheritDoc serial serialdata serialfield generated override hidden".split())
# Words that carry no information of their own beside a method's names, mostly English function words and what comments call a method.
FILLER = frozenset(
    "a an the this that these those it its of to for from in on at by with as and or is are be will was do does did has have method function constructor procedure routine operation call member getter setter gets get sets set return returns returned returning param parameter parameters parameter's argument arguments arg args value values given specified provided passed new current object instance class type types result results s which used using use performs perform executes execute helper utility simple simply just into out if any all some java lang util".split()
)
BLOCK_MARKS = re.compile(r"^\s*/\*+|\*+/\s*$")
LINE_MARKS = re.compile(r"^[ \t]*(?:\*(?!/)[ \t]?|///?[ \t]?)", re.MULTILINE)
INLINE = re.compile(r"\{@(\w+)\s*([^{}]*)\}")
HTML = re.compile(r"<!--.*?-->|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>", re.DOTALL)
WORDS = re.compile(r"[^\W_]+")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+|\d+")


def strip_marks(doc: str) -> str:
    """The text of a comment without comment marks."""
    body = doc.strip()
    if body.startswith(("/*", "//", "*")) or body.endswith("*/"):
        body = BLOCK_MARKS.sub("", body)
        body = BLOCK_MARKS.sub("", body)
    body = LINE_MARKS.sub("", body)
    return body


def plain(doc: str) -> str:
    """The text of a comment without comment marks, inline tags and markup; tag lines stay."""
    body = INLINE.sub(lambda m: "" if m[1].lower() == "inheritdoc" else f" {m[2]} ", strip_marks(doc))
    return re.sub(r"[ \t]+", " ", HTML.sub(" ", body)).strip()


def stem(word: str) -> str:
    w = word.lower()
    for end in ("ies", "ied"):
        if w.endswith(end) and len(w) > 4:
            return w[:-3] + "y"
    for end in ("ing", "ed", "es", "er", "or", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 2:
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] == w[-2]:
        w = w[:-1]
    return w[:-1] if w.endswith("e") and len(w) > 3 else w


def name_stems(*names: str | None) -> set[str]:
    """Stems of the words of identifiers, types and whole signatures, and of the joined names themselves."""
    out: set[str] = set()
    for text in names:
        for word in WORDS.findall((text or "").replace("_", " ")):
            out.add(stem(word))
            out.update(stem(x) for x in CAMEL.findall(word))
    return out


def clause_informs(clause: str, known: set[str]) -> bool:
    """Whether one clause says more than placeholders, references, notes or the names it documents."""
    text = " ".join(clause.split()).strip(" \t\r\n.,;:!?*-=_/\\|#~+<>()[]{}\"'`")
    if not WORDS.search(re.sub(r"⟦[^⟧]*⟧", " ", text)):  # nothing, or a bare link
        return False
    if PLACEHOLDER.fullmatch(text) or GENERATOR.fullmatch(text) or ADMIN.fullmatch(text):
        return False
    if (m := REFERENCE.fullmatch(text)) and len([w for w in WORDS.findall(re.sub(r"\S*[#.(]\S*|`[^`]*`", " ", m["rest"])) if w.lower() not in FILLER]) <= 6:
        return False
    for word in WORDS.findall(text.replace("_", " ")):
        if word.isdigit() or word.lower() in FILLER or stem(word) in known:
            continue
        parts = CAMEL.findall(word)
        if len(parts) > 1 and all(stem(p) in known or p.lower() in FILLER or p.isdigit() for p in parts):
            continue
        return True
    return False


def informs(doc: str | None, known: set[str]) -> bool:
    """Whether a documentation comment informs, given the stems of the names and types it documents."""
    if doc is None:
        return False
    body = INLINE.sub(lambda m: " " if m[1].lower() == "inheritdoc" else f" ⟦{m[2]}⟧ " if m[1].startswith("link") else f" {m[2]} ", strip_marks(doc))
    body = re.sub(r"^[ \t]*\(non-javadoc\)", " ", HTML.sub(" . ", body), flags=re.IGNORECASE | re.MULTILINE)
    body = re.sub(r"(?<!\w)(@inheritdoc)\b", " ", body, flags=re.IGNORECASE)
    starts = [m.start() for m in TAG.finditer(body)]
    main = body[: starts[0]] if starts else body
    for clause in re.split(r"(?<=[.!?;])\s+|\n\s*\n", main):
        if clause_informs(clause, known):
            return True
    for a, b in zip(starts, [*starts[1:], len(body)]):
        tag, _, rest = body[a:b].strip().partition(" ")
        tag = tag[1:].strip()
        tag, _, more = tag.partition("\n")
        rest = f"{more} {rest}".strip()
        if tag in ADMIN_TAGS:
            continue
        if tag in ("param", "throws", "exception"):
            first, _, rest = rest.partition(" ")
            own = known | name_stems(first)
            if tag != "param":
                own = own | {stem("thrown"), stem("throw"), stem("throws"), stem("exception"), stem("error"), "when", "case"}
            if clause_informs(rest, own):
                return True
        elif tag == "deprecated":
            rest = re.sub(r"^\s*(?:as\s+of|since|from|in)\s+(?:release|version|java|jdk)?\s*[\d.]+\s*[:;,.]?", "", rest, flags=re.IGNORECASE)
            if any(clause_informs(x, known) for x in re.split(r"(?<=[.!?;])\s+", rest)):
                return True
        elif any(clause_informs(x, known) for x in re.split(r"(?<=[.!?;])\s+", rest)):
            return True
    return False


def declared(owner: str, signature: str, comment: str | None) -> Island:
    """The island of a comment and a declaration that stand without their file, read by the same grammar.

    A comment may come without its marks. What is no declaration to the grammar keeps its whole text as the signature.
    """
    text = comment or ""
    if not text.lstrip().startswith("/**"):
        text = "/** " + re.sub(r"\A\s*/\*+|\*+/\s*\Z", "", text).replace("*/", "* /") + " */"
    elif "*/" not in text.strip()[4:]:
        text += " */"
    body = signature.strip().rstrip(";{").rstrip()
    name = owner.rpartition(".")[2] or "Owner"
    found = java_islands(f"class {name if name.isidentifier() else 'Owner'} {{\n{text}\n{body};\n}}")
    if len(found) == 1 and found[0].doc is not None:
        return Island(owner, found[0].name, found[0].signature, comment if comment is None else found[0].doc, found[0].code)
    return Island(owner, "", signature, comment, signature)


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep, docs = [], []
        for fqn, signature, javadoc in zip(pdf["id"], pdf["signature"], pdf["javadoc"]):
            owner, _, member = (fqn or "").rpartition("#")
            island = declared(owner, signature, javadoc)
            known = name_stems(member, owner.rpartition(".")[2], island.name, island.signature)
            keep.append(bool(informs(island.doc, known)))
            docs.append(plain(island.doc) if island.doc is not None else None)
        yield pdf.assign(doc=docs)[keep]


def last_nodes(events: DataFrame) -> DataFrame:
    """The last N event of every id: id, label, signature, javadoc, nulls of that event kept.

    A max over (seq, values) per id, so map-side partial results are one row per id.
    """
    last = F.max(F.struct("seq", "label", "signature", "javadoc")).alias("last")
    nodes = events.filter((F.col("kind") == "N") & F.col("id").isNotNull() & F.col("seq").isNotNull())
    return nodes.groupBy("id").agg(last).select("id", "last.label", "last.signature", "last.javadoc")


def documented_methods(events: DataFrame) -> DataFrame:
    """id, signature, javadoc, doc (plain text) of the methods whose last javadoc informs.

    The island grammar reads comment, annotations and signature of every event as one declaration.
    Methods with a null or blank signature, a null or empty javadoc, or one that tells
    nothing are dropped. Ids occur once, however often their events are repeated.
    """
    methods = last_nodes(events).filter((F.col("label") == "Method") & F.col("javadoc").isNotNull() & F.col("signature").rlike(r"\S")).drop("label")
    return methods.mapInPandas(_judged, "id string, signature string, javadoc string, doc string")


def island_pairs(files: DataFrame) -> DataFrame:
    """file_id, path, lang, owner, name, signature, doc, code of every informing function of source files.

    files: file_id, path, lang (java or python; others and null content give none), content.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["file_id", "path", "lang", "owner", "name", "signature", "doc", "code"]
        for pdf in batches:
            out = []
            for file_id, path, lang, content in zip(pdf["file_id"], pdf["path"], pdf["lang"], pdf["content"]):
                if content is None or lang not in GRAMMARS:
                    continue
                for x in GRAMMARS[lang](content):
                    if x.doc is not None and informs(x.doc, name_stems(x.name, x.owner.rpartition(".")[2], x.signature)):
                        out.append((file_id, path, lang, x.owner, x.name, x.signature, plain(x.doc), x.code))
            yield pd.DataFrame(out, columns=cols)

    return files.select("file_id", "path", "lang", "content").mapInPandas(parse, "file_id long, path string, lang string, owner string, name string, signature string, doc string, code string")


def parameter_types(signature: str) -> list[str]:
    """The types of a Java signature's parameters, without annotations, modifiers, names and white space."""
    parts, depth, item = [], 0, ""
    inside = signature[signature.find("(") + 1 :]
    for c in inside:
        if c == ")" and depth == 0:
            break
        depth += (c in "<([") - (c in ">)]")
        if c == "," and depth == 0:
            parts.append(item)
            item = ""
        else:
            item += c
    types = []
    for part in [*parts, item]:
        part = re.sub(r"^\s*(?:final\s+)+", "", _unannotated(re.sub(r"^\s*final\s+", "", part)))
        m = re.fullmatch(r"(?P<type>.*[\s>\].])(?P<name>[^\W\d][\w$]*)\s*(?P<dims>(?:\[\s*\]\s*)*)", part.strip(), re.DOTALL)
        if m and m["name"] != "this":
            types.append(re.sub(r"\s+", "", m["type"] + m["dims"]))
    return types


def method_code(files: DataFrame) -> DataFrame:
    """key, code: the newest code of every Java method of source files, by owner#name(types) without white space.

    files: file_id, lang, content, received_at.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file_id, at, content in zip(pdf["file_id"], pdf["received_at"], pdf["content"]):
                for x in java_islands(content):
                    out.append((f"{x.owner}#{x.name}({','.join(parameter_types(x.signature))})", x.code, at, file_id))
            yield pd.DataFrame(out, columns=["key", "code", "at", "file_id"])

    java = files.filter("lang = 'java' and content is not null").select("file_id", F.col("received_at").cast("string").alias("received_at"), "content")
    return java.mapInPandas(parse, "key string, code string, at string, file_id long").groupBy("key").agg(F.max_by("code", F.struct("at", "file_id")).alias("code"))
