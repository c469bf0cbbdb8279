"""Text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMPLE = r"[\p{L}\p{N}_]+"
# Word segmentation: letters and digits, joined by . ' ’ · : between letters and by . , ; ' between digits.
STANDARD = r"(?:[\p{L}\p{N}\p{M}_]|(?<=[\p{L}_])[.'’·:](?=[\p{L}_])|(?<=\p{N})[.,;'](?=\p{N}))+"
MAX_TOKEN = 255


def tokens(text: Column, mode: str = "simple") -> Column:
    """Lower-cased terms of a text in order; null gives an empty array.

    simple: runs of letters, digits and underscores. standard: as above, with dotted
    identifiers and decimal numbers kept whole and terms over 255 characters cut.
    """
    text = F.coalesce(text, F.lit(""))
    if mode == "simple":
        return F.regexp_extract_all(F.lower(text), F.lit(SIMPLE), F.lit(0))
    found = F.regexp_extract_all(F.lower(text), F.lit(STANDARD), F.lit(0))
    pieces = F.transform(found, lambda t: F.regexp_extract_all(t, F.lit("(?s).{1,%d}" % MAX_TOKEN), F.lit(0)))
    return F.flatten(pieces)


def query_terms(query: str | None, mode: str = "simple") -> list[str]:
    """Terms of a query as the analyzer of texts cuts them; capitalised AND, OR, NOT are plain terms."""
    if mode == "simple":
        return re.findall(r"\w+", (query or "").lower())
    import regex

    found = regex.findall(STANDARD, (query or "").lower())
    return [t[a : a + MAX_TOKEN] for t in found for a in range(0, len(t), MAX_TOKEN)]


def cut_at_space(text: Column, most: int) -> Column:
    """The first most characters, ended before the last space among the first most + 1 unless that is at the start."""
    head = F.substring(text, 1, most + 1)
    at = F.lit(most + 1) - F.instr(F.reverse(head), " ")  # offset of the last space in a full head
    return F.when((F.instr(head, " ") > 0) & (at > 0), F.substr(text, F.lit(1), at)).otherwise(F.substring(text, 1, most))


def snippet(text: Column, most: int = 500) -> Column:
    """Null gives ""; longer texts are cut at a space and get three dots."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut_at_space(text, most), F.lit("...")))


def slug(title: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "(^-|-$)", "")
    return F.when(title.isNull() | (F.trim(title) == ""), F.lit("body")).otherwise(s)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def fqn_simple(fqn: Column) -> Column:
    """What follows the last . # or /, without anything from ( on, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_extract(fqn, r"([^.#/]*)$", 1), r"\(.*", ""))


def simple_name(fqn: Column) -> Column:
    """What follows the last . or #, cut at (; null stays null."""
    return F.regexp_replace(F.regexp_extract(fqn, r"([^.#]*)$", 1), r"\(.*", "")


def token_estimate(text: Column, chars_per_token: int = 4) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(n / chars_per_token).cast("int")))


def fits(text: Column, budget: int | Column, chars_per_token: int = 4) -> Column:
    """Whether a text is within a budget of tokens; null counts as empty."""
    return token_estimate(text, chars_per_token) <= (budget if isinstance(budget, Column) else F.lit(budget))


def truncate_to_fit(text: Column, budget: int | Column, chars_per_token: int = 4) -> Column:
    """At most budget tokens, cut at the last space that is not at the start."""
    text = F.coalesce(text, F.lit(""))
    most = (budget if isinstance(budget, Column) else F.lit(budget)) * chars_per_token
    head = F.substr(text, F.lit(1), most + 1)
    at = most + 1 - F.instr(F.reverse(head), " ")
    has = (F.instr(head, " ") > 0) & (at > 0)
    return F.when(F.length(text) <= most, text).when(has, F.substr(text, F.lit(1), at)).otherwise(F.substr(text, F.lit(1), most))


def source_class(path: Column) -> Column:
    p = F.lower(path)
    ends = lambda *xs: F.coalesce(p.rlike(r"\.(?:%s)$" % "|".join(xs)), F.lit(False))
    return (
        F.when(ends("java"), "JAVA")
        .when(ends("md", "markdown"), "MARKDOWN")
        .when(ends("yml", "yaml", "json"), "API_SPEC")
        .when(ends("pdf", "docx", "html", "txt"), "DOCUMENT")
        .otherwise("IGNORE")
    )


# Type names that are not taken for injected components.
NOT_BEANS = ("String", "Integer", "Long", "Double", "Float", "Boolean", "Object", "List", "Map", "Set", "Collection", "Optional", "Path", "File")


def looks_like_bean(type_name: Column) -> Column:
    simple = F.regexp_extract(F.regexp_replace(type_name, r"<.*", ""), r"([^.]*)$", 1)
    return simple.rlike("^[A-Z]") & ~simple.isin(*NOT_BEANS)


def strip_annotation_value(value: Column) -> Column:
    """Braces, brackets, quotes and white space around an annotation's value are dropped."""
    return F.regexp_replace(value, r'^[\s{\["]+|[\s}\]"]+$', "")


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression for whole paths: * stays inside a name, ** crosses, ** before / needs a directory."""
    out, i, braces = [], 0, 0
    while i < len(glob):
        ch = glob[i]
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "{":
            out.append("(?:")
            braces += 1
        elif ch == "}" and braces:
            out.append(")")
            braces -= 1
        elif ch == "," and braces:
            out.append("|")
        elif ch == "[":
            end = glob.find("]", i + 1)
            if end > 0:
                body = glob[i + 1 : end]
                out.append("[" + ("^" + body[1:] if body[:1] == "!" else body) + "]")
                i = end
            else:
                out.append(r"\[")
        elif ch == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


def accepted(path: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Any include glob (or none given) and no exclude glob; backslashes count as slashes."""
    p = F.translate(path, "\\", "/")
    any_of = lambda globs: p.rlike("^(?:%s)$" % "|".join(glob_regex(g) for g in globs))
    inside = any_of(include) if include else F.lit(True)
    outside = any_of(exclude) if exclude else F.lit(False)
    return inside & ~outside
