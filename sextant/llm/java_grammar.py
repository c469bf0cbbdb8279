"""Java 21: a lexer with a pushdown stack of delimiters, and a grammar check over its tokens.

The lexer alone finds unterminated literals and comments, delimiters that do not
match, files that end too early and merge-conflict markers. What it lets pass is
read once more by a predictive parser that uses the delimiter matches of the stack
to decide between lambdas, casts and parentheses without backtracking over bodies.
"""

from __future__ import annotations

import re
import sys


class Rejected(Exception):
    """reason: the kind of fault; offset: where in the text."""

    def __init__(self, reason: str, offset: int):
        super().__init__(reason)
        self.reason, self.offset = reason, offset


# The reserved words of Java 21.
RESERVED = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
)
PRIMITIVES = frozenset("boolean byte char double float int long short".split())
MODIFIERS = frozenset("abstract default final native private protected public static strictfp synchronized transient volatile".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
BINARY = frozenset("|| && | ^ & == != < > <= >= << >> >>> + - * / %".split())

_ESC = r"\\(?:[btnfrs\"'\\]|[0-3]?[0-7]{1,2}|u+[0-9a-fA-F]{4})"
TOKEN = re.compile(
    r"(?P<ws>[ \t\f\r\n\x1a]+)"
    r"|(?P<line>//[^\r\n]*)"
    r"|(?P<block>/\*.*?\*/)"
    r"|(?P<openblock>/\*)"
    r'|(?P<textblock>"""[ \t\f]*\r?\n(?:[^"\\]|\\.|"(?!""))*""")'
    r'|(?P<openblockstr>""")'
    r"|(?P<str>\"(?:[^\"\\\r\n]|" + _ESC + r")*\")"
    r"|(?P<chr>'(?:[^'\\\r\n]|" + _ESC + r")')"
    r"|(?P<openstr>[\"'])"
    r"|(?P<num>(?:0[xX](?:[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?)?(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9]+[fFdD]?|[lL])?|0[bB][01](?:[01_]*[01])?[lL]?|(?:[0-9](?:[0-9_]*[0-9])?\.?(?:[0-9](?:[0-9_]*[0-9])?)?|\.[0-9](?:[0-9_]*[0-9])?)(?:[eE][+-]?[0-9](?:[0-9_]*[0-9])?)?[lLfFdD]?))"
    r"|(?P<id>(?:[^\W\d]|\$|\\u+[0-9a-fA-F]{4})(?:\w|\$|\\u+[0-9a-fA-F]{4})*)"
    r"|(?P<op>->|::|\.\.\.|\+\+|--|&&|\|\||==|!=|<=|<<=|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^!~?:;,.=<>@(){}\[\]])",
    re.DOTALL,
)
MARKER = re.compile(r"^(?:<{7}|>{7}|={7}|\|{7})(?:[ \t].*)?\r?$", re.MULTILINE)
CLOSES = {")": "(", "]": "[", "}": "{"}


def lex(text: str) -> tuple[list[tuple[str, str, int]], dict[int, int]]:
    """Tokens as (kind, text, offset), and for each opening delimiter's index its closing one's."""
    out: list[tuple[str, str, int]] = []
    stack: list[int] = []
    match: dict[int, int] = {}
    pos, end, step = 0, len(text), TOKEN.match
    while pos < end:
        m = step(text, pos)
        if m is None:
            raise Rejected("stray_character", pos)
        kind, pos0, pos = m.lastgroup, pos, m.end()
        if kind in ("ws", "line", "block"):
            continue
        tok = m.group()
        if kind in ("openblock", "openblockstr", "openstr"):
            raise Rejected("unterminated_literal", pos0)
        if kind == "op":
            if tok in ("<", "=", ">", "<<", "==") and (pos0 == 0 or text[pos0 - 1] == "\n") and MARKER.match(text, pos0):
                raise Rejected("merge_conflict", pos0)
            if tok in "([{":
                stack.append(len(out))
            elif tok in CLOSES:
                if not stack or out[stack[-1]][1] != CLOSES[tok]:
                    raise Rejected("unbalanced_delimiter", pos0)
                match[stack.pop()] = len(out)
        elif kind == "id":
            kind = "kw" if tok in RESERVED else "id"
        elif kind == "num":
            if tok[:2] in ("0x", "0X") and len(tok) == 2 or text[pos : pos + 1].isalnum():
                raise Rejected("bad_literal", pos0)
        out.append((kind, tok, pos0))
    if stack:
        raise Rejected("premature_end", out[stack[-1]][2])
    out.append(("eof", "", end))
    return out, match


class Grammar:
    """Accepts the tokens of one compilation unit or raises Rejected."""

    def __init__(self, text: str):
        self.t, self.match = lex(text)
        self.i = 0

    # -- helpers
    def fail(self):
        kind, _, at = self.t[self.i]
        raise Rejected("premature_end" if kind == "eof" else "grammar", at)

    def at(self, *texts: str) -> bool:
        kind, tok, _ = self.t[self.i]
        return tok in texts and kind in ("op", "kw")

    def word(self, *texts: str) -> bool:
        kind, tok, _ = self.t[self.i]
        return kind == "id" and tok in texts

    def take(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def need(self, *texts: str) -> None:
        if not self.take(*texts):
            self.fail()

    def ident(self) -> str:
        kind, tok, _ = self.t[self.i]
        if kind != "id":
            self.fail()
        self.i += 1
        return tok

    def peek(self, n: int = 1) -> tuple[str, str, int]:
        return self.t[min(self.i + n, len(self.t) - 1)]

    def attempt(self, rule) -> bool:
        at = self.i
        try:
            rule()
            return True
        except Rejected:
            self.i = at
            return False

    # -- names, types, annotations
    def qualified(self) -> None:
        self.ident()
        while self.at(".") and self.peek()[0] == "id":
            self.i += 2

    def annotation(self) -> None:
        self.need("@")
        self.qualified()
        if self.take("("):
            if not self.at(")"):
                if self.t[self.i][0] == "id" and self.peek()[1] == "=":
                    while True:
                        self.ident()
                        self.need("=")
                        self.element()
                        if not self.take(","):
                            break
                else:
                    self.element()
            self.need(")")

    def element(self) -> None:
        if self.at("@"):
            self.annotation()
        elif self.take("{"):
            while not self.at("}"):
                self.element()
                if not self.take(","):
                    break
            self.need("}")
        else:
            self.ternary()

    def annotations(self) -> None:
        while self.at("@") and self.peek()[1] != "interface":
            self.annotation()

    def modifiers(self) -> None:
        while True:
            if self.at("@") and self.peek()[1] != "interface":
                self.annotation()
            elif self.t[self.i][0] == "kw" and self.t[self.i][1] in MODIFIERS and not (self.at("default") and self.peek()[1] in (":", "->")):
                self.i += 1
            elif self.word("sealed") and self.peek()[0] in ("kw", "id") and self.peek()[1] in ("class", "interface", "abstract", "public", "private", "protected", "static", "strictfp"):
                self.i += 1
            elif self.word("non") and self.peek()[1] == "-" and self.peek(2)[1] == "sealed":
                self.i += 3
            else:
                return

    def type_args(self) -> None:
        self.need("<")
        if self.take(">"):
            return
        while True:
            self.annotations()
            if self.take("?"):
                if self.take("extends", "super"):
                    self.type()
            else:
                self.type()
            if not self.take(","):
                break
        self.need(">")

    def type(self, dims: bool = True) -> bool:
        """True for a primitive type without dimensions."""
        self.annotations()
        kind, tok, _ = self.t[self.i]
        primitive = kind == "kw" and tok in PRIMITIVES
        if primitive:
            self.i += 1
        else:
            self.ident()
            if self.at("<"):
                self.type_args()
            while self.at(".") and self.peek()[0] in ("id",) or self.at(".") and self.peek()[1] == "@":
                self.i += 1
                self.annotations()
                self.ident()
                if self.at("<"):
                    self.type_args()
        if dims and self.dims():
            primitive = False
        return primitive

    def dims(self) -> bool:
        any_ = False
        while True:
            at = self.i
            self.annotations()
            if self.at("[") and self.peek()[1] == "]":
                self.i += 2
                any_ = True
            else:
                self.i = at
                return any_

    def type_params(self) -> None:
        self.need("<")
        while True:
            self.annotations()
            self.ident()
            if self.take("extends"):
                self.type()
                while self.take("&"):
                    self.type()
            if not self.take(","):
                break
        self.need(">")

    def type_list(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    # -- declarations
    def unit(self) -> None:
        at = self.i
        self.annotations()
        if self.take("package"):
            self.qualified()
            self.need(";")
        else:
            self.i = at
        while self.at("import", ";"):
            if self.take(";"):
                continue
            self.i += 1
            self.take("static")
            self.qualified()
            if self.take("."):
                self.need("*")
            self.need(";")
        at = self.i
        self.annotations()
        if self.word("open", "module") and self.peek()[0] == "id":
            if self.word("open"):
                self.i += 1
            self.i += 1
            self.qualified()
            if not self.at("{"):
                self.fail()
            self.i = self.match[self.i] + 1
            if self.t[self.i][0] != "eof":
                self.fail()
            return
        self.i = at
        while self.t[self.i][0] != "eof":
            if self.take(";"):
                continue
            self.modifiers()
            if not self.type_decl():
                self.fail()

    def type_decl(self) -> bool:
        """After the modifiers: a class, interface, annotation, enum or record, if one stands here."""
        if self.take("class"):
            self.ident()
            if self.at("<"):
                self.type_params()
            if self.take("extends"):
                self.type()
            self.heritage()
            self.body()
        elif self.at("interface"):
            self.i += 1
            self.ident()
            if self.at("<"):
                self.type_params()
            if self.take("extends"):
                self.type_list()
            self.heritage()
            self.body()
        elif self.at("@") and self.peek()[1] == "interface":
            self.i += 2
            self.ident()
            self.body()
        elif self.take("enum"):
            self.ident()
            self.heritage()
            self.enum_body()
        elif self.word("record") and self.peek()[0] == "id" and self.peek(2)[1] in ("(", "<"):
            self.i += 2
            if self.at("<"):
                self.type_params()
            self.params()
            self.heritage()
            self.body()
        else:
            return False
        return True

    def heritage(self) -> None:
        while True:
            if self.take("implements"):
                self.type_list()
            elif self.word("permits"):
                self.i += 1
                self.type_list()
            else:
                return

    def enum_body(self) -> None:
        self.need("{")
        while self.at("@") or self.t[self.i][0] == "id":
            self.annotations()
            self.ident()
            if self.at("("):
                self.arguments()
            if self.at("{"):
                self.body()
            if not self.take(","):
                break
        if self.take(";"):
            while not self.at("}"):
                self.member()
        self.need("}")

    def body(self) -> None:
        self.need("{")
        while not self.at("}"):
            self.member()
        self.need("}")

    def member(self) -> None:
        if self.take(";"):
            return
        self.modifiers()
        if self.at("{"):
            self.block()
            return
        if self.type_decl():
            return
        if self.at("<"):
            self.type_params()
            self.annotations()
        if self.t[self.i][0] == "id" and self.peek()[1] == "(":  # a constructor
            self.i += 1
            self.params()
            if self.take("throws"):
                self.type_list()
            self.block()
            return
        if self.t[self.i][0] == "id" and self.peek()[1] == "{":  # a compact constructor
            self.i += 1
            self.block()
            return
        if not self.take("void"):
            self.type()
        self.ident()
        if self.at("("):
            self.params()
            self.dims()
            if self.take("throws"):
                self.type_list()
            if self.take("default"):
                self.element()
                self.need(";")
            elif self.at("{"):
                self.block()
            else:
                self.need(";")
            return
        self.declarators()
        self.need(";")

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dims()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.ident()

    def initializer(self) -> None:
        if self.take("{"):
            while not self.at("}"):
                self.initializer()
                if not self.take(","):
                    break
            self.need("}")
        else:
            self.expression()

    def params(self) -> None:
        self.need("(")
        while not self.at(")"):
            self.modifiers()
            self.type()
            self.annotations()
            self.take("...")
            if self.at("this"):
                self.i += 1
            else:
                self.ident()
                if self.take("."):
                    self.need("this")
            self.dims()
            if not self.take(","):
                break
            if self.at(")"):
                self.fail()
        self.need(")")

    # -- statements
    def block(self) -> None:
        self.need("{")
        while not self.at("}"):
            self.block_statement()
        self.need("}")

    def local_type(self) -> bool:
        at = self.i
        self.modifiers()
        if self.at("class", "interface", "enum") or self.word("record") and self.peek()[0] == "id" and self.peek(2)[1] in ("(", "<"):
            return self.type_decl()
        self.i = at
        return False

    def declaration_ahead(self) -> bool:
        """A type and then a name: read past both if so."""

        def rule():
            self.type()
            self.ident()
            if not self.at("=", ";", ",", ":", "[", ")"):
                self.fail()

        kind, tok, _ = self.t[self.i]
        if not (kind == "id" or kind == "kw" and tok in PRIMITIVES):
            return False
        return self.attempt(rule)

    def block_statement(self) -> None:
        if self.at("final", "abstract", "static", "strictfp", "@", "class", "interface", "enum") or self.word("record", "sealed", "non"):
            if self.local_type():
                return
            self.modifiers_or_stay()
        if self.word("yield") and self.peek()[1] not in ("=", ".", "(", "[", "++", "--"):
            self.i += 1
            self.expression()
            self.need(";")
            return
        if self.declaration_ahead():
            self.declarators()
            self.need(";")
            return
        self.statement()

    def modifiers_or_stay(self) -> None:
        at = self.i
        self.modifiers()
        if self.i != at:
            if not self.declaration_ahead():
                self.fail()
            self.i = at
            self.modifiers()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        kind, tok, _ = self.t[self.i]
        if kind == "op" and tok == "{":
            self.block()
        elif kind == "op" and tok == ";":
            self.i += 1
        elif kind == "kw" and tok in ("if", "while", "for", "do", "try", "switch", "return", "break", "continue", "throw", "synchronized", "assert"):
            self.i += 1
            getattr(self, "s_" + tok)()
        elif kind == "id" and self.peek()[1] == ":":
            self.i += 2
            self.statement()
        elif kind == "id" and tok == "yield" and self.peek()[1] not in ("=", ".", "[", "++", "--"):
            self.i += 1
            self.expression()
            self.need(";")
        else:
            if self.expression() not in ("assign", "call", "new", "step"):
                self.fail()
            self.need(";")

    def s_if(self):
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def s_while(self):
        self.condition()
        self.statement()

    def s_do(self):
        self.statement()
        self.need("while")
        self.condition()
        self.need(";")

    def s_for(self):
        self.need("(")
        if not self.at(";"):
            at = self.i
            self.modifiers()
            if self.declaration_ahead():
                if self.take(":"):
                    self.expression()
                    self.need(")")
                    self.statement()
                    return
                self.declarators()
            else:
                if self.i != at:
                    self.fail()
                self.expressions()
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expressions()
        self.need(")")
        self.statement()

    def expressions(self):
        self.expression()
        while self.take(","):
            self.expression()

    def s_try(self):
        resources = self.at("(")
        if self.take("("):
            while not self.at(")"):
                self.modifiers()
                if self.declaration_ahead():
                    self.need("=")
                    self.expression()
                else:
                    self.expression()
                if not self.take(";"):
                    break
            self.need(")")
        self.block()
        handlers = 0
        while self.take("catch"):
            self.need("(")
            self.modifiers()
            self.type()
            while self.take("|"):
                self.type()
            self.ident()
            self.need(")")
            self.block()
            handlers += 1
        if self.take("finally"):
            self.block()
        elif not handlers and not resources:
            self.fail()

    def s_switch(self):
        self.condition()
        self.switch_body()

    def switch_body(self):
        self.need("{")
        while not self.at("}"):
            if self.take("default"):
                pass
            else:
                self.need("case")
                while True:
                    if not self.take("default"):
                        if not self.attempt(self.pattern):
                            self.ternary()
                    if not self.take(","):
                        break
                if self.word("when"):
                    self.i += 1
                    self.expression()
            if self.take("->"):
                if self.at("{"):
                    self.block()
                elif self.take("throw"):
                    self.s_throw()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while not self.at("case", "default", "}"):
                    self.block_statement()
        self.need("}")

    def pattern(self):
        self.modifiers()
        self.type()
        if self.take("("):
            while not self.at(")"):
                self.pattern()
                if not self.take(","):
                    break
            self.need(")")
            if self.t[self.i][0] == "id" and not self.word("when"):
                self.i += 1
        else:
            self.ident()
        if not (self.at(",", ":", "->", ")", "&&", "||", "?", ";", "}") or self.word("when")):
            self.fail()

    def s_return(self):
        if not self.at(";"):
            self.expression()
        self.need(";")

    def s_break(self):
        if self.t[self.i][0] == "id":
            self.i += 1
        self.need(";")

    s_continue = s_break

    def s_throw(self):
        self.expression()
        self.need(";")

    def s_synchronized(self):
        self.condition()
        self.block()

    def s_assert(self):
        self.expression()
        if self.take(":"):
            self.expression()
        self.need(";")

    # -- expressions; each rule returns the kind of what it read
    def operator(self) -> tuple[str, int]:
        """The operator here, shifts put together from single signs, and its number of tokens."""
        kind, tok, at = self.t[self.i]
        if kind != "op":
            return "", 0
        if tok == ">":
            n = 1
            while n < 3 and self.peek(n)[1] == ">" and self.peek(n)[2] == at + n:
                n += 1
            nxt = self.peek(n)
            if nxt[1] in ("=", "==") and nxt[2] == at + n:
                return (">" * n + "=", n + 1) if nxt[1] == "=" else ("", 0)
            return ">" * n, n
        return tok, 1

    def expression(self) -> str:
        kind = self.ternary()
        op, n = self.operator()
        if op in ASSIGN:
            if kind not in ("name", "index", "field"):
                self.fail()
            self.i += n
            self.expression()
            return "assign"
        return kind

    def ternary(self) -> str:
        kind = self.binary()
        if self.take("?"):
            self.expression_no_assign()
            self.need(":")
            self.expression_no_assign()
            return "value"
        return kind

    def expression_no_assign(self) -> None:
        self.expression()

    def binary(self) -> str:
        kind = self.unary()
        while True:
            if self.at("instanceof"):
                self.i += 1
                kind = "value"
                if not self.attempt(self.pattern):
                    self.take("final")
                    self.type()
                continue
            op, n = self.operator()
            if op not in BINARY:
                return kind
            self.i += n
            self.unary()
            kind = "value"

    def unary(self) -> str:
        if self.at("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            return "value"
        if self.at("++", "--"):
            self.i += 1
            if self.unary() not in ("name", "index", "field"):
                self.fail()
            return "step"
        if self.at("("):
            close = self.match[self.i]
            after = self.t[close + 1]
            if after[1] == "->":
                self.lambda_params(close)
                return self.lambda_body()
            if self.cast_ahead(close):
                self.i = close + 1
                self.unary()
                return "value"
        return self.postfix()

    def cast_ahead(self, close: int) -> bool:
        at, primitive = self.i, False
        self.i += 1
        try:
            primitive = self.type()
            while self.take("&"):
                self.type()
            ok = self.i == close
        except Rejected:
            ok = False
        self.i = at
        if not ok:
            return False
        kind, tok, _ = self.t[close + 1]
        if primitive:
            return kind != "eof" and (kind != "op" or tok in ("(", "+", "-", "!", "~", "++", "--"))
        return kind in ("id", "num", "str", "chr", "textblock") or kind == "op" and tok in ("(", "!", "~") or kind == "kw" and tok in ("this", "super", "new", "switch", "true", "false", "null", "void", *PRIMITIVES)

    def lambda_params(self, close: int) -> None:
        self.i += 1
        while self.i < close:
            if self.t[self.i][0] == "id" and self.peek()[1] in (",", ")"):
                self.i += 1
            else:
                self.modifiers()
                self.type()
                self.take("...")
                self.ident()
                self.dims()
            if self.i < close:
                self.need(",")
        self.need(")")

    def lambda_body(self) -> str:
        self.need("->")
        if self.at("{"):
            self.block()
        else:
            self.expression()
        return "lambda"

    def arguments(self) -> None:
        self.need("(")
        if not self.at(")"):
            self.expressions()
        self.need(")")

    def type_reference(self) -> bool:
        """A generic or array type before :: or, for arrays, before .class."""

        def rule():
            self.type()
            if self.at("::"):
                return
            if self.at(".") and self.peek()[1] == "class":
                return
            self.fail()

        return self.attempt(rule)

    def postfix(self) -> str:
        kind, tok, _ = self.t[self.i]
        if kind in ("num", "str", "chr", "textblock"):
            self.i += 1
            result = "value"
        elif kind == "kw" and tok in ("true", "false", "null"):
            self.i += 1
            result = "value"
        elif kind == "kw" and tok in PRIMITIVES or kind == "kw" and tok == "void":
            if tok == "void":
                self.i += 1
            else:
                self.type()
            if self.at("."):
                self.i += 1
                self.need("class")
            elif not self.at("::"):
                self.fail()
            result = "value"
        elif kind == "kw" and tok == "this":
            self.i += 1
            result = "call" if self.at("(") else "value"
            if self.at("("):
                self.arguments()
        elif kind == "kw" and tok == "super":
            self.i += 1
            if self.at("("):
                self.arguments()
                result = "call"
            elif self.at(".", "::"):
                result = "value"
            else:
                self.fail()
        elif kind == "kw" and tok == "switch":
            self.i += 1
            self.condition()
            self.switch_body()
            result = "value"
        elif kind == "kw" and tok == "new":
            self.i += 1
            result = self.creation()
        elif kind == "op" and tok == "(":
            self.i += 1
            inner = self.expression()
            self.need(")")
            result = inner if inner in ("name", "index", "field") else "value"
        elif kind == "op" and tok == "@":
            self.annotations()
            return self.postfix()
        elif kind == "id":
            if self.peek()[1] == "->":
                self.i += 1
                return self.lambda_body()
            nxt = self.peek()[1]
            if nxt in ("<", "[", ".") and self.type_reference():
                result = "value"
            else:
                self.i += 1
                result = "name"
                if self.at("("):
                    self.arguments()
                    result = "call"
        else:
            self.fail()
        while True:
            if self.take("."):
                k, w, _ = self.t[self.i]
                if self.at("<"):
                    self.type_args()
                    if not self.take("super"):
                        self.ident()
                    self.arguments()
                    result = "call"
                elif k == "id":
                    self.i += 1
                    result = "field"
                    if self.at("("):
                        self.arguments()
                        result = "call"
                elif k == "kw" and w in ("this", "class"):
                    self.i += 1
                    result = "value"
                elif k == "kw" and w == "super":
                    self.i += 1
                    result = "value"
                    if self.at("("):
                        self.arguments()
                        result = "call"
                elif k == "kw" and w == "new":
                    self.i += 1
                    result = self.creation()
                else:
                    self.fail()
            elif self.at("["):
                self.i += 1
                self.expression()
                self.need("]")
                result = "index"
            elif self.take("::"):
                if self.at("<"):
                    self.type_args()
                if not self.take("new"):
                    self.ident()
                result = "value"
            elif self.at("++", "--") and result in ("name", "index", "field"):
                self.i += 1
                result = "step"
            else:
                return result

    def creation(self) -> str:
        self.annotations()
        if self.at("<"):
            self.type_args()
        self.type(dims=False)
        if self.at("("):
            self.arguments()
            if self.at("{"):
                self.body()
            return "new"
        if not self.at("[", "@"):
            self.fail()
        sized = False
        while self.at("["):
            self.i += 1
            if self.take("]"):
                continue
            if sized is None:
                self.fail()
            self.expression()
            self.need("]")
            sized = True
        if self.at("{"):
            if sized:
                self.fail()
            self.initializer()
        elif not sized:
            self.fail()
        return "value"


#: Frames the parser may use, some 12 for each level of nesting; what is nested deeper is a fault of its own kind.
FRAMES = 3_000_000


def check(text: str) -> tuple[str, int] | None:
    """None for a valid compilation unit, else the kind of fault and its offset.

    The verdict does not depend on how deep the interpreter's frames may go: they lie on the
    heap and follow the number of tokens. Only beyond FRAMES is the reason "nesting".
    """
    usual = sys.getrecursionlimit()
    try:
        grammar = Grammar(text)
        sys.setrecursionlimit(max(usual, min(FRAMES, 1000 + 40 * len(grammar.t))))
        grammar.unit()
    except Rejected as fault:
        return fault.reason, fault.offset
    except RecursionError:
        return "nesting", grammar.t[grammar.i][2]
    finally:
        sys.setrecursionlimit(usual)
    return None
