import ast
import json

import pytest
import yaml
from hypothesis import given, settings
from hypothesis import strategies as st

from sextant.llm import syntax
from sextant.llm.syntax import check

GOOD_JAVA = [
    "",
    "package a; import static b.C.*; import d.E;",
    "class A<T extends B & C<D>> extends E<F[]> implements G, H { }",
    "sealed interface S permits A, B {} record A(int x, @N String... y) implements S { A { check(x); } static int z = 1; } non-sealed class B implements S {}",
    "enum E { A(1) { int f() { return 1; } }, B; E() {} E(int x) {} ; int f() { return 0; } }",
    "@interface X { int value() default 3; String[] names() default {\"a\", \"b\"}; }",
    "class A { int[] a = {1, 2}, b[] = {{1}}; long x = 0xFFL + 0b1_0 + 1_000.5e-3f; char c = '\\u0041', d = '\\'', e = '\\n'; String s = \"\\t\\\"(\"; }",
    'class A { String t = """\n  } { " \\""" \n  """; }',
    "class A { void f() { for (int i = 0, j = 1; i < 3; i++, j--) ; for (var x : xs) { continue; } for (;;) break; } }",
    "class A { void f() { a: while (x) { do { y(); } while (z); break a; } if (a) b(); else if (c) d(); else { } } }",
    "class A { int f(Object o) { return switch (o) { case Integer i when i > 3 -> 1; case P(int x, var y) -> { yield 2; } case null, default -> throw new E(); }; } }",
    "class A { void f() { switch (x) { case 1: case 2, 3: y(); break; default: z(); } } }",
    "class A { void f() { try (var a = b(); c) { } catch (E | F e) { } finally { } synchronized (this) { } assert x : y; throw new E(); } }",
    "class A { Object f() { Runnable r = () -> { }; F g = x -> x + 1; G h = (a, b) -> a; H i = (final int a, String... b) -> { return; }; return List<String>::new; } }",
    "class A { void f() { int x = (int) y + (Integer) z; Foo q = (Foo & Bar) w; a.<T>b().c[1]++; int[].class.getName(); String[]::new; } }".replace("String[]::new;", "use(String[]::new, this::f, super::g, A.B::c);"),
    "class A { void f() { new B<>() { void g() {} }.h(); new int[3][]; } }".replace("new int[3][];", "x = new int[3][]; y = new int[] {1}; z = a.new B();"),
    "class A { void f() { List<Map<String, List<Integer>>> x = y; boolean b = a < c && d > e; int s = a >> 2 >>> 3; s >>= 1; s >>>= 2; } }",
    "class A { void f() { if (o instanceof String s && !s.isEmpty()) { } if (!(o instanceof final P(int a, int b) p)) return; } }".replace("final P(int a, int b) p", "P(int a, int b)"),
    "class A { void f() { record R(int x) {} enum K { A } interface I {} final class L {} int record = 1; record = 2; var yield_ = 3; } }",
    "class A { A() { this(1); } A(int x) { super(); } static { } { } ; }",
    "class A { // <<<<<<< HEAD\n /*\n<<<<<<< HEAD\n=======\n>>>>>>> x\n*/ }",
    "module a.b { requires c; exports d to e; }",
    "class A { int f() [] { return null; } void g(A this, int x[]) { } @X int @Y [] h; }",
    "class A { void f() { x = a ? b : c ? d : e; x = a ? (b) -> c : d; } }",
]
BAD_JAVA = [
    "class A {", "class A { }}", "class A { void f() { ) } }", 'class A { String s = "abc; }', "class A { char c = ''; }", "class A { /* }", 'class A { String s = """\n x }',
    "class A { void f() { int x = ; } }", "class A { void f() { x } }", "class A { void f() { a + b; } }", "class A { void f() { if (x { } } }", "class A { int x }", "class { }",
    "class A {\n<<<<<<< HEAD\n int x;\n=======\n int y;\n>>>>>>> b\n}", "package a\nclass A { }", "{\"a\": 1}", "select a from b;", "def f():\n    pass", "import a.b", "class A { void f() { else { } } }",
    "class A { void f() { try { } } }", "class A { void f() { case 1: x(); } }", "a: 1", "class A { void f() { int class = 1; } }", "class A { void f(int x,) { } }", "class A { int x = 0x; }",
]


@pytest.mark.parametrize("text", GOOD_JAVA)
def test_java_that_parses(text):
    assert check("java", text) is None


@pytest.mark.parametrize("text", BAD_JAVA)
def test_java_that_does_not(text):
    assert check("java", text) is not None


def test_reasons():
    assert check("java", "class A {")[0] == "premature_end"
    assert check("java", 'class A { String s = "x')[0] == "unterminated_literal"
    assert check("java", "class A { ]")[0] == "unbalanced_delimiter"
    assert check("java", "class A {\n<<<<<<< HEAD\n}")[0] == "merge_conflict"
    assert check("json", "[1, 2")[0] == "premature_end"
    assert check("python", "def f(a):\n<<<<<<< HEAD\n    pass\n")[0] == "merge_conflict"
    assert check("yaml", "a: [1, 2")[0] == "premature_end"
    assert check("markdown", "<<<<<<< ```") is None and check(None, "x") is None and check("json", None) is None


def no_constant(x):
    raise ValueError(x)


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8), st.data())
def test_json_equals_the_exact_parser(value, data):
    text = json.dumps(value, indent=data.draw(st.sampled_from([None, 2])), ensure_ascii=data.draw(st.booleans()))
    at, how = data.draw(st.integers(0, len(text))), data.draw(st.sampled_from(["keep", "cut", "drop", "put"]))
    text = {"keep": text, "cut": text[:at], "drop": text[:at] + text[at + 1 :], "put": text[:at] + data.draw(st.sampled_from('{}[],:"\\ 1tx\n\'')) + text[at:]}[how]
    try:
        json.loads(text, parse_constant=no_constant)
        valid = True
    except ValueError:
        valid = False
    assert (check("json", text) is None) == valid


@pytest.mark.parametrize("text", ["01", "1.", ".5", "-", "+1", "1e", "NaN", "Infinity", "'a'", '"\t"', '"\\x"', "[1,]", '{"a":1,}', "", " ", "﻿1", "1 2", "tru", '{"a" 1}', "[1 2]", "{1:2}"])
def test_json_is_strict(text):
    assert check("json", text) is not None


PYTHON = [
    "x = f'{a!r:>{w}} {b[\"k\"]} {{}} {d:%Y:%m}'\n", "def f(a, *, b: int = 3) -> int:\n    '''doc ( '''\n    return (a +\n b)\n", "if x:\n  y\nelse:\n    z\n", "x = '''\n<<<<<<< HEAD\n'''\n",
    "# (\nx = 'a\\\nb'\n", "match x:\n    case [1, *_] if y: pass\n", "x = [\n1,\n  2]\n", "async def f():\n\tawait g()\n", "print 1\n", "x = (\n", "x = 'a\n", "if x:\n", "if x:\npass\n", "  x\n", "def f(\n", "x = }\n", "x = f'{a'\n",
    "if a:\n    b\n  c\n", "=======\n", "x = 1 +\n", "lambda x: x\n", "class A: pass\n", "x = rb'\\''\n", "x = f'{x:{y}}' f\"{'a' if b else \"c\"}\"\n", "", "\n\n", "x: int = 3; y = x\n", "with (a as b, c as d):\n    pass\n", "x = a if b else\n",
]


@pytest.mark.parametrize("text", PYTHON)
def test_python_equals_the_exact_grammar(text):
    try:
        ast.parse(text)
        valid = True
    except SyntaxError:
        valid = False
    assert (check("python", text) is None) == valid


YAML = [
    "a: 1\nb: [1, 2]\n", "a: |\n  x: [\n  'open\nb: 2\n", "a: 'it''s'\nb: \"q\\\"\"\n", "- a\n- b: {c: d}\n", "a: it's [fine\n", "a: [1,\n 2]\n", "a: {b: 'x', c: \"y\"}\n", "# only [ a comment\n", "", "---\na: 1\n---\nb: 2\n",
    "a: [1, 2\n", "a: 'x\n", "a: \"x\n", "a: b: c\n", "\ta: 1\n", "a: ]\n", "a: {b: ]}\n", "*x\n", "a: &x 1\nb: *x\n", "a: >-\n  folded \"\n  text\n", "key: value # note 'x\n", "- 'a'\n- \"b\nc\"\n", "'q': [a, 'b]']\n", "a:\n  - b\n c: d\n", "{a: 1}\n{b: 2}\n", "a: !!str [x\n",
]


@pytest.mark.parametrize("text", YAML)
def test_yaml_equals_the_exact_parser(text):
    try:
        list(yaml.parse(text, Loader=yaml.SafeLoader))
        valid = True
    except yaml.YAMLError:
        valid = False
    assert (check("yaml", text) is None) == valid


def test_rows_and_rates(spark):
    files = spark.createDataFrame(
        [(1, "r", "a.JSON", None, "[1]", 9), (2, "r", "b.json", "java", "[1", 9), (2, "r", "b.json", "json", "[1", 9), (3, "r", "c", "JAVA", "class A {", 9), (4, None, "d.md", None, "x", 9), (5, "r", "e.py", "py", None, 9), (6, "r", None, None, "x", 9)],
        "file_id bigint, repo string, path string, lang string, content string, valid int",
    )
    got = [(r["file_id"], r["lang"], r["valid"], r["reason"]) for r in syntax.parse_faults(files).orderBy("file_id").collect()]
    assert got == [(1, "json", True, None), (2, "json", False, "premature_end"), (2, "json", False, "premature_end"), (3, "java", False, "premature_end"), (4, "markdown", True, None), (5, "python", None, None), (6, None, None, None)]
    rates = {(r["repo"], r["lang"]): (r["files"], r["invalid"], r["rate"]) for r in syntax.fault_rates(files).collect()}
    assert rates[("r", "json")] == (3, 2, 0.666667) and rates[(None, "markdown")] == (1, 0, 0.0)
    assert syntax.parse_faults(files.limit(0)).count() == 0


def nested(inner, deep):
    return "class A { int f() { return " + "(" * deep + inner + ")" * deep + "; } }"


@pytest.mark.parametrize("deep", [2, 300, 3000, 40_000])
def test_depth_changes_no_verdict(deep):
    assert check("java", nested("1", deep)) is None
    assert check("java", nested("1 1", deep)) == ("grammar", nested("1 1", deep).index("1 1") + 2)
    chain = "class A { void f() { " + "if (a) b(); else " * deep
    assert check("java", chain + "c(); } }") is None and check("java", chain + "c() } }")[0] == "grammar"


def test_nesting_beyond_every_parser_is_named(monkeypatch):
    from sextant.llm import java_grammar

    monkeypatch.setattr(java_grammar, "FRAMES", 5000)
    assert check("java", nested("1", 3000))[0] == "nesting"
    assert check("python", "x = " + "-" * 500_000 + "1")[0] == "nesting"
    assert check("python", "x = " + "(" * 3000 + "1" + ")" * 3000) is not None  # the interpreter's own limit


def test_tabs_do_not_hide_faults():
    head = "def f():\n\tif x:\n\t\treturn 1\n"
    assert check("python", head) is None and check("python", "if x:\n\ty = 1\n        z = 2\n") is not None
    assert check("python", head + "<<<<<<< HEAD\ny = 1\n")[0] == "merge_conflict"
    assert check("python", head + "s = 'open\n")[0] == "unterminated_literal"
    assert check("python", "x = [\n1,\n=======\n2]\n")[0] == "merge_conflict"
    assert check("python", "def f:\n    pass\n") == ("grammar", 0) and check("python", "class A[T]:\n    def g[U](x): pass\n") is None


def test_yaml_markers_are_found_by_the_lexer():
    for text in ("a: 1\n<<<<<<< HEAD\nb: 2\n=======\nb: 3\n>>>>>>> x\n", "- a\n=======\n- b\n", "a:\n  - b\n>>>>>>> main\n"):
        with pytest.raises(syntax.Rejected) as fault:
            syntax._yaml_lexer(text)
        assert fault.value.reason == "merge_conflict" and check("yaml", text)[0] == "merge_conflict"
    for text in ("text\n=======\nmore\n", "a: |\n  x\n  =======\n  y\nb: 1\n", "a: 1\n<<<<<<< b: 2\n", "a: 1\n---\n=======\n", "a: '\n\n  =======\n'\n"):
        assert check("yaml", text) is None, text
