from sextant.llm import docpairs as d
from sextant.llm.docpairs import informs, name_stems

KNOWN = name_stems("fetchManifest", "EdgeStore", "public List<String> fetchManifest(String partitionName, long id)")


def test_comments_that_tell_nothing():
    for doc in (
        None, "", " \n", "/***/", "/** */", "/**\n * *\n */", "----", "...", "???", "N/A", "TODO", "TODO: document", "FIXME describe", "xxx", "<p></p>", "<!-- later -->",
        "No description.", "Description goes here.", "undocumented", "Auto-generated method stub", "TODO Auto-generated method stub", "Generated code, do not edit.",
        "(non-Javadoc)", "(non-Javadoc)\n@see EdgeStore#fetchManifest", "{@inheritDoc}", "<p>{@inheritDoc}</p>", "@inheritDoc", "See {@link EdgeStore#fetchManifest}.", "{@link Other}",
        "@author team one", "@since 3.1\n@version 4", "@deprecated", "@see Other", "fetchManifest", "fetchManifest().", "Method fetchManifest.", "EdgeStore#fetchManifest",
        "Fetches the manifest.", "This method fetches the manifest.", "The fetch manifest method.", "fetch the {@code manifest}", "@return the manifest", "@return {@code List<String>}",
        "@param partitionName the partition name\n@param id\n@return list", "@throws IllegalStateException",
    ):
        assert not informs(doc, KNOWN), doc


def test_comments_that_tell_something():
    for doc in (
        "Idempotent; safe to retry.", "Never blocks the calling thread.", "Fetches the manifest, unless the queue is empty.", "{@inheritDoc}\n\nThe cold path is skipped.",
        "@return the manifest that was stored last", "@param id the oldest key to use", "@throws IllegalStateException if the disk is full", "@deprecated since release 4: too slow under load",
        "TODO: revisit. Every module collects its parts.", "Lädt den Zweig ohne Neustart.", "La tâche trie la branche.", "/**\n     * Costs one round trip per shard.\n     */",
    ):
        assert informs(doc, KNOWN), doc


def test_java_islands():
    text = '''
package a.b;
// water ( {
class C {
    String s = "void no() {";
    /** Adds two numbers slowly. */
    @Deprecated @Anno("x)")
    public <T> int add(int a, Map<String, T> b) throws E { if (x) { call(); } return 1; }
    int f = compute(3);
    /* plain */ void plain() {}
    /** Runs. */ abstract void later(String s);
    class Inner { /** Inner words. */ Inner() { } }
}
'''
    got = [(x.owner, x.name, x.signature, x.doc is not None) for x in d.java_islands(text)]
    assert got == [
        ("a.b.C", "add", "public <T> int add(int a, Map<String, T> b) throws E", True),
        ("a.b.C", "plain", "void plain()", False),
        ("a.b.C", "later", "abstract void later(String s)", True),
        ("a.b.C.Inner", "Inner", "Inner()", True),
    ]
    assert d.java_islands(text)[0].code.endswith("return 1; }")
    assert d.java_islands("class X { void broken( {") == []


def test_python_islands():
    text = 'import os\n\nclass A:\n    """No function."""\n    def f(self, x={"a": 1}) -> dict[str, int]:\n        """Adds all rows."""\n        def g():\n            return 1\n        return g\n\n\nasync def h(a, b=(1, 2)):\n    x = """\ndef no():\n"""\n    return x\nprint(1)\n'
    got = d.python_islands(text)
    assert [(x.owner, x.name, x.doc) for x in got] == [("A", "f", "Adds all rows."), ("A.f", "g", None), ("", "h", None)]
    assert got[0].signature == 'def f(self, x={"a": 1}) -> dict[str, int]'
    assert got[2].code.endswith("return x")


def test_last_event_decides(make_events):
    e = make_events
    events = e(
        e.node("p.A#f()", "void f()", "Keeps order of arrival."),
        e.node("p.A#f()", "void f()", "TODO"),
        e.node("p.A#g()", "void g()", "TODO"),
        e.node("p.A#g()", "void g()", "Keeps order of arrival."),
        e.node("p.A#h()", " ", "Keeps order of arrival."),
        e.node("p.A#i()", None, "Keeps order of arrival."),
        e.node("p.A#j()", "void j()", None),
        e.node("p.A", "A", "Keeps order of arrival.", label="Class"),
        {"kind": "N", "id": None, "label": "Method", "signature": "x", "javadoc": "Keeps order of arrival."},
    )
    assert [r["id"] for r in d.documented_methods(events).collect()] == ["p.A#g()"]
    assert d.documented_methods(events.limit(0)).count() == 0


def test_pairs_of_files(spark):
    files = spark.createDataFrame([(1, "A.java", "java", "class A { /** Keeps order. */ void f() {} }"), (2, "x", None, "?"), (3, "a.py", "python", None)], "file_id bigint, path string, lang string, content string")
    assert [(r["name"], r["doc"]) for r in d.island_pairs(files).collect()] == [("f", "Keeps order.")]


def test_code_of_methods_without_a_chunk(spark, make_events, make_chunks, tmp_path):
    from sextant.llm import queries

    doc = "Keeps order of arrival."
    make_events(make_events.node("p.A#f(Map<String, Long>, int[])", "void f(Map<String, Long> a, int[] b)", doc), make_events.node("p.A#f(int)", "void f(int a)", doc), make_events.node("p.A#g()", "void g()", doc)).write.parquet(f"{tmp_path}/graph_events.parquet")
    make_chunks({"id": "g", "type": "METHOD", "fqn": "p.A#g()", "text": "chunk"}).write.parquet(f"{tmp_path}/chunks.parquet")
    content = "package p; class A { void f(@X(1) final Map<String,Long> a, int b[]) { one(); } void f(long a) { two(); } void g() { three(); } }"
    spark.createDataFrame([(1, "A.java", None, content, "2024-01-01")], "file_id bigint, path string, lang string, content string, received_at string").write.parquet(f"{tmp_path}/source_files.parquet")
    got = {r["id"]: r["code"] for r in queries.p1_pairs(spark, str(tmp_path)).collect()}
    assert got["p.A#g()"] == "chunk" and got["p.A#f(int)"] is None
    assert got["p.A#f(Map<String, Long>, int[])"].endswith("{ one(); }")
