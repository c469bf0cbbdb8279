from sextant.operators import compact, ingest, java_source, markdown, monitor
from sextant.sources import store
from sextant.sources.repository import IgnoreRules

JAVA = '''package com.shop;
import java.util.*;
/** Pays.
 * Twice. */
@Service
public class PaymentService<T extends Comparable<T>> extends Base {
    private final Map<String, List<Integer>> m = new HashMap<>();
    int[] xs = {1, 2};
    public PaymentService(OrderRepo repo, String name, java.util.List<Foo> l) { this.repo = repo; }
    /** Settles it. */
    @Transactional(readOnly = true)
    public <R> Optional<R> settle(String id, Map<String, Long> by) throws IOException {
        log.info("a } {");
        repo.find(id).ifPresent(x -> markPaid(x));
        return Optional.empty();
    }
    @PostMapping("/api/pay") void pay(@RequestBody Dto d) {}
    @GetMapping void none() {}
    @RequestMapping(value = {"v1/items", "/v2"}, method = GET) void items() {}
    @KafkaListener(topics = "orders") void listen(String s) {}
    enum Kind { A { void x() {} }, B; void inner() {} }
    interface Inner { int f(int... a); }
    record Point(int x) { void shown() {} }
}
'''


def test_java_structure():
    chunks, events = ingest.parse_java("r", "P.java", JAVA)
    assert [c["fqn"] for c in chunks] == [
        "com.shop.PaymentService",
        "com.shop.PaymentService#settle(String, Map<String, Long>)",
        "com.shop.PaymentService#pay(Dto)",
        "com.shop.PaymentService#none()",
        "com.shop.PaymentService#items()",
        "com.shop.PaymentService#listen(String)",
        "com.shop.Inner",
        "com.shop.Inner#f(int)",
    ] or [c["fqn"] for c in chunks][-1].startswith("com.shop.Inner#f(int")
    assert chunks[0]["text"] == "com.shop.PaymentService\nPays.\nTwice."
    assert chunks[0]["symbols"] == ["@Service"]
    assert chunks[1]["text"].startswith("public <R> Optional<R> settle(String id, Map<String, Long> by) throws IOException\n{")
    edges = {(e["src"], e["dst"], e["edge_type"]) for e in events if e["kind"] == "E"}
    top = "com.shop.PaymentService"
    assert (top, "OrderRepo", "DEPENDS_ON") in edges
    assert not any(t == "DEPENDS_ON" and d != "OrderRepo" for _, d, t in edges)
    assert {d for s, d, t in edges if t == "EXPOSES"} == {"POST /api/pay", "GET /", "ANY /v1/items"}
    assert (f"{top}#listen(String)", "orders", "CONSUMES") in edges
    calls = {d for s, d, t in edges if t == "CALLS"}
    assert calls == {"log.info", "repo.find(id).ifPresent", "repo.find", "markPaid", "Optional.empty"}
    nodes = {e["id"]: e for e in events if e["kind"] == "N"}
    assert nodes[top]["tags"] == ["BEAN"]
    assert nodes["com.shop.Inner"]["label"] == "Interface"


def test_java_that_does_not_parse_gives_nothing():
    assert ingest.parse_java("r", "p", "class A { void f( }") == ([], [])
    assert ingest.parse_java("r", "p", None) == ([], [])
    assert java_source.parse("class A {") is None


def test_markdown_sections_and_ids():
    chunks, _ = ingest.parse_markdown("r", "docs/readme.md", "# Install\n\nRun Maven.\n\n# Config\n\nEdit YAML.")
    assert [(c["id"], c["title"], c["text"]) for c in chunks] == [("docs/readme.md#install", "Install", "Run Maven."), ("docs/readme.md#config", "Config", "Edit YAML.")]
    assert [c["id"] for c in ingest.parse_markdown("r", "notes.md", "plain body")[0]] == ["notes.md#body"]
    assert [c["id"] for c in ingest.parse_markdown("r", "e.md", None)[0]] == ["e.md#body"]
    fenced = markdown.sections("Title\n=====\n\ntext\n\n```\n# no heading\n```\n\n> # quoted\n\n- # item\n")
    assert len(fenced) == 1 and fenced[0][0] == "Title"


def test_packing_keeps_oversized_paragraphs_whole():
    chunks, _ = ingest.parse_markdown("r", "b.md", "# Big Section\n\n" + "\n\n".join("word " * 39 for _ in range(25)))
    assert len(chunks) > 1 and all(len(c["text"]) <= 4100 and c["title"] == "Big Section" for c in chunks)
    assert [c["id"] for c in chunks[:2]] == ["b.md#big-section", "b.md#big-section-1"]
    assert [len(p) for p in markdown.pack("a" * 3000 + "\n\n" + "b" * 2000)] == [3000, 2000]
    assert [len(p) for p in markdown.pack("a" * 9000)] == [9000]


def test_openapi_operations():
    spec = """
openapi: 3.0.0
paths:
  /pets:
    get: {summary: List, parameters: [{name: limit, description: how many}], responses: {"200": {description: fine}}}
    post: {requestBody: {description: a pet}, responses: {"201": {description: made}}}
  /pets/{id}:
    get: {responses: {}}
"""
    chunks, events = ingest.parse_openapi("myrepo", "api/p.yaml", spec)
    assert [c["fqn"] for c in chunks] == ["GET /pets", "POST /pets", "GET /pets/{id}"]
    assert chunks[0]["text"] == "GET /pets\nList\nparam:limit how many\nresponse:200 fine"
    assert chunks[0]["id"] == "api/p.yaml#GET-_pets"
    assert "request:a pet" in chunks[1]["text"]
    assert events[0]["tags"] == ["ENDPOINT", "REPO:myrepo"]
    assert ingest.parse_openapi("r", "x.json", '{"a": 1}') == ([], [])
    assert ingest.parse_openapi("r", "x.yaml", "a: [") == ([], [])


def test_html_text_is_the_visible_one():
    assert ingest.html_text("<h1>A</h1><script>x</script><p>b &amp; c") == "A\nb & c"


def test_files_to_rows(spark):
    files = spark.createDataFrame(
        [(1, "r", None, "a/A.java", "s", "package p; class A {}"), (2, "r", None, "a/A.java", "s", "package p; /** new */ class A {}"), (3, "r", None, "x.png", "s", "?"), (4, "r", None, "n.txt", "s", None), (5, "r", "b", "n.txt", "s", " hi ")],
        "seq bigint, repo string, branch string, path string, git_sha string, content string",
    )
    parsed = ingest.parse_files(files)
    rows = {r["id"]: r for r in ingest.chunk_rows(parsed).collect()}
    assert set(rows) == {"p.A", "n.txt#body"}
    assert rows["p.A"]["text"] == "p.A\nnew"
    assert rows["n.txt#body"]["text"] == "hi" and len(rows["n.txt#body"]["vector"]) == 384
    assert ingest.event_rows(parsed).count() == 2
    assert ingest.chunk_rows(ingest.parse_files(files.limit(0))).count() == 0


def test_incremental_changes(spark, make_chunks):
    old = make_chunks({"id": "a#body", "path": "a", "content_hash": "h1"}, {"id": "b#body", "path": "b", "content_hash": "h2"}, {"id": "c#body", "path": "c"})
    fresh = make_chunks({"id": "a#body", "path": "a", "content_hash": "h1", "seq": 11}, {"id": "b#body", "path": "b", "content_hash": "h9", "seq": 12})
    changes = spark.createDataFrame([("MODIFY", "a"), ("MODIFY", "b"), ("DELETE", "c")], "kind string, path string")
    got = {r["id"]: r["seq"] for r in ingest.apply_changes(old, changes, fresh).collect()}
    assert got == {"a#body": 1, "b#body": 12}
    got = {r["id"]: r["seq"] for r in ingest.apply_changes(old, changes, fresh, branch="main").collect()}
    assert got == {"a#body": 11, "b#body": 12, "c#body": 3}


def test_upserts_and_deletes(spark, make_chunks):
    now = make_chunks({"id": "a", "path": "x", "branch": "main"}, {"id": "b", "path": "x"}, {"id": "c", "path": None})
    again = store.upsert(now, now.filter("id = 'a'"))
    assert again.count() == 3
    paths = spark.createDataFrame([("x",), (None,), ("x",)], "path string")
    assert [r["id"] for r in store.delete_by_path(now, paths).collect()] == ["c"]
    assert sorted(r["id"] for r in store.delete_by_path(now, paths, branch="main").collect()) == ["b", "c"]


def test_ignore_rules():
    rules = IgnoreRules({"": "*.log\ntarget/\n", "logs": "!important.log"})
    assert rules.ignores("app.log") and rules.ignores("logs/debug.log") and not rules.ignores("logs/important.log")
    assert rules.ignores("a/target/x.java") and not rules.ignores("target.txt")
    assert not IgnoreRules({}).ignores("x")


def test_monitoring(spark, make_chunks):
    rows = make_chunks({"id": "c1", "repo": "m", "branch": "main"}, {"id": "c2", "repo": "m", "branch": "main"}, {"id": "k1", "repo": "m", "branch": "main", "domain": "KNOWLEDGE"}, {"id": "n", "repo": "m"})
    tracked = spark.createDataFrame([("m", "main"), ("m", None), ("m", "gone")], "repo string, branch string")
    marks = spark.createDataFrame([("m", "main", "abc123")], "repo string, branch string, sha string")
    stats = {r["branch"]: r for r in monitor.branch_stats(rows, tracked, marks).collect()}
    assert (stats["main"]["code_chunks"], stats["main"]["knowledge_chunks"], stats["main"]["last_sha"]) == (2, 1, "abc123")
    assert stats[None]["total_chunks"] == 1 and stats["gone"]["total_chunks"] == 0
    activity = monitor.Activity()
    with activity.indexing("r", "b"):
        assert activity.is_indexing("r", "b") and not activity.is_indexing("r") and activity.any()
    assert not activity.any()


def test_context_budget(spark):
    hits = spark.createDataFrame(
        [(1, "CODE", "i", "com.A", None, "p", None, "word " * 80), (2, "KNOWLEDGE", "j", None, "T", "p", "S", "small")],
        "rank int, domain string, id string, fqn string, title string, path string, section string, snippet string",
    )
    row = compact.compact(hits, 100).first()
    assert "// com.A" in row["context"] and "## T > S\nsmall" in row["context"] and row["n_hits"] == 2
    first = row["context"].split("\n\n")[0]
    assert len(first) <= 320
    assert compact.compact(hits.limit(0), 100).first()["context"] == ""
    assert compact.compact(hits, 10).first()["n_hits"] == 1
