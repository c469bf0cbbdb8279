from sextant.operators import graph


def fold(events):
    return graph.fold_nodes(events), graph.fold_edges(events)


def signatures(df):
    return [r["signature"] for r in df.orderBy("depth", "seq").collect()]


def test_callers_and_callees(make_events):
    e = make_events
    n, ed = fold(e(e.node("com.A#foo", "void foo()", "does foo"), e.node("com.B#bar", "void bar()"), e.edge("com.B#bar", "com.A#foo")))
    assert signatures(graph.callers(n, ed, "com.A#foo")) == ["void bar()"]
    assert signatures(graph.callees(n, ed, "com.B#bar")) == ["void foo()"]
    assert graph.callers(n, ed, "com.A#foo", 0).count() == 0
    assert graph.callers(n, ed, "unknown").count() == 0
    view = graph.symbol_view(n, ed, "com.A#foo").first()
    assert (view["signature"], view["javadoc"], view["callers"], view["callees"]) == ("void foo()", "does foo", ["void bar()"], [])
    assert graph.symbol_view(n, ed, "unknown").first()["signature"] is None


def test_cycles_and_repeated_edges_end(make_events):
    e = make_events
    n, ed = fold(e(e.node("A"), e.edge("A", "B"), e.edge("B", "A"), e.edge("A", "B"), e.edge("B", "C"), e.edge("C", "C")))
    got = graph.callees(n, ed, "A", 5).orderBy("depth", "id").collect()
    assert [(r["id"], r["signature"], r["depth"]) for r in got] == [("B", "B", 1), ("C", "C", 2)]


def test_expansion_hops_and_limits(make_events):
    e = make_events
    n, ed = fold(e(e.edge("A", "B"), e.edge("B", "C")))
    assert [r["id"] for r in graph.expand(n, ed, ["A"], 1).collect()] == ["B"]
    assert sorted(r["id"] for r in graph.expand(n, ed, ["A"], 2).collect()) == ["B", "C"]
    n, ed = fold(e(*[e.edge("A", f"B{i}") for i in range(10)]))
    assert graph.expand(n, ed, ["A"], 1, 3).count() == 3
    assert graph.expand(n, ed, ["A"], 1).count() == 10
    assert graph.expand_seeds(" a, ,b ", 0) == (["a", "b"], 50)
    assert graph.expand_seeds("a", 900) == (["a"], 200)


def test_endpoints(make_events):
    e = make_events
    n, ed = fold(
        e(
            e.node("POST /api/pay", "POST /api/pay", "operationPay", "Endpoint", ["ENDPOINT", "REPO:alpha"]),
            e.node("GET /b", None, None, "Endpoint", ["ENDPOINT", "REPO:beta"]),
            e.node("GET /spec", None, None, "Endpoint", ["ENDPOINT", "REPO:alpha"]),
            e.edge("com.Pay#pay()", "POST /api/pay", "EXPOSES"),
            e.edge("com.Later#pay()", "POST /api/pay", "EXPOSES"),
            e.edge("com.B#b()", "GET /b", "EXPOSES"),
            e.edge("spec.yaml", "GET /spec", "SPECIFIES"),
        )
    )
    row = graph.endpoint(n, ed, "post", "api/pay").first()
    assert (row["method"], row["path"], row["operation_id"], row["handler"]) == ("POST", "/api/pay", "operationPay", "com.Pay#pay()")
    assert graph.endpoint(n, ed, "GET", "/none").count() == 0
    assert sorted(r["id"] for r in graph.endpoint_keys(n, ed).collect()) == ["GET /b", "POST /api/pay"]
    assert [r["id"] for r in graph.endpoint_keys(n, ed, "alpha").collect()] == ["POST /api/pay"]


def test_bean_graph_resolves_simple_names(make_events):
    e = make_events
    n, ed = fold(
        e(
            *[e.node(f"com.shop.{c}", c, None, "Class", ["BEAN"]) for c in ("OrderService", "PaymentService", "RepoClient")],
            e.edge("com.shop.OrderService", "PaymentService", "DEPENDS_ON"),
            e.edge("com.shop.PaymentService", "RepoClient", "DEPENDS_ON"),
        )
    )
    got = graph.bean_graph(n, ed, "OrderService", 2).orderBy("depth").collect()
    assert [(r["root"], r["fqn"], r["depth"]) for r in got] == [("com.shop.OrderService", "com.shop.PaymentService", 1), ("com.shop.OrderService", "com.shop.RepoClient", 2)]
    assert graph.bean_graph(n, ed, "OrderService", 1).count() == 1
    assert graph.bean_graph(n, ed, "Nothing", 2).count() == 0


def test_topic_flow_keeps_repeated_edges(make_events):
    e = make_events
    n, ed = fold(e(e.node("p", "void p()"), e.edge("p", "t", "PRODUCES"), e.edge("c", "t", "CONSUMES"), e.edge("c", "t", "CONSUMES")))
    got = [(r["role"], r["signature"]) for r in graph.topic_flow(n, ed, "t").orderBy("seq").collect()]
    assert got == [("producer", "void p()"), ("consumer", "c"), ("consumer", "c")]


def test_folding_the_log(make_events):
    e = make_events
    events = e(
        e.tag("A", "EARLY"),
        e.node("A", "s1", "d1", tags=["X"]),
        e.node("A", None, "d2", label="Class", tags=["Y", "X"]),
        e.tag("A", "BEAN"),
        e.tag("only-tag", "BEAN"),
        e.edge("A", "ghost"),
        {"kind": "N", "id": None},
    )
    rows = graph.fold_nodes(events).collect()
    assert [(r["id"], r["label"], r["tags"], r["signature"], r["javadoc"]) for r in rows] == [("A", "Class", ["BEAN", "X", "Y"], None, "d2")]
    assert graph.fold_nodes(events.limit(0)).count() == 0
    assert graph.fold_edges(events).count() == 1


def test_specification_against_implementation(spark):
    spec = spark.createDataFrame([("GET /a",), ("POST /b",), ("GET /a",), (None,)], "id string")
    impl = spark.createDataFrame([("GET /a",), ("GET /c",)], "id string")
    got = {r["key"]: r["state"] for r in graph.spec_vs_impl(spec, impl).collect()}
    assert got == {"GET /a": "matched", "POST /b": "unimplemented", "GET /c": "undocumented"}
