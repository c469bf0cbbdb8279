import duckdb

from sextant.operators import graph
from sextant.plans import catalogue
from sextant.sources.store import SnapshotStore
from sextant.streaming import sync

DATA = "/root/testdata/sf0.001"


def test_a_stream_of_upserts_equals_the_batch(spark):
    got = catalogue.QUERIES["stream_upsert"](spark, DATA).select("user_id", "event_id").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{DATA}/events.parquet')")
    want = con.sql(catalogue.ORACLES["stream_upsert"]).fetchall()
    assert sorted((r[0], r[1]) for r in got) == sorted((r[0], r[1]) for r in want)


def test_batches_that_come_again_change_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z"), (None, 4, "n")], "id string, seq bigint, text string")
    kept = SnapshotStore(spark, f"file://{tmp_path}/s")
    rows.write.parquet(f"{tmp_path}/in")
    for n in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        sync.upsert_stream(stream, kept, "t", f"file://{tmp_path}/c{n}").awaitTermination()
    assert sorted(((r["id"] or ""), r["text"]) for r in kept.read("t").collect()) == [("", "n"), ("a", "z"), ("b", "y")]


def test_the_graph_log_as_a_stream(spark, tmp_path, make_events):
    e = make_events
    events = e(e.node("A", "s"), e.edge("A", "B"), e.tag("A", "BEAN"))
    events.write.parquet(f"{tmp_path}/in")
    kept = SnapshotStore(spark, f"file://{tmp_path}/s")
    sync.graph_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), kept, f"file://{tmp_path}/c").awaitTermination()
    log = kept.read("graph_events")
    assert graph.fold_nodes(log).first()["tags"] == ["BEAN"] and graph.fold_edges(log).count() == 1


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS kind UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2024-01-01 05:00:00', 'b'")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = sync.activity_counts(stream, "ts", "kind").writeStream.format("memory").queryName("closed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["kind"], r["n"]) for r in spark.table("closed").collect()] == [("a", 2)]
    q = sync.latest_by_key(stream.withColumn("v", stream["kind"]), "kind", "ts", ["v"])
    run = q.writeStream.format("memory").queryName("last").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert {r["kind"]: str(r["ts"]) for r in spark.table("last").collect()} == {"a": "2024-01-01 00:50:00", "b": "2024-01-01 05:00:00"}
