import subprocess

import pytest
from pyspark.sql import functions as F

from sextant.api import Engine, Indexer
from sextant.config import EngineConfig
from sextant.operators.search import SearchFilter
from sextant.operators import monitor
from sextant.sources import repository
from sextant.sources.repository import FilterRegistry
from sextant.sources.store import Checkpoints, SnapshotStore
from sextant.sources.tables import current_rows
from sextant.streaming.sync import BranchSync, Repo, SyncService


@pytest.fixture
def repo(tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    git("init", "-q", "-b", "main")
    (tmp_path / "src/a").mkdir(parents=True)
    (tmp_path / "src/a/A.java").write_text("package a; /** Doc. */ public class A { void run() { helper.call(); } }")
    (tmp_path / "src/a/notes.md").write_text("# One\n\nkafka stream\n")
    (tmp_path / "src/a/skip.log").write_text("x")
    (tmp_path / ".gitignore").write_text("ignored/\n")
    (tmp_path / "ignored/b").mkdir(parents=True)
    (tmp_path / "ignored/b/B.java").write_text("class B {}")
    git("add", "-A")
    git("commit", "-q", "-m", "one")
    return tmp_path, git


def test_full_and_incremental_index(spark, repo, tmp_path_factory):
    folder, git = repo
    out = tmp_path_factory.mktemp("store")
    kept = SnapshotStore(spark, f"file://{out}/s")
    indexer = Indexer(spark, kept, Checkpoints(str(out / "c.json")), EngineConfig(dim=16))
    first = repository.head(str(folder), "main")
    done = indexer.full(str(folder), "r", "main", first)
    assert (done.indexed, done.skipped, done.failed, done.sha) == (3, 0, 0, first)
    assert sorted(r["id"] for r in kept.read("chunks").collect()) == ["a.A", "a.A#run()", "src/a/notes.md#one"]
    (folder / "src/a/A.java").unlink()
    (folder / "src/a/notes.md").write_text("# Two\n\nmaven\n")
    git("add", "-A")
    git("commit", "-q", "-m", "two")
    second = repository.head(str(folder), "main")
    assert sorted(repository.diff(str(folder), first, second)) == [("DELETE", "src/a/A.java"), ("MODIFY", "src/a/notes.md")]
    done = indexer.incremental(str(folder), "r", "main", first, second)
    assert (done.indexed, done.deleted, done.failed) == (1, 1, 0) and indexer.metrics.counters["index.indexed"] == 4
    assert [r["id"] for r in kept.read("chunks").collect()] == ["src/a/notes.md#two"]
    engine = indexer.engine()
    assert engine.search("maven", "BM25").rows.count() == 1
    assert engine.keyword_search("maven", where=SearchFilter(branch="other")).rows.count() == 0
    assert engine.get_callees("a.A#run()").first()["signature"] == "helper.call"
    assert "maven" in engine.answer_context("maven")
    assert not Engine(spark, spark.range(1)).search("x").ok
    assert Engine(spark, spark.range(1)).answer_context("x").startswith("Error: ")


def test_single_files_and_refresh(spark, repo, tmp_path_factory):
    folder, _ = repo
    out = tmp_path_factory.mktemp("store")
    registry = FilterRegistry(overrides={"docs": (("**/*.md",), ())})
    indexer = Indexer(spark, SnapshotStore(spark, f"file://{out}/s"), Checkpoints(str(out / "c.json")), EngineConfig(dim=16), registry)
    assert indexer.file(str(folder), "r", None, "none.md", "s").indexed == 0
    assert indexer.file(str(folder), "r", None, "ignored/b/B.java", "s").skipped == 1
    assert indexer.file(str(folder), "docs", None, "src/a/A.java", "s").skipped == 1
    assert indexer.file(str(folder), "r", None, "src/a/notes.md", "s").indexed == 1
    assert [r["id"] for r in indexer.engine().search("kafka", "bm25").rows.collect()] == ["src/a/notes.md#one"]
    (folder / "src/a/notes.md").write_text("# One\n\nmaven\n")
    assert indexer.file(str(folder), "r", None, "src/a/notes.md", "t").indexed == 1
    engine = indexer.engine()
    assert engine.search("kafka", "bm25").rows.count() == 0 and engine.search("maven").rows.first()["id"] == "src/a/notes.md#one"
    assert engine.refresh_index(indexer, "r", str(folder)) == {"total": 3, "version": "ok [reindex complete: r]"}
    assert engine.keyword_search("helper.call").rows.count() == 1
    assert engine.refresh_index(indexer, "r", str(folder / "nowhere"))["total"] == -1
    tracked = spark.createDataFrame([("r", None)], "repo string, branch string")
    with engine.activity.indexing("r"):
        status = engine.index_status(tracked, Checkpoints(str(out / "c.json")).table(spark))
    assert (status["total"], status["indexing"]) == (3, True)
    assert engine.index_status(spark.range(1), spark.range(1))["total"] == -1


def test_branches(repo):
    folder, git = repo
    for b in ("feature/auth", "feature/search"):
        git("branch", b)
    assert repository.branches(str(folder), "SINGLE", ("main", "x")) == ["main"]
    assert repository.branches(str(folder), "MULTI", ("feature/*",)) == ["feature/auth", "feature/search"]
    assert repository.branches(str(folder)) == ["main"]
    with pytest.raises(ValueError):
        repository.head(str(folder), "none")


def test_branch_sync(repo, tmp_path_factory):
    folder, _ = repo
    path = str(tmp_path_factory.mktemp("c") / "c.json")
    done = []
    sync = BranchSync(Checkpoints(path), lambda *a: done.append(("full", *a[:2])), lambda *a: done.append(("inc", *a[:2])))
    assert [r.mode for r in sync.sync("r", str(folder))] == ["full"]
    assert [r.mode for r in sync.sync("r", str(folder))] == ["none"]
    again = Checkpoints(path)
    again.put("r", "main", "0" * 40)
    again.flush()
    again = BranchSync(Checkpoints(path), lambda *a: None, lambda *a: done.append(("inc", *a[:2])))
    assert [r.mode for r in again.sync("r", str(folder))] == ["incremental"]
    assert done == [("full", "r", "main"), ("inc", "r", "main")]


def test_manual_sync(spark, repo, tmp_path_factory):
    folder, _ = repo
    path = str(tmp_path_factory.mktemp("c") / "c.json")
    service = SyncService({"r": Repo(str(folder), tracked=("main",))}, BranchSync(Checkpoints(path), lambda *a: None, lambda *a: None))
    with pytest.raises(ValueError, match="Unknown repo: x"):
        service.trigger("x")
    assert service.last_sync_table(spark).count() == 0
    assert [r.mode for r in service.trigger("r")] == ["full"]
    assert set(service.status()["last_sync"]) == {"r"} and "r:main" in service.status()["checkpoints"]
    chunks = spark.createDataFrame([("r", "main", "CODE")], "repo string, branch string, domain string")
    row = monitor.branch_stats(chunks, service.tracked_table(spark), service.sync.checkpoints.table(spark), service.last_sync_table(spark)).first()
    assert row["last_sync_at"].endswith("Z") and row["indexing"] is False and row["total_chunks"] == 1 and row["last_sha"]
    assert service.start(spark) == []


def test_upserts_write_only_their_buckets(spark, tmp_path):
    kept = SnapshotStore(spark, f"file://{tmp_path}/s")
    schema = "id string, seq long, text string"
    kept.upsert("t", spark.createDataFrame([(str(i), 1, "old") for i in range(400)] + [(None, 1, "null")], schema))
    before = kept._buckets("t")["parts"]
    opened = kept.read("t")
    kept.upsert("t", spark.createDataFrame([("7", 2, "new"), ("7", 3, "newest"), ("8", 0, "late"), ("x", 1, "added"), (None, 2, "null too")], schema))
    after = kept._buckets("t")["parts"]
    assert 1 <= sum(after[b] != v for b, v in before.items()) <= 4
    rows = {r["id"]: r["text"] for r in kept.read("t").collect()}
    assert (rows["7"], rows["8"], rows["x"], rows[None], len(rows)) == ("newest", "old", "added", "null too", 402)
    assert {r["id"]: r["text"] for r in opened.collect()}["7"] == "old"  # a reader keeps its version
    version = kept.version("t")
    kept.delete_where("t", F.col("id").isin("7", "none"))
    assert kept.read("t").count() == 401 and kept.version("t") != version
    kept.delete_where("t", F.col("id") == "none")
    kept.upsert("t", spark.createDataFrame([("9", 5, "wide", 1)], schema + ", more int"))
    assert kept.read("t").filter("more = 1").count() == 1 and kept.read("t").count() == 401
    assert kept.vacuum("t") >= 0 and kept.read("t").count() == 401
    kept.commit("t", spark.createDataFrame([("a", 1, "whole")], schema))
    kept.upsert("t", spark.createDataFrame([("b", 1, "then")], schema))
    assert sorted(r["id"] for r in kept.read("t").collect()) == ["a", "b"] and kept.vacuum("t") > 0
    kept.delete_where("t", F.lit(True))
    assert kept.read("t").count() == 0


def test_checkpoints_survive(tmp_path, spark):
    marks = Checkpoints(str(tmp_path / "c.json"))
    marks.put("repo1", "main", "abc123")
    marks.put("repo1", None, "sha1")
    marks.flush()
    again = Checkpoints(str(tmp_path / "c.json"))
    assert (again.get("repo1", "main"), again.get("repo1"), again.get("x")) == ("abc123", "sha1", None)
    assert again.table(spark).count() == 2


def test_current_rows(spark):
    rows = spark.createDataFrame(
        [("a", "r", None, 1, "old"), ("a", "r", None, 5, "new"), ("a", "r", "b", 2, "other"), ("a", "r", None, 3, "late"), (None, None, None, 4, "null"), ("z", "r", None, None, "no seq")],
        "id string, repo string, branch string, seq bigint, text string",
    )
    assert sorted(r["text"] for r in current_rows(rows).collect()) == ["new", "null", "other"]
    assert current_rows(rows.limit(0)).count() == 0
    assert [r["seq"] for r in current_rows(rows, rows.filter("text = 'new'").select("seq")).collect()] == [5]
