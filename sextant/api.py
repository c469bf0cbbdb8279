"""The engine as one object: tools that return data or an error, never raise for bad input to a search."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.config import DEFAULTS, EngineConfig
from sextant.operators import compact, graph, ingest, monitor, search
from sextant.operators.index import SearchIndex
from sextant.operators.search import SearchFilter
from sextant.session import materialize, scratch
from sextant.sources import repository
from sextant.sources import store as snapshots
from sextant.sources.store import Checkpoints, SnapshotStore


@dataclass(frozen=True)
class Result:
    """rows, or the message of what went wrong."""

    rows: DataFrame | None = None
    error: str | None = None

    @property
    def ok(self) -> bool:
        return self.error is None


def _enveloped(work: Callable[[], DataFrame]) -> Result:
    try:
        return Result(work())
    except Exception as e:
        return Result(error=str(e) or type(e).__name__)


class Engine:
    """Searches are served from a stored index: the one of store, built there at first use, else one of the session.

    Rows are known to the index by a hash of (repo, branch, id), which the engine puts in place of seq.
    """

    def __init__(self, spark: SparkSession, chunks: DataFrame, events: DataFrame | None = None, config: EngineConfig = DEFAULTS, reranker: search.Reranker | None = None, store: SnapshotStore | None = None):
        self.spark, self.chunks, self.config = spark, chunks, config
        if reranker is None and config.rerank and config.model_dir:
            reranker = staged_reranker(config.model_dir)
        self.reranker = reranker if config.rerank else None
        self.metrics, self.activity = monitor.Metrics(), monitor.Activity()
        self._store, self._index = store, None
        if events is not None:
            self.nodes, self.edges = graph.fold_nodes(events), graph.fold_edges(events)

    @property
    def index(self) -> SearchIndex:
        if self._index is None:
            rows = keyed(self.chunks)
            if self._store is not None and self._store.version("search_statistics"):
                self._index = SearchIndex.open(rows, self._store)
            else:
                store = self._store or SnapshotStore(self.spark, scratch(self.spark, "search"))
                self._index = SearchIndex.build(rows, store, dim=self.config.dim, mode=self.config.analyzer)
        return self._index

    # -- search
    def search(self, query: str, mode: str = "hybrid", k: int | None = None, where: SearchFilter = SearchFilter()) -> Result:
        """Without reranking, k capped; the number of rows returned is the total."""
        self.metrics.count("search.requests")
        k = min(k or self.config.default_k, self.config.max_k)
        if mode.lower() == "bm25":
            return _enveloped(lambda: search.hits(self.index.bm25(query, k, where)))
        return _enveloped(lambda: search.hits(self.index.hybrid(query, k, where, self.config.candidate_k)))

    def _reranked(self, query: str, k: int | None, where: SearchFilter) -> Result:
        return _enveloped(lambda: search.hits(self.index.hybrid_rerank(query, k or self.config.default_k, where, self.reranker, self.config.candidate_k)))

    def search_code(self, query: str, k: int | None = None, repo: str | None = None, branch: str | None = None) -> Result:
        return self._reranked(query, k, SearchFilter(repo=repo, branch=branch, domain="CODE"))

    def search_knowledge(self, query: str, k: int | None = None, repo: str | None = None, branch: str | None = None) -> Result:
        return self._reranked(query, k, SearchFilter(repo=repo, branch=branch, domain="KNOWLEDGE"))

    def semantic_search(self, query: str, k: int | None = None, where: SearchFilter = SearchFilter()) -> Result:
        return self._reranked(query, k, where)

    def keyword_search(self, query: str, k: int | None = None, where: SearchFilter = SearchFilter()) -> Result:
        return _enveloped(lambda: search.hits(self.index.bm25(query, k or self.config.default_k, where)))

    def answer_context(self, query: str, budget: int = 0, where: SearchFilter = SearchFilter()) -> str:
        try:
            found = self.index.hybrid_rerank(query, self.config.default_k, where, self.reranker, self.config.candidate_k)
            return compact.compact(search.hits(found), budget, self.config.chars_per_token, self.config.min_tokens_per_hit).first()["context"]
        except Exception as e:
            return f"Error: {e}"

    def refresh_index(self, indexer: Indexer, repo: str, folder: str, sha: str = "local") -> dict[str, Any]:
        """Index a repository anew and search what is then stored: the number of chunks, or -1 and the error."""
        try:
            done = indexer.full(folder, repo, None, sha)
            self.chunks, self._store, self._index = indexer.store.read("chunks"), indexer.store, None
            events = indexer.store.read("graph_events")
            self.nodes, self.edges = graph.fold_nodes(events), graph.fold_edges(events)
            return {"total": done.indexed, "version": f"ok [reindex complete: {repo}]"}
        except Exception as e:
            return {"total": -1, "version": f"ERROR: {e}"}

    # -- symbols
    def get_symbol(self, fqn: str) -> DataFrame:
        view = graph.symbol_view(self.nodes, self.edges, fqn)
        body = search.symbol_body(self.chunks, fqn, self.config.max_body_chars).withColumn("fqn", F.lit(fqn))
        return view.join(body, "fqn", "left")

    def find_symbol(self, fragment: str, type: str | None = None) -> Result:
        return _enveloped(lambda: search.symbol_refs(search.by_name_fragment(self.chunks, fragment, type, self.config.find_symbol_k)))

    def discover_symbols(self, query: str, k: int | None = None, where: SearchFilter = SearchFilter()) -> Result:
        """Search hits without their snippets."""
        found = self._reranked(query, k, where)
        return found if not found.ok else Result(found.rows.withColumn("snippet", F.lit(None).cast("string")))

    def get_callers(self, fqn: str, depth: int = 1) -> DataFrame:
        return graph.callers(self.nodes, self.edges, fqn, depth)

    def get_callees(self, fqn: str, depth: int = 1) -> DataFrame:
        return graph.callees(self.nodes, self.edges, fqn, depth)

    def get_topic_flow(self, topic: str) -> DataFrame:
        return graph.topic_flow(self.nodes, self.edges, topic)

    def expand_context(self, seeds: str, hops: int = 1, most: int = 0) -> DataFrame:
        wanted, limit = graph.expand_seeds(seeds, most)
        return graph.expand(self.nodes, self.edges, wanted, hops, limit)

    def get_endpoint(self, method: str, path: str) -> DataFrame:
        return graph.endpoint(self.nodes, self.edges, method, path)

    def get_bean_graph(self, name: str, depth: int = 2) -> DataFrame:
        return graph.bean_graph(self.nodes, self.edges, name, depth)

    def get_design_for_symbol(self, fqn: str) -> Result:
        return _enveloped(lambda: search.hits(search.design_for_symbol(self.index, fqn, self.reranker)))

    def get_code_for_doc(self, id_: str) -> Result:
        return _enveloped(lambda: search.hits(search.code_for_document(self.index, id_, self.reranker)))

    def check_spec_vs_impl(self, repo: str) -> DataFrame:
        spec = search.by_type(self.chunks, "OPENAPI_OP", repo, self.config.spec_max_ops).select(F.col("fqn").alias("id"))
        return graph.spec_vs_impl(spec, graph.endpoint_keys(self.nodes, self.edges, repo))

    def index_status(self, tracked: DataFrame, checkpoints: DataFrame, last_sync: DataFrame | None = None) -> dict[str, Any]:
        """Chunks of all tracked branches, whether any is being indexed, and the rows of each branch."""
        try:
            stats = monitor.branch_stats(self.chunks, tracked, checkpoints, last_sync, self.activity)
            row = monitor.status(stats).first()
            return {"total": row["total_chunks"], "version": "ok", "indexing": row["any_indexing"], "branches": stats}
        except Exception as e:
            return {"total": -1, "version": str(e), "indexing": False, "branches": None}


def keyed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("seq", F.xxhash64("repo", "branch", "id"))


def staged_reranker(model_dir: str) -> search.Reranker | None:
    """The cross-encoder where its model and tokenizer are staged, else none."""
    files = [os.path.join(model_dir, name) for name in ("reranker.onnx", "reranker-tokenizer.json")]
    return search.cross_encoder(*files) if all(map(os.path.exists, files)) else None


@dataclass(frozen=True)
class Counts:
    """What a run did: chunks indexed, files whose rows were deleted, files left out by rules, files that gave nothing."""

    indexed: int
    deleted: int = 0
    skipped: int = 0
    failed: int = 0
    sha: str | None = None


class Indexer:
    """Builds the chunk and graph tables of repositories in a snapshot store, and the search index over them."""

    def __init__(self, spark: SparkSession, store: SnapshotStore, checkpoints: Checkpoints, config: EngineConfig = DEFAULTS, registry: repository.FilterRegistry | None = None):
        self.spark, self.store, self.checkpoints, self.config = spark, store, checkpoints, config
        self.registry = registry or repository.FilterRegistry((config.include, config.exclude))
        self.activity, self.metrics = monitor.Activity(), monitor.Metrics()

    def _files(self, folder: str, repo: str, branch: str | None, sha: str) -> DataFrame:
        found = repository.decoded(repository.accepted_files(self.spark, folder, repo, self.registry, self.config))
        numbered = found.withColumn("seq", F.floor(F.unix_micros("modified") / 1000))
        return numbered.select("seq", F.lit(repo).alias("repo"), F.lit(branch).cast("string").alias("branch"), "path", F.lit(sha).alias("git_sha"), "content")

    def _parsed(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The chunks and events of files, each file read and parsed once."""
        parsed = materialize(ingest.parse_files(files), "parsed")
        return parsed, materialize(ingest.chunk_rows(parsed, self.config), "fresh")

    def _commit(self, chunks: DataFrame, parsed: DataFrame, files: int, fresh: DataFrame, sha: str, deleted: int = 0, skipped: int = 0) -> Counts:
        self.store.commit("chunks", chunks, sort_by=("repo", "path"))
        self.store.upsert("graph_events", ingest.event_rows(parsed), ("seq", "kind", "id", "src", "dst", "edge_type"))
        SearchIndex.build(keyed(self.store.read("chunks")), self.store, dim=self.config.dim, mode=self.config.analyzer)
        facts = fresh.agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths")).first()
        done = Counts(facts["n"], deleted, skipped, max(0, files - facts["paths"]), sha)
        for name in ("indexed", "deleted", "skipped", "failed"):
            self.metrics.count(f"index.{name}", getattr(done, name))
        self.metrics.gauge("index.chunks", self.store.read("chunks").count())
        return done

    def full(self, folder: str, repo: str, branch: str | None, sha: str, prune: bool = False) -> Counts:
        """All accepted files of a folder; prune also drops rows of the repo whose files are gone."""
        with self.activity.indexing(repo, branch), self.metrics.timed("index.full"):
            files = self._files(folder, repo, branch, sha)
            parsed, fresh = self._parsed(files)
            now, rows = self.store.read("chunks"), fresh
            if now is not None:
                gone = F.col("repo") == repo if prune else F.lit(False)
                now = now.filter(~F.coalesce(gone, F.lit(False)))
                now = snapshots.delete_by_path(now, fresh.select("path"), branch)
                rows = snapshots.upsert(now, fresh, self.config.chunk_key)
            return self._commit(rows, parsed, files.select("path").count(), fresh, sha)

    def incremental(self, folder: str, repo: str, branch: str | None, old: str, new: str) -> Counts:
        """The files that differ between two commits; deletions need no acceptance."""
        with self.activity.indexing(repo, branch), self.metrics.timed("index.incremental"):
            every = repository.changes(self.spark, folder, old, new)
            changes = every.filter((F.col("kind") == "DELETE") | self.registry.accepted(F.lit(repo), F.col("path")))
            files = self._files(folder, repo, branch, new).join(changes.filter("kind != 'DELETE'").select("path"), "path", "left_semi")
            parsed, fresh = self._parsed(files)
            now = self.store.read("chunks")
            rows = fresh if now is None else ingest.apply_changes(now, changes, fresh, branch, self.config)
            kinds = {r["kind"]: r["n"] for r in changes.groupBy((F.col("kind") == "DELETE").cast("string").alias("kind")).agg(F.count("*").alias("n")).collect()}
            read = files.select("path").count()
            return self._commit(rows, parsed, read, fresh, new, kinds.get("true", 0), every.count() - kinds.get("true", 0) - read)

    def file(self, folder: str, repo: str, branch: str | None, path: str, sha: str) -> Counts:
        """One file: nothing if it is missing, skipped if rules leave it out, else its rows are replaced."""
        with self.activity.indexing(repo, branch), self.metrics.timed("index.file"):
            if not os.path.isfile(os.path.join(folder, path)):
                return Counts(0, sha=sha)
            content = repository.read_file(self.spark, folder, path, repo, self.registry, self.config)
            if content is None:
                return Counts(0, skipped=1, sha=sha)
            files = content.select(F.floor(F.unix_micros("modified") / 1000).alias("seq"), F.lit(repo).alias("repo"), F.lit(branch).cast("string").alias("branch"), "path", F.lit(sha).alias("git_sha"), "content")
            parsed, fresh = self._parsed(files)
            now, rows = self.store.read("chunks"), fresh
            if now is not None:
                rows = snapshots.upsert(snapshots.delete_by_path(now, files.select("path"), branch), fresh, self.config.chunk_key)
            return self._commit(rows, parsed, 1, fresh, sha)

    def engine(self, reranker: search.Reranker | None = None) -> Engine:
        """An engine over what is stored now."""
        return Engine(self.spark, self.store.read("chunks"), self.store.read("graph_events"), self.config, reranker, self.store)
