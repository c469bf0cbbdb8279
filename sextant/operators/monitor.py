"""Index monitoring: counts, status per tracked branch, activity and metrics."""

from __future__ import annotations

import threading
import time
from collections import Counter
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators.search import ANY, SearchFilter


def count_by_filter(chunks: DataFrame, where: SearchFilter = ANY) -> DataFrame:
    return chunks.filter(where.condition()).agg(F.count("*").alias("n"))


def branch_stats(chunks: DataFrame, tracked: DataFrame, checkpoints: DataFrame, last_sync: DataFrame | None = None, activity: Activity | None = None) -> DataFrame:
    """Per tracked (repo, branch): code, knowledge and all chunks, last commit, time of the repo's last synchronisation, and whether it is being indexed.

    One aggregate serves all branches. A null branch is a value of its own. Tracked branches without
    chunks count 0. last_sync: repo, at (timestamp); the latest counts, in ISO form.
    """
    kind = lambda d: F.count_if(F.col("domain") == d)
    per = chunks.groupBy("repo", "branch").agg(kind("CODE").alias("code_chunks"), kind("KNOWLEDGE").alias("knowledge_chunks"), F.count("*").alias("total_chunks"))
    shas = checkpoints.groupBy("repo", "branch").agg(F.max("sha").alias("last_sha"))

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({"repo": "_repo", "branch": "_branch"})
        same = F.col("repo").eqNullSafe(F.col("_repo")) & F.col("branch").eqNullSafe(F.col("_branch"))
        return left.join(right, same, "left").drop("_repo", "_branch")

    joined = attach(attach(tracked.select("repo", "branch"), per), shas)
    iso = F.lit(None).cast("string").alias("last_sync_at")
    if last_sync is not None:
        joined = joined.join(last_sync.groupBy("repo").agg(F.max("at").alias("_at")), "repo", "left")
        iso = F.date_format("_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_sync_at")
    running = sorted(activity.open()) if activity is not None else []
    key = F.concat_ws(":", "repo", "branch")  # a null branch is keyed by the repo alone
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("repo", "branch", zero("code_chunks"), zero("knowledge_chunks"), zero("total_chunks"), "last_sha", iso, key.isin(running).alias("indexing"))


def status(stats: DataFrame) -> DataFrame:
    """total_chunks, branches, any_indexing over the rows of branch_stats."""
    return stats.agg(F.coalesce(F.sum("total_chunks"), F.lit(0)).alias("total_chunks"), F.count("*").alias("branches"), F.coalesce(F.max("indexing"), F.lit(False)).alias("any_indexing"))


class Activity:
    """Which (repo, branch) pairs are being indexed now; a null branch is keyed by the repo alone."""

    def __init__(self):
        self._lock, self._open = threading.Lock(), Counter()

    @staticmethod
    def key(repo: str, branch: str | None) -> str:
        return repo if branch is None else f"{repo}:{branch}"

    @contextmanager
    def indexing(self, repo: str, branch: str | None = None):
        key = self.key(repo, branch)
        with self._lock:
            self._open[key] += 1
        try:
            yield
        finally:
            with self._lock:
                self._open[key] -= 1
                if not self._open[key]:
                    del self._open[key]

    def is_indexing(self, repo: str, branch: str | None = None) -> bool:
        with self._lock:
            return self.key(repo, branch) in self._open

    def open(self) -> list[str]:
        with self._lock:
            return list(self._open)

    def any(self) -> bool:
        with self._lock:
            return bool(self._open)


class Metrics:
    """Counters, timers and gauges of one engine."""

    def __init__(self):
        self.counters: Counter = Counter()
        self.timers: dict[str, list[float]] = {}
        self.gauges: dict[str, float] = {}

    def count(self, name: str, by: int = 1) -> None:
        self.counters[name] += by

    @contextmanager
    def timed(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.timers.setdefault(name, []).append(time.perf_counter() - began)

    def gauge(self, name: str, value: float) -> None:
        self.gauges[name] = value
