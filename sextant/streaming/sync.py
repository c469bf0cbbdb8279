"""Incremental work as streams: chunk upserts, the graph event log, branch synchronisation."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.monitor import Activity
from sextant.sources import repository
from sextant.sources.store import Checkpoints, SnapshotStore

log = logging.getLogger(__name__)


def upsert_stream(rows: DataFrame, store: SnapshotStore, table: str, checkpoint: str, key: tuple[str, ...] = ("id",), order: tuple[str, ...] = ("seq",), once: bool = True, interval: str = "30 seconds"):
    """Start a query that merges each batch into a snapshot table, last writer wins.

    A batch that is delivered again after a failure gives the same table: the merge
    depends on the rows alone. Each batch is a new version that readers open as a whole.
    """

    def merge(batch: DataFrame, _: int) -> None:
        if batch.take(1):
            store.upsert(table, batch, key, order)

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def latest_by_key(rows: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """A streaming aggregate with the values of the highest order per key, for complete or update mode."""
    return rows.groupBy(key).agg(F.max(F.struct(order, *values)).alias("last")).select(key, *[F.col(f"last.{c}").alias(c) for c in (order, *values)])


def graph_stream(events: DataFrame, store: SnapshotStore, checkpoint: str, once: bool = True):
    """Append graph events to the stored log, from which nodes and edges are folded."""
    return upsert_stream(events, store, "graph_events", checkpoint, key=("seq",), order=("seq",), once=once)


def activity_counts(rows: DataFrame, ts: str, kind: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows per window and kind with a watermark; rows later than it are left out of closed windows."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begins"), kind, "n")


@dataclass(frozen=True)
class SyncResult:
    repo: str
    branch: str | None
    mode: str  # full, none or incremental
    sha: str


class BranchSync:
    """Brings each tracked branch of a repository up to its head: full at first, then by differences.

    full and incremental do the work; the checkpoint of a branch is put when it is done,
    and all are flushed at the end, so a failing branch does not lose what others did.
    """

    def __init__(self, checkpoints: Checkpoints, full: Callable[[str, str, str], object], incremental: Callable[[str, str, str, str], object], activity: Activity | None = None):
        self.checkpoints, self.full, self.incremental = checkpoints, full, incremental
        self.activity = activity or Activity()

    def sync(self, repo: str, folder: str, mode: str = "SINGLE", tracked: tuple[str, ...] = ()) -> list[SyncResult]:
        out = []
        try:
            for branch in repository.branches(folder, mode, tracked):
                with self.activity.indexing(repo, branch):
                    sha, last = repository.head(folder, branch), self.checkpoints.get(repo, branch)
                    if last is None:
                        self.full(repo, branch, sha)
                        done = "full"
                    elif last == sha:
                        done = "none"
                    else:
                        self.incremental(repo, branch, last, sha)
                        done = "incremental"
                    self.checkpoints.put(repo, branch, sha)
                    out.append(SyncResult(repo, branch, done, sha))
        finally:
            self.checkpoints.flush()
        return out


@dataclass(frozen=True)
class Repo:
    """A repository that is kept in step: its folder, tracked branches, and seconds between synchronisations (0: by hand only)."""

    folder: str
    mode: str = "SINGLE"
    tracked: tuple[str, ...] = ()
    interval: int = 0


class SyncService:
    """The registered repositories, synchronised by hand or by schedule, and when each last was."""

    def __init__(self, repos: dict[str, Repo], sync: BranchSync):
        self.repos, self.sync = repos, sync
        self.last_sync: dict[str, datetime] = {}

    def trigger(self, repo: str) -> list[SyncResult]:
        """Synchronise one repository now; an unknown one is an error."""
        if repo not in self.repos:
            raise ValueError(f"Unknown repo: {repo}")
        wanted = self.repos[repo]
        done = self.sync.sync(repo, wanted.folder, wanted.mode, wanted.tracked)
        self.last_sync[repo] = datetime.now(UTC)
        return done

    def status(self) -> dict:
        return {"checkpoints": self.sync.checkpoints.snapshot(), "last_sync": dict(self.last_sync)}

    def last_sync_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.last_sync.items()), "repo string, at timestamp")

    def tracked_table(self, spark: SparkSession) -> DataFrame:
        rows = [(name, b) for name, r in sorted(self.repos.items()) for b in (r.tracked or ("main",))]
        return spark.createDataFrame(rows, "repo string, branch string")

    def start(self, spark: SparkSession) -> list:
        return scheduled(spark, {name: r.interval for name, r in self.repos.items()}, self.trigger)


def scheduled(spark: SparkSession, repos: dict[str, int], sync: Callable[[str], object]) -> list:
    """One rate-driven stream per repository with a positive interval (seconds); failures are logged and do not end it."""
    started = []
    for repo, seconds in repos.items():
        if seconds <= 0:
            log.warning("%s has no interval and is not synchronised", repo)
            continue

        def tick(_: DataFrame, __: int, repo: str = repo) -> None:
            try:
                sync(repo)
            except Exception:
                log.exception("synchronising %s failed", repo)

        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        started.append(ticks.writeStream.foreachBatch(tick).trigger(processingTime=f"{seconds} seconds").start())
    return started
