"""Versioned Parquet snapshots with upsert and delete, and the checkpoint table."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def latest(rows: DataFrame, key: tuple[str, ...] = ("id",), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The row of highest order of each key; null keys are values, null orders come before all others."""
    by = Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def upsert(current: DataFrame, incoming: DataFrame, key: tuple[str, ...] = ("id",), order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Last writer wins per key among both tables."""
    return latest(current.unionByName(incoming, allowMissingColumns=True), key, order)


def delete_by_path(chunks: DataFrame, paths: DataFrame, branch: str | None = None, repo: str | None = None) -> DataFrame:
    """Rows whose path is not in paths; with branch only rows of that branch go, without one those of all (and all repos unless repo is given)."""
    gone = paths.select(F.col("path").alias("_path")).filter("_path is not null").distinct()
    hit = F.col("path") == F.col("_path")
    if branch is not None:
        hit = hit & (F.col("branch") == branch)
    if repo is not None:
        hit = hit & (F.col("repo") == repo)
    return chunks.join(gone, hit, "left_anti")


def unchanged(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """Incoming rows (id, content_hash, ...) whose stored row of that id has the same hash."""
    known = current.select("id", F.lower("content_hash").alias("content_hash")).distinct()
    return incoming.join(known, ["id", "content_hash"], "left_semi")


class SnapshotStore:
    """Each commit writes new files; a pointer file names the current ones and is replaced atomically.

    A table that is upserted is kept in buckets by a hash of its key, and only buckets that
    change are written again. The driver is the only writer. Readers keep the version they opened.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read_text(self, path: str) -> str | None:
        p = self._path(path)
        if not self._fs.exists(p):
            return None
        return "\n".join(r[0] for r in self.spark.read.text(path).collect())  # one short line

    def version(self, table: str) -> str | None:
        return (self._read_text(f"{self.root}/{table}.current") or "").strip() or None

    def _buckets(self, table: str) -> dict | None:
        """key, buckets and the version of each bucket that has rows, if the table is kept in buckets."""
        v = self.version(table)
        return json.loads(v) if v is not None and v.startswith("{") else None

    def _open(self, table: str, parts: dict[str, str], schema: str) -> DataFrame:
        wanted = StructType.fromJson(json.loads(schema))
        if not parts:
            return self.spark.createDataFrame([], wanted)
        return self.spark.read.schema(wanted).parquet(*[f"{self.root}/{table}/{v}/_bucket={b}" for b, v in sorted(parts.items(), key=lambda x: int(x[0]))])

    def read(self, table: str) -> DataFrame | None:
        v, kept = self.version(table), self._buckets(table)
        if v is None:
            return None
        return self.spark.read.parquet(f"{self.root}/{table}/{v}") if kept is None else self._open(table, kept["parts"], kept["schema"])

    def _point(self, table: str, text: str) -> None:
        fresh = self._path(f"{self.root}/.{table}.{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        array = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, self._path(f"{self.root}/{table}.current"), array)

    @staticmethod
    def _fresh() -> str:
        return f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"

    def commit(self, table: str, df: DataFrame, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = (), spread: tuple[str | Column, ...] = ()) -> str:
        """Replace the whole table; with spread rows of one value of it come to one file, else sorted tables are cut into ranges."""
        version = self._fresh()
        if spread:  # without the sample of the rows that ranges need
            df = df.repartition(*spread).sortWithinPartitions(*sort_by)
        elif sort_by:  # narrow min and max per file: scans for a few keys skip the others
            df = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{table}/{version}")
        self._point(table, version)
        return version

    def _commit_buckets(self, table: str, rows: DataFrame, touched: list[int], kept: dict, untouched: dict[str, str], schema: StructType) -> str:
        version = self._fresh()
        rows.write.partitionBy("_bucket").parquet(f"{self.root}/{table}/{version}")
        written = {str(b): version for b in touched if self._fs.exists(self._path(f"{self.root}/{table}/{version}/_bucket={b}"))}
        self._point(table, json.dumps({**kept, "schema": schema.json(), "parts": untouched | written}))
        return version

    def upsert(self, table: str, incoming: DataFrame, key: tuple[str, ...] = ("id",), order: tuple[str, ...] = ("seq",)) -> str:
        """Merge rows, last writer wins per key; what was committed whole, or under another key, is put into buckets first."""
        kept = self._buckets(table)
        if kept is not None and kept["key"] != list(key):
            kept = None
        now = None if kept is not None else self.read(table)
        number = kept["buckets"] if kept is not None else self.BUCKETS
        bucket = F.pmod(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in key]), F.lit(number)).cast("int")
        incoming = incoming.withColumn("_bucket", bucket)
        if kept is None:
            rows, touched, parts = (incoming if now is None else now.withColumn("_bucket", bucket).unionByName(incoming, allowMissingColumns=True)), list(range(number)), {}
        else:
            touched = [r["_bucket"] for r in incoming.select("_bucket").distinct().collect()]  # at most as many as buckets
            old = self._open(table, {b: v for b, v in kept["parts"].items() if int(b) in touched}, kept["schema"])
            rows, parts = old.withColumn("_bucket", bucket).unionByName(incoming, allowMissingColumns=True), {b: v for b, v in kept["parts"].items() if int(b) not in touched}
        # rows of a bucket come to one task, which serves the merge and the write
        merged = latest(rows.repartition(max(1, len(touched)), "_bucket"), ("_bucket", *key), order)
        return self._commit_buckets(table, merged, touched, {"key": list(key), "buckets": number}, parts, merged.drop("_bucket").schema)

    def delete_where(self, table: str, condition: Column) -> str | None:
        """Drop the rows the condition holds for; of a table in buckets only those with such rows are written again."""
        kept, now = self._buckets(table), self.read(table)
        if now is None:
            return None
        stay = ~F.coalesce(condition, F.lit(False))
        if kept is None:
            return self.commit(table, now.filter(stay))
        bucket = F.pmod(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in kept["key"]]), F.lit(kept["buckets"])).cast("int")
        touched = [r["_bucket"] for r in now.filter(condition).select(bucket.alias("_bucket")).distinct().collect()]
        if not touched:
            return self.version(table)
        old = self._open(table, {b: v for b, v in kept["parts"].items() if int(b) in touched}, kept["schema"])
        rows = old.filter(stay).withColumn("_bucket", bucket).repartition(len(touched), "_bucket")
        return self._commit_buckets(table, rows, touched, {"key": kept["key"], "buckets": kept["buckets"]}, {b: v for b, v in kept["parts"].items() if int(b) not in touched}, now.schema)

    def vacuum(self, table: str) -> int:
        """Delete the files of versions that are not current; readers of these lose them. The number of versions deleted."""
        kept, v = self._buckets(table), self.version(table)
        alive = {v} if kept is None else set(kept["parts"].values())
        folder = self._path(f"{self.root}/{table}")
        gone = [s.getPath() for s in self._fs.listStatus(folder) if s.getPath().getName() not in alive] if self._fs.exists(folder) else []
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)


class Checkpoints:
    """repo[:branch] -> commit, as one small JSON file on the driver, replaced atomically on flush."""

    def __init__(self, path: str):
        self.path = path
        self._map: dict[str, str] = {}
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self._map = json.load(f)

    @staticmethod
    def key(repo: str, branch: str | None) -> str:
        return repo if branch is None else f"{repo}:{branch}"

    def get(self, repo: str, branch: str | None = None) -> str | None:
        return self._map.get(self.key(repo, branch))

    def put(self, repo: str, branch: str | None, sha: str) -> None:
        self._map[self.key(repo, branch)] = sha

    def snapshot(self) -> dict[str, str]:
        return dict(self._map)

    def flush(self) -> None:
        fresh = f"{self.path}.{uuid.uuid4().hex}"
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump(self._map, f, sort_keys=True)
        os.replace(fresh, self.path)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k.split(":", 1)[0], k.split(":", 1)[1] if ":" in k else None, v) for k, v in sorted(self._map.items())]
        return spark.createDataFrame(rows, "repo string, branch string, sha string")
