"""The test tables seen as chunk tables and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import graph
from sextant.operators.index import SearchIndex
from sextant.session import scratch
from sextant.sources.store import SnapshotStore
from sextant.sources.tables import current_rows, table


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """documents as chunks: repo is the source, branch the language label."""
    docs = table(spark, d, "documents")
    text = lambda x=None: F.lit(x).cast("string")
    id_ = F.concat(F.lit("doc-"), F.col("doc_id"))
    return docs.select(
        id_.alias("id"), F.col("source").alias("repo"), F.col("lang").alias("branch"), F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".txt")).alias("path"),
        F.lit("KNOWLEDGE").alias("domain"), F.lit("DOCUMENT").alias("type"), text().alias("fqn"), F.col("doc_type").alias("title"), text().alias("section"),
        F.array().cast("array<string>").alias("symbols"), "text", F.col("doc_id").alias("seq"),
    )


def embedding_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("type"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return current_rows(table(spark, d, "chunks"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.fold_nodes(table(spark, d, "graph_events"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.fold_edges(table(spark, d, "graph_events"))


# ---------------------------------------------------------------- stored indexes
CORPORA = {"documents": document_chunks, "chunks": chunks}
_open: dict[tuple, SearchIndex] = {}


def _key(spark: SparkSession, d: str, name: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    return spark.sparkContext.applicationId, d, name, status.getModificationTime(), status.getLen()


def build_index(spark: SparkSession, d: str, name: str) -> SearchIndex:
    """Index a corpus into a store of the session's shared folder."""
    key = _key(spark, d, name)
    for old in [k for k in _open if k[0] != key[0] or k[1:3] == key[1:3]]:
        del _open[old]
    _open[key] = SearchIndex.build(CORPORA[name](spark, d), SnapshotStore(spark, scratch(spark, f"index-{name}")), mode="simple")
    return _open[key]


def search_index(spark: SparkSession, d: str, name: str) -> SearchIndex:
    """The index of a corpus as last built, built at its first use in a session and again when its table was written anew."""
    return _open.get(_key(spark, d, name)) or build_index(spark, d, name)
