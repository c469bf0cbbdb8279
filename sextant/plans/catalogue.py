"""All queries over the engine's own operators and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.config import DEFAULTS
from sextant.functions import text as T
from sextant.operators import compact, graph, ingest, markdown, monitor, search
from sextant.operators.search import SearchFilter
from sextant.plans import corpora
from sextant.plans.oracles import ORACLES  # noqa: F401
from sextant.session import scratch
from sextant.sources import store
from sextant.sources.tables import table
from sextant.streaming import sync

QUERY = "queue index filter"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


def _vector(df: DataFrame) -> list[float]:
    return list(df.filter("vector is not null").orderBy("seq").limit(1).first()["vector"])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return search.hits(corpora.search_index(spark, d, "documents").hybrid(QUERY, 10))


# ---------------------------------------------------------------- ranked retrieval
@query
def index_documents(spark, d):
    """Builds the index anew: documents, terms and postings of it."""
    index = corpora.build_index(spark, d, "documents")
    facts = index.terms.agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.coalesce(F.sum("cf"), F.lit(0)).alias("tokens"))
    return facts.select(F.lit(index.documents).cast("long").alias("documents"), "terms", "postings", "tokens")


@query
def bm25_topk(spark, d):
    return corpora.search_index(spark, d, "documents").lexical(QUERY, 10).select("seq", _r("score"))


@query
def bm25_filtered(spark, d):
    where = SearchFilter(domain="KNOWLEDGE", type="MD_SECTION")
    return corpora.search_index(spark, d, "chunks").lexical(QUERY, 10, where).select("seq", _r("score"))


@query
def bm25_scan(spark, d):
    """BM25 over texts without an index."""
    return search.bm25(corpora.document_chunks(spark, d), QUERY, 10).select("seq", _r("score"))


@query
def document_frequencies(spark, d):
    return corpora.search_index(spark, d, "documents").terms.select("term", "df", "cf")


@query
def knn_topk(spark, d):
    rows = corpora.embedding_chunks(spark, d)
    return search.knn(rows, _vector(rows), 10).select("seq", _r("score"))


@query
def knn_prefilter_label(spark, d):
    rows = corpora.embedding_chunks(spark, d)
    return search.knn(rows, _vector(rows), 10, SearchFilter(type="3")).select("seq", _r("score"))


@query
def knn_chunks(spark, d):
    rows = corpora.chunks(spark, d).select("seq", "domain", "vector")
    return search.knn(rows, _vector(corpora.embedding_chunks(spark, d)), 10, SearchFilter(domain="CODE")).select("seq", _r("score"))


@query
def hash_embedding_knn(spark, d):
    return corpora.search_index(spark, d, "documents").semantic(QUERY, 10).select("seq", _r("score"))


@query
def hash_embedding_scan(spark, d):
    """The same neighbours without an index."""
    return search.knn_hashed(corpora.document_chunks(spark, d), QUERY, 10).select("seq", _r("score"))


@query
def hybrid_rrf(spark, d):
    return corpora.search_index(spark, d, "documents").hybrid(QUERY, 10).select("seq", _r("score"), _r("rrf_score"), F.col("rank").cast("long").alias("rank"))


@query
def hybrid_rerank(spark, d):
    found = corpora.search_index(spark, d, "documents").hybrid_rerank(QUERY, 10, reranker=search.lexical_overlap)
    return found.select("seq", _r("rerank_score"), F.col("rank").cast("long").alias("rank"))


def _hits(ranked: DataFrame) -> DataFrame:
    return search.hits(ranked).withColumns({"score": F.round("score", 6), "rrf_score": F.round("rrf_score", 6)})


@query
def design_for_symbol(spark, d):
    return _hits(search.design_for_symbol(corpora.search_index(spark, d, "chunks"), "dev.example.FilterIndex#queue(long)"))


@query
def code_for_document(spark, d):
    return _hits(search.code_for_document(corpora.search_index(spark, d, "chunks"), "queue filter segment"))


@query
def keyword_hits(spark, d):
    """Hits with all their stored fields and a snippet."""
    return search.hits(corpora.search_index(spark, d, "documents").bm25(QUERY, 10)).withColumn("score", F.round("score", 6))


@query
def rerank_documents(spark, d):
    return search.rerank_texts(corpora.document_chunks(spark, d), QUERY, search.lexical_overlap, 10).select("seq", _r("rerank_score"))


@query
def discover_symbols(spark, d):
    """Code hits of a search without their texts."""
    found = corpora.search_index(spark, d, "chunks").hybrid("queue filter segment", 10, SearchFilter(domain="CODE"))
    return _hits(found).drop("snippet")


@query
def answer_context(spark, d):
    found = search.hits(corpora.search_index(spark, d, "documents").hybrid(QUERY, 10))
    return compact.compact(found, 400)


# ---------------------------------------------------------------- text projections
@query
def snippet_projection(spark, d):
    return corpora.chunks(spark, d).select("seq", T.snippet(F.col("text")).alias("snippet"))


@query
def content_hash(spark, d):
    actual = T.content_hash(F.col("text"))
    return corpora.chunks(spark, d).select("seq", actual.alias("actual"), F.coalesce(F.lower("content_hash") == actual, F.lit(False)).alias("fresh"))


@query
def token_estimate(spark, d):
    return corpora.chunks(spark, d).select("seq", T.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query
def truncate_to_fit(spark, d):
    return corpora.chunks(spark, d).select("seq", T.truncate_to_fit(F.col("text"), 25).alias("text"))


@query
def fits_budget(spark, d):
    return corpora.chunks(spark, d).select("seq", T.fits(F.col("text"), 25).alias("fits"))


@query
def slugify_titles(spark, d):
    return corpora.chunks(spark, d).select("seq", T.slug(F.col("title")).alias("slug"))


@query
def fqn_simple(spark, d):
    rows = corpora.chunks(spark, d).filter("fqn is not null")
    return rows.select("seq", T.fqn_simple(F.col("fqn")).alias("fqn_simple"), T.simple_name(F.col("fqn")).alias("simple_name"))


@query
def looks_like_bean(spark, d):
    e = corpora.edges(spark, d).filter("type = 'DEPENDS_ON'")
    return e.groupBy("dst").agg(F.count("*").alias("n")).select("dst", "n", T.looks_like_bean(F.col("dst")).alias("bean"))


# ---------------------------------------------------------------- upserts, deletes, monitoring
@query
def current_chunks(spark, d):
    return corpora.chunks(spark, d).select("seq", "repo", "branch", "id")


@query
def upsert_last_wins(spark, d):
    rows = table(spark, d, "chunks").select("id", "repo", "branch", "seq")
    return store.upsert(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1"), DEFAULTS.chunk_key).select("id", "seq")


@query
def delete_by_path(spark, d):
    rows = corpora.chunks(spark, d)
    return store.delete_by_path(rows, rows.filter("type = 'OPENAPI_OP'").select("path")).select("seq")


@query
def delete_by_path_branch(spark, d):
    rows = corpora.chunks(spark, d)
    return store.delete_by_path(rows, rows.filter("domain = 'CODE'").select("path"), branch="main").select("seq")


@query
def unchanged_by_hash(spark, d):
    rows = table(spark, d, "chunks")
    older = rows.select("id", "content_hash")
    fresh = corpora.chunks(spark, d).select("id", T.content_hash(F.col("text")).alias("content_hash"), "seq")
    return store.unchanged(fresh, older).select("seq")


@query
def dedupe_by_hash(spark, d):
    docs = corpora.document_chunks(spark, d)
    return docs.groupBy(T.content_hash(F.col("text")).alias("hash")).agg(F.min("seq").alias("first"), F.count("*").alias("n"))


@query
def count_by_filter(spark, d):
    return monitor.count_by_filter(corpora.chunks(spark, d), SearchFilter(domain="CODE", branch="main"))


@query
def index_monitor(spark, d):
    marks, rows = table(spark, d, "checkpoints"), corpora.chunks(spark, d)
    return monitor.branch_stats(rows, marks.select("repo", "branch").distinct(), marks, rows.select("repo", F.col("indexed_at").alias("at")))


@query
def index_status(spark, d):
    marks = table(spark, d, "checkpoints")
    return monitor.status(monitor.branch_stats(corpora.chunks(spark, d), marks.select("repo", "branch").distinct(), marks))


# ---------------------------------------------------------------- sources and lookups
@query
def source_classify(spark, d):
    return table(spark, d, "source_files").select("file_id", T.source_class(F.col("path")).alias("source_class"))


@query
def accept_glob(spark, d):
    files = table(spark, d, "source_files")
    return files.filter(T.accepted(F.col("path"), ("**/*.java", "**/*.md"), ("**/u5*/**", "api/**"))).select("file_id")


@query
def symbol_prefix(spark, d):
    return search.by_name_fragment(corpora.chunks(spark, d), "load*seg", "METHOD", 10).select("seq", "fqn")


@query
def find_symbol(spark, d):
    return search.symbol_refs(search.by_name_fragment(corpora.chunks(spark, d), "Batch", None, 10))


@query
def by_type_and_repo(spark, d):
    return search.by_type(corpora.chunks(spark, d), "OPENAPI_OP", "narildex-core").select("seq", "fqn")


@query
def symbol_filter(spark, d):
    return corpora.chunks(spark, d).filter(SearchFilter(symbol="@Service").condition()).select("seq")


def _symbol(rows: DataFrame) -> str:
    return rows.filter("type = 'METHOD' and fqn is not null and length(text) > 200").agg(F.min("fqn")).first()[0] or ""


@query
def text_by_fqn(spark, d):
    rows = corpora.chunks(spark, d)
    return search.text_by_fqn(rows, _symbol(rows))


@query
def symbol_body(spark, d):
    rows = corpora.chunks(spark, d)
    return search.symbol_body(rows, _symbol(rows), 200)


@query
def hash_by_id(spark, d):
    rows = corpora.chunks(spark, d)
    return search.hash_by_id(rows, rows.agg(F.min("id")).first()[0] or "")


@query
def title_or_fqn(spark, d):
    return corpora.chunks(spark, d).select("seq", F.coalesce("title", "fqn").alias("title"))


# ---------------------------------------------------------------- graph
def _seed(nodes: DataFrame, label: str) -> str:
    return nodes.filter(F.col("label") == label).agg(F.min("id")).first()[0]


@query
def graph_event_fold(spark, d):
    n = corpora.nodes(spark, d)
    return n.select("id", "label", F.array_join("tags", "|").alias("tags"), "signature", "javadoc")


@query
def nodes_by_tag(spark, d):
    return graph.by_tag(corpora.nodes(spark, d), "BEAN").select("id")


@query
def edge_scan(spark, d):
    return graph.edges_of(corpora.edges(spark, d), "log.info", False, "CALLS")


@query
def edge_degrees(spark, d):
    e = corpora.edges(spark, d)
    return e.groupBy("dst", "type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query
def edges_distinct(spark, d):
    return graph.fold_edges(table(spark, d, "graph_events"), distinct=True)


@query
def callers_d1(spark, d):
    return graph.callers(corpora.nodes(spark, d), corpora.edges(spark, d), "log.info", 1).select("id", "signature", F.col("depth").cast("long").alias("depth"))


@query
def callees_bfs(spark, d):
    n = corpora.nodes(spark, d)
    return graph.callees(n, corpora.edges(spark, d), _seed(n, "Method"), 3).select("id", "signature", F.col("depth").cast("long").alias("depth"))


@query
def expand_context_2hop(spark, d):
    n = corpora.nodes(spark, d)
    return graph.expand(n, corpora.edges(spark, d), [_seed(n, "Class")], 2).select("id", "signature", F.col("depth").cast("long").alias("depth"))


@query
def symbol_view(spark, d):
    n = corpora.nodes(spark, d)
    v = graph.symbol_view(n, corpora.edges(spark, d), _seed(n, "Method"))
    return v.select("fqn", "signature", "javadoc", F.array_join(F.array_sort("callers"), "|").alias("callers"), F.array_join(F.array_sort("callees"), "|").alias("callees"))


@query
def topic_flow(spark, d):
    """The log has no topics: calls stand for consuming, dependencies for producing."""
    e = corpora.edges(spark, d)
    kind = F.when(F.col("type") == "CALLS", "CONSUMES").when(F.col("type") == "DEPENDS_ON", "PRODUCES").otherwise(F.col("type"))
    return graph.topic_flow(corpora.nodes(spark, d), e.withColumn("type", kind), "log.info")


@query
def endpoint_lookup(spark, d):
    n = corpora.nodes(spark, d)
    verb, _, path = _seed(n, "Endpoint").partition(" ")
    return graph.endpoint(n, corpora.edges(spark, d), verb.lower(), path)


@query
def endpoint_keys(spark, d):
    return graph.endpoint_keys(corpora.nodes(spark, d), corpora.edges(spark, d))


@query
def bean_graph_depth2(spark, d):
    n = corpora.nodes(spark, d)
    root = graph.by_tag(n, "BEAN").agg(F.min("id")).first()[0]
    return graph.bean_graph(n, corpora.edges(spark, d), root, 2).select("root", "fqn", "signature", F.col("depth").cast("long").alias("depth"))


@query
def spec_vs_impl(spark, d):
    spec = search.by_type(corpora.chunks(spark, d), "OPENAPI_OP").select(F.col("fqn").alias("id"))
    return graph.spec_vs_impl(spec, graph.endpoint_keys(corpora.nodes(spark, d), corpora.edges(spark, d)))


# ---------------------------------------------------------------- ingest
def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select(F.col("file_id").alias("seq"), "repo", "branch", "path", "git_sha", "content")


@query
def ingest_chunks(spark, d):
    rows = ingest.chunk_rows(ingest.parse_files(_files(spark, d)), embed=False)
    return rows.select("id", "repo", "branch", "path", "type", "fqn", "title", "content_hash", "text")


@query
def ingest_graph_events(spark, d):
    return ingest.event_rows(ingest.parse_files(_files(spark, d))).select("seq", "kind", "id", "label", "signature", "src", "dst", "edge_type")


@query
def section_packer(spark, d):
    """Long texts packed from paragraphs, as the Markdown reader packs sections."""
    long_ = corpora.chunks(spark, d).filter(F.length("text") > DEFAULTS.max_section_chars)
    return markdown.packed(long_).select("seq", "part", F.length("text").alias("n_chars"))


# ---------------------------------------------------------------- streams
@query
def stream_upsert(spark, d):
    """The last event of each user, kept by a stream that merges its batches into a snapshot table."""
    source = table(spark, d, "events")
    folder = scratch(spark, "events")
    kept = store.SnapshotStore(spark, f"{folder}/store")
    rows = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    sync.upsert_stream(rows.drop("props"), kept, "last_events", f"{folder}/checkpoint", ("user_id",), ("ts", "event_id")).awaitTermination()
    return kept.read("last_events").select("user_id", "event_id", "event_type", "value")


@query
def windowed_activity(spark, d):
    """Events per hour and type, by the windowed aggregate that streams use too."""
    return sync.activity_counts(table(spark, d, "events"), "ts", "event_type")
