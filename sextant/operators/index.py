"""The stored search index: postings sorted by term, embedding buckets sorted by bucket, and the corpus statistics.

A search reads the postings of its terms and the buckets of its embedding, nothing of other
texts; the rows themselves are fetched for the hits alone. Scores are exactly those of the
plans over texts in sextant.operators.search.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.config import DEFAULTS
from sextant.functions import text as T
from sextant.functions import vectors as V
from sextant.operators import search
from sextant.operators.search import ANY, SearchFilter
from sextant.sources.store import SnapshotStore

#: Files, at most, that the entries of one term or bucket are spread over.
SHARES = 64
TABLES = ("postings", "terms", "buckets", "statistics")


@dataclass
class SearchIndex:
    """rows: the indexed chunks, by seq. documents, average: their number and average length."""

    rows: DataFrame
    postings: DataFrame
    terms: DataFrame
    buckets: DataFrame
    documents: int
    average: float
    dim: int
    mode: str

    @classmethod
    def build(cls, chunks: DataFrame, store: SnapshotStore, name: str = "search", dim: int = DEFAULTS.dim, mode: str = DEFAULTS.analyzer) -> SearchIndex:
        """Index chunks (seq unique, text) into tables of the store, and open them.

        Texts are cut into terms once. The entries of a term or bucket lie together in at most SHARES files,
        so that one of very many texts is no single task's work.
        Null and empty texts count as documents without terms.
        """
        rows = chunks.filter("seq is not null")
        share = F.pmod(F.xxhash64("seq"), F.lit(SHARES))
        cut = rows.select("seq", T.tokens(F.col("text"), mode).alias("toks")).select("seq", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
        postings = cut.groupBy("term", "seq", "dl").agg(F.count("*").cast("int").alias("tf"))

        def lexical() -> None:
            store.commit(f"{name}_postings", postings.select("term", "seq", "tf", "dl"), sort_by=("term", "seq"), spread=("term", share))
            terms = store.read(f"{name}_postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
            store.commit(f"{name}_terms", terms, sort_by=("term",), spread=("term",))
            total = store.read(f"{name}_terms").agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("total"))
            facts = rows.agg(F.count("*").alias("documents")).join(F.broadcast(total))  # one row each
            store.commit(f"{name}_statistics", facts.select("documents", "total", F.lit(dim).alias("dim"), F.lit(mode).alias("mode")))

        def semantic() -> None:
            store.commit(f"{name}_buckets", V.hashed_buckets(rows, dim), sort_by=("bucket", "seq"), spread=("bucket", share))

        with ThreadPoolExecutor(2) as both:  # neither waits for the other's last tasks
            for done in [both.submit(leg) for leg in (semantic, lexical)]:
                done.result()
        return cls.open(chunks, store, name)

    @classmethod
    def open(cls, chunks: DataFrame, store: SnapshotStore, name: str = "search") -> SearchIndex:
        """The index as last built; chunks must be those it was built from."""
        found = {t: store.read(f"{name}_{t}") for t in TABLES}
        if any(t is None for t in found.values()):
            raise ValueError(f"no index named {name}")
        facts = found["statistics"].first()
        n = facts["documents"]
        return cls(chunks, found["postings"], found["terms"], found["buckets"], n, facts["total"] / n if n else 0.0, facts["dim"], facts["mode"])

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    def _kept(self, scored: DataFrame, where: SearchFilter) -> DataFrame:
        if where == ANY:
            return scored
        return scored.join(self.rows.filter(where.condition()).select("seq"), "seq", "left_semi")

    def lexical(self, query: str | None, k: int = DEFAULTS.default_k, where: SearchFilter = ANY) -> DataFrame:
        """seq, score of the k best BM25 matches, ties by seq. The filter never changes the statistics."""
        terms = T.query_terms(query, self.mode)
        known = self.terms.filter(F.col("term").isin(sorted(set(terms)))).collect() if terms else []  # one row a query term
        if not known:
            return self.spark.createDataFrame([], "seq long, score double")
        idf = {r["term"]: math.log(1 + (self.documents - r["df"] + 0.5) / (r["df"] + 0.5)) * terms.count(r["term"]) for r in known}
        weight = F.create_map(*[F.lit(x) for pair in sorted(idf.items()) for x in pair])
        saturated = F.col("tf") / (F.col("tf") + search.K1 * (1 - search.B + search.B * F.col("dl") / (self.average or 1.0)))
        mine = self._kept(self.postings.filter(F.col("term").isin(sorted(idf))), where)
        scored = mine.groupBy("seq").agg(F.sum(weight[F.col("term")] * saturated).alias("score"))
        return scored.orderBy(F.desc("score"), "seq").limit(search.natural(k))

    def semantic(self, query: str | None, k: int = DEFAULTS.default_k, where: SearchFilter = ANY) -> DataFrame:
        """seq, score of the k nearest rows by the hashing embedding, ties by seq; rows without tokens take no part."""
        q = {b: x for b, x in enumerate(V.hash_counts(query, self.dim)) if x}
        if not q or not search.natural(k):
            return self.spark.createDataFrame([], "seq long, score double")
        weight = F.create_map(*[F.lit(x) for pair in sorted(q.items()) for x in pair])
        mine = self._kept(self.buckets.filter(F.col("bucket").isin(sorted(q))), where)
        cosine = F.sum(weight[F.col("bucket")] * F.col("n")) / (F.sqrt(F.max("squares")) * math.sqrt(sum(x * x for x in q.values())))
        scored = mine.groupBy("seq").agg(V.knn_score(cosine).alias("score"))
        top = scored.orderBy(F.desc("score"), "seq").limit(k).collect()  # k rows
        if len(top) < k:  # the others with tokens are all at right angles to the query
            seen = self.spark.createDataFrame([(r["seq"],) for r in top], "seq long")
            rest = self._kept(self.buckets.select("seq").distinct().join(F.broadcast(seen), "seq", "left_anti"), where)
            top += rest.orderBy("seq").limit(k - len(top)).select("seq", F.lit(0.5).alias("score")).collect()
        return self.spark.createDataFrame([(r["seq"], float(r["score"])) for r in top], "seq long, score double")

    def fetched(self, ranked: DataFrame) -> DataFrame:
        """ranked (at most a search's k rows) with the columns of its rows; only these are read."""
        top = ranked.collect()
        wide = self.rows.filter(F.col("seq").isin([r["seq"] for r in top])) if top else self.rows.limit(0)
        return wide.join(F.broadcast(self.spark.createDataFrame(top, ranked.schema)), "seq")

    def bm25(self, query: str | None, k: int = DEFAULTS.default_k, where: SearchFilter = ANY) -> DataFrame:
        return self.fetched(self.lexical(query, k, where)).orderBy(F.desc("score"), "seq")

    def hybrid(self, query: str | None, k: int = DEFAULTS.default_k, where: SearchFilter = ANY, candidate_k: int = DEFAULTS.candidate_k) -> DataFrame:
        """Both legs of exactly candidate_k rows, fused by reciprocal ranks; ordered by rank."""
        return self.fetched(search.fuse(self.lexical(query, candidate_k, where), self.semantic(query, candidate_k, where), k)).orderBy("rank")

    def hybrid_rerank(self, query: str | None, k: int = DEFAULTS.default_k, where: SearchFilter = ANY, reranker: search.Reranker | None = None, candidate_k: int = DEFAULTS.candidate_k) -> DataFrame:
        found = self.hybrid(query, max(search.natural(k), candidate_k), where, candidate_k)
        return search.reranked(found, query, k, reranker)
