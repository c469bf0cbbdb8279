"""Ranked retrieval over chunks: BM25, nearest vectors, reciprocal-rank fusion, reranking, symbol lookup."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.config import DEFAULTS
from sextant.functions import text as T
from sextant.functions import vectors as V

K1, B = 1.2, 0.75
HIT = ("id", "repo", "path", "domain", "type", "fqn", "title", "section")


@dataclass(frozen=True)
class SearchFilter:
    """Conjunction of equalities; None puts no constraint (it never means IS NULL)."""

    repo: str | None = None
    domain: str | None = None
    type: str | None = None
    path: str | None = None
    branch: str | None = None
    symbol: str | None = None

    def condition(self) -> Column:
        parts = [F.col(c) == v for c in ("repo", "domain", "type", "path", "branch") if (v := getattr(self, c)) is not None]
        if self.symbol is not None:
            parts.append(F.array_contains("symbols", self.symbol))
        return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


ANY = SearchFilter()


def hits(ranked: DataFrame, snippet_chars: int = DEFAULTS.snippet_chars) -> DataFrame:
    """Project rows with score (and optional extra columns) to hits with a snippet."""
    extra = [c for c in ("score", "rrf_score", "rerank_score", "rank") if c in ranked.columns]
    return ranked.select(*HIT, T.snippet(F.col("text"), snippet_chars).alias("snippet"), *extra)


def natural(k: int) -> int:
    if k < 0:
        raise ValueError("k must not be negative")
    return k


# ---------------------------------------------------------------- lexical leg
def _equals(word: str):
    return lambda t: t == F.lit(word)


def term_frequencies(chunks: DataFrame, terms: list[str], mode: str = "simple") -> DataFrame:
    """chunks with dl (terms of the text) and tf (array: occurrences of each query term), one pass, no shuffle."""
    toks = T.tokens(F.col("text"), mode)
    tf = F.array(*[F.size(F.filter("toks", _equals(w))) for w in terms])
    return chunks.withColumn("toks", toks).withColumn("dl", F.size("toks")).withColumn("tf", tf).drop("toks")


def corpus_statistics(counted: DataFrame, n_terms: int) -> tuple[int, float, list[int]]:
    """Documents, average length and document frequency of each term: one row, whatever the corpus."""
    df = [F.sum((F.col("tf")[i] > 0).cast("bigint")).alias(f"d{i}") for i in range(n_terms)]
    row = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *df).first()
    return row["n"], row["avg"] or 0.0, [row[f"d{i}"] or 0 for i in range(n_terms)]


def bm25_scores(chunks: DataFrame, query: str | None, where: SearchFilter = ANY, mode: str = "simple", statistics: tuple | None = None) -> DataFrame:
    """Rows of chunks and their score; those without a query term are left out or have score 0.

    The filter never changes the statistics: they are those of all rows, or the ones
    given (of an index built before). A query without terms gives no rows. Repeated query
    terms count as often as they stand.
    """
    terms = T.query_terms(query)
    if not terms:
        return chunks.withColumn("score", F.lit(0.0)).limit(0)
    distinct = sorted(set(terms))
    counted = term_frequencies(chunks.select("text"), distinct, mode)
    n, average, df = statistics or corpus_statistics(counted, len(distinct))
    score = F.lit(0.0)
    for i, w in enumerate(distinct):
        idf = math.log(1 + (n - df[i] + 0.5) / (df[i] + 0.5)) * terms.count(w)
        tf = F.col("tf")[i].cast("double")
        score = score + F.lit(idf) * tf / (tf + K1 * (1 - B + B * F.col("dl") / (average or 1.0)))
    # Texts that do not even hold a term as a substring are dropped before they are cut into terms.
    holds = reduce(lambda a, b: a | b, (F.contains(F.lower("text"), F.lit(w)) for w in distinct))
    scored = term_frequencies(chunks.filter(where.condition() & holds), distinct, mode)
    return scored.withColumn("score", score).drop("tf", "dl")


def _top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows. Conditions on the score come after it: before it they would be pushed down and the score computed twice."""
    return df.orderBy(*order).limit(natural(k))


def bm25(chunks: DataFrame, query: str | None, k: int = DEFAULTS.default_k, where: SearchFilter = ANY, mode: str = "simple") -> DataFrame:
    """The k best rows with at least one query term, ties by seq."""
    return _top(bm25_scores(chunks, query, where, mode), k, F.desc("score"), F.asc("seq")).filter("score > 0")


def knn(chunks: DataFrame, vector: list[float], k: int = DEFAULTS.default_k, where: SearchFilter = ANY) -> DataFrame:
    """The k rows of highest cosine that pass the filter; rows with a null, zero or other-sized vector take no part."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = chunks.filter(where.condition()).withColumn("score", V.knn_score(V.cosine(F.col("vector"), q)))
    return _top(scored, k, F.desc("score"), F.asc("seq")).filter("score is not null")


def knn_hashed(chunks: DataFrame, query: str | None, k: int = DEFAULTS.default_k, where: SearchFilter = ANY, dim: int = DEFAULTS.dim) -> DataFrame:
    """As knn, with the hashing embedding of the rows' texts and of the query."""
    q = V.hash_counts(query, dim)
    if not any(q):
        return chunks.withColumn("score", F.lit(0.0)).limit(0)
    scored = chunks.filter(where.condition()).withColumn("score", V.knn_score(V.hashed_cosine(F.col("text"), q)))
    return _top(scored, k, F.desc("score"), F.asc("seq")).filter("score is not null")


def fuse(lexical: DataFrame, semantic: DataFrame, k: int, constant: int = DEFAULTS.rrf_constant) -> DataFrame:
    """Reciprocal-rank fusion of two lists of at most candidate_k rows each.

    Ordered by the fused score; each row carries the score of the leg it came from, of
    the lexical one if of both. Ties: the lexical list first, then by rank.
    """

    def ranked(df: DataFrame, leg: str) -> DataFrame:
        order = Window.orderBy(F.desc("score"), F.asc("seq"))  # candidate_k rows after the limit
        return df.withColumn("r", F.row_number().over(order)).withColumn("leg", F.lit(leg))

    both = ranked(lexical, "b").unionByName(ranked(semantic, "k"), allowMissingColumns=True)
    leg_rank = lambda leg: F.min(F.when(F.col("leg") == leg, F.col("r")))
    kept = [c for c in both.columns if c not in ("leg", "r", "seq")]
    fused = both.groupBy("seq").agg(
        F.sum(1.0 / (F.lit(constant) + F.col("r"))).alias("rrf_score"),
        leg_rank("b").alias("b_rank"),
        leg_rank("k").alias("k_rank"),
        F.min_by(F.struct(*kept), "leg").alias("row"),
    )
    top = fused.orderBy(F.desc("rrf_score"), F.asc_nulls_last("b_rank"), F.asc_nulls_last("k_rank"), "seq").limit(natural(k))
    order = Window.orderBy(F.desc("rrf_score"), F.asc_nulls_last("b_rank"), F.asc_nulls_last("k_rank"), "seq")
    return top.withColumn("rank", F.row_number().over(order)).select("seq", "row.*", "rrf_score", "rank")


def hybrid(chunks: DataFrame, query: str | None, k: int = DEFAULTS.default_k, where: SearchFilter = ANY, candidate_k: int = DEFAULTS.candidate_k, dim: int = DEFAULTS.dim, vector: list[float] | None = None) -> DataFrame:
    """Both legs of exactly candidate_k rows, fused. With vector, the stored vectors are searched, else hashed texts."""
    lexical = bm25(chunks, query, candidate_k, where)
    semantic = knn(chunks, vector, candidate_k, where) if vector is not None else knn_hashed(chunks, query, candidate_k, where, dim)
    return fuse(lexical, semantic, k)


def lexical_overlap(query: str, snippet: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's distinct terms in the snippet."""
    terms = sorted(set(T.query_terms(query)))
    if not terms:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.array_distinct(T.tokens(snippet)), F.array(*[F.lit(t) for t in terms]))) / F.lit(float(len(terms)))


Reranker = Callable[[str, Column], Column]


def hybrid_rerank(chunks: DataFrame, query: str | None, k: int = DEFAULTS.default_k, where: SearchFilter = ANY, reranker: Reranker | None = None, candidate_k: int = DEFAULTS.candidate_k, dim: int = DEFAULTS.dim) -> DataFrame:
    """Hybrid search of max(k, candidate_k) rows, then the reranker's order, ties in the order before; without one the first k."""
    return reranked(hybrid(chunks, query, max(natural(k), candidate_k), where, candidate_k, dim), query, k, reranker)


def reranked(found: DataFrame, query: str | None, k: int, reranker: Reranker | None) -> DataFrame:
    """Rows with rank and text in the reranker's order, ties in the order before; without one the first k."""
    if reranker is None:
        return found.orderBy("rank").limit(natural(k))
    scored = found.withColumn("rerank_score", reranker(query or "", T.snippet(F.col("text"))))
    order = (F.desc("rerank_score"), F.asc("rank"))
    return scored.orderBy(*order).limit(natural(k)).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rerank_texts(texts: DataFrame, query: str, reranker: Reranker, top: int) -> DataFrame:
    """The top best of (seq, text) by the reranker, with rerank_score, ties by seq; null texts count as empty."""
    scored = texts.withColumn("rerank_score", reranker(query, F.coalesce("text", F.lit(""))))
    return scored.orderBy(F.desc("rerank_score"), "seq").limit(natural(top))


def cross_encoder(model_path: str, tokenizer_path: str, max_tokens: int = 512) -> Reranker:
    """A reranker from a staged ONNX model: one logit is the score, two give the sigmoid of their difference."""

    def build(query: str, snippet: Column) -> Column:
        @F.pandas_udf("double")
        def score(batches):
            import numpy as np
            import onnxruntime
            import pandas as pd
            from tokenizers import Tokenizer

            session = onnxruntime.InferenceSession(model_path)
            tok = Tokenizer.from_file(tokenizer_path)
            tok.enable_truncation(max_tokens)
            names = {i.name for i in session.get_inputs()}
            for texts in batches:
                out = []
                for t in texts:
                    e = tok.encode(query, t or "")
                    feed = {"input_ids": [e.ids], "attention_mask": [e.attention_mask], "token_type_ids": [e.type_ids]}
                    logits = session.run(None, {n: np.asarray(v, np.int64) for n, v in feed.items() if n in names})[0].ravel()
                    out.append(float(logits[0]) if len(logits) == 1 else float(1 / (1 + np.exp(logits[0] - logits[1]))))
                yield pd.Series(out)

        return score(snippet)

    return build


# ---------------------------------------------------------------- lookups
def by_name_fragment(chunks: DataFrame, fragment: str, type_: str | None = None, k: int = DEFAULTS.find_symbol_k) -> DataFrame:
    """Prefix of the simple name (with * and ? as wildcards) or the exact fqn; exact first, then by name and id."""
    pattern = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c for c in fragment.lower())
    exact = F.col("fqn") == fragment
    named = chunks.withColumn("fqn_simple", T.fqn_simple(F.col("fqn")))
    if type_ is not None:
        named = named.filter(F.col("type") == type_)
    found = named.filter(exact | F.col("fqn_simple").rlike(f"^{pattern}"))
    return found.withColumn("exact", exact.cast("int")).orderBy(F.desc("exact"), "fqn_simple", "id", "seq").limit(natural(k)).drop("exact")


def symbol_refs(found: DataFrame) -> DataFrame:
    return found.filter("fqn is not null").select("fqn", "type", "repo", "path")


def text_by_fqn(chunks: DataFrame, fqn: str) -> DataFrame:
    return chunks.filter(F.col("fqn") == fqn).orderBy("seq").limit(1).select("text")


def hash_by_id(chunks: DataFrame, id_: str) -> DataFrame:
    return chunks.filter(F.col("id") == id_).orderBy("seq").limit(1).select("content_hash")


def title_by_id(chunks: DataFrame, id_: str) -> DataFrame:
    return chunks.filter(F.col("id") == id_).orderBy("seq").limit(1).select(F.coalesce("title", "fqn").alias("title"))


def by_type(chunks: DataFrame, type_: str, repo: str | None = None, k: int | None = None) -> DataFrame:
    found = chunks.filter(SearchFilter(type=type_, repo=repo).condition())
    return found if k is None else found.orderBy("seq").limit(natural(k))


def symbol_body(chunks: DataFrame, fqn: str, most: int = DEFAULTS.max_body_chars) -> DataFrame:
    """The text of a symbol, cut at the last line end before most characters and marked so."""
    head = F.substring("text", 1, most)
    at = F.length(head) - F.instr(F.reverse(head), "\n")
    cut = F.when(F.instr(head, "\n") > 0, F.substr(F.col("text"), F.lit(1), at)).otherwise(head)
    body = F.when(F.length("text") <= most, F.col("text")).otherwise(F.concat(cut, F.lit("\n// ... (truncated)")))
    return text_by_fqn(chunks, fqn).select(body.alias("body"))


def design_for_symbol(index, fqn: str, reranker: Reranker | None = None) -> DataFrame:
    """Knowledge about a symbol: a search for its simple name in a SearchIndex."""
    name = fqn[max(fqn.rfind("."), fqn.rfind("#")) + 1 :].split("(")[0]
    return index.hybrid_rerank(name, DEFAULTS.cross_domain_k, SearchFilter(domain="KNOWLEDGE"), reranker)


def code_for_document(index, id_: str, reranker: Reranker | None = None) -> DataFrame:
    """Code about a document: a search for its title (its id if it has none) in a SearchIndex."""
    row = title_by_id(index.rows, id_).first()
    query = row["title"] if row and row["title"] else id_
    return index.hybrid_rerank(query, DEFAULTS.cross_domain_k, SearchFilter(domain="CODE"), reranker)
