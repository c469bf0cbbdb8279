"""Near-duplicate records: rare shingles in one order, segment popcounts, exact verification.

The fingerprint of a text is the wide bitmap of its shingle hashes (one bit per 64-bit
hash, so equal sets have equal fingerprints and the Hamming distance of two is the size of
their symmetric difference). Cutting the hash range into segments and counting bits per
segment embeds fingerprints as small integer vectors whose Manhattan distance never exceeds
the Hamming distance. Two sets of similarity t differ in at most (1-t)/(1+t) of their summed
sizes, which bounds the distance. Popcounts of segments wide enough for a grid cannot part
texts at such thresholds (the bound is about what two unrelated texts reach), so the join is
on the finest cells, single bits: the rarest ones of every set in one order of all, so many
that every pair has a certain number of them in common. What lies before a common bit in
both orders is a part of the distance, and a range condition of the join; the segments'
popcounts then bound the whole distance from below, and the texts themselves decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.session import materialize

WORDS = re.compile(r"[^\W_]+")
#: Segments of the popcount vector that bounds the distance of candidates.
SEGMENTS = 64
#: Shingle hashes are counted in so many buckets to order them by rareness. Any counts give every pair.
BUCKETS = 1 << 18
#: Of every so many members of a set a pair must have one more in common among the rarest, of which as many more are taken.
COMMON = 32
#: Members of one class that are paired with all others in one task.
PART = 2048
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < 500_000:
            self[word] = h
        return h


def fingerprint(text: str, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of width words; a shorter text is one run."""
    words = WORDS.findall(text.lower())
    width = min(width, len(words))
    n = len(words) - width + 1
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = _mix(h * _A + w[i : i + n] + _B)
    return np.unique(h)


def popcounts(fp: np.ndarray) -> np.ndarray:
    """Bits in each of SEGMENTS equal ranges of the hash values; cut at 65,535, which lessens no distance's truth as a lower bound."""
    return np.minimum(np.bincount((fp >> np.uint64(58)).astype(np.int64), minlength=SEGMENTS), 65_535).astype(np.uint16)


def frequencies(rows: DataFrame, width: int) -> np.ndarray:
    """How often the buckets of shingle hashes occur in all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, n = WordHashes(), np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            found = [fingerprint(text, width, hashes) for text in pdf["text"]]
            n += np.bincount((np.concatenate([np.empty(0, np.uint64), *found]) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": n[at]})  # one row a bucket from each task

    texts = rows.select("text").filter("seq is not null and text is not null")
    got = texts.mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
    counts = np.zeros(BUCKETS, np.int64)
    counts[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return counts


def rarest(fp: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """The rarest shingles of a set, so many that two sets at the threshold have 1 + size // COMMON of them in common.

    All sets are put into one order; partners have threshold of a set's members in common, so
    the l-th common one has no more than the other members and l - 1 common ones before it in either set.
    """
    most = len(fp) - int(np.ceil(threshold * len(fp) - 1e-9)) + 1 + len(fp) // COMMON
    order = np.lexsort((fp, counts[(fp % np.uint64(BUCKETS)).astype(np.int64)]))
    return fp[order[:most]].view(np.int64)


def embed(rows: DataFrame, width: int, threshold: float, least: int) -> DataFrame:
    """seq, size, h1, h2 (of the whole fingerprint), pops, rare for each (seq, text) with at least least shingles."""
    shared = rows.sparkSession.sparkContext.broadcast(frequencies(rows, width))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            out = []
            for seq, text in zip(pdf["seq"], pdf["text"]):
                fp = fingerprint(text, width, hashes)
                if len(fp) >= least:
                    h1 = int(_mix(fp).sum(dtype=np.uint64).view(np.int64))
                    h2 = int(_mix(fp + _C).sum(dtype=np.uint64).view(np.int64))
                    out.append((seq, len(fp), h1, h2, popcounts(fp).tobytes(), rarest(fp, shared.value, threshold)))
            yield pd.DataFrame(out, columns=["seq", "size", "h1", "h2", "pops", "rare"])

    return rows.select("seq", "text").filter("seq is not null and text is not null").mapInPandas(work, "seq long, size int, h1 long, h2 long, pops binary, rare array<bigint>")


def _bounded(threshold: float):
    """Keep candidates whose popcounts' Manhattan distance is within the bound of their sizes."""
    most = (1 - threshold) / (1 + threshold)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a = np.frombuffer(b"".join(pdf["pops_a"]), np.uint16).reshape(len(pdf), -1).astype(np.int32)
                b = np.frombuffer(b"".join(pdf["pops_b"]), np.uint16).reshape(len(pdf), -1).astype(np.int32)
                bound = most * (pdf["size_a"] + pdf["size_b"]).to_numpy() + 1e-9
                pdf = pdf[np.abs(a - b).sum(axis=1) <= bound]
            yield pdf[["rep_a", "rep_b"]]

    return keep


def _verified(threshold: float, width: int):
    """Exact similarity of the shingle sets of both texts, as word sequences."""

    def sets(text: str) -> set[tuple[str, ...]]:
        w = WORDS.findall(text.lower())
        return set(zip(*[w[i:] for i in range(min(width, len(w)))]))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, last, own = [], None, set()
            for a, b, x, y in zip(pdf["rep_a"], pdf["rep_b"], pdf["text_a"], pdf["text_b"]):
                if a != last:
                    last, own = a, sets(x)
                other = sets(y)
                both = len(own & other)
                either = len(own) + len(other) - both
                if both >= threshold * either - 1e-9:
                    out.append((a, b, both / either))
            yield pd.DataFrame(out, columns=["rep_a", "rep_b", "similarity"])

    return verify


def near_classes(rows: DataFrame, width: int = 5, threshold: float = 0.8, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Two tables: members (seq, rep) and links (rep_a, rep_b, similarity) between classes of equal shingle sets.

    Texts with fewer than least shingles (null ones and those without words too) take no part; a text
    of fewer words than a shingle counts as one. Rows with equal shingle sets form one class, named
    by its lowest seq; links join different classes of similarity threshold or more, rep_a < rep_b,
    none is left out. seq must be unique.
    """
    embedded = materialize(embed(rows, width, threshold, least), "fingerprints")
    # Copies agree in everything that is kept here, and map-side aggregation folds them before the shuffle.
    classes = embedded.groupBy("h1", "h2").agg(F.min("seq").alias("rep"), F.count("*").alias("n"))
    several = classes.filter("n > 1").select("h1", "h2", "rep")
    members = embedded.select("seq", "h1", "h2").join(several, ["h1", "h2"], "left").select("seq", F.coalesce("rep", "seq").alias("rep"))
    members = materialize(members, "members")
    spare = members.filter("seq != rep").select("seq")
    reps = embedded.join(spare, "seq", "left_anti").withColumnRenamed("seq", "rep")
    # One exchange serves both sides; adaptive execution splits the partition of a shingle that very many texts have among their rarest.
    placed = reps.select("rep", "size", F.posexplode("rare").alias("at", "shingle"))
    x = placed.select("shingle", F.col("rep").alias("rep_a"), F.col("size").alias("size_a"), F.col("at").alias("at_a"))
    y = placed.select("shingle", F.col("rep").alias("rep_b"), F.col("size").alias("size_b"), F.col("at").alias("at_b"))
    sized = (F.col("size_b") >= threshold * F.col("size_a") - 1e-9) & (F.col("size_a") >= threshold * F.col("size_b") - 1e-9)
    # behind the l-th common shingle lie the others, so both sets must have enough left from there on
    needed = F.least(F.floor(F.col("size_a") / COMMON), F.floor(F.col("size_b") / COMMON)) + 1
    left = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= threshold / (1 + threshold) * (F.col("size_a") + F.col("size_b")) - needed + 1 - 1e-6
    common = x.join(y, "shingle").filter((F.col("rep_a") < F.col("rep_b")) & sized & left).select("rep_a", "rep_b", "size_a", "size_b")
    candidates = common.groupBy("rep_a", "rep_b").agg(F.count("*").alias("n"), F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b")).filter(F.col("n") >= needed).drop("n")
    pops = lambda end: reps.select(F.col("rep").alias(f"rep_{end}"), F.col("pops").alias(f"pops_{end}"))
    close = candidates.join(pops("a"), "rep_a").join(pops("b"), "rep_b").mapInPandas(_bounded(threshold), "rep_a long, rep_b long")
    close = materialize(close, "candidates")
    read = close.select(F.explode(F.array("rep_a", "rep_b")).alias("seq")).distinct()
    texts = rows.select("seq", "text").join(read, "seq", "left_semi")
    links = (
        close.join(texts.select(F.col("seq").alias("rep_b"), F.col("text").alias("text_b")), "rep_b")
        .join(texts.select(F.col("seq").alias("rep_a"), F.col("text").alias("text_a")), "rep_a")
        .mapInPandas(_verified(threshold, width), "rep_a long, rep_b long, similarity double")
    )
    return members, links


def near_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """seq_a, seq_b: every pair of rows in one class or in linked classes, each once, seq_a < seq_b.

    The members of a large class are dealt to parts: each part meets all members in a task of its own.
    """
    parts = members.groupBy("rep").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count("*").alias("n")).filter("n > 1").select("rep", "parts")
    dealt = members.join(parts, "rep")
    one = dealt.select("rep", F.pmod(F.xxhash64("seq"), F.col("parts").cast("long")).cast("int").alias("part"), F.col("seq").alias("seq_a"))
    all_ = dealt.select("rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("seq").alias("seq_b"))
    own = one.join(all_, ["rep", "part"]).filter("seq_a < seq_b").select("seq_a", "seq_b")
    left = members.select(F.col("rep").alias("rep_a"), F.col("seq").alias("x"))
    right = members.select(F.col("rep").alias("rep_b"), F.col("seq").alias("y"))
    across = links.join(left, "rep_a").join(right, "rep_b").select(F.least("x", "y").alias("seq_a"), F.greatest("x", "y").alias("seq_b"))
    return own.unionByName(across)


def linked_members(members: DataFrame, links: DataFrame) -> DataFrame:
    """seq, class_id, copies, links: one row per row, its class, the size of the class, and the number of linked classes."""
    ends = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    facts = sizes.join(ends, "rep", "left")
    return members.join(facts, "rep").select("seq", F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
