"""The k most similar vectors of every vector: inverted file, product-quantised residuals, exact reranking.

Centroids and codebooks are fitted on a bounded sample, then every vector is indexed.
Vectors that point the same way (up to a fine grid) form one class; classes are searched,
their members expanded, so any number of copies costs no more than one vector. A cell's
queries and its neighbour cells' codes meet in blocks of bounded size; asymmetric
distance tables rank the codes and the best candidates are reranked with exact cosines.
What the bounds leave open is then searched too, by cells, or with a floor by groups of
vectors close together, so no neighbour is lost to the number of probes or candidates.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.session import discard, materialize

#: Vectors the centroids and codebooks are fitted on, at most about so many.
SAMPLE = 65_536
#: Cells grow with the square root of the rows; at most so many, which bounds what is broadcast.
CELLS_PER_ROOT, MAX_CELLS = 4, 16_384
#: Neighbour cells searched from each cell, itself among them.
PROBES = 10
SUBSPACES, CODEWORDS = 16, 256
#: Candidates of each query that the distance tables leave for exact reranking; they set the bound of the completing
#: search, which finds what they lack.
RERANK = 32
#: Most queries, and most codes of one cell, in a block.
BLOCK = 2048
#: Queries of one cell, or groups of them, that the completing search takes at a time.
QUERIES = 256
#: Vectors, about, that one pass of the completing search broadcasts: a quarter of all, but between these bounds
#: (16 and 64 MB at 64 entries). Every executor keeps a copy on its disk; every pass reads all queries again.
PASS, MOST_PASS = 65_536, 262_144
#: Cosine to a first member from which vectors form a group, and most members of one.
GROUP, MEMBERS = 0.9, 32
GRID = 1e-4


def kmeans(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from seeded random points; empty ones are moved to far points."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        best, far = _nearest(points, centres)
        sums = np.stack([np.bincount(best, points[:, j], k) for j in range(points.shape[1])], axis=1).astype(np.float32)
        n = np.bincount(best, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            centres[empty] = points[np.argsort(-far)[: len(empty)]]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centre, in blocks."""
    best, far = np.empty(len(points), np.int64), np.empty(len(points), np.float32)
    half = (centres * centres).sum(axis=1) / 2
    for a in range(0, len(points), 8192):
        p = points[a : a + 8192]
        s = p @ centres.T - half
        i = s.argmax(axis=1)
        best[a : a + 8192] = i
        far[a : a + 8192] = (p * p).sum(axis=1) - 2 * s[np.arange(len(p)), i]
    return best, far


@dataclass
class Codec:
    centroids: np.ndarray  # (cells, dim)
    codebooks: np.ndarray  # (subspaces, codewords, dim / subspaces)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, residual code and length of what the code misses, for normalised vectors."""
        cell, _ = _nearest(x, self.centroids)
        rest = x - self.centroids[cell]
        m, _, d = self.codebooks.shape
        codes = np.empty((len(x), m), np.uint8)
        miss = np.zeros(len(x), np.float32)
        for j in range(m):
            codes[:, j], e = _nearest(np.ascontiguousarray(rest[:, j * d : (j + 1) * d]), self.codebooks[j])
            miss += np.maximum(e, 0)
        return cell, codes, np.sqrt(miss)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Asymmetric tables (subspaces, codewords, queries): inner products of codewords and query parts."""
        m, _, d = self.codebooks.shape
        return self.codebooks @ q.reshape(len(q), m, d).transpose(1, 2, 0)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _binaries(x: np.ndarray) -> pa.Array:
    """The rows of a C-ordered array as one Arrow column of binaries."""
    width = x.strides[0] if len(x) else 0
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(x)])


def directions(rows: DataFrame, dim: int) -> DataFrame:
    """seq, unit (normalised, single precision), h1, h2 (of the direction on the grid) of every usable (seq, vector).

    Vectors of that length without nulls, infinities and NaN that are not all zero are usable.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            good = np.isfinite(x).all(axis=1) & (np.abs(x) < 3.0e38).all(axis=1) & (x != 0).any(axis=1)
            x, seq = x[good], batch.column(0).to_numpy(zero_copy_only=False)[good]
            x = x / np.abs(x).max(axis=1, keepdims=True, initial=0.0)  # so that no square under- or overflows
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            grid = np.ascontiguousarray(np.rint(x / GRID).astype(np.int64).T).view(np.uint64)
            h1, h2 = np.zeros(len(x), np.uint64), np.full(len(x), 7, np.uint64)
            for j in range(dim):
                h1 = _mixed(h1 * np.uint64(0x9E3779B97F4A7C15) + grid[j])
                h2 = _mixed(h2 * np.uint64(0xC2B2AE3D27D4EB4F) ^ grid[j])
            yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), _binaries(np.ascontiguousarray(x, np.float32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["seq", "unit", "h1", "h2"])

    right = rows.filter(F.col("seq").isNotNull() & (F.size("vector") == dim)).select(F.col("seq").cast("long").alias("seq"), "vector")
    return right.mapInArrow(work, "seq long, unit binary, h1 long, h2 long")


def _matrix(units_: Iterable[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(units_), np.float32).reshape(-1, dim)


def _vectors(units_: pa.BinaryArray, dim: int) -> np.ndarray:
    """The rows of an Arrow column of binaries, without a copy."""
    if not len(units_):
        return np.empty((0, dim), np.float32)
    ends = np.frombuffer(units_.buffers()[1], np.int32)[units_.offset : units_.offset + len(units_) + 1]
    return np.frombuffer(units_.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(-1, dim)


def cells_of(n: int) -> int:
    """Cells for n vectors: they grow with the square root."""
    return int(min(MAX_CELLS, max(1, CELLS_PER_ROOT * math.sqrt(n))))


def fit(rows: DataFrame, dim: int, n: int, sample: int = SAMPLE, seed: int = 5) -> Codec:
    """Cells and codebooks from a seeded sample of (seq, unit): 32 vectors a cell, about, and at most about sample of them."""
    wanted = min(sample, max(16_384, 32 * cells_of(n)))
    draw = F.pmod(F.xxhash64("seq", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    got = rows.filter(draw < min(1.0, wanted / max(1, n))).select("seq", "unit").toPandas().sort_values("seq")
    if got.empty:
        got = rows.select("seq", "unit").limit(1).toPandas()
    x = _matrix(got["unit"], dim)
    centroids = kmeans(x, min(cells_of(n), max(1, len(x) // 4)), 6, seed)
    rest = x - centroids[_nearest(x, centroids)[0]]
    m = SUBSPACES if dim % SUBSPACES == 0 else 1
    d = dim // m
    small = rest[:: max(1, len(rest) // 16_384)]
    books = np.zeros((m, CODEWORDS, d), np.float32)
    for j in range(m):
        got_ = kmeans(np.ascontiguousarray(small[:, j * d : (j + 1) * d]), CODEWORDS, 5, seed + j)
        books[j, : len(got_)] = got_
        books[j, len(got_) :] = got_[0]
    return Codec(centroids.astype(np.float32), books)


def _codes_of(codec, dim: int) -> object:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units_ = batch.column(1)
            cell, codes, miss = codec.value.encode(_vectors(units_, dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), units_, pa.array(cell, pa.int32()), _binaries(codes), pa.array(miss, pa.float32())], ["rep", "unit", "cell", "code", "miss"])

    return encode


def _ranked(codec, rerank: int, floor: float | None, dim: int) -> object:
    """Per (home cell, query block, code block): the best codes of each query by distance tables."""

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = codec.value
        is_query = pdf["unit"].notna().to_numpy()
        queries, codes = pdf[is_query], pdf[~is_query]
        if queries.empty or codes.empty:
            return pd.DataFrame(columns=["cell", "block", "rep", "other", "estimate"])
        q = np.frombuffer(b"".join(queries["unit"]), np.float32).reshape(-1, dim)
        q_rep = queries["rep"].to_numpy()
        ids = codes["rep"].to_numpy()
        cells = codes["source"].to_numpy().astype(np.int64)
        code = np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(ids), -1)
        miss = codes["miss"].to_numpy().astype(np.float32)
        own, inverse = np.unique(cells, return_inverse=True)
        columns = code.T.astype(np.intp)
        out = []
        for a in range(0, len(q), 256):
            part, asker = q[a : a + 256], q_rep[a : a + 256]
            score = (c.centroids[own] @ part.T)[inverse]  # a row for each code
            for table, column in zip(c.tables(part), columns):
                score += table[column]
            if floor is None:
                score[ids[:, None] == asker[None, :]] = -np.inf
                keep = min(rerank, len(score))
                col = np.argpartition(-score.T, keep - 1, axis=1)[:, :keep].ravel()
                row = np.repeat(np.arange(len(part)), keep)
            else:  # an estimate misses the true cosine by no more than the length the code misses
                flat = np.flatnonzero(score >= (floor - 1e-4 - miss)[:, None])
                col, row = np.divmod(flat, len(part))
            value = score[col, row]
            good = np.isfinite(value) & (ids[col] != asker[row])
            row, col, value = row[good], col[good], value[good]
            order = np.lexsort((-value, row))
            row, col, value = row[order], col[order], value[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < rerank
            out.append((asker[row[kept]], ids[col[kept]], value[kept]))
        found = pd.DataFrame({"rep": np.concatenate([o[0] for o in out]), "other": np.concatenate([o[1] for o in out]), "estimate": np.concatenate([o[2] for o in out])})
        found.insert(0, "cell", np.int32(key[0]))
        found.insert(1, "block", np.int32(key[1]))
        return found

    return search


def _groups(x: np.ndarray) -> np.ndarray:
    """A group number for each vector: at most MEMBERS of a cosine of GROUP or more to one of them."""
    near = x @ x.T >= GROUP
    np.fill_diagonal(near, True)
    group, last = np.full(len(x), -1), 0
    for i in np.argsort(-near.sum(axis=1), kind="stable").tolist():
        if group[i] < 0:
            free = np.flatnonzero(near[i] & (group < 0))
            group[free[:MEMBERS]] = last
            group[i] = last
            last += 1
    return group


def _exact(k: int, floor: float | None, dim: int) -> object:
    """Per (home cell, query block): the queries by groups, each with its k-th cosine by exact cosines of the candidates."""

    def rerank(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["askers"].isna().to_numpy()
        queries, others = pdf[is_query], pdf[~is_query]
        unit_ = _matrix(queries["unit"], dim)
        least = np.full(len(queries), -2.0 if floor is None else floor)
        if len(others):
            q, v = unit_.astype(np.float64), _matrix(others["unit"], dim).astype(np.float64)
            where = pd.Series(np.arange(len(q)), index=queries["rep"].to_numpy())
            counts = others["askers"].map(len).to_numpy()
            right = np.repeat(np.arange(len(v)), counts)
            left = where.loc[np.concatenate(others["askers"].to_numpy())].to_numpy()
            cosine = np.einsum("ij,ij->i", q[left], v[right])
            order = np.lexsort((-cosine, left))
            left, cosine = left[order], cosine[order]
            last = np.arange(len(left)) - np.searchsorted(left, left) == k - 1
            least[left[last]] = np.maximum(least[left[last]], cosine[last])
        group = np.zeros(len(queries), int) if floor is None else _groups(unit_)
        found = pd.DataFrame({"rep": queries["rep"].to_numpy(), "unit": queries["unit"].to_numpy(), "cell": np.int32(key[0]), "block": np.int32(key[1]), "part": group.astype(np.int32), "least": least})
        return found.sort_values("part", kind="stable")

    return rerank


def similar_classes(units_: DataFrame, codec: Codec, k: int, floor: float | None, dim: int, probes: int = PROBES, rerank: int = RERANK) -> DataFrame:
    """rep, unit, cell, block, part, least: every (rep, unit, cell, code, miss) row with the k-th cosine found, else the floor.

    Rows of one cell and block come together, by the groups (part) in which the completing search takes them.
    """
    spark = units_.sparkSession
    shared = spark.sparkContext.broadcast(codec)
    cells = len(codec.centroids)
    sizes = np.zeros(cells, np.int64)
    for r in units_.groupBy("cell").agg(F.count("*").alias("n")).collect():  # one row per cell, at most MAX_CELLS
        sizes[r["cell"]] = r["n"]
    blocks = np.maximum(1, -(-sizes // BLOCK)).astype(int)
    near = np.empty((cells, min(probes, cells)), np.int64)
    square = (codec.centroids**2).sum(axis=1)
    for a in range(0, cells, 1024):
        distance = square[None, :] - 2 * codec.centroids[a : a + 1024] @ codec.centroids.T
        near[a : a + 1024] = np.argsort(distance, axis=1, kind="stable")[:, : near.shape[1]]
    # For each cell: the homes whose queries look into it, with the number of query blocks there.
    homes: list[list[int]] = [[] for _ in range(cells)]
    parts = np.ones(cells, int)  # code blocks a home's queries meet
    for home in range(cells):
        for source in near[home].tolist():
            homes[source].append(home)
            parts[home] = max(parts[home], blocks[source])
    plan = pa.table({"cell": pa.array(range(cells), pa.int32()), "blocks": pa.array(blocks, pa.int32()), "parts": pa.array(parts, pa.int32()), "targets": pa.array([[{"home": h, "n": int(blocks[h])} for h in x] for x in homes], pa.list_(pa.struct([("home", pa.int32()), ("n", pa.int32())])))})
    plan = F.broadcast(spark.createDataFrame(plan))  # MAX_CELLS rows with probes homes each on average
    placed = units_.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    empty = F.lit(None)
    asking = placed.select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rep", "unit", empty.cast("int").alias("source"), empty.cast("binary").alias("code"), empty.cast("float").alias("miss"))
    offered = (
        placed.select(F.col("cell").alias("source"), F.col("block").alias("part"), "rep", "code", "miss", F.explode("targets").alias("t"))
        .select(F.col("t.home").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("t.n") - 1)).alias("block"), "part", "rep", empty.cast("binary").alias("unit"), "source", "code", "miss")
    )
    found = asking.unionByName(offered).groupBy("cell", "block", "part").applyInPandas(_ranked(shared, rerank, floor, dim), "cell int, block int, rep long, other long, estimate float")
    if parts.max() > 1:  # candidates of several code blocks: the best of them all, of which each map task passes on no more either
        best = Window.partitionBy("cell", "block", "rep").orderBy(F.col("estimate").desc(), "other")
        found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= rerank).drop("r")
    wanted = found.groupBy("cell", "block", "other").agg(F.collect_list("rep").alias("askers"))
    vectors = units_.select(F.col("rep").alias("other"), "unit")
    candidates = wanted.join(vectors, "other").select("cell", "block", F.col("other").alias("rep"), "unit", "askers")
    asked = placed.select("cell", "block", "rep", "unit", empty.cast("array<bigint>").alias("askers"))
    return candidates.unionByName(asked).groupBy("cell", "block").applyInPandas(_exact(k, floor, dim), "rep long, unit binary, cell int, block int, part int, least double")


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where the rows change to another key."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))


def _caps(unit_: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Direction of the middle of each run of rows and the largest angle of a row to it."""
    middle = np.add.reduceat(unit_, starts, axis=0, dtype=np.float64)
    middle /= np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-30)
    sizes = np.diff(starts, append=len(unit_))
    cosine = np.einsum("ij,ij->i", unit_, np.repeat(middle, sizes, axis=0)) / np.linalg.norm(unit_.astype(np.float64), axis=1)
    return middle.astype(np.float32), np.arccos(np.clip(np.minimum.reduceat(cosine, starts), -1, 1))


@dataclass
class Source:
    """Vectors of one pass, ordered by cell, or with a floor by groups and these by bound and radius."""

    rep: np.ndarray
    unit: np.ndarray
    cells: np.ndarray
    sizes: np.ndarray  # of each cell or group
    radius: np.ndarray  # of each cell by the vectors of this pass, as a distance; of each group as an angle
    middle: np.ndarray | None = None  # of each group, and a 1
    reach: np.ndarray | None = None  # of each group: its radius and the angle of its lowest bound
    least: np.ndarray | None = None  # bound of each vector

    @classmethod
    def of(cls, rep: np.ndarray, unit_: np.ndarray, cell: np.ndarray, centroids: np.ndarray) -> Source:
        order = np.lexsort((rep, cell))
        rep, unit_, cell = rep[order], unit_[order], cell[order]
        cells, starts, sizes = np.unique(cell, return_index=True, return_counts=True)
        far = np.linalg.norm(unit_ - centroids[cell], axis=1)
        return cls(rep, unit_, cells, sizes, np.maximum.reduceat(far, starts))

    @classmethod
    def grouped(cls, rep: np.ndarray, unit_: np.ndarray, least: np.ndarray, *keys: np.ndarray) -> Source:
        order = np.lexsort(keys)
        starts = _starts(*(k[order] for k in keys))
        middle, radius = _caps(unit_[order], starts)
        reach = radius + _angle(np.minimum.reduceat(least[order], starts))
        sizes = np.diff(starts, append=len(rep))
        by = np.lexsort((radius, np.rint(10 * (reach - radius))))  # alike in a block
        row = order[np.repeat(starts[by] - np.cumsum(sizes[by]) + sizes[by], sizes[by]) + np.arange(len(rep))]
        return cls(rep[row], unit_[row], keys[-1][row], sizes[by], radius[by], np.pad(middle[by], ((0, 0), (0, 1)), constant_values=1), reach[by], least[row])


def _angle(least: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(least - 1e-6, -1, 1))


def _open_cells(q: np.ndarray, home: int, least: np.ndarray, centroids: np.ndarray, source: Source) -> np.ndarray:
    """Which cells of the source may hold, for some query of one home cell, a vector of its cosine least or more.

    A vector of another cell lies beyond the wall halfway between both centroids, and none
    lies further from its centroid than the radius; both bound the distance from below.
    """
    there, here = centroids[source.cells], centroids[home]
    square = (there * there).sum(axis=1)
    to = np.maximum(1 + square[None, :] - 2 * q @ there.T, 0)
    own = 1 + here @ here - 2 * q @ here
    between = np.sqrt(np.maximum(here @ here + square - 2 * there @ here, 1e-12))
    wall = (to - own[:, None] - 1e-5) / (2 * between)  # 1e-5, 1e-4: more than single precision misses
    reach = np.sqrt(np.maximum(2 - 2 * least, 0)) + 1e-4
    return (np.maximum(wall, np.sqrt(to) - source.radius) <= reach[:, None]).any(axis=0)


def _open_groups(middle: np.ndarray, radius: np.ndarray, reach: np.ndarray, source: Source, space: np.ndarray) -> np.ndarray:
    """Which groups of the source may hold a vector that reaches the bound of some query of these groups, or whose bound such a query reaches.

    Angles obey the triangle inequality, so middles further apart than one group's reach and the other's radius rule it out.
    """
    open_ = np.empty(len(source.middle), bool)
    asking = np.pad(middle, ((0, 0), (0, 1)))
    for b in range(0, len(open_), BLOCK):
        there = source.middle[b : b + BLOCK]
        far = np.maximum(reach + source.radius[b : b + BLOCK].max(), radius + source.reach[b : b + BLOCK].max())
        asking[:, -1] = 1e-5 - np.cos(np.minimum(far + 1e-3, np.pi))  # 1e-3, 1e-5: more than single precision misses
        near = np.matmul(asking, there.T, out=space[: len(middle), : len(there)] if len(there) == BLOCK else None)
        open_[b : b + BLOCK] = near.max(axis=0) >= 0
    return open_


class Answers:
    """The best k queries for each vector of the source, as far as they reach its bound."""

    def __init__(self, source: Source, k: int) -> None:
        self.k, self.names, self.lowest = k, source.rep, (source.least - 1e-6).astype(np.float32)
        self.vector, self.rep, self.cosine = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.kept = 0

    def add(self, vector: np.ndarray, rep: np.ndarray, cosine: np.ndarray) -> None:
        self.vector, self.rep, self.cosine = np.append(self.vector, vector), np.append(self.rep, rep), np.append(self.cosine, cosine)
        if len(self.vector) > 2 * self.kept + 65_536:
            self.sift()

    def sift(self) -> None:
        order = np.lexsort((self.rep, -self.cosine, self.vector))
        vector = self.vector[order]
        rank = np.arange(len(vector)) - np.searchsorted(vector, vector)
        last, order = order[rank == self.k - 1], order[rank < self.k]
        self.lowest[self.vector[last]] = np.maximum(self.lowest[self.vector[last]], self.cosine[last] - 1e-6)
        self.vector, self.rep, self.cosine = self.vector[order], self.rep[order], self.cosine[order]
        self.kept = len(order)

    def taken(self) -> pa.RecordBatch:
        """What is held, which is then forgotten; the bounds stay as high as it has raised them."""
        self.sift()
        batch = _found(self.names[self.vector], self.rep, self.cosine)
        self.vector, self.rep, self.cosine, self.kept = self.vector[:0], self.rep[:0], self.cosine[:0], 0
        return batch


def _found(rep: np.ndarray, other: np.ndarray, cosine: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(other, pa.int64()), pa.array(cosine, pa.float64())], ["rep", "other", "similarity"])


def _completed(codec, source, k: int, floor: float | None, dim: int, now: int) -> object:
    """The best k of the source for each query that reach its bound, by exact cosines with all that is open.

    The queries come ordered by cell and group, so those of one cell, or some groups, are searched together.
    Queries of a later turn than now also answer the vectors of the source, which do not ask in theirs.
    """

    def blocks(unit_: np.ndarray, least: np.ndarray, cell: np.ndarray, block: np.ndarray, part: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        s = source.value
        if s.middle is None:
            edges = [*_starts(cell).tolist(), len(cell)]
            for begin, end in ((a, min(a + QUERIES, z)) for y, z in zip(edges, edges[1:]) for a in range(y, z, QUERIES)):
                yield begin, end, np.repeat(_open_cells(unit_[begin:end], cell[begin], least[begin:end], codec.value.centroids, s), s.sizes)
        elif len(cell):
            starts = _starts(cell, block, part)
            middle, radius = _caps(unit_, starts)
            reach = radius + _angle(np.minimum.reduceat(least, starts))
            edges = [*starts.tolist(), len(cell)]
            for a in range(0, len(starts), QUERIES):
                z = min(a + QUERIES, len(starts))
                open_ = np.repeat(_open_groups(middle[a:z], radius[a:z], reach[a:z], s, space), s.sizes)
                for begin in range(edges[a], edges[z], QUERIES):
                    yield begin, min(begin + QUERIES, edges[z]), open_

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = source.value
        space = np.empty((QUERIES, BLOCK), np.float32)
        answers = None if s.least is None else Answers(s, k)
        for batch in batches:
            unit_ = _vectors(batch.column(1), dim)
            reps, cell, block, part, bounds, turn = (batch.column(i).to_numpy() for i in (0, 2, 3, 4, 5, 6))
            for begin, end, open_ in blocks(unit_, bounds, cell, block, part, space):
                q, rep, least, later = unit_[begin:end], reps[begin:end], bounds[begin:end], turn[begin:end] > now
                columns = None if open_.mean() > 0.7 else np.flatnonzero(open_)  # a copy of most vectors costs more than the others' products
                vectors, names = (s.unit, s.rep) if columns is None else (s.unit[columns], s.rep[columns])
                r, name, cosine = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
                lowest = (least - 1e-6).astype(np.float32)
                for b in range(0, len(vectors), BLOCK):
                    v = vectors[b : b + BLOCK]
                    near = np.matmul(q, v.T, out=space[: len(q), : len(v)] if len(v) == BLOCK else None)
                    if later.any():
                        at = np.arange(b, b + len(v)) if columns is None else columns[b : b + len(v)]
                        flat = np.flatnonzero(near >= np.where(later[:, None], answers.lowest[at], np.float32(9)))
                        if len(flat):
                            i, m = np.divmod(flat, len(v))
                            c = np.einsum("ij,ij->i", q[i].astype(np.float64), v[m].astype(np.float64))
                            good = c >= floor
                            answers.add(at[m[good]], rep[i[good]], c[good])
                    flat = np.flatnonzero(near >= lowest[:, None])
                    if not len(flat):
                        continue
                    i, m = np.divmod(flat, len(v))
                    m += b
                    c = np.einsum("ij,ij->i", q[i].astype(np.float64), vectors[m].astype(np.float64))
                    good = (rep[i] != names[m]) & (c >= (-2.0 if floor is None else floor))
                    r, name, cosine = np.append(r, i[good]), np.append(name, names[m[good]]), np.append(cosine, c[good])
                    order = np.lexsort((name, -cosine, r))
                    r, name, cosine = r[order], name[order], cosine[order]
                    rank = np.arange(len(r)) - np.searchsorted(r, r)
                    last = rank == k - 1
                    lowest[r[last]] = np.maximum(lowest[r[last]], cosine[last] - 1e-6)
                    r, name, cosine = r[rank < k], name[rank < k], cosine[rank < k]
                if len(r):
                    yield _found(rep[r], name, cosine)
            if answers is not None:
                yield answers.taken()

    return search


def complete(found: DataFrame, codec: Codec, k: int, floor: float | None, dim: int) -> DataFrame:
    """rep, other, similarity: the exact best k others of every unit, given the bounds of a first search.

    The k-th cosine found so far (or the floor) bounds what can still be better; a query is
    compared with all vectors of every cell or group that may hold such a one. Nothing of a bounded
    number is left out, and the work grows with what is open, at worst with the square of the units.
    """
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast(codec)
    asking = materialize(found, "bounds")
    sizes = sorted((r["cell"], r["n"]) for r in asking.groupBy("cell").agg(F.count("*").alias("n")).collect())  # at most MAX_CELLS
    start = np.cumsum([0] + [n for _, n in sizes])
    passes = max(1, -(-int(start[-1]) // min(max(PASS, int(start[-1]) // 4), max(PASS, MOST_PASS))))
    plan = spark.createDataFrame(pa.table({"cell": pa.array([c for c, _ in sizes], pa.int32()), "n": pa.array([n for _, n in sizes], pa.int64()), "start": pa.array(start[:-1], pa.int64())}))
    # Where a vector stands decides the turn in which it is searched.
    spread = F.xxhash64("rep") if floor is None else F.xxhash64("block", "part")  # a group stays together
    turn = ((F.col("start") + F.pmod(spread, F.col("n"))) * passes / F.lit(int(start[-1]))).cast("int")
    placed = asking.join(F.broadcast(plan), "cell").withColumn("turn", turn)
    done = []
    for i in range(passes):
        got = placed.filter(F.col("turn") == i).select("rep", "unit", "cell", "block", "part", "least").toArrow()
        if not got.num_rows:
            continue
        vectors = np.concatenate([_vectors(c, dim) for c in got["unit"].chunks])
        rep, cell, block, part, least = (got[c].to_numpy() for c in ("rep", "cell", "block", "part", "least"))
        del got
        source = spark.sparkContext.broadcast(Source.of(rep, vectors, cell, codec.centroids) if floor is None else Source.grouped(rep, vectors, least, part, block, cell))
        queries = asking.withColumn("turn", F.lit(i)) if floor is None else placed.filter(F.col("turn") >= i)  # each two groups meet once
        queries = queries.select("rep", "unit", "cell", "block", "part", "least", "turn")
        done.append(materialize(queries.mapInArrow(_completed(shared, source, k, floor, dim, i), "rep long, other long, similarity double"), "completed"))
        source.destroy()
    if len(done) == 1:
        return done[0]
    both = functools.reduce(DataFrame.unionByName, done)
    return both.withColumn("r", F.row_number().over(_by("rep"))).filter(F.col("r") <= k).drop("r")


def most_similar(rows: DataFrame, k: int = 5, dim: int = 64, floor: float | None = None, probes: int = PROBES, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """seq, other, similarity, rank: the k rows of highest cosine similarity to every row of (seq, vector).

    The search is completed until it is exact. floor leaves out neighbours of a lower
    similarity, and lets their candidates be dropped early by a bound that loses none. Rows with a null, short, long, zero or not finite
    vector, or a null seq, take no part. Ties go to the lower seq. Vectors equal up to a
    grid of 1e-4 count as copies of similarity 1. Fewer than k others give fewer rows; an
    empty table gives none.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = rows.sparkSession
    schema = "seq long, other long, similarity double, rank int"
    keyed = materialize(directions(rows.select("seq", "vector"), dim), "vectors")
    n = keyed.count()
    if not n:
        return spark.createDataFrame([], schema)
    # Classes of equal directions, folded map-side; of each at most the first k + 1 members are listed.
    classes = keyed.groupBy("h1", "h2").agg(F.min("seq").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    several = materialize(classes, "copies")
    copies = keyed.select("seq", "h1", "h2").join(several.select("h1", "h2", "rep"), ["h1", "h2"]).select("seq", "rep") if several.take(1) else None
    alone = keyed.select("seq", "unit")
    if copies is not None:
        copies = materialize(copies, "members")
        alone = alone.join(copies.filter("seq != rep").select("seq"), "seq", "left_anti")
        first = copies.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("seq"))).filter(F.col("r") <= k + 1)
        several = several.join(first.groupBy("rep").agg(F.array_sort(F.collect_list("seq")).alias("members")), "rep").select("rep", "n", "members")
    codec = fit(keyed, dim, n, sample)
    shared = spark.sparkContext.broadcast(codec)
    units_ = materialize(alone.mapInArrow(_codes_of(shared, dim), "rep long, unit binary, cell int, code binary, miss float"), "codes")
    discard(keyed)  # all that follows reads the codes and the copies
    pairs = complete(similar_classes(units_, codec, k, floor, dim, probes, rerank), codec, k, floor, dim)
    if copies is None:
        ranked = pairs.select(F.col("rep").alias("seq"), "other", "similarity")
        order = F.row_number().over(_by("seq"))
        return ranked.withColumn("rank", order.cast("int")).select("seq", "other", "similarity", "rank")
    # Expand: the members of each neighbouring class (k of them are enough), then the own class.
    members = several.select("rep", "members")
    wide = pairs.join(members.withColumnRenamed("rep", "other"), "other", "left")
    wide = wide.select("rep", F.explode(F.coalesce(F.slice("members", 1, k), F.array("other"))).alias("other"), "similarity")
    top = wide.withColumn("r", F.row_number().over(_by("rep"))).filter(F.col("r") <= k).groupBy("rep").agg(F.collect_list(F.struct("other", "similarity")).alias("outer"))
    top = materialize(top, "neighbours")  # read by the class and by its followers; the search is not done twice
    owners = several.filter(F.col("n") <= k).select("rep")  # larger classes have k others of their own
    followers = copies.join(owners, "rep", "left_semi").filter("seq != rep")
    outer = top.select(F.col("rep").alias("seq"), "outer").unionByName(followers.join(top, "rep").select("seq", "outer"))
    outer = outer.select("seq", F.explode("outer").alias("o")).select("seq", "o.other", "o.similarity")
    inner = copies.join(several.select("rep", "members"), "rep").select("seq", F.explode("members").alias("other"), F.lit(1.0).alias("similarity")).filter("seq != other")
    both = outer.unionByName(inner)
    return both.withColumn("rank", F.row_number().over(_by("seq"))).filter(F.col("rank") <= k).select("seq", "other", "similarity", F.col("rank").cast("int").alias("rank"))


def _by(column: str):
    return Window.partitionBy(column).orderBy(F.col("similarity").desc(), F.col("other"))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """seq_a, seq_b, similarity of the pairs in which one is a neighbour of the other, each once, seq_a < seq_b."""
    return neighbours.groupBy(F.least("seq", "other").alias("seq_a"), F.greatest("seq", "other").alias("seq_b")).agg(F.max("similarity").alias("similarity"))
