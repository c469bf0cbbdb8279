"""Mixing sources to target shares of all tokens, by a minimum-cost flow over membership patterns.

A text that several sources hold (as exact copies under other ids) can serve any of
them. Texts are aggregated by their pattern of member sources; the flow routes each
pattern's tokens to the quotas of its sources, every further repetition of a text
costing more than the one before. Seeded documents are then selected for the amounts.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.session import materialize

#: Where the vocabulary file of the public tokenizer lies; a parameter of every function here.
VOCABULARY = os.path.join(os.environ.get("SEXTANT_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: Units of one pattern, about, that are put in line in one task.
SLICE = 50_000
# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str, pattern: str = PATTERN):
    """A byte-level BPE encoder from a file of base64 tokens and ranks, which is data only."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (trimmed, lower case), h1, h2 (of the text), tokens of every document with a text that is not empty."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for pdf in batches:
            yield pdf[["doc_id", "source", "h1", "h2"]].assign(tokens=[len(enc.encode_ordinary(t)) for t in pdf["text"]])

    usable = documents.filter("doc_id is not null and length(text) > 0")
    keyed = usable.select("doc_id", F.lower(F.trim("source")).alias("source"), F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(3)).alias("h2"), "text")
    return keyed.mapInPandas(count, "doc_id long, source string, h1 long, h2 long, tokens long")


# ---------------------------------------------------------------- the flow
class Flow:
    """A network of integer capacities that is augmented along shortest paths until none is left."""

    def __init__(self, nodes: int):
        self.head: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def edge(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.head[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.head)
        level[source], queue = 0, [source]
        for x in queue:
            for e in self.head[x]:
                if self.room[e] > 0 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def run(self, source: int, sink: int) -> int:
        """Augment in phases of equally long paths; the amount added."""
        total, head, to, room = 0, self.head, self.to, self.room
        while True:
            level = self.levels(source)
            if level[sink] < 0:
                return total
            at = [0] * len(head)
            path: list[int] = []
            x = source
            while True:
                if x == sink:
                    push = min(room[e] for e in path)
                    total += push
                    for n, e in enumerate(path):
                        room[e] -= push
                        room[e ^ 1] += push
                    first = next(n for n, e in enumerate(path) if room[e] == 0)
                    x = to[path[first] ^ 1]
                    del path[first:]
                    continue
                while at[x] < len(head[x]):
                    e = head[x][at[x]]
                    if room[e] > 0 and level[to[e]] == level[x] + 1:
                        break
                    at[x] += 1
                else:
                    if not path:
                        break
                    x = to[path.pop() ^ 1]
                    at[x] += 1
                    continue
                path.append(e)
                x = to[e]


class Routing:
    """Patterns of sources, their texts' repetitions, and the sources' quotas, as one network.

    The r-th repetition of a pattern's texts is a node of its own with the pattern's
    tokens as capacity, and costs r*r a token; it serves only sources that allow r
    repetitions. As all cost lies on the edges out of the origin, opening them in the
    order of their cost and augmenting after each gives the flow of least cost.
    """

    def __init__(self, patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int):
        sources = sorted(targets)
        self.quota = {s: int(round(targets[s][0] * total)) for s in sources}
        self.at = {s: 1 + i for i, s in enumerate(sources)}
        layers = [(r, p) for p in sorted(patterns) for r in range(1, max(targets[s][1] for s in p) + 1)]
        self.flow = Flow(2 + len(sources) + len(layers))
        self.sink = len(self.flow.head) - 1
        for s in sources:
            self.flow.edge(self.at[s], self.sink, self.quota[s])
        self.edges, self.inlets = [], []
        for i, (r, p) in enumerate(layers):
            node = 1 + len(sources) + i
            self.inlets.append((r, self.flow.edge(0, node, 0), patterns[p], node))
            self.edges += [(p, r, s, self.flow.edge(node, self.at[s], patterns[p])) for s in p if targets[s][1] >= r]
        self.got = 0

    def solve(self) -> Routing:
        for cost in sorted({r for r, *_ in self.inlets}):
            for r, e, tokens, _ in self.inlets:
                if r == cost:
                    self.flow.room[e] = tokens
            self.got += self.flow.run(0, self.sink)
            if self.got == sum(self.quota.values()):
                break
        return self

    def amounts(self) -> dict[tuple, list[tuple[int, str, int]]]:
        """(repetition, source, tokens) of each pattern."""
        out: dict[tuple, list[tuple[int, str, int]]] = {}
        for p, r, s, e in self.edges:
            if used := self.flow.room[e ^ 1]:
                out.setdefault(p, []).append((r, s, used))
        return out

    def bottleneck(self) -> tuple[int, list[str]]:
        """Of a smallest cut: the tokens of the cut inlets, and the sources that are still within reach."""
        level = self.flow.levels(0)
        return sum(tokens for _, _, tokens, node in self.inlets if level[node] < 0), [s for s, n in self.at.items() if level[n] >= 0]


def largest_total(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]]) -> int:
    """The most tokens for which every source's quota can be filled.

    From above: each smallest cut that a total does not pass gives the total that it would let pass.
    """
    total = sum(n * max(targets[s][1] for s in p) for p, n in patterns.items())
    while total > 0:
        routing = Routing(patterns, targets, total).solve()
        if routing.got >= sum(routing.quota.values()):
            return total
        tokens, reached = routing.bottleneck()
        rest = 1.0 - sum(targets[s][0] for s in reached)
        total = min(total - 1, int(tokens / rest) if rest > 1e-12 else 0)
    return 0


def _targets(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Share and repetitions of every listed source; sources listed twice add up. One row per source of the wanted mix."""
    wanted = mix_targets.filter("source is not null and target_share > 0 and max_repeats > 0")
    rows = wanted.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect()
    return {r["source"]: (float(r["share"]), int(r["repeats"])) for r in rows}


def mix(documents: DataFrame, mix_targets: DataFrame, total_tokens: int | None = None, seed: int = 17, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Two tables: the mix (doc_id, source, repetition, tokens) and its report per listed source.

    Each row of the mix is one use of a text for a source. A text is used at most as often
    as the largest max_repeats of the sources it serves, for each source at most its own
    max_repeats times: copies are repetitions of their text, and its uses go to the copies of the wanting
    source in turn (to the lowest doc_id of all where that source has none). total_tokens
    defaults to the largest total for which all sources that have documents get their
    share; their shares are rescaled to sum to 1, listed sources without documents get
    nothing and are reported so. Unlisted and null sources, and null and empty texts, are
    not used. Shares are met up to one document per source and repetition of a pattern. All patterns
    take part in the flow; there are no more than sets of listed sources, or texts.
    """
    spark = documents.sparkSession
    targets = _targets(mix_targets)
    listed = spark.createDataFrame(sorted((s, v[0], v[1]) for s, v in targets.items()), "source string, target_share double, max_repeats int")
    wanted = documents.filter(F.lower(F.trim("source")).isin(sorted(targets)) if targets else F.lit(False))
    counted = materialize(count_tokens(wanted, vocabulary), "tokens")
    # One unit per distinct text: its sources and its lowest document. collect_set is folded map-side and holds listed sources only.
    units = counted.groupBy("h1", "h2").agg(F.array_join(F.array_sort(F.collect_set("source")), "\n").alias("pattern"), F.min("doc_id").alias("first"), F.max("tokens").alias("tokens"))
    units = materialize(units, "units")
    patterns: dict[tuple[str, ...], int] = {}
    slices: list[tuple[str, int]] = []
    for r in units.groupBy("pattern").agg(F.sum("tokens").alias("n"), F.count("*").alias("units")).collect():  # one row a pattern
        if r["n"]:
            patterns[tuple(r["pattern"].split("\n"))] = r["n"]
            slices.append((r["pattern"], -(-r["units"] // SLICE)))
    if not patterns:
        empty = spark.createDataFrame([], "doc_id long, source string, repetition int, tokens long")
        return empty, _report(empty, listed)
    present = {s: v for s, v in targets.items() if any(s in p for p in patterns)}
    whole = sum(v[0] for v in present.values())
    present = {s: (share / whole, repeats) for s, (share, repeats) in present.items()}
    total = largest_total(patterns, present) if total_tokens is None else total_tokens
    amounts = Routing(patterns, present, total).solve().amounts()
    # Each repetition of a pattern is one line of its units in seeded order; the sources take consecutive stretches of it.
    stretches = []
    for p, parts in amounts.items():
        for r in sorted({r for r, _, _ in parts}):
            at = 0
            for _, s, n in sorted(x for x in parts if x[0] == r):
                stretches.append(("\n".join(p), r, s, at, at + n))
                at += n
    stretches = spark.createDataFrame(stretches, "pattern string, repetition int, wanted_by string, begins long, ends long")
    sliced = F.broadcast(spark.createDataFrame(slices, "pattern string, slices long"))  # one row a pattern
    draw = F.xxhash64("h1", "h2", F.lit(seed))
    seeded = units.join(sliced, "pattern").withColumn("draw", draw).withColumn("slice", F.pmod("draw", F.col("slices"))).drop("slices")
    sums = seeded.groupBy("pattern", "slice").agg(F.sum("tokens").alias("n"))  # a row for each SLICE units
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pattern").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = seeded.join(sums.select("pattern", "slice", before.alias("base")), ["pattern", "slice"])
    inside = F.sum("tokens").over(Window.partitionBy("pattern", "slice").orderBy("draw", "first").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("at", F.col("base") + F.coalesce(inside, F.lit(0)))
    middle = F.col("at") + F.col("tokens") / 2
    chosen = placed.join(F.broadcast(stretches), "pattern").filter((middle >= F.col("begins")) & (middle < F.col("ends")))  # patterns x repetitions x sources rows
    chosen = chosen.select("h1", "h2", "first", F.col("wanted_by").alias("source"), "repetition", "tokens")
    # The uses of a text go in turn to the copies that the wanting source holds; more copies than uses are not needed.
    most = max(repeats for _, repeats in targets.values())
    turn = Window.partitionBy("h1", "h2", "source").orderBy("doc_id")
    own = counted.select("h1", "h2", "source", "doc_id").withColumn("r", F.row_number().over(turn)).filter(F.col("r") <= most)
    own = own.groupBy("h1", "h2", "source").agg(F.array_sort(F.collect_list("doc_id")).alias("copies"))
    mine = F.element_at("copies", F.pmod(F.col("repetition") - 1, F.size("copies")).cast("int") + 1)
    mixed = chosen.join(own, ["h1", "h2", "source"], "left").select(F.coalesce(F.when(F.col("copies").isNotNull(), mine), "first").alias("doc_id"), "source", "repetition", "tokens")
    mixed = materialize(mixed, "mix")
    return mixed, _report(mixed, listed)


def _report(mixed: DataFrame, listed: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, documents, uses, tokens, actual_share for every listed source."""
    per = mixed.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    whole = mixed.agg(F.sum("tokens").alias("whole"))
    joined = listed.join(per, "source", "left").join(F.broadcast(whole))  # one row
    share = F.coalesce(F.col("tokens") / F.when(F.col("whole") > 0, F.col("whole")), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("source", "target_share", "max_repeats", zero("documents"), zero("uses"), zero("tokens"), F.round(share, 6).alias("actual_share"))
