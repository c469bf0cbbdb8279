"""The code graph: folding its event log and answering structural questions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.config import DEFAULTS
from sextant.session import materialize


# ---------------------------------------------------------------- folding the log
def fold_nodes(events: DataFrame) -> DataFrame:
    """nodes (id, label, tags, signature, javadoc) of the event log.

    Label, signature and javadoc are those of the last N event, nulls too; tags are the
    union of the tags of all N events and of the T events after the node's first N event.
    Ids that only edges name have no node. Tag sets are folded map-side, so a hot id does
    not gather its events.
    """
    e = events.filter(F.col("kind").isin("N", "T") & F.col("id").isNotNull() & F.col("seq").isNotNull())
    is_node = F.col("kind") == "N"
    last = F.max(F.when(is_node, F.struct("seq", "label", "signature", "javadoc")))
    first = F.min(F.when(is_node, F.col("seq")))
    heads = e.groupBy("id").agg(last.alias("last"), first.alias("first")).filter("last is not null")
    tags = e.select("id", F.explode(F.when(is_node, F.coalesce("tags", F.array().cast("array<string>"))).otherwise(F.array("tag"))).alias("tag"), F.when(is_node, F.lit(None)).otherwise(F.col("seq")).alias("at"))
    # of a tag only its latest T event matters, and whether an N event carries it
    seen = tags.filter("tag is not null").groupBy("id", "tag").agg(F.max("at").alias("at"), F.max(F.col("at").isNull()).alias("own"))
    kept = seen.join(heads.select("id", "first"), "id").filter(F.col("own") | (F.col("at") > F.col("first")))
    sets = kept.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    empty = F.array().cast("array<string>")
    return heads.join(sets, "id", "left").select("id", "last.label", F.coalesce("tags", empty).alias("tags"), "last.signature", "last.javadoc")


def fold_edges(events: DataFrame, distinct: bool = False) -> DataFrame:
    """edges (src, dst, type, seq): a multiset in log order, or the first of each (src, dst, type)."""
    e = events.filter("kind = 'E' and src is not null and dst is not null").select("src", "dst", F.col("edge_type").alias("type"), "seq")
    return e.groupBy("src", "dst", "type").agg(F.min("seq").alias("seq")) if distinct else e


def by_tag(nodes: DataFrame, tag: str) -> DataFrame:
    return nodes.filter(F.array_contains("tags", tag))


def edges_of(edges: DataFrame, id_: str, outgoing: bool, type_: str | None = None) -> DataFrame:
    found = edges.filter(F.col("src" if outgoing else "dst") == id_)
    return found if type_ is None else found.filter(F.col("type") == type_)


# ---------------------------------------------------------------- traversal
def _signature(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """ids with the node's signature, the id itself where there is none."""
    return ids.join(nodes.select("id", "signature"), "id", "left").withColumn("signature", F.coalesce("signature", "id"))


def bfs(steps: DataFrame, seeds: list[str], depth: int) -> DataFrame:
    """id, depth, seq of what is reached from the seeds over steps (a, b, seq) in at most depth hops, seeds left out.

    Every hop is one join of the frontier, reduced to distinct new ids; frontiers are
    written to the shared folder, so plans stay short and survive lost executors.
    """
    spark = steps.sparkSession
    frontier = spark.createDataFrame([(s,) for s in dict.fromkeys(seeds)], "id string")
    visited = frontier
    levels: list[DataFrame] = []
    for hop in range(1, depth + 1):
        reached = steps.join(frontier.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("seq").alias("seq"))
        fresh = reached.join(visited, "id", "left_anti").withColumn("depth", F.lit(hop))
        if hop < depth:
            fresh = materialize(fresh, "frontier")
            if not fresh.take(1):
                break
        levels.append(fresh.select("id", "depth", "seq"))
        frontier = fresh.select("id")
        visited = visited.unionByName(frontier)
    if not levels:
        return spark.createDataFrame([], "id string, depth int, seq long")
    return reduce(DataFrame.unionByName, levels)


def callers(nodes: DataFrame, edges: DataFrame, fqn: str, depth: int = 1) -> DataFrame:
    """id, signature, depth, seq of the methods that call fqn, level by level; depth 0 gives none."""
    steps = edges.filter("type = 'CALLS'").select(F.col("dst").alias("a"), F.col("src").alias("b"), "seq")
    return _signature(nodes, bfs(steps, [fqn], depth))


def callees(nodes: DataFrame, edges: DataFrame, fqn: str, depth: int = 1) -> DataFrame:
    steps = edges.filter("type = 'CALLS'").select(F.col("src").alias("a"), F.col("dst").alias("b"), "seq")
    return _signature(nodes, bfs(steps, [fqn], depth))


def symbol_view(nodes: DataFrame, edges: DataFrame, fqn: str) -> DataFrame:
    """One row: fqn, signature, javadoc (null if unknown) and the direct callers and callees."""
    own = edges.sparkSession.createDataFrame([(fqn,)], "fqn string")
    node = nodes.filter(F.col("id") == fqn).select("signature", "javadoc", F.col("id").alias("fqn"))
    listed = lambda df, name: df.agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "id", "signature"))), lambda x: x["signature"]).alias(name))
    sides = listed(callers(nodes, edges, fqn), "callers").withColumn("fqn", F.lit(fqn)).join(listed(callees(nodes, edges, fqn), "callees").withColumn("fqn", F.lit(fqn)), "fqn")
    return own.join(node, "fqn", "left").join(sides, "fqn", "left").select("fqn", "signature", "javadoc", "callers", "callees")


def expand(nodes: DataFrame, edges: DataFrame, seeds: Iterable[str], hops: int, most: int | None = None) -> DataFrame:
    """id, signature, depth of the neighbourhood over edges of all types in both directions, seeds left out, the first most of it."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "seq").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "seq"))
    found = bfs(both, list(seeds), hops)
    if most is not None:
        found = found.orderBy("depth", "seq", "id").limit(most)
    return _signature(nodes, found).select("id", "signature", "depth")


def expand_seeds(seeds: str, most: int = 0) -> tuple[list[str], int]:
    """Comma-separated seeds, and the number of results: 0 stands for the default, never over the cap."""
    wanted = [s.strip() for s in seeds.split(",") if s.strip()]
    return wanted, min(most if most > 0 else DEFAULTS.expand_default, DEFAULTS.expand_cap)


def topic_flow(nodes: DataFrame, edges: DataFrame, topic: str) -> DataFrame:
    """role, signature, seq: sources of PRODUCES and CONSUMES edges into a topic, repeated edges kept."""
    into = edges.filter((F.col("dst") == topic) & F.col("type").isin("PRODUCES", "CONSUMES"))
    role = F.when(F.col("type") == "PRODUCES", "producer").otherwise("consumer").alias("role")
    return _signature(nodes, into.select(F.col("src").alias("id"), role, "seq")).select("role", "signature", "seq")


def endpoint_id(method: str, path: str) -> str:
    return f"{method.upper()} {path if path.startswith('/') else '/' + path}"


def endpoint(nodes: DataFrame, edges: DataFrame, method: str, path: str) -> DataFrame:
    """method, path, operation_id, handler of an endpoint: the node's javadoc slot and its first EXPOSES source."""
    id_ = endpoint_id(method, path)
    verb, _, where = id_.partition(" ")
    handler = edges.filter((F.col("dst") == id_) & (F.col("type") == "EXPOSES")).groupBy("dst").agg(F.min_by("src", "seq").alias("handler"))
    node = nodes.filter(F.col("id") == id_)
    return node.join(handler, node["id"] == handler["dst"], "left").select(F.lit(verb).alias("method"), F.lit(where).alias("path"), F.col("javadoc").alias("operation_id"), "handler")


def endpoint_keys(nodes: DataFrame, edges: DataFrame, repo: str | None = None) -> DataFrame:
    """Ids of endpoints (of a repo) that some EXPOSES edge reaches."""
    found = by_tag(nodes, "ENDPOINT") if repo is None else by_tag(by_tag(nodes, "ENDPOINT"), f"REPO:{repo}")
    exposed = edges.filter("type = 'EXPOSES'").select(F.col("dst").alias("id"))
    return found.select("id").join(exposed, "id", "left_semi")


def spec_vs_impl(specified: DataFrame, implemented: DataFrame) -> DataFrame:
    """key, state (unimplemented, undocumented, matched) for a column id of both sides; nulls are left out, copies count once."""
    spec = specified.filter("id is not null").select("id").distinct().withColumn("s", F.lit(1))
    impl = implemented.filter("id is not null").select("id").distinct().withColumn("i", F.lit(1))
    state = F.when(F.col("i").isNull(), "unimplemented").when(F.col("s").isNull(), "undocumented").otherwise("matched")
    return spec.join(impl, "id", "full").select(F.col("id").alias("key"), state.alias("state"))


# ---------------------------------------------------------------- component dependencies
def _suffix_names(beans: DataFrame) -> DataFrame:
    """Every name a bean answers to: its id and what follows each of its dots. Dependencies then resolve by equality."""
    parts = F.split("id", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    return beans.select("id", F.explode(names).alias("name"))


def bean_root(nodes: DataFrame, name: str) -> DataFrame:
    """The bean a name means: equal, then a suffix after a dot, then contained; ties by id."""
    rank = F.when(F.col("id") == name, 0).when(F.endswith("id", F.lit("." + name)), 1).when(F.contains("id", F.lit(name)), 2)
    return by_tag(nodes, "BEAN").withColumn("r", rank).filter("r is not null").orderBy("r", "id").limit(1).select("id")


def bean_graph(nodes: DataFrame, edges: DataFrame, name: str, depth: int) -> DataFrame:
    """root, fqn, signature, depth of what a bean depends on, targets resolved to bean ids where they name one."""
    root = bean_root(nodes, name).first()
    if root is None:
        return nodes.sparkSession.createDataFrame([], "root string, fqn string, signature string, depth int")
    depends = edges.filter("type = 'DEPENDS_ON'").select("src", "dst", "seq")
    resolved_names = _suffix_names(by_tag(nodes, "BEAN")).groupBy("name").agg(F.min("id").alias("bean"))
    known = nodes.select(F.col("id").alias("dst"), F.lit(1).alias("known"))
    target = F.when(F.col("known").isNotNull(), F.col("dst")).otherwise(F.coalesce("bean", "dst"))
    steps = depends.join(known, "dst", "left").join(resolved_names, F.col("dst") == F.col("name"), "left").select(F.col("src").alias("a"), target.alias("b"), "seq")
    found = _signature(nodes, bfs(materialize(steps, "steps"), [root["id"]], depth))  # names are resolved once, not on every hop
    return found.select(F.lit(root["id"]).alias("root"), F.col("id").alias("fqn"), "signature", "depth")
