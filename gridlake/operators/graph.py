"""Dataflow graphs: validation, generations, closures, status reduction."""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import SHORT_LIST, cut, shared_dir


def _stable(df: DataFrame, *columns: str) -> tuple:
    """What tells two tables of the same size apart."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first())


#: Links up to which components are found in one place: they are few megabytes, and rounds of joins would cost more.
FEW = 200_000


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n numbered nodes each one's root, the smallest that links a - b lead to."""
    root = np.arange(n)
    while len(a):  # each round hooks the later root of a link to the earlier one, then every node to its root
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _connected_few(edges: DataFrame) -> DataFrame:
    """connected() of at most FEW links."""
    table = edges.toArrow()
    u, v = (table[c].combine_chunks() for c in ("u", "v"))
    nodes = pc.unique(pa.concat_arrays([u, v]))
    nodes = nodes.take(pc.sort_indices(nodes))
    a, b = (pc.index_in(x, value_set=nodes).to_numpy() for x in (u, v))
    return edges.sparkSession.createDataFrame(pa.table({"node": nodes, "root": nodes.take(pa.array(roots(len(nodes), a, b)))}))


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the smallest node of its connected component.

    Alternates large and small stars: neighbours of a node are hung on the smallest of them, the larger ones first.  Rounds
    are about the logarithm of the longest path; rows never outnumber the links.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.limit(FEW + 1).count() <= FEW:
        return _connected_few(edges)
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.*").where("u <> v").distinct())
        now = _stable(edges, "u", "v")
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Levels:
    """Rows that come level by level, kept in one table in the shared folder, however many levels there are."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.schema = spark, f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}", None

    def add(self, rows: DataFrame) -> DataFrame:
        """The rows as they are stored."""
        part = f"{self.path}/part-{uuid.uuid4().hex}"
        rows.write.parquet(part)
        self.schema = rows.schema
        return self.spark.read.schema(rows.schema).parquet(part)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/*")


def generations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): 0 without predecessors, else one more than the highest of them; nodes of cycles, and those behind
    them, have null.

    Only the frontier moves: a node whose last predecessor has got its level is next.  What a level reaches is counted and
    taken off the open predecessors, so that every edge is looked at once; levels are one table.
    """
    spark = nodes.sparkSession
    edges = cut(edges.select("source", "target").distinct())
    all_nodes = cut(nodes.select("node").distinct())
    degree = edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("open"))
    waiting = cut(all_nodes.join(degree, "node", "left").select("node", F.coalesce("open", F.lit(0)).alias("open")))
    levels = Levels(spark)
    frontier = levels.add(waiting.where("open = 0").select("node", F.lit(0).alias("level")))
    waiting = cut(waiting.where("open > 0"))
    for level in itertools.count(1):
        if frontier.isEmpty():
            break
        met = edges.join(frontier.select(F.col("node").alias("source")), "source", "left_semi").groupBy(F.col("target").alias("node")).agg(F.count("*").alias("met"))
        waiting = cut(waiting.join(met, "node", "left").select("node", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")))
        frontier = levels.add(waiting.where("open = 0").select("node", F.lit(level).alias("level")))
        waiting = waiting.where("open > 0")
    done = levels.all()
    return all_nodes.join(done, "node", "left").select("node", "level")


def _merged(df: DataFrame, **names: str) -> DataFrame:
    """df with the given columns (new name = old), marked to be merged in a join: a loop's broadcasts would all pass the driver."""
    return df.select(*(F.col(old).alias(new) for new, old in names.items())).hint("merge")


def _between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends are both in nodes."""
    return edges.join(_merged(nodes, source="node"), "source", "left_semi").join(_merged(nodes, target="node"), "target", "left_semi")


def _trimmed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those that lead from or to no cycle: what has no predecessor or no successor goes, again and
    again."""
    n = nodes.count()
    while True:
        inner = cut(nodes.join(_merged(edges, node="target"), "node", "left_semi").join(_merged(edges, node="source"), "node", "left_semi"))
        last, n = n, inner.count()
        if n == last:
            return inner, edges
        nodes = inner
        edges = cut(_between(edges, nodes))


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G1: (node, cycle): the nodes of each cycle, that is of each strongly connected component with an edge inside; cycle is
    its smallest node.

    After trimming, every node takes the smallest node that reaches it as its colour; a node from which its colour can be
    reached, through nodes of that colour, is in a component with it.  Those go, and the rest is coloured anew, all colours at once.
    """
    spark = nodes.sparkSession
    nodes, edges = cut(nodes.select("node").distinct()), cut(edges.select("source", "target").distinct())
    own = edges.where("source = target").select(F.col("source").alias("node"))
    edges = edges.where("source <> target")
    found = Levels(spark)
    found.add(nodes.limit(0).select("node", F.col("node").alias("cycle")))
    alone = nodes.join(own.hint("merge"), "node", "left_semi")
    nodes, edges = _trimmed(nodes, edges)
    while not nodes.isEmpty():
        colour = nodes.select("node", F.col("node").alias("colour"))
        last = None
        while True:  # forward: the smallest node that reaches each
            sent = edges.join(_merged(colour, source="node", colour="colour"), "source").select(F.col("target").alias("node"), "colour")
            colour = cut(colour.unionByName(sent).groupBy("node").agg(F.min("colour").alias("colour")))
            now = _stable(colour, "node", "colour")
            if now == last:
                break
            last = now
        inside = edges.join(_merged(colour, source="node", c="colour"), "source").join(_merged(colour, target="node", colour="colour"), "target").where("c = colour").select("source", "target")
        back = descendants(colour.where("node = colour").select("node"), inside.select(F.col("target").alias("source"), F.col("source").alias("target"))).hint("merge")
        found.add(colour.join(back, "node", "left_semi").select("node", F.col("colour").alias("cycle")))
        nodes = cut(nodes.join(back, "node", "left_anti"))
        edges = cut(_between(edges, nodes))
        nodes, edges = _trimmed(nodes, edges)
    out = found.all()
    return out.unionByName(alone.join(_merged(out, node="node"), "node", "left_anti").select("node", F.col("node").alias("cycle")))


def has_cycle(nodes: DataFrame, edges: DataFrame) -> bool:
    """G1: whether some node is on a cycle."""
    return not _trimmed(nodes.select("node").distinct(), edges.select("source", "target").distinct())[0].isEmpty()


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G1: (problem, item): ids that occur twice, and edges whose ends are no nodes."""
    twice = nodes.groupBy("node").count().where("count > 1").select(F.lit("duplicate_node").alias("problem"), F.col("node").cast("string").alias("item"))
    ends = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    lost = ends.join(nodes, "node", "left_anti").select(F.lit("unknown_node").alias("problem"), F.col("node").cast("string").alias("item"))
    return twice.unionByName(lost)


def edge_problems(edges: DataFrame, ports: DataFrame) -> DataFrame:
    """G1: (problem, item) of edges (edge_id, source, target, output, input, branch) and ports (node, side in/out, port).

    duplicate_edge: an id that occurs twice; self_edge: an edge from a node to itself; unknown_output, unknown_input: a port
    that the node does not have; input_conflict (node:input): several edges come to one input and are not the branches of one
    source, each with a branch of its own.
    """
    text = lambda c: F.col(c).cast("string")
    named = lambda problem, df, item: df.select(F.lit(problem).alias("problem"), item.alias("item"))
    twice = named("duplicate_edge", edges.groupBy("edge_id").count().where("count > 1"), text("edge_id"))
    self_edges = named("self_edge", edges.where("source = target"), text("edge_id"))

    def unknown(end: str, port: str, side: str) -> DataFrame:
        has = ports.where(F.col("side") == side).select(F.col("node").alias(end), F.col("port").alias(port))
        return named(f"unknown_{port}", edges.join(has, [end, port], "left_anti"), text("edge_id"))

    groups = edges.groupBy("target", "input").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct("branch").alias("branches"))
    conflicts = named("input_conflict", groups.where("n > 1 AND (sources > 1 OR branches < n)"), F.concat(text("target"), F.lit(":"), F.col("input")))
    out = twice
    for part in (self_edges, unknown("source", "output", "out"), unknown("target", "input", "in"), conflicts):
        out = out.unionByName(part)
    return out


def descendants(start: DataFrame, edges: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """Nodes reachable from start, itself included; nodes of stop are neither returned nor passed."""
    seen = start.select("node").distinct()
    if stop is not None:
        edges = edges.join(stop.select(F.col("node").alias("target")), "target", "left_anti")
        seen = seen.join(stop.select("node"), "node", "left_anti")
    levels = Levels(start.sparkSession)
    fresh = levels.add(seen)
    edges = cut(edges.select("source", "target").distinct())
    while n := fresh.limit(SHORT_LIST + 1).count():
        few = n <= SHORT_LIST
        fresh = edges.join(fresh.withColumnRenamed("node", "source").hint("broadcast" if few else "merge"), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        fresh = levels.add(fresh.join(_merged(levels.all(), node="node"), "node", "left_anti"))
    return levels.all()


def reduced_status(log: DataFrame, key: str = "run_id", status: str = "status") -> DataFrame:
    """Failed if any node failed, running if any runs, succeeded if all did (or were skipped), else pending."""
    s = F.col(status)
    out = F.when(F.bool_or(s == "failed"), "failed").when(F.bool_or(s == "running"), "running").when(F.bool_and(s.isin("succeeded", "skipped")), "succeeded").otherwise("pending")
    return log.groupBy(key).agg(out.alias("status"), F.count("*").alias("n_nodes"))


def active_inputs(edges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(node, n_inputs, skip_reason) from edges (source, target, branch) and outcomes (node, status, branch).

    An edge is active if its source succeeded and took the edge's branch (null: any).  A node without an active edge is
    skipped: because a source failed, or because its branch was not taken.
    """
    o = outcomes.select(F.col("node").alias("source"), "status", F.col("branch").alias("taken"))
    joined = edges.join(o, "source", "left")
    active = (F.col("status") == "succeeded") & (F.col("branch").isNull() | F.col("branch").eqNullSafe(F.col("taken")))
    out = joined.groupBy(F.col("target").alias("node")).agg(F.count_if(active).alias("n_inputs"), F.bool_or(F.coalesce(F.col("status"), F.lit("")) == "failed").alias("failed"))
    return out.select("node", "n_inputs", F.when(F.col("n_inputs") > 0, None).when(F.col("failed"), "upstream_failed").otherwise("branch_not_taken").alias("skip_reason"))


def task_plan(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node with its predecessors in order."""
    up = edges.groupBy(F.col("target").alias("node")).agg(F.array_sort(F.collect_set("source")).alias("upstream"))
    return nodes.join(up, "node", "left").select("node", F.coalesce("upstream", F.array().cast("array<long>")).alias("upstream"))
