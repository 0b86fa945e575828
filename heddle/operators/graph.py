"""Graphs as edge tables (src, dst): degrees, PageRank, components, contraction, relabelling.

Loops cut their lineage with checkpoint() in the folder that the session names in
spark.checkpoint.dir; where none is named and all runs in one process, one is made.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rounds of a loop between checkpoints.
EVERY = 3


def _kept(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="heddle-graph-"))
    return df.checkpoint()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def out_degree(edges: DataFrame, nodes: DataFrame | None = None, smooth: int = 0) -> DataFrame:
    """id, degree. With nodes, those without edges have `smooth`, and the others that much more."""
    found = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    if nodes is None:
        return found.withColumn("degree", F.col("degree") + smooth)
    return nodes.select("id").join(found, "id", "left").select("id", (F.coalesce("degree", F.lit(0)) + smooth).alias("degree"))


def initial_ranks(nodes: DataFrame, damping: float = 0.85, n: int | None = None) -> DataFrame:
    """id, ranking: (1 - damping) / n for each node."""
    return nodes.select("id", F.lit((1 - damping) / (n or nodes.count())).alias("ranking"))


def pagerank(edges: DataFrame, iterations: int = 10, damping: float = 0.85, nodes: DataFrame | None = None) -> DataFrame:
    """id, ranking after a number of rounds: (1 - d)/N + d * what the in-neighbours hand on.
    A node without edges out of it hands nothing on."""
    nodes = nodes_of(edges) if nodes is None else nodes.select("id").distinct()
    nodes = _kept(nodes)
    n = max(1, nodes.count())
    base = (1 - damping) / n
    linked = _kept(edges.join(out_degree(edges).withColumnRenamed("id", "src"), "src").groupBy("src", "dst", "degree").agg(F.count("*").alias("times")))
    ranks = initial_ranks(nodes, damping, n)
    for k in range(1, iterations + 1):
        handed = linked.join(ranks, linked["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("ranking") / F.col("degree") * F.col("times")).alias("got"))
        ranks = nodes.join(handed, nodes["id"] == handed["dst"], "left").select("id", (F.lit(base) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("ranking"))
        if k % EVERY == 0 and k < iterations:
            ranks = _kept(ranks)
    return ranks


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that each node reaches over edges in either direction.

    Each round points every node at the smallest label among its neighbours' and then
    at that label's own label, so that long paths shorten by more than half.
    """
    both = _kept(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).filter("src <> dst").distinct())
    labels = _kept(nodes_of(edges).withColumn("label", F.col("id")))
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["id"] == near["src"], "left").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # what a node learns is told to the node that its label names
        told = step.select(F.col("was").alias("id"), "label").union(step.select("id", "label")).groupBy("id").agg(F.min("label").alias("label"))
        over = told.select(F.col("id").alias("label"), F.col("label").alias("next"))
        after = _kept(told.join(over, "label").select("id", F.col("next").alias("label")))
        moved = after.join(labels.withColumnRenamed("label", "was"), "id").filter("label <> was")
        done = moved.isEmpty()
        labels = after
        if done:
            return labels.select("id", F.col("label").alias("component"))


def largest_component(edges: DataFrame) -> DataFrame:
    """id, component of the largest weakly connected component; of equal ones, that with the smallest id."""
    found = components(edges)
    top = found.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)
    return found.join(F.broadcast(top.select("component")), "component").select("id", "component")


def contract(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """src < dst: the graph after random edges have been contracted until k nodes are left.

    Every round takes each node's edge with the smallest random number; these make a
    forest, so that contracting m of them leaves m nodes fewer. Stops earlier when no
    edge is left. Self-loops are dropped, and edges go from the smaller id.
    """
    orient = lambda df: df.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src <> dst").distinct()
    edges = _kept(orient(edges))
    left = nodes_of(edges).count()
    while left > k and not edges.isEmpty():
        drawn = edges.withColumn("draw", F.struct(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst"))
        ends = drawn.select(F.col("src").alias("id"), "draw").union(drawn.select(F.col("dst").alias("id"), "draw"))
        least = ends.groupBy("id").agg(F.min("draw").alias("draw")).select("draw").distinct()
        some = _kept(least.orderBy("draw").limit(left - k).select("draw.src", "draw.dst"))
        to = components(some)
        named = lambda df, c: df.join(to.select(F.col("id").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")  # noqa: E731,B023
        edges = _kept(orient(named(named(edges, "src"), "dst")))
        left -= some.count()
        seed += 1
    return edges


#: Nodes that one task numbers.
NUMBERED = 1_000_000


def numbered(rows: DataFrame, *order: str | Column, name: str = "label", partitions: int | None = None) -> DataFrame:
    """rows with 0 .. n-1 in an order that tells all rows apart, numbered within ranges and then over them."""
    partitions = partitions or -(-rows.count() // NUMBERED) or 1
    ranged = _kept(rows.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    ahead = sizes.withColumn("ahead", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ranged.withColumn("nth", nth).join(F.broadcast(ahead), "part").select(*rows.columns, (F.coalesce("ahead", F.lit(0)) + F.col("nth")).alias(name))


def relabel(nodes: DataFrame, partitions: int | None = None) -> DataFrame:
    """id, label: 0 .. n-1 by rising id."""
    return numbered(nodes.select("id"), "id", partitions=partitions)
