"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import cut, release

#: A node with this share of all edge ends is a hub; there are at most so many of them.
HUBS = 1000
#: Edges of a partition, where fewer partitions will do; edge ends from which hubs are sent along.
EDGES, SPREAD = 50_000, 1_000_000


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hash of an edge set: equal marks mean that an iteration changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """edges (a, b) beside the m of least (a, m, n), where n is how many of the ends a has.

    Nodes with 1/HUBS of the ends or more, at most HUBS of them, are sent to all tasks, so their
    edges stay where they are; no other node has enough to make a partition large. Few edges are
    simply joined.
    """
    if ends < SPREAD:
        return edges.join(least.select("a", "m"), "a")
    hubs = F.broadcast(least.filter(F.col("n") >= max(2, -(-ends // HUBS))).select("a", F.col("m").alias("hub")))
    known = edges.join(hubs, "a", "left")
    rest = known.filter("hub is null").drop("hub").join(least.select("a", "m"), "a")
    return rest.unionByName(known.filter("hub is not null").withColumnRenamed("hub", "m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long edges to (node, root): root is the smallest node of the component.

    Each round is two star steps whose groups are reduced by partial minima, and a hub's edges
    are never gathered. Self loops, repeated edges and null ends are ignored; an empty edge table
    gives an empty result. The number of rounds is logarithmic in the longest chain.
    """
    spark = edges.sparkSession
    current = cut(
        edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = _mark(current)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        # edges never grow in number, so from here on a few partitions hold what is few
        ends, few = 2 * mark[0], -(-mark[0] // EDGES)
        # each step is a job of its own, and names its input once, which keeps plans small
        both = current.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = cut(_with_least(both, least, ends).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(few))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        met = _with_least(large, least, ends)
        ends_of = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = met.select(F.explode(ends_of).alias("e")).select("e.a", "e.b").filter("a != b").distinct()
        current = cut(small.coalesce(few))
        before, mark = mark, _mark(current)
        del both, least, large, met, small
        release(spark)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def merge(components: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) components after more links (a, b); a node that is in neither is its own root.

    Only the roots that the links touch are joined up again.
    """
    root = components.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    moved = links.join(root, "a", "left").withColumn("ra", F.coalesce("ra", "a")).join(root.toDF("b", "rb"), "b", "left").withColumn("rb", F.coalesce("rb", "b"))
    joined = connected_components(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("now"))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(components, "node", "left_anti").withColumn("root", F.col("node"))
    return cut(components.unionByName(ends).join(joined, "root", "left").select("node", F.coalesce("now", "root").alias("root")))
