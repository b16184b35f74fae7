"""Connected components for region graphs by alternating stars: every round is two grouped joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.session import Scratch


def components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, root): each node on an edge with the smallest node of its component.

    Rounds link larger neighbours to the smallest one and then smaller ones among themselves, until
    every edge points at a root. Minima are aggregated map-side, so a hub fills no task. Null ends and
    loops link nothing; no edges give no rows.
    """
    scratch = scratch or Scratch(edges.sparkSession, "graph")
    e = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = scratch.save(e, "edges")
    last = None
    while True:
        # large star: for each node, link its larger neighbours to the smallest of its neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: for each node, link its smaller neighbours and itself to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v").distinct()
        new = scratch.save(small.select("u", "v"), "edges")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = new
        if mark == last:
            break
        last = mark
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def touch_edges(nodes: DataFrame, by: list[str], key: str, step: str, x: str, y: str, most_step: int, most_distance: float) -> DataFrame:
    """(a, b): edges with the components of ``joins.range_edges``, but few of them where nodes are dense.

    Cells are so small that all nodes of one cell and step touch: each is linked to the cell's smallest
    node only. Two cells whose nodes touch are linked once, by their smallest nodes. A dense group
    shuffles an edge a node and an edge a pair of cells, and not all its pairs. Nodes meet in blocks of
    four distances and eight steps, each being sent only to the blocks it reaches, fewer than three on average.
    """
    n = nodes.where(F.col(key).isNotNull() & F.col(step).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    steps = 8 * max(1, most_step)
    side, block, far = most_distance / 2**0.5 * (1 - 1e-9), 4 * most_distance, most_distance * (1 + 1e-9)
    at = lambda c, width: F.floor(c / width).cast("int")
    n = n.select(*by, F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(step).cast("long").alias("s"))
    cell = [*by, "s", at(F.col("x"), side), at(F.col("y"), side)]
    n = n.withColumn("head", F.min("k").over(Window.partitionBy(*cell)))
    star = n.where("k <> head").select(F.col("head").alias("a"), F.col("k").alias("b"))
    reach = lambda c: F.explode(F.sequence(at(F.col(c) - far, block), at(F.col(c) + far, block)))
    left = n.select(*by, F.col("k").alias("ak"), F.col("head").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("s").alias("as_"), F.explode(F.sequence(at(F.col("s"), steps), at(F.col("s") + most_step, steps))).alias("bs"))
    left = left.withColumn("bx", reach("ax")).withColumn("by_", reach("ay"))
    right = n.select(*by, "s", at(F.col("s"), steps).alias("bs"), at(F.col("x"), block).alias("bx"), at(F.col("y"), block).alias("by_"), "k", F.col("head").alias("b"), "x", "y")
    near = (F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2 <= most_distance**2
    near &= F.col("s").between(F.col("as_"), F.col("as_") + most_step)
    once = (F.col("as_") < F.col("s")) | (F.col("ak") < F.col("k"))
    return star.unionByName(left.join(right, [*by, "bs", "bx", "by_"]).where(near & once & (F.col("a") != F.col("b"))).select("a", "b").distinct())
