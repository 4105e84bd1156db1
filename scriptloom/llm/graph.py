"""Connected components by contraction, as DataFrames.

Each round maps every node to the least of itself and its neighbours and replaces the edges
by those between images; rounds are saved to the shared folder, and the maps are composed at
the end.  Rounds take turns between the nodes' own order, which contracts a star to its
least node at once, and a hashed order, under which a chain halves whatever its labels are;
so the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _ranked(column: str, turn: int) -> Column:
    """A node behind what it is compared by in this round."""
    return F.struct((F.xxhash64(F.lit(turn), column) if turn % 2 else F.lit(0).cast("long")).alias("h"), F.col(column).alias("node"))


def components(edges: DataFrame, work: Workspace, label: str) -> DataFrame:
    """node, root: for every node of the undirected edges (a, b), the least of its component.
    Loops, repeated edges and null ends change nothing; no edges give no rows.

    A node with very many edges is aggregated in part before the shuffle, and joins on it
    can be split by Spark."""
    both = edges.where("a <> b").select("a", "b")
    now = work.save(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges-0")
    maps, k = [], 0
    while True:
        least = now.groupBy("a").agg(F.min(_ranked("b", k)).alias("m"))
        step = work.save(least.select("a", F.least(_ranked("a", k), F.col("m"))["node"].alias("image")), f"{label}-map-{k}")
        maps.append(step)
        images = now.join(step, "a").select(F.col("image").alias("x"), F.col("b").alias("a")).join(step, "a").select(F.col("x").alias("a"), F.col("image").alias("b"))
        after = work.save(images.where("a <> b").distinct(), f"{label}-edges-{k + 1}")
        work.drop(f"{label}-edges-{k}")
        now, k = after, k + 1
        if now.isEmpty():
            break
    out = maps[0].select(F.col("a").alias("node"), F.col("image").alias("root"))
    for step in maps[1:]:
        out = out.join(step.select(F.col("a").alias("root"), "image"), "root", "left").select("node", F.coalesce("image", "root").alias("root"))
    out = work.save(out, f"{label}-roots")
    names = out.groupBy("root").agg(F.min("node").alias("least"))
    return work.save(out.join(names, "root").select("node", F.col("least").alias("root")), f"{label}-components")
