"""Connected components of a link table, by randomised contraction.

Each round every node points to the neighbour (or itself) of least hashed rank; links are rewritten to
those parents, loops and repeats go. Hashed ranks, drawn anew each round, shrink paths as well as cliques, so the
number of rounds grows with the logarithm of the nodes. Rounds are written to the shared folder, which cuts lineage.
The minima are combined map-side, so a hub costs one row per task, and no link ever reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); nodes of one component share a root. Loops are ignored."""
    spark = links.sparkSession
    edges = scratch.put(f"{tag}-e0", links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps, rnd = [], 0
    while not edges.isEmpty():
        if rnd >= max_rounds:
            raise RuntimeError("components did not converge")
        both = edges.union(edges.select("b", "a"))
        rank = lambda c, r=rnd: F.struct(F.xxhash64(F.col(c), F.lit(r)).alias("h"), F.col(c).alias("v"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m"))
        parent = scratch.put(f"{tag}-p{rnd}", parent.select("node", F.when(F.col("m") < rank("node"), F.col("m.v")).otherwise(F.col("node")).alias("root")))
        pa, pb = parent.toDF("a", "ra"), parent.toDF("b", "rb")
        moved = edges.join(pa, "a").join(pb, "b").where("ra <> rb")
        moved = moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        maps.append(parent)
        nxt = scratch.put(f"{tag}-e{rnd + 1}", moved)
        scratch.drop(f"{tag}-e{rnd}")
        edges, rnd = nxt, rnd + 1
    if not maps:
        return spark.createDataFrame([], "node bigint, root bigint")
    out = maps[0]
    for k, m in enumerate(maps[1:], 1):
        out = out.join(m.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        if k % 6 == 0:
            out = scratch.put(f"{tag}-m{k}", out)
    return scratch.put(f"{tag}-out", out)
