"""Connected components over an edge table, by alternating star contraction.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014):
the large-star step links every larger neighbour of a node to the smallest
node it knows; the small-star step does so for the smaller neighbours.  Each
round is two aggregates and joins; no node's neighbours are ever collected, and
the number of rounds grows with the logarithm of the longest path.  Least
neighbours are found by partial aggregates, and the joins that carry a hub's
neighbours are ones whose large partitions Spark splits, so a hub is no one
task's work.  Each round's table replaces the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import Tables


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable.

    Self loops, repeated edges and null ends are ignored.  No edges: no rows.
    """
    tables = Tables(edges.sparkSession, "components")
    now = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    now = tables.write(now.where("u <> v").distinct())
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        # large star: u's larger neighbours go to the smallest node in u's neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = tables.write(small.select("e.u", "e.v").where("u <> v").distinct())
        new = _state(after)
        tables.drop(now)
        now = after
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
