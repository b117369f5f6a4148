"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations and joins on node keys: minima are combined before the shuffle, and the
least neighbours of hubs (nodes with more than a share of all edges, so there are few) are broadcast to
the hubs' edges instead of bringing these edges to one task. Rounds are cut by tables in the shared
folder, each removed when the next is written. The number of rounds grows with the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from localmarkets.shared import cut_at, remove

#: A hub has more than 2**-HUB_BITS of all edges, and more than HUB_EDGES.
HUB_BITS, HUB_EDGES = 10, 256


def _large_star(now: DataFrame, edges: int) -> tuple[DataFrame, str]:
    """The edges after the step, and the table of least neighbours that they are read from."""
    both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least, path = cut_at(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    many = F.col("n") > max(HUB_EDGES, edges >> HUB_BITS)
    above = both.where("v > u")
    if least.where(many).isEmpty():
        told = above.join(least.select("u", "m"), "u")
    else:
        hubs = F.broadcast(least.where(many).select("u", "m"))  # fewer than 2 * 2**HUB_BITS rows, as each edge is there twice
        told = above.join(hubs, "u").unionByName(above.join(hubs.select("u"), "u", "left_anti").join(least.where(~many).select("u", "m"), "u"))
    return told.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), path


def _small_star(edges: DataFrame) -> DataFrame:
    """After a large star a node has an edge to each other least neighbour of its neighbours, so it is no hub."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (u, v: any ordered type) to (node, component): the smallest node reachable.

    Nodes without an edge to another node don't appear; edges with a null end and loops are ignored.
    """
    now, path = cut_at(edges.select("u", "v").where("u <> v"), "edges")
    told, n = None, now.count()
    for _ in range(rounds):
        large, least = _large_star(now, n)
        past = [path, least]
        now, path = cut_at(_small_star(large), "stars")
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        for old in past:
            remove(edges.sparkSession, old)
        if told == (state.n, state.x):
            break
        told, n = (state.n, state.x), state.n
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
