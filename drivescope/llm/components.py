"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivescope.operators.staging import materialize


def _star(pairs: DataFrame, keep_all: bool) -> DataFrame:
    """Links each node's greater neighbours (all, itself included, unless ``keep_all``) to the least of them; ``u > v`` in every row.

    The least neighbour is an aggregate joined back, so a hub's neighbours are never gathered.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = pairs.join(least, "u")
    if keep_all:
        return moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.select("v", "u", "m").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (its least member) for all nodes of ``edges`` (``u, v``); any type that has an order.

    Tables of each round are written to the shared folder. Ends when a round changes nothing.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True).where("u > v").distinct()
        now = materialize(_star(large, False).where("u > v").distinct(), "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
