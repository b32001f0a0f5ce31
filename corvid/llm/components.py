"""Connected components by alternating large and small stars; links stay in tables, never on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> (node, component), the component's smallest node; nodes without an edge have no row.

    Each round costs two shuffles by node; their number grows with the logarithm of the longest chain. Hubs are summed
    before the shuffle and joined by joins that adaptive execution can split. Null ends and loops are ignored.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    down = materialise(down, "links")
    state = _state(down)
    while state[0]:
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = materialise(small.where("a <> b").distinct(), "links")
        discard(down)
        down, (state, was) = new, (_state(new), state)
        if state == was:
            break
    return down.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(down.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
