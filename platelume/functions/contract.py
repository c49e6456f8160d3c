"""Connected components of an edge table by alternating star contraction (Kiveris et al. 2014), and joins that bear hub keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, keep

#: A key with more than 1/HOT_SHARE of all rows is joined by broadcast of its (single) right row; fewer than HOT_SHARE keys can be that frequent.
HOT_SHARE = 500
#: Keys with up to this many rows are never hot.
FEW = 1000


def hot_keys(df: DataFrame, key: str) -> DataFrame | None:
    """Keys that hold over 1/HOT_SHARE of df's rows, HOT_SHARE of them at most; None without any."""
    total = df.count()
    if total <= FEW:
        return None
    often = df.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > max(FEW, total // HOT_SHARE)).select(key)
    rows = often.collect()
    return df.sparkSession.createDataFrame(rows, often.schema) if rows else None


def join_by(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Left join on a key that is unique in right; rows of the hot keys meet their few right rows by broadcast, where they are."""
    if hot is None:
        return left.join(right, key, "left")
    few = right.join(F.broadcast(hot), key, "left_semi")  # a row a hot key at most
    cold = left.join(F.broadcast(hot), key, "left_anti").join(right, key, "left")
    return cold.unionByName(left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, "left"))


def _next_to(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each (u, v) with u's least neighbour m."""
    return join_by(edges, least, "u", hot_keys(edges, "u"))


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """edges (a, b) -> (node, root) for each node that has an edge to another; root is the least node of its component.

    Every round is written to the shared folder and the one before removed. Rounds grow with the logarithm of the longest path.
    """
    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    for _ in range(limit):
        # large star: u's larger neighbours go to the least node next to u
        both = keep(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "star")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = keep(_next_to(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        drop(now, both)
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _next_to(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = keep(small.filter("u <> v").distinct(), "small")
        drop(large)
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
    raise RuntimeError(f"components did not settle in {limit} rounds")
