"""Sharding by jump consistent hashing (Lamping and Veach 2014): no ring table, and a further shard takes rows only into itself.

Each row's 64-bit key is the XXH64 of its id. Places (slots) in a shard are counted in two steps, so that no task
holds a shard: rows are numbered in CHUNKS parts of each shard, and each part starts where those before it end.

Defined cases: a null id is a key like any other; null text counts as empty; rows with the same id go to the
same shard, to slots of their own; no rows give no rows; extra columns of any name pass through, and one named like an output is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import keep
from .common import numbered

#: Parts of a shard that are numbered apart.
CHUNKS = 512
OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key, all keys at once; a key leaves the loop when its next jump passes the last shard."""
    key = keys.astype(np.uint64)
    out = np.zeros(len(key), np.int32)
    open_, at = np.arange(len(key)), np.zeros(len(key), np.int64)
    while len(open_):
        out[open_] = at
        key = key * np.uint64(2862933555777941757) + np.uint64(1)
        at = ((at + 1) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        stay = at < shards
        open_, at, key = open_[stay], at[stay], key[stay]
    return out


def shard_of(key: Column, shards: int) -> Column:
    if shards < 1:
        raise ValueError("shards must be 1 at least")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards))

    return place(key)


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", chunks: int = CHUNKS, text_stays: bool = True) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (the shard among shards + 1)."""
    plain, number, own = numbered(docs)
    bid, text = F.col(number(id_col)), F.coalesce(F.col(number(text_col)), F.lit(""))
    key = F.xxhash64(bid)
    rows = plain.withColumns({"size": F.octet_length(text).cast("long") + 16, "text_crc32": F.crc32(text), "shard": shard_of(key, shards), "grown_shard": shard_of(key, shards + 1)})
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # written once, so that a row keeps its number; by it, rows alike in everything are spread over a shard's chunks
    rows = keep(rows if text_stays else rows.drop(number(text_col)), "sharded")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(key, "row"), F.lit(chunks)).cast("int"))
    counts = rows.groupBy("shard", "chunk").count()  # shards * chunks rows at most
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy(bid, "size", "text_crc32", "row"))
    placed = rows.withColumn("nth", nth).join(F.broadcast(starts), ["shard", "chunk"])
    placed = placed.withColumns({"slot": F.col("start") + F.col("nth") - 1, "law": F.lit("key")})
    return own(placed, OUT, [] if text_stays else [text_col])
