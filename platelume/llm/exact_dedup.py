"""Exact deduplication by content sort, in DataFrame functions alone.

Sampled splitters range-partition the normalised bytes (a bounded head of them stands for the whole in the splitters, so
that what is sampled stays small; the digest breaks ties of heads). Each partition is sorted externally by the
text itself, which puts equals next to each other, and the window over the sorted rows tells where a run of equals ends by comparing each
whole text with its neighbour's.

A text that holds more than 1/SPREAD of all rows would fill one sort partition. Such texts (SPREAD at most)
are found by a pre-aggregated count of digests. Their rows are written once with a salt by id and row number, so that rows alike in everything
are dealt out as well; the first rows of the salted runs, at most 2 * SPREAD of them, go through the same sort once more, and their result
returns by broadcast.

Defined cases: null text counts as empty and so equals ''. A null doc_id sorts last: it stays only if no row of
its text has an id. Of rows with the same text and doc_id one, whichever comes first, stays. No rows give no rows. Extra
columns of any name pass through; one named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import keep
from .common import numbered

#: A text with more than 1/SPREAD of the rows, and more than FEW of them, is salted.
SPREAD, FEW = 2000, 64
#: Characters of the text that go into the splitters.
HEAD = 24
OUT = ("keep_id", "group_size", "kept", "text_sha256")
#: What rows are dealt by, and what the rows of one run have in common.
SPLIT, SAME = ("head", "text_sha256"), ("head", "text", "text_sha256")


def _runs(df: DataFrame, order: list[Column], *more: str, size: Column, best: Column) -> DataFrame:
    """df range-partitioned, sorted by text, with each run's keep_id and group_size, and each row's place nth in its run."""
    place = Window.partitionBy(*SAME, *more).orderBy(*order)
    run = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.repartitionByRange(*SPLIT, *more).withColumns({"keep_id": best.over(run), "group_size": size.over(run), "nth": F.row_number().over(place)})


def _sorted_runs(docs: DataFrame, normalise: Callable[[Column], Column] | None, largest: bool, bid: str, text: Column) -> DataFrame:
    """docs (c0, c1, ..) with OUT."""
    text = F.coalesce(text, F.lit(""))
    rows = docs.withColumn("text", normalise(text) if normalise else text)
    rows = rows.withColumns({"head": F.substring("text", 1, HEAD), "text_sha256": F.sha2("text", 256)})
    by = lambda c: F.col(c).desc_nulls_last() if largest else F.col(c).asc_nulls_last()
    done = [*docs.columns, "keep_id", "group_size", (F.col("nth") == 1).alias("kept"), "text_sha256"]
    share = max(FEW, docs.count() // SPREAD)
    often = rows.groupBy("text_sha256").count().filter(F.col("count") > share).collect()  # SPREAD rows at most
    one = {"size": F.count("*"), "best": F.first(bid)}
    if not often:
        return _runs(rows, [by(bid)], **one).select(*done)

    salts = F.broadcast(docs.sparkSession.createDataFrame([(r[0], r[1] // share + 1) for r in often], "text_sha256 string, salts int"))
    cold = _runs(rows.join(salts, "text_sha256", "left_anti"), [by(bid)], **one).select(*done)
    salt = F.pmod(F.xxhash64(bid, F.monotonically_increasing_id()), F.col("salts")).cast("int")
    hot = keep(rows.join(salts, "text_sha256").withColumn("salt", salt).drop("salts"), "hot-texts")
    parts = _runs(hot, [by(bid)], "salt", **one)
    # the first row of each salted run, compared in full with the others of its text
    firsts = parts.filter("nth = 1").select(*SAME, "salt", F.col("keep_id").alias("own"), F.col("group_size").alias("rows"))
    whole = _runs(firsts, [by("own"), F.col("salt")], size=F.sum("rows"), best=F.first("own"))
    whole = whole.select("text_sha256", "salt", "keep_id", "group_size", (F.col("nth") == 1).alias("top"))
    again = keep(whole, "hot-runs")
    parts = parts.drop("keep_id", "group_size").join(F.broadcast(again), ["text_sha256", "salt"])
    return cold.unionByName(parts.withColumn("kept", (F.col("nth") == 1) & F.col("top")).select(*cold.columns))


def exact_dedup(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, largest: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256. largest: whether the largest id of equal texts stays, or the smallest."""
    plain, number, own = numbered(docs)
    return own(_sorted_runs(plain, normalise, largest, number(id_col), F.col(number(text_col))), OUT)


def drop_copies(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, largest: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text another row keeps; its columns, clashing names too, are those of docs."""
    plain, number, own = numbered(docs)
    return own(_sorted_runs(plain, normalise, largest, number(id_col), F.col(number(text_col))).filter("kept"))
