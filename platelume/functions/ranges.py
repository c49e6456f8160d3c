"""Running sums in parallel: rows in ranges, summed in each and put together by the ranges' own sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import keep


def begins(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Which rows differ from the one before in a key; the first does. Nulls are alike."""
    first = np.zeros(len(batch), bool)
    first[0] = True
    for k in keys:
        col = batch.column(batch.schema.get_field_index(k))
        same = pc.fill_null(pc.equal(col[1:], col[:-1]), False).to_numpy(zero_copy_only=False)
        both = pc.and_(pc.is_null(col[1:]), pc.is_null(col[:-1])).to_numpy(zero_copy_only=False)
        first[1:] |= ~(same | both)
    return first


def ints(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def keys_at(batch: pa.RecordBatch, key: list[str], at: np.ndarray) -> dict[str, pa.Array]:
    return {c: batch.column(batch.schema.get_field_index(c)).take(pa.array(at)) for c in key}


def spans(first: np.ndarray) -> list[tuple[int, int]]:
    """Where each group begins and ends."""
    start = np.flatnonzero(first).tolist()
    return list(zip(start, [*start[1:], len(first)], strict=True))


def grouped(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.RecordBatch, np.ndarray], dict[str, pa.Array | np.ndarray]], schema: str) -> DataFrame:
    """The columns of schema that work(batch, first) makes of many whole groups at once, sorted by keys and order; first tells where a group begins.

    As a call for each group costs more than a small group's work, what a batch holds of groups is worked on together.
    """
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.concat_batches(parts)
            made = work(whole, begins(whole, keys))
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (made[n] for n in names)], names=names)

        for batch in batches:
            if not len(batch):
                continue
            # the last group may go on in the next batch; one that has gone on to here may be all there is
            start = np.flatnonzero(begins(pa.concat_batches([held[-1].slice(len(held[-1]) - 1), batch]) if held else batch, keys))[1:]
            start = start - 1 if held else start
            cut = int(start[-1]) if len(start) else None
            if cut is None:
                held.append(batch)
                continue
            parts = [*held, batch.slice(0, cut)] if cut else held
            if parts:
                yield done(parts)
            held = [batch.slice(cut)]
        if held:
            yield done(held)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def running(df: DataFrame, keys: list[str], by: str, values: list[str]) -> DataFrame:
    """df with nth (from 1) and upto_{value} (this row included) within each key, in order of by, which is unique in a key.

    A range of rows is a task, so that no task holds a key's rows. Only a range's first and last key lie in others too, so
    that what is broadcast is two rows a range at most.
    """
    names = [f"upto_{v}" for v in values]
    order = [*keys, by]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("part", T.LongType()), *ranged.schema.fields, T.StructField("nth", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, np.zeros(len(values) + 1)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            first = begins(batch, keys)
            own = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            goes_on = last is not None and [c[0].as_py() for c in own] == last
            start = np.flatnonzero(first)
            size = np.diff(np.append(start, n))
            sums = []
            for i, v in enumerate([None, *values]):
                x = np.ones(n) if v is None else batch.column(batch.schema.get_field_index(v)).to_numpy(zero_copy_only=False).astype(float)
                total = np.cumsum(x)
                total -= np.repeat(np.concatenate(([0.0], total))[start], size)
                if goes_on:
                    total[: size[0]] += held[i]
                sums.append(total)
            last, held = [c[-1].as_py() for c in own], np.array([s[-1] for s in sums])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), *batch.columns, pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])], names=schema.names)

    parts = keep(ranged.mapInArrow(run, schema), "running")
    key = F.struct(*keys)
    ends = parts.groupBy("part").agg(F.min(key).alias("x"), F.max(key).alias("y"))
    both = ends.select("part", F.explode(F.array("x", "y")).alias("key")).distinct().groupBy("key").count().filter("count > 1").select("key")
    totals = parts.withColumn("key", key).join(F.broadcast(both), "key", "left_semi").groupBy("key", "part").agg(F.max("nth").alias("nth"), *[F.max_by(n, "nth").alias(n) for n in names])
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("key", "part", *[F.sum(c).over(before).alias(f"before_{c}") for c in ("nth", *names)])
    out = parts.withColumn("key", key).join(F.broadcast(shift), ["key", "part"], "left")
    return out.select(*df.columns, (F.col("nth") + F.coalesce("before_nth", F.lit(0))).alias("nth"), *[(F.col(n) + F.coalesce(f"before_{n}", F.lit(0.0))).alias(n) for n in names])
