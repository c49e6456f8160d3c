"""Vector codes: each part of a vector as the nearest entry of its codebook, by k-means with adaptive distance bounds (Drake and Hamerly 2012).

Components become whole numbers, floor(256 * x). A pass over the rows finds each part's nearest entry and writes, beside it, the
next b nearest entries with lower bounds of their distances in ascending order, and one bound for all entries further out.
Entries then move to the mean of their parts, and the next pass takes each entry's way off its bounds: a part whose own
entry is nearer than all of them stays as it is; where only near entries are in doubt, these are measured again; where the
outer bound is, all are. All distances are whole numbers, so the result is that of measuring everything. Bounds are kept
rounded down: as 16 bits, then steps of 8 bits. b starts at a quarter of the entries, and each batch of rows writes as many as SHARE
of its parts were in need of, an eighth of the entries at least.

Rows stay where they are; only sums of each entry (one row an entry and task) and of each label are shuffled. Codebooks alone reach the driver.

Defined cases: a vector that is null, empty, of another length than most, or that holds a null, NaN or infinity is left out, and an empty table
gives no rows; a length that the parts don't divide is an error; fewer vectors than entries make fewer entries; null ids come last, and
of equal ids the smaller vector first; rows alike get codes alike; null labels are one label; components beyond +-32768 count as
that; a label's error is held to the largest long. Extra columns pass through, the vector's own place is the code's, and columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.contract import hot_keys, join_by
from ..functions.scratch import drop, keep
from .common import numbered, small_batches

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Whole numbers a unit, and their largest size: squared distances and places then fit one long.
UNIT, LARGEST = 256, 1 << 23
#: Of the parts whose outer bound held, the share that the next b has to serve.
SHARE = 0.95
#: The largest bound that is written.
FAR = 65535
OUT = ("code", "error", "label_error", "codebooks_sha256")


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 * x), held to +-LARGEST."""
    return np.clip(np.floor(values.astype(np.float64) * UNIT), -LARGEST, LARGEST).astype(np.int32)


def root(d2: np.ndarray) -> np.ndarray:
    """The whole part of the root, FAR at most."""
    return np.minimum(np.sqrt(np.minimum(d2, FAR * FAR).astype(np.float64)).astype(np.int64), FAR)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries). Sums of up to 2^53 are whole in doubles, whose product is the fast one."""
    if x.shape[1] * (int(np.abs(x).max(initial=0)) + int(np.abs(book).max(initial=0))) ** 2 < 1 << 53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return sum((x[:, j, None].astype(np.int64) - book[None, :, j]) ** 2 for j in range(x.shape[1]))


def own_distance(x: np.ndarray, book: np.ndarray, entry: np.ndarray) -> np.ndarray:
    gap = x.astype(np.int64) - book[entry]
    return (gap * gap).sum(-1)


class Bounds:
    """Of one part of n rows: the entry, the next b entries and their b + 1 lower bounds, the last one for all further entries."""

    def __init__(self, entry: np.ndarray, near: np.ndarray, low: np.ndarray):
        self.entry, self.near, self.low = entry, near, low

    @classmethod
    def measured(cls, x: np.ndarray, book: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
        """All entries measured; also the squared distance to the nearest."""
        k = len(book)
        order = distances(x, book) * k + np.arange(k)  # ties to the lower index
        b = min(b, k - 1)
        order = np.sort(np.partition(order, min(b + 1, k - 1), axis=1)[:, : b + 2], axis=1)
        d2 = order // k
        low = root(d2[:, 1:])
        if low.shape[1] == b:  # nothing is further out
            low = np.concatenate((low, np.full((len(x), 1), FAR)), axis=1)
        return cls(order[:, 0] % k, order[:, 1 : b + 1] % k, low), d2[:, 0]

    def after(self, x: np.ndarray, book: np.ndarray, way: np.ndarray) -> tuple[Bounds, np.ndarray, np.ndarray]:
        """What holds after entries went at most these ways; squared distances; how many near entries were measured (-1: all entries)."""
        b = self.near.shape[1]
        d2 = own_distance(x, book, self.entry)
        low = np.maximum(self.low[:, :b] - way[self.near], 0)
        all_near = b == len(book) - 1
        outer = np.full(len(x), FAR) if all_near else np.maximum(self.low[:, b] - way.max(initial=0), 0)
        sure = all_near | (d2 < outer * outer)
        entry, near = self.entry.copy(), self.near.copy()
        doubt = (low * low <= d2[:, None]) & sure[:, None]
        used = np.where(sure, doubt.sum(1), -1)
        row, col = np.nonzero(doubt)
        if len(row):
            other = own_distance(x[row], book, near[row, col])
            low[row, col] = root(other)
            best = np.full(low.shape, np.iinfo(np.int64).max)
            best[row, col] = other * len(book) + near[row, col]
            at = best.argmin(1)
            every = np.arange(len(x))
            swap = np.flatnonzero(best[every, at] < d2 * len(book) + entry)
            c = at[swap]
            new = near[swap, c]
            near[swap, c], low[swap, c] = entry[swap], root(d2[swap])
            d2[swap] = best[swap, c] // len(book)
            entry[swap] = new
        order = np.argsort(low, axis=1, kind="stable")
        low, near = np.take_along_axis(low, order, 1), np.take_along_axis(near, order, 1)
        low = np.concatenate((low, outer[:, None]), axis=1)
        redo = np.flatnonzero(~sure)
        if len(redo):
            fresh, d2[redo] = Bounds.measured(x[redo], book, b)
            entry[redo], near[redo], low[redo] = fresh.entry, fresh.near, fresh.low
        return Bounds(entry, near, low), d2, used

    def cut(self, b: int) -> Bounds:
        """Only the nearest b of the near entries; the rest is further out."""
        if b >= self.near.shape[1]:
            return self
        return Bounds(self.entry, self.near[:, :b], np.concatenate((self.low[:, :b], self.low[:, b:].min(1, keepdims=True)), axis=1))


def packed(low: np.ndarray) -> np.ndarray:
    """Ascending bounds as 16 bits and steps of 8 bits: bytes (rows, 2 + b). A step of over 255 lowers what follows it."""
    low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
    at, out = low[:, 0].copy(), np.zeros((len(low), low.shape[1] + 1), np.uint8)
    out[:, 0], out[:, 1] = at & 255, at >> 8
    for z in range(1, low.shape[1]):
        step = np.minimum(low[:, z] - at, 255)
        out[:, z + 1] = step
        at += step
    return out


def unpacked(data: np.ndarray) -> np.ndarray:
    low = data[:, 1:].astype(np.int64)
    low[:, 0] = data[:, 0] + (data[:, 1].astype(np.int64) << 8)
    return np.cumsum(low, axis=1)


def _rows(column: pa.Array, dtype: str) -> np.ndarray:
    """A binary column of equally long values as (rows, ..)."""
    return np.array([np.frombuffer(v, dtype) for v in column.to_pylist()])


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in rows.reshape(len(rows), -1)], pa.binary())


def _ints(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, numbers) of values that are written in 2 or in 4 bytes each; rows of a batch are written alike, but batches are cut anew when read."""
    values = column.to_pylist()
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, np.array([np.frombuffer(values[i], np.uint8) for i in at.tolist()])


class _State:
    """How a pass writes a row: the numbers, the code, near entries and bounds, in the columns of SCHEMA."""

    NAMES = ("q", "code", "near", "low")

    @staticmethod
    def write(q: np.ndarray, made: list[Bounds]) -> dict[str, pa.Array]:
        small = np.abs(q).max(initial=0) < 1 << 15
        code = np.stack([m.entry for m in made], axis=1).astype(np.uint8)
        near = np.concatenate([m.near for m in made], axis=1).astype(np.uint8)
        low = np.concatenate([packed(m.low) for m in made], axis=1)
        return {"q": _binary(q.astype("<i2" if small else "<i4")), "code": _binary(code), "near": _binary(near), "low": _binary(low)}


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int32)
    for at, raw in _ints(column):
        out[at] = raw.view("<i2" if raw.shape[1] == 2 * width else "<i4")
    return out


class Codebooks:
    """(parts, entries, width) whole numbers."""

    def __init__(self, books: np.ndarray):
        self.books = books

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()

    def ways(self, other: Codebooks) -> np.ndarray:
        """How far each entry is from other's at most, rounded up: (parts, entries)."""
        gap = (self.books.astype(object) - other.books.astype(object)) ** 2
        return np.array([[math.isqrt(max(int(s) - 1, -1)) + 1 if s else 0 for s in row] for row in gap.sum(2)], np.int64).reshape(self.books.shape[:2])


def _map(df: DataFrame, payload: int, make: Callable[[pa.RecordBatch], dict[str, pa.Array]], new: T.StructType) -> DataFrame:
    """df's first payload columns with those that make(batch) returns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                made = make(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns[:payload], *(made[n] for n in new.names)], names=[*batch.schema.names[:payload], *new.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:payload], *new.fields]))


STATE = T.StructType([T.StructField(n, T.BinaryType()) for n in _State.NAMES])
CODED = T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])


def _part(x: np.ndarray, p: int, width: int) -> np.ndarray:
    return x[:, p * width : (p + 1) * width]


def _bounds_of(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[np.ndarray, list[Bounds]]]:
    """(places, a part's bounds each), rows of the same b together."""
    column = {n: batch.column(batch.schema.get_field_index(n)) for n in _State.NAMES}
    code = _rows(column["code"], np.uint8)
    low = column["low"].to_pylist()
    for at, near in _ints(column["near"]):
        b = near.shape[1] // parts
        bound = np.array([np.frombuffer(low[i], np.uint8) for i in at.tolist()])
        yield at, [Bounds(code[at, p].astype(np.int64), near[:, p * b : (p + 1) * b].astype(np.int64), unpacked(bound[:, p * (b + 2) : (p + 1) * (b + 2)])) for p in range(parts)]


def _take(made: list[Bounds], d2: np.ndarray, x: np.ndarray, books: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """Brings made and d2 up to date for these books; returns the near entries that were measured, a row and part."""
    width, used = books.shape[2], np.zeros(d2.shape, np.int64)
    for p, old in enumerate(made):
        made[p], d2[:, p], used[:, p] = old.after(_part(x, p, width), books[p], ways[p])
    return used


def fit(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """rows that have a vector, with code (two hex digits a part), error, label_error and codebooks_sha256 in the vector's place; and the codebooks."""
    if not 0 < entries <= 256 or rounds < 1:
        raise ValueError("1 to 256 entries, 1 round at least")
    small_batches(rows.sparkSession)
    df, number, own = numbered(rows)
    i, v, label = number(id_col), F.col(number(vector_col)), number(label_col)
    fine = df.filter(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size(v) > 0))
    length = fine.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = length[0].n if length else parts
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    width = size // parts
    fine = fine.filter(F.size(v) == size)
    first = [r.v for r in fine.orderBy(F.col(i).asc_nulls_last(), v).limit(entries).select(v.alias("v")).collect()]
    books = Codebooks(whole(np.array(first, np.float64).reshape(len(first), parts, width)).astype(np.int64).transpose(1, 0, 2))
    payload = [c for c in df.columns if c != number(vector_col)]
    n = len(payload)
    start, least = max(entries // 4, 1), max(entries // 8, 1)
    initial = books.books

    def begin(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        x = whole(batch.column(n).flatten().to_numpy(zero_copy_only=False)).reshape(len(batch), size)
        return _State.write(x, [Bounds.measured(_part(x, p, width), initial[p], start)[0] for p in range(parts)])

    state = keep(_map(fine.select(*payload, v.alias("v")), n, begin, STATE), "bounds")
    for r in range(rounds):
        new = moved(state, books) if first else books
        now, ways = new.books, books.ways(new)
        last = r == rounds - 1

        def follow(batch: pa.RecordBatch, now: np.ndarray = now, ways: np.ndarray = ways, last: bool = last) -> dict[str, pa.Array]:
            x = _numbers(batch.column(n), size)
            codes, errors = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            states: list[tuple[np.ndarray, dict[str, pa.Array]]] = []
            for at, made in _bounds_of(batch, parts):
                d2 = np.zeros((len(at), parts), np.int64)
                used = _take(made, d2, x[at], now, ways)
                if last:
                    codes[at], errors[at] = np.stack([m.entry for m in made], axis=1), d2.sum(1)
                    continue
                held = used[used >= 0]
                b = max(least, int(np.quantile(held, SHARE, method="higher")) if len(held) else least)
                states.append((at, _State.write(x[at], [m.cut(b) for m in made])))
            if last:
                return {"code": pa.array([c.tobytes().hex() for c in codes], pa.string()), "error": pa.array(errors)}
            back = pa.array(np.argsort(np.concatenate([at for at, _ in states]), kind="stable"))
            return {name: pa.concat_arrays([s[name] for _, s in states]).take(back) for name in _State.NAMES}

        after = keep(_map(state, n, follow, CODED if last else STATE), "codes" if last else "bounds")
        drop(state)
        state, books = after, new
    key = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null"))
    coded = state.withColumn("key", key)
    total = coded.groupBy("key").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("total")).select("key", F.least("total", F.lit(2**63 - 1).cast("decimal(30,0)")).cast("long").alias("label_error"))
    out = join_by(coded, total, "key", hot_keys(coded, "key")).withColumn("codebooks_sha256", F.lit(books.sha256))
    return own(out, OUT, [vector_col]), books


def moved(state: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry at floor(sum / count) of its parts, componentwise; entries without a part stay."""
    parts, entries, width = books.books.shape

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if len(batch):
                x = _numbers(batch.column(0), parts * width)
                at = _rows(batch.column(1), np.uint8).astype(np.int64) + np.arange(parts) * entries
                count += np.bincount(at.reshape(-1), minlength=len(count))
                values = x.reshape(-1, width)
                order = np.argsort(at.reshape(-1), kind="stable")
                places = at.reshape(-1)[order]
                cut = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
                total[places[cut]] += np.add.reduceat(values[order].astype(np.int64), cut, axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), *(pa.array(total[some, j]) for j in range(width))], names=["entry", "n", *(f"s{j}" for j in range(width))])

    partial = state.select("q", "code").mapInArrow(sums, ", ".join(["entry int", "n long", *(f"s{j} long" for j in range(width))]))
    add = [F.sum(F.col(f"s{j}").cast("decimal(20,0)")).alias(f"s{j}") for j in range(width)]
    out = books.books.copy().reshape(parts * entries, width)
    for r in partial.groupBy("entry").agg(F.sum("n").alias("n"), *add).collect():  # an entry a row
        out[r.entry] = [int(r[f"s{j}"]) // r.n for j in range(width)]
    return Codebooks(out.reshape(books.books.shape))


def restored(coded: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """coded with restored: the entries' middles, as doubles; a null code gives null."""
    middle = (books.books + 0.5) / UNIT

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        codes = batch.column(batch.schema.get_field_index(code_col)).to_pylist()
        every = np.arange(len(middle))
        return {"restored": pa.array([None if c is None else middle[every, np.frombuffer(bytes.fromhex(c), np.uint8)].reshape(-1) for c in codes], pa.list_(pa.float64()))}

    return _map(coded, len(coded.columns), make, T.StructType([T.StructField("restored", T.ArrayType(T.DoubleType()))]))
