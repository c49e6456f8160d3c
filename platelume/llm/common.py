"""What the operators of this subpackage share: table reading, scratch tables, bounded joins, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import reach_workers

#: Python helpers work on slices of about this many text bytes, so that their arrays stay small.
SLICE_BYTES = 1 << 20
#: Text bytes of an Arrow batch that are Python objects at once, unless one row has more; batches come about this large.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df without columns of these names, in any case: an operator's own outputs take their place."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[..., DataFrame]]:
    """df with its columns named c0, c1, .., so that no name an operator uses can be one of them.

    Also a function from a column's own name to its number's, and one that gives a result of these columns their own names again:
    own(result, outputs, gone) selects df's columns, without those named like an output (which replace them) or in gone, and the outputs.
    """
    names = df.columns
    of = {n.lower(): f"c{i}" for i, n in reversed(list(enumerate(names)))}

    def number(name: str) -> str:
        if name.lower() not in of:
            raise ValueError(f"no column {name!r}; there are {', '.join(names)}")
        return of[name.lower()]

    def own(result: DataFrame, outputs: Iterable[str] = (), gone: Iterable[str] = ()) -> DataFrame:
        out = list(outputs)
        hidden = {n.lower() for n in [*out, *gone]}
        return result.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n.lower() not in hidden], *out)

    return df.toDF(*[f"c{i}" for i in range(len(names))]), number, own


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(False))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, where the session says nothing else: a batch is held by the executor and by its worker at once."""
    reach_workers(spark)
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def append_columns(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, pa.Array]], new: T.StructType, drop: Iterable[str] = (), rows: int = 1000, size: int = BATCH_BYTES, end: Callable[[], None] | None = None) -> DataFrame:
    """df, without the columns drop, with those that make(batch) returns for each Arrow batch; no shuffle, rows and their order stay.

    make gets rows rows and about size bytes of text at most at once (or one row), so that Python objects exist for these only.
    end is called when a task is done, to give back what make has gathered in the worker.
    """
    small_batches(df.sparkSession)
    gone = {n.lower() for n in drop}
    base = without(df, {n.lower() for n in new.names} - gone)  # what drop names is there for make to read
    stay = [i for i, n in enumerate(base.columns) if n.lower() not in gone]
    names = [*(base.columns[i] for i in stay), *new.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for whole in stretches(batches, size):
                for a, b in slices(text_bytes(whole), size, rows):
                    batch = whole.slice(a, b - a)
                    made = make(batch)
                    yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), *(made[n] for n in new.names)], names=names)
        finally:
            if end:
                end()
            pa.default_memory_pool().release_unused()  # the worker lives on

    return base.mapInArrow(run, T.StructType([*(base.schema.fields[i] for i in stay), *new.fields]))


def stretches(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches one after the other, joined while they have limit bytes of text at most together."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        n = sum(text_bytes(batch))
        if held and total + n > limit:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held, total = [], 0
        held.append(batch)
        total += n
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def text_bytes(batch: pa.RecordBatch) -> list[int]:
    """The bytes of each row's texts."""
    total = np.zeros(len(batch), np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return total.tolist()


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def slices(sizes: list[int], limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Runs of rows rows and about limit bytes at most; a larger row is a run of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > limit or i - start == rows):
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


# ---- words of many texts at once, as arrays -------------------------------------------------

#: Bytes whose word hashes are worked out together; a longer word takes several such blocks.
HASH_BLOCK = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int) -> np.ndarray:
    x = np.full(HASH_BLOCK, base, np.uint64)
    x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _polynomials(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word the sum of its bytes' values times powers of _BASE by place in the word, a block of words at a time."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = int(starts[i])
        j = int(np.searchsorted(ends, first + HASH_BLOCK, side="right"))  # words i..j-1 lie in the block
        if j > i:
            sums = np.zeros(int(ends[j - 1]) - first + 1, np.uint64)
            np.cumsum(_VALUE[data[first : int(ends[j - 1])]] * _UP[: len(sums) - 1], dtype=np.uint64, out=sums[1:])
            out[i:j] = (sums[ends[i:j] - first] - sums[starts[i:j] - first]) * _DOWN[starts[i:j] - first]
            i = j
            continue
        total = 0  # a word longer than a block
        for k, a in enumerate(range(first, int(ends[i]), HASH_BLOCK)):
            part = data[a : min(a + HASH_BLOCK, int(ends[i]))]
            total += int((_VALUE[part] * _UP[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, k * HASH_BLOCK, 1 << 64)
        out[i] = total & (1 << 64) - 1
        i += 1
    return out


class Words:
    """Words of several texts: places in one byte buffer, a 64-bit hash each, and each text's first word."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        """texts: already lower-cased; is_word: for each byte value, whether it belongs to a word."""
        self.raw = b" " + b" ".join(texts) + b" "
        data = np.frombuffer(self.raw, np.uint8)
        inside = is_word[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hashes = mix(_polynomials(data, self.starts, self.ends))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.bounds = np.searchsorted(self.starts, np.concatenate(([1], 1 + np.cumsum(sizes))))

    def shingles(self, width: int) -> np.ndarray:
        """A hash of the words i..i+width-1 for each i; those that run over a text's end are there as well."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = out * np.uint64(0x100000001B3) + self.hashes[k : k + n]
        return mix(out)

    def joined(self, first: int, last: int) -> bytes:
        return b" ".join(self.raw[s:e] for s, e in zip(self.starts[first:last].tolist(), self.ends[first:last].tolist(), strict=True))
