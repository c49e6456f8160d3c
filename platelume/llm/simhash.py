"""SimHash near-duplicates by pigeonring filtering (Qin and Xiao 2018).

A text's fingerprint counts, for each of 64 bits, in how many of its word shingles' XXH64 the bit is set. Equal
fingerprints become one node. The 64 bits form a ring of 8 segments of 8 bits. If two fingerprints differ in
d <= 3 bits, then some segment starts a chain in which the first l segments differ in at most l * 3 / 8 bits, for
every l. So its first two segments agree (16 bits), and its third to fifth (24 bits) hold one difference at
most: one half of them (12 bits) agrees. The 28 bits are the bucket key, 16 keys a fingerprint; in a bucket, pairs
must pass the whole chain from its start before their full Hamming distance is counted.

A bucket of over BUCKET fingerprints is dealt anew: the bits that its key leaves are cut in four, of which one
must agree as three differences can't touch all four, and so on until buckets are small, or so few bits are left
that they can't be large. No pair is lost and none is capped. A bucket emits a path through each of its linked groups,
not their pairs; the paths' components are the classes.

Defined cases: null or blank text has the fingerprint zero, linked like any other; a text of fewer words than a
shingle is one shingle; rows with the same text or id count each; a null id is never a class's id unless
it has no other; no rows give no rows; extra columns of any name pass through, and one named like an output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.contract import components, hot_keys, join_by
from ..functions.scratch import drop, keep
from .common import LOWER, append_columns, numbered, small_batches, texts_of

SHINGLE = 3
DISTANCE = 3
SEGMENTS, WIDTH = 8, 8
#: Fingerprints in a bucket that are compared in one task at once.
BUCKET = 512
#: Buckets whose fingerprints differ in so few bits only can't exceed 2 ** SMALL.
SMALL = 11
#: Hot buckets that are marked by broadcast; beyond this number, by a salted join.
BROADCAST_KEYS = 20_000
OUT = ("fingerprint", "component_id")


#: Bytes of a text whose words are Python objects at once, about.
BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(text: str, width: int = SHINGLE) -> int:
    raw = text.encode().translate(LOWER)
    total, n, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_intdigest
    words: list[bytes] = []
    at = 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + BLOCK)
        end = cut.start() if cut else len(raw)
        words += raw[at:end].split()  # after the last ones of the block before
        at = end
        if at == len(raw) and not n and 0 < len(words) < width:
            grams = iter([b" ".join(words)])
        else:
            grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        while part := [digest(g, 42) for g in islice(grams, 1 << 14)]:
            n += len(part)
            total += np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        words = words[-(width - 1) :] if width > 1 else []
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def add_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", drop=()) -> DataFrame:
    """docs with each text's fingerprint as a signed 64-bit number."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {name: pa.array(np.array([fingerprint(t) for t in texts_of(batch, text_col)], np.uint64).view(np.int64))}

    return append_columns(docs, make, T.StructType([T.StructField(name, T.LongType())]), drop)


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def first_masks() -> dict[int, list[int]]:
    """For each start segment, the masks of the bits that must agree."""
    out = {}
    for start in range(SEGMENTS):
        ring = [(start * WIDTH + k) % 64 for k in range(64)]
        exact, loose = ring[: 2 * WIDTH], ring[2 * WIDTH : 5 * WIDTH]
        half = len(loose) // 2
        out[start] = [_mask(exact + loose[:half]), _mask(exact + loose[half:])]
    return out


def next_masks(mask: int) -> list[int]:
    """mask with each quarter of the bits that it leaves."""
    left = [b for b in range(64) if not mask >> b & 1]
    cut = [round(len(left) * i / (DISTANCE + 1)) for i in range(DISTANCE + 2)]
    return [mask | _mask(left[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which pairs pass every step of the chain from their start, and then the full distance."""
    differ = a ^ b
    ok, total = np.ones(differ.shape, bool), np.zeros(differ.shape, np.int64)
    for k in range(SEGMENTS):
        shift = (((start + k) % SEGMENTS) * WIDTH).astype(np.uint64)
        total = total + np.bitwise_count((differ >> shift) & np.uint64((1 << WIDTH) - 1))
        ok &= SEGMENTS * total <= (k + 1) * DISTANCE
    return ok & (np.bitwise_count(differ) <= DISTANCE)


def paths(fps: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours in a path through each linked group of one bucket."""
    n = len(fps)
    near = linked(fps[:, None], fps[None, :], np.int64(start))
    label = np.arange(n)
    while True:
        least = np.where(near, label[None, :], n).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    order = np.argsort(label, kind="stable")
    same = label[order][1:] == label[order][:-1]
    return fps[order][:-1][same], fps[order][1:][same]


def _bucket_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (start, mask, part, fp), sorted so that buckets are runs -> path edges (a, b). The last bucket of a batch waits for the next."""
    held = None
    names = ["start", "mask", "part", "fp"]

    def work(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        start, mask, part, fp = cols
        new = np.flatnonzero((start[1:] != start[:-1]) | (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
        edges = np.concatenate(([0], new, [len(fp)]))
        size = np.diff(edges)
        two = edges[:-1][size == 2]
        ok = linked(fp[two], fp[two + 1], start[two])
        a, b = [fp[two][ok]], [fp[two + 1][ok]]
        for i in np.flatnonzero(size > 2):
            x, y = paths(fp[edges[i] : edges[i + 1]], int(start[edges[i]]))
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]) if len(a) else None

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        cols = [c.astype(np.int64) if n != "fp" else c.astype(np.int64).view(np.uint64) for n, c in zip(names, cols, strict=True)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
        cut = last[-1] + 1 if len(last) else 0
        held = [c[cut:] for c in cols]
        if cut and (out := work([c[:cut] for c in cols])) is not None:
            yield out
    if held is not None and len(held[0]) > 1 and (out := work(held)) is not None:
        yield out


def links(prints: DataFrame) -> DataFrame:
    """prints (fp, distinct) -> edges (a, b) whose components are those of all pairs at DISTANCE or less."""
    small_batches(prints.sparkSession)
    key = ["start", "mask", "part"]
    masks = {s: [_signed(m) for m in ms] for s, ms in first_masks().items()}
    choose = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(m).alias("mask")) for s, ms in masks.items() for m in ms])
    rows = prints.select("fp", F.explode(choose).alias("k")).select("k.start", "k.mask", F.col("fp").bitwiseAND(F.col("k.mask")).alias("part"), "fp")
    edges = None
    while True:
        level = {m for ms in masks.values() for m in ms}
        closed = [m for m in level if bin(m & (1 << 64) - 1).count("1") >= 64 - SMALL]
        hot = keep(rows.filter(~F.col("mask").isin(closed)).groupBy(*key).count().filter(F.col("count") > BUCKET).drop("count"), "hot")
        n = hot.count()
        if not n:
            large = None
        elif n <= BROADCAST_KEYS:
            large = rows.join(F.broadcast(hot), key, "left_semi")
            rows = rows.join(F.broadcast(hot), key, "left_anti")
        else:
            salted = hot.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
            rows = rows.withColumn("salt", F.pmod("fp", F.lit(16)).cast("int"))
            large = rows.join(salted, [*key, "salt"], "left_semi").drop("salt")
            rows = rows.join(salted, [*key, "salt"], "left_anti").drop("salt")
        found = rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_bucket_paths, "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        if large is None:
            return edges
        after = {m: [_signed(x) for x in next_masks(m & (1 << 64) - 1)] for m in level - set(closed)}
        masks = {s: [x for m in ms if m in after for x in after[m]] for s, ms in masks.items()}
        wider = F.create_map(*[x for m, xs in after.items() for x in (F.lit(m), F.array(*map(F.lit, xs)))])
        rows = keep(large, "deal").select("fp", "start", F.explode(wider[F.col("mask")]).alias("mask"))
        rows = rows.select("start", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")


def _prints(docs: DataFrame, text_col: str, text_stays: bool) -> DataFrame:
    """docs (c0, c1, ..) with fp and a row number, written once: what follows reads them more than once."""
    made = add_fingerprints(docs, text_col, "fp", drop=[] if text_stays else [text_col])
    return keep(made.withColumn("row", F.monotonically_increasing_id()), "prints")


def _classes(rows: DataFrame) -> DataFrame:
    """rows (row, id, fp) with root: a number that the rows of one near-duplicate class share."""
    prints = keep(rows.select("fp").distinct(), "distinct")
    found = components(links(prints)).withColumnRenamed("node", "fp")
    made = keep(join_by(rows, found, "fp", hot_keys(rows, "fp")).withColumn("root", F.coalesce("root", "fp")), "classes")
    drop(prints)
    return made


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text_stays: bool = True) -> DataFrame:
    """docs with fingerprint (16 hex digits) and component_id, the least id of each row's class."""
    plain, number, own = numbered(docs)
    rows = _prints(plain, number(text_col), text_stays)
    classes = _classes(rows.select("row", F.col(number(id_col)).alias("id"), "fp"))
    least = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    found = join_by(classes, least, "root", hot_keys(classes, "root")).select("row", "component_id")
    made = rows.join(found, "row").withColumn("fingerprint", F.lpad(F.lower(F.hex("fp")), 16, "0"))
    return own(made, OUT, [] if text_stays else [text_col])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, that of the least id; its columns are those of docs."""
    plain, number, own = numbered(docs)
    rows = _prints(plain, number(text_col), True)
    classes = _classes(rows.select("row", F.col(number(id_col)).alias("id"), "fp"))
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("s"))
    return own(rows.join(first.select(F.col("s.row").alias("row")), "row", "left_semi"))
