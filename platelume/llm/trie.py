"""The prefix trie of conversations that share their heads, by composable fingerprints.

A conversation c is rebuilt from the first h turns of its base conversation and its own turns after its first h. No rebuilt text is
made: a turn is a map x -> a * x + b of 64-bit numbers drawn from the digest of its role and text, a run of turns is the composition of their maps, and the prefix of
a rebuilt conversation is the base's head composed with a part of its own run, found from two of its own prefixes. Prefixes of one depth and
one map are a node. Each prefix keeps the reference of its last turn, its digest, and a node's prefixes must have one and the same: maps of one depth
and one last turn have the same map before it, so that, depth by depth, nodes hold equal sequences. Should two digests meet in a node, all is
done again with other maps.

Turns are numbered and composed in a sort over all of them (range exchange), a part of a conversation a task, and the parts are put together by their
own compositions: a conversation of any length is not one task. Texts are read once, for their digests, and are never shuffled. A node's subtree
is summed along chains (nodes with the same least member, all of them prefixes of it), whose totals are passed up by pointer doubling.

Defined cases: null role or text counts as empty; rows of one conversation are ordered by turn (null first), then role, then text (by its
first HEAD characters, then by its digest); equal rows are turns each; rows with a null conv_id belong to no conversation; no rows give
no nodes; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.contract import hot_keys, join_by
from ..functions.scratch import drop, keep, written
from .common import numbered, small_batches

#: A base conversation serves this many ids, and this many first turns of it at most go into another.
GROUP, HEADS = 5, 9
#: Characters of a text that order rows of one turn.
HEAD = 64
#: Bytes of joined ids that are one row on their way to a node's digest.
CHUNK = 1 << 18
_ONE = np.uint64(1)


# ---- maps x -> a * x + b of 64-bit numbers, as two arrays -------------------------------------


def drawn(x: np.ndarray, y: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The maps of turns from the first two numbers of their digests; a is odd, so that each map can be undone."""
    salt = np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)

    def mixed(v: np.ndarray) -> np.ndarray:
        v = (v ^ salt) * np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(32)
        return v * np.uint64(0xD6E8FEB86659FD93)

    return mixed(x) | _ONE, mixed(y)


def inverse(a: np.ndarray) -> np.ndarray:
    """Of odd numbers, modulo 2^64: each step doubles the bits that are right."""
    x = a * np.uint64(3) ^ np.uint64(2)
    for _ in range(4):
        x = x * (np.uint64(2) - a * x)
    return x


def then(f: tuple, g: tuple) -> tuple:
    """First f, then g."""
    return f[0] * g[0], f[1] * g[0] + g[1]


def without_last(f: tuple, g: tuple) -> tuple:
    """What comes before g in f."""
    back = inverse(g[0])
    return f[0] * back, (f[1] - g[1]) * back


def without_first(f: tuple, g: tuple) -> tuple:
    """What comes after g in f."""
    a = f[0] * inverse(g[0])
    return a, f[1] - g[1] * a


def running(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compositions from the beginning of each group (first: where one begins) up to each place."""
    up = np.cumprod(a, dtype=np.uint64)
    down = inverse(up)
    sums = np.cumsum(b * down, dtype=np.uint64)
    start = np.flatnonzero(first)
    count = np.diff(np.append(start, len(a)))
    before = np.repeat(np.where(start > 0, up[start - 1], _ONE), count), np.repeat(np.where(start > 0, sums[start - 1], 0).astype(np.uint64), count)
    a = up * inverse(before[0])
    return a, up * (sums - before[1])


def _longs(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in arrays]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _pair(batch: pa.RecordBatch, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(_column(batch, n).astype(np.int64).view(np.uint64) for n in (a, b))


# ---- running values over parts of sorted rows -------------------------------------------------


def _map(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, pa.Array | np.ndarray]], schema: str) -> DataFrame:
    """The columns of schema that make(batch) returns, a batch at a time."""
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                made = make(batch)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (made[n] for n in names)], names=names)

    return df.mapInArrow(run, schema)


def _split(parts: DataFrame, value: list[str], before: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """(part, conv_id, ..) of conversations that lie in several parts: what before() makes of the last k and value of their parts up to this one.

    Only a part's first and last conversation go on in another, so that these are two rows a part at most.
    """
    ends = parts.groupBy("part").agg(F.min("conv_id").alias("x"), F.max("conv_id").alias("y"))
    both = ends.select("part", F.explode(F.array("x", "y")).alias("conv_id")).distinct().groupBy("conv_id").count().filter("count > 1").select("conv_id")
    names = T.StructType.fromDDL(schema).names
    last = parts.join(F.broadcast(both), "conv_id", "left_semi").groupBy("part", "conv_id").agg(F.max("k").alias("k"), *[F.max_by(v, "k").alias(v) for v in value])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", ignore_index=True)
        made = before(list(pdf[["k", *value]].itertuples(index=False, name=None)))
        return pd.DataFrame([(p, c, *m) for p, c, m in zip(pdf["part"], pdf["conv_id"], made, strict=True)], columns=names)

    return F.broadcast(last.groupBy("conv_id").applyInPandas(one, schema))


def _starts(conv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a conversation begins here, where those begin, and each place's number within its own (from 1)."""
    first = np.concatenate(([True], conv[1:] != conv[:-1]))
    start = np.flatnonzero(first)
    return first, start, np.arange(len(conv)) - np.repeat(start, np.diff(np.append(start, len(conv)))) + 1


def turns(rows: DataFrame, seed: int) -> DataFrame:
    """rows (conv_id, turn, role, text) -> (conv_id, pos, n, x1..x4, a, b): each turn's place from 1 on, its text's bytes, its digest as longs, and the map of its conversation up to it."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    light = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, HEAD).alias("head"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n"))
    # equal rows may lie in several parts, in any order
    light = light.withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest"), F.col("row")]
    ranged = light.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "n", "digest")

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv_at, k_at, held = TaskContext.get().partitionId(), None, 0, None
        for batch in batches:
            if not len(batch):
                continue
            conv = _column(batch, "conv_id")
            raw = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("digest")).to_pylist()), "<u8").reshape(-1, 4)
            first, start, k = _starts(conv)
            a, b = running(*drawn(raw[:, 0], raw[:, 1], seed), first)
            if conv[0] == conv_at:  # goes on from the batch before
                own = slice(0, start[1] if len(start) > 1 else len(conv))
                a[own], b[own] = then(held, (a[own], b[own]))
                k[own] += k_at
            conv_at, k_at, held = conv[-1], k[-1], (a[-1:].copy(), b[-1:].copy())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part)), *batch.columns[:2], pa.array(k), *_longs(*raw.T, a, b)], names=["part", "conv_id", "n", "k", "x1", "x2", "x3", "x4", "a", "b"])

    parts = keep(ranged.mapInArrow(number, "part long, conv_id long, n long, k long, x1 long, x2 long, x3 long, x4 long, a long, b long"), "turns")

    def before(last: list[tuple]) -> list[tuple]:
        k0, a0, b0, out = 0, 1, 0, []
        for k, a, b in last:
            out.append((k0, *(x - (1 << 64) if x >> 63 else x for x in (a0, b0))))
            a, b = int(a) % (1 << 64), int(b) % (1 << 64)
            k0, a0, b0 = k0 + int(k), a0 * a % (1 << 64), (b0 * a + b) % (1 << 64)
        return out

    shift = _split(parts, ["a", "b"], before, "part long, conv_id long, k0 long, a0 long, b0 long")
    placed = parts.join(shift, ["part", "conv_id"], "left").withColumns({"k0": F.coalesce("k0", F.lit(0)), "a0": F.coalesce("a0", F.lit(1)), "b0": F.coalesce("b0", F.lit(0))})

    def compose(batch: pa.RecordBatch) -> dict[str, pa.Array | np.ndarray]:
        a, b = _longs(*then(_pair(batch, "a0", "b0"), _pair(batch, "a", "b")))
        return {n: batch.column(batch.schema.get_field_index(n)) for n in ("conv_id", "n", "x1", "x2", "x3", "x4")} | {"pos": _column(batch, "k") + _column(batch, "k0"), "a": a, "b": b}

    return _map(placed, compose, "conv_id long, pos long, n long, x1 long, x2 long, x3 long, x4 long, a long, b long")


# ---- rebuilt conversations --------------------------------------------------------------------

_TURN = ["n", "x1", "x2", "x3", "x4"]


def _h() -> Column:
    return F.crc32(F.col("conv_id").cast("string")) % HEADS


def prefixes(own: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """own (turns) -> a row a conversation (conv_id, length), and (conv_id, d, source, pos, n, x1..x4, a, b, pa, pb, last): its rebuilt prefixes of one turn and
    more with their maps and those of the prefixes before, where their last turn comes from, and whether they are the whole."""
    convs = own.withColumn("h", _h()).groupBy("conv_id", "h").agg(F.max("pos").alias("count"), *[F.max(F.when(F.col("pos") == F.col("h"), F.col(c))).alias(f"own_{c}") for c in ("a", "b")])
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    heads = own.filter((F.col("pos") < HEADS) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    # a base has few conversations and few heads
    head = keep(convs.select("conv_id", "base", "h").join(heads, "base").filter("pos <= h"), "heads")
    top = head.groupBy("conv_id").agg(F.max("pos").alias("h2"), F.max_by("a", "pos").alias("base_a"), F.max_by("b", "pos").alias("base_b"))
    info = convs.join(top, "conv_id", "left").fillna({"own_a": 1, "own_b": 0, "h2": 0, "base_a": 1, "base_b": 0})
    info = keep(info.withColumn("length", F.col("h2") + F.greatest(F.lit(0), F.col("count") - F.col("h"))), "convs")
    first = head.join(info.select("conv_id", "length"), "conv_id").select("conv_id", F.col("pos").alias("d"), F.col("base").alias("source"), "pos", *_TURN, "a", "b", "length", *[F.lit(v).cast("long").alias(c) for c, v in (("own_a", 1), ("own_b", 0), ("base_a", 1), ("base_b", 0))])
    tail = join_by(own.filter(F.col("pos") > _h()), info.select("conv_id", "h", "h2", "length", "own_a", "own_b", "base_a", "base_b"), "conv_id", hot_keys(own, "conv_id"))
    tail = tail.select("conv_id", (F.col("h2") + F.col("pos") - F.col("h")).alias("d"), F.col("conv_id").alias("source"), "pos", *_TURN, "a", "b", "length", "own_a", "own_b", "base_a", "base_b")

    def rebuilt(batch: pa.RecordBatch) -> dict[str, pa.Array | np.ndarray]:
        whole = then(_pair(batch, "base_a", "base_b"), without_first(_pair(batch, "a", "b"), _pair(batch, "own_a", "own_b")))
        up = without_last(whole, drawn(*_pair(batch, "x1", "x2"), seed))
        a, b, pa_, pb = _longs(*whole, *up)
        same = {n: batch.column(batch.schema.get_field_index(n)) for n in ("conv_id", "d", "source", "pos", *_TURN)}
        return same | {"a": a, "b": b, "pa": pa_, "pb": pb, "last": _column(batch, "d") == _column(batch, "length")}

    schema = ", ".join(f"{c} long" for c in ("conv_id", "d", "source", "pos", *_TURN, "a", "b", "pa", "pb")) + ", last boolean"
    made = keep(_map(first.unionByName(tail), rebuilt, schema), "prefixes")
    drop(head)
    return info.select("conv_id", "length"), made


# ---- nodes ------------------------------------------------------------------------------------


def _nodes(rows: DataFrame, seed: int) -> tuple[DataFrame, DataFrame] | None:
    """Nodes (conv_id, depth, a, b, pa, pb, n_convs, n, source, pos), the root among them, and whole conversations (depth, a, b, conv_id); None if a node holds different turns."""
    convs, made = prefixes(turns(rows, seed), seed)
    seen = [f(x).alias(f"{k}_{x}") for x in ("x1", "x2", "x3", "x4") for k, f in (("lo", F.min), ("hi", F.max))]
    nodes = made.groupBy(F.col("d").alias("depth"), "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n").alias("n"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.min_by("source", "conv_id").alias("source"), F.min_by("pos", "conv_id").alias("pos"), *seen)
    nodes = keep(nodes, "nodes")
    if not nodes.filter(" OR ".join(f"lo_{x} <> hi_{x}" for x in ("x1", "x2", "x3", "x4"))).isEmpty():
        return None
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    names = ["conv_id", "depth", "a", "b", "pa", "pb", "n_convs", "n", "source", "pos"]
    root = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), none.alias("pa"), none.alias("pb"), "n_convs", F.lit(0).cast("long").alias("n"), none.alias("source"), none.alias("pos"))
    whole = made.filter("last").select(F.col("d").alias("depth"), "a", "b", "conv_id")
    bare = convs.filter("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv_id")
    return nodes.select(*names).unionByName(root.select(*names)), whole.unionByName(bare)


def ends_digests(whole: DataFrame) -> DataFrame:
    """(depth, a, b, conv_id) -> (depth, a, b, ends_sha256): of the joined ids of a node, in order.

    Ids are joined in ranges, so that a node that holds most conversations is many tasks' work; what is left to one is to digest its joined strings, chunk after chunk.
    """
    key = ["depth", "a", "b"]
    ranged = whole.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        out: list[tuple] = []

        def flush() -> None:
            if held:
                out.append((*at, held[0], ",".join(map(str, held))))

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], pa.int64()) for i in range(4)), pa.array([r[4] for r in out], pa.string())], names=[*key, "first", "ids"])
            out.clear()
            return made

        for batch in batches:
            for *k, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != at or size > CHUNK:
                    flush()
                    at, held, size = k, [], 0
                held.append(c)
                size += 20
            if out:
                yield batch_of()
        flush()
        if out:
            yield batch_of()

    strings = ranged.select(*key, "conv_id").mapInArrow(chunks, "depth long, a long, b long, first long, ids string")

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            out = []
            for *k, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k == at:
                    own.update(b",")
                else:
                    if own:
                        out.append((*at, own.hexdigest()))
                    at, own = k, hashlib.sha256()
                own.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out]) for i in range(4)], names=[*key, "ends_sha256"])
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, own.hexdigest())], names=[*key, "ends_sha256"])

    return strings.repartition(*key).sortWithinPartitions(*key, "first").select(*key, "ids").mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


_SUMS = ["n_leaves", "saved_tokens"]


def chain_totals(chains: DataFrame) -> DataFrame:
    """chains (conv_id, up, n_leaves, saved_tokens) -> (conv_id, n_leaves, saved_tokens) summed over each chain and all that hang on it, by pointer doubling."""
    now = keep(chains.select("conv_id", "up", *_SUMS), "chains")
    while not now.filter("up IS NOT NULL").isEmpty():
        more = now.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(c).alias(f"more_{c}") for c in _SUMS])
        above = now.select(F.col("conv_id").alias("up"), F.col("up").alias("further"))
        jumped = join_by(now, above, "up", hot_keys(now, "up")).join(more, "conv_id", "left")
        after = keep(jumped.select("conv_id", F.col("further").alias("up"), *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in _SUMS]), "chains")
        drop(now)
        now = after
    return now.select("conv_id", *_SUMS)


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """nodes (conv_id, depth, parent_conv_id, n_leaves, saved_tokens: each node's own) -> (conv_id, depth, n_leaves, saved_tokens) of whole subtrees.

    A conversation's nodes are one chain, and each chain hangs on the node above its top.
    """
    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.min_by("parent_conv_id", "depth").alias("up"), *[F.sum(c).alias(c) for c in _SUMS])
    chains = keep(chains, "tops")
    hung = chains.filter("up IS NOT NULL").select("conv_id", "up", (F.col("top") - 1).alias("depth")).join(chain_totals(chains), "conv_id")
    hung = hung.groupBy(F.col("up").alias("conv_id"), "depth").agg(*[F.sum(c).alias(f"hung_{c}") for c in _SUMS])
    own = nodes.select("conv_id", "depth", *_SUMS).join(hung, ["conv_id", "depth"], "left")
    own = own.select("conv_id", "depth", *[(F.col(c) + F.coalesce(f"hung_{c}", F.lit(0))).alias(c) for c in _SUMS])
    order = [F.col("conv_id"), F.col("depth").desc()]
    ranged = own.repartitionByRange(*order).sortWithinPartitions(*order)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv_at, k_at, held = TaskContext.get().partitionId(), None, 0, None
        for batch in batches:
            if not len(batch):
                continue
            conv = _column(batch, "conv_id")
            first, start, k = _starts(conv)
            sums = [np.cumsum(_column(batch, c)) for c in _SUMS]
            sums = [s - np.repeat(np.concatenate(([0], s))[start], np.diff(np.append(start, len(s)))) for s in sums]
            if conv[0] == conv_at:
                own = slice(0, start[1] if len(start) > 1 else len(conv))
                for s, more in zip(sums, held, strict=True):
                    s[own] += more
                k[own] += k_at
            conv_at, k_at, held = conv[-1], k[-1], [s[-1] for s in sums]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part)), *batch.columns[:2], pa.array(k), *map(pa.array, sums)], names=["part", "conv_id", "depth", "k", *_SUMS])

    parts = keep(ranged.mapInArrow(add, "part long, conv_id long, depth long, k long, n_leaves long, saved_tokens long"), "sums")

    def before(last: list[tuple]) -> list[tuple]:
        out, total = [], (0, 0)
        for _, *more in last:
            out.append(total)
            total = tuple(t + int(m) for t, m in zip(total, more, strict=True))
        return out

    shift = _split(parts, _SUMS, before, "part long, conv_id long, before_n_leaves long, before_saved_tokens long")
    return parts.join(shift, ["part", "conv_id"], "left").select("conv_id", "depth", *[(F.col(c) + F.coalesce(f"before_{c}", F.lit(0))).alias(c) for c in _SUMS])


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row a node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and
    source_conv_id and source_turn, the conversation and place (from 1) where its last turn stands."""
    small_batches(conversations.sparkSession)
    plain, number, _ = numbered(conversations)
    rows = plain.select(*[F.col(number(c)).alias(n) for c, n in ((conv_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))])

    def make() -> DataFrame:
        seed = 1
        while (found := _nodes(rows, seed)) is None:
            seed += 1
        nodes, whole = found
        above = nodes.select(F.struct("depth", "a", "b").alias("key"), F.col("conv_id").alias("parent_conv_id"))
        below = nodes.withColumn("key", F.when(F.col("pa").isNotNull(), F.struct((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))))
        linked = keep(join_by(below, above, "key", hot_keys(below, "key")).drop("key", "pa", "pb"), "linked")
        children = linked.filter("parent_conv_id IS NOT NULL").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
        full = keep(linked.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "full")
        alone = full.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n")})
        out = full.join(subtree_sums(alone), ["conv_id", "depth"]).join(ends_digests(whole), ["depth", "a", "b"], "left")
        nothing = F.lit(hashlib.sha256(b"").hexdigest())
        return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *_SUMS, F.coalesce("ends_sha256", nothing).alias("ends_sha256"), F.col("source").alias("source_conv_id"), F.col("pos").alias("source_turn"))

    return written(make, "trie")
