"""The prefix trie against rebuilding every conversation, and against SQL."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from platelume.llm import queries, trie
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def _plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + v[h:]
    nodes = {}
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    above = lambda p: p[:-1]
    children, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            children[above(p)] += 1
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] += children[p] == 0
        saved[p] += (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            leaves[above(p)] += leaves[p]
            saved[above(p)] += saved[p]
    out = set()
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(p))
        out.add((min(members), len(p), min(nodes[above(p)]) if p else None, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _got(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert len(rows) == len({(r.conv_id, r.depth) for r in rows})
    return set(map(tuple, rows))


@pytest.fixture(params=["one part", "many parts"])
def parts(spark, request):
    """Small parts are joined, unless this is switched off: then conversations lie in several."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, str(request.param == "one part").lower())
    spark.conf.set("spark.sql.shuffle.partitions", "7" if request.param == "many parts" else "4")
    yield
    spark.conf.unset(setting)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_against_rebuilt_conversations(spark, parts):
    """Negative ids, bases that are absent or short, nulls, ties, repeated rows, chains that hang on chains, a conversation over several parts and one met by a third of all."""
    rng = random.Random(8)
    words = ["", "a", "b", "ê", "long " * 40]
    rows = []
    for c in [*range(-12, 60), *range(1000, 1012), *range(2001, 2005)]:
        for k in range(rng.choice((1, 2, 3, 6, 9, 12, 14))):
            rows.append((c, rng.choice((k, k, k, k, 3, None)), rng.choice(("user", "assistant", None)), rng.choice([*words, None])))
    rows += rows[:9] + [(None, 1, "user", "x"), (None, None, None, None)]
    rows += [(3000, k, "user", str(k)) for k in range(1500)] + [(3005, k, "user", str(k)) for k in range(1500)] + [(3010, k, "user", str(k % 700)) for k in range(900)]
    rows += [(4000 + i, k, "user", "same") for i in range(0, 400, 5) for k in range(10)]
    rows += [(5000 + 5 * i, k, "user", "deep" if k < i else f"own {i}") for i in range(12) for k in range(i + 1)]
    rng.shuffle(rows)
    want = _plain(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).select(F.lit(1).alias("a"), "text", "turn", F.col("role").alias("Role"), "conv_id", F.lit("x").alias("pos"))
    assert _got(trie.prefix_trie(df)) == want
    assert _plain([]) == _got(trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == set()


def test_references_lead_to_the_turns(spark):
    rows = [(c, k, "user", f"{c if k > 2 else 0} {k}") for c in range(10) for k in range(12)]
    out = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).filter("depth > 0").collect()
    for r in out:
        h = zlib.crc32(str(r.conv_id).encode()) % 9
        assert r.source_conv_id == (r.conv_id - r.conv_id % 5 if r.depth <= h else r.conv_id) and r.source_turn == r.depth


def test_maps_compose():
    rng = np.random.default_rng(2)
    x, y = (rng.integers(0, 1 << 63, 50, dtype=np.uint64) for _ in range(2))
    a, b = trie.drawn(x, y, 3)
    assert (a * trie.inverse(a) == 1).all()
    first = np.zeros(50, bool)
    first[[0, 1, 17, 40]] = True
    got = trie.running(a, b, first)
    now = None
    for i in range(50):
        one = (a[i : i + 1], b[i : i + 1])
        now = one if first[i] else trie.then(now, one)
        assert got[0][i] == now[0][0] and got[1][i] == now[1][0]
    f, g = (a[:1], b[:1]), (a[1:2], b[1:2])
    both = trie.then(f, g)
    assert trie.without_first(both, f) == g and trie.without_last(both, g) == f


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = queries.op11_prefix_trie(spark, sf)
    found = con.execute(queries.ORACLE["op11_prefix_trie"])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert {tuple(r) for r in got.select(*names).collect()} == set(found.fetchall())
