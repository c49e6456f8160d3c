"""Deduplication, sharding, SimHash, decontamination and BPE against brute force."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platelume.llm import bpe, common, decontaminate, exact_dedup, queries, sharding, simhash

SCHEMA = "doc_id long, text string, kept string, `we ird` int"
ODD = [
    (1, "a b c d e", "x", 1),
    (2, None, None, None),
    (3, "", "y", 2),
    (4, "a b c d e", "z", 3),
    (4, "a b c d e", "z", 3),
    (None, "a b c d e", "q", 4),
    (5, "  \t\n ", "w", 5),
    (6, "word " * 30000, "w", 6),
    (7, "é A b", "w", 6),
]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, SCHEMA)


def test_exact_dedup_defined_cases(spark):
    out = exact_dedup.exact_dedup(docs(spark)).collect()
    assert len(out) == len(ODD)
    same = [r for r in out if r.text == "a b c d e"]
    assert {r.keep_id for r in same} == {4} and {r.group_size for r in same} == {4}
    assert sorted((r.doc_id is None, r.doc_id, r.kept) for r in same if r.kept) == [(False, 4, True)]
    empty = [r for r in out if r.doc_id in (2, 3)]
    assert {(r.keep_id, r.group_size, r.kept) for r in empty} == {(3, 2, False), (3, 2, True)}
    assert all(r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() for r in out)
    left = exact_dedup.drop_copies(docs(spark))
    assert left.columns == docs(spark).columns and left.count() == 5
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_hot_text(spark):
    rows = [(i, "hot" if i % 3 else f"t{i // 2}", None, None) for i in range(1500)] + [(9000 + i, f"p{i % 5}", None, None) for i in range(400)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark, rows)).collect()}
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t, []).append(i)
    assert got == {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    small = exact_dedup.exact_dedup(docs(spark, rows), largest=False).filter("kept").select("doc_id").collect()
    assert sorted(r[0] for r in small) == sorted(min(g) for g in groups.values())


def test_exact_dedup_sorts_by_content_once(spark):
    """Without and with a hot text, texts are dealt out by range alone: the window's keys are what the sort has put together."""
    for n in (0, 400):
        rows = [(i, f"text {i % 90}" if i >= n else "hot", None, None) for i in range(900)]
        out = exact_dedup.exact_dedup(docs(spark, rows))
        plan = out._jdf.queryExecution().sparkPlan().toString()
        final = out._jdf.queryExecution().executedPlan().toString()
        assert final.count("Exchange rangepartitioning") == (2 if n else 1) and "Exchange hashpartitioning" not in final, final
        assert "Window" in plan
        assert out.filter("kept").count() == len({t for _, t, *_ in rows})


def test_exact_dedup_hot_rows_alike(spark):
    """A hot text whose rows have one id, or none, is dealt over salts all the same; one row of it stays."""
    rows = [(7, "one id", None, None)] * 300 + [(None, "no id", None, None)] * 300 + [(i, f"t{i}", None, None) for i in range(300)] + [(9, "no id", None, None)]
    out = exact_dedup.exact_dedup(docs(spark, rows))
    kept = {(r.text, r.keep_id, r.group_size) for r in out.filter("kept").collect()}
    assert kept == {("one id", 7, 300), ("no id", 9, 301)} | {(f"t{i}", i, 1) for i in range(300)}
    assert out.count() == len(rows) and out.filter("kept").count() == 302


CLASH = ["head", "salt", "nth", "row", "fp", "root", "chunk", "start", "c0", "__text", "KEPT", "Shard", "fingerprint", "n_hit", "score", "held_out", "__hits", "id", "label"]


def clashing(spark, rows=ODD):
    """docs with a column of each name that an operator could use itself, all holding their own name."""
    return docs(spark, rows).select("doc_id", "text").withColumns({c: F.lit(c) for c in CLASH})


@pytest.mark.parametrize(
    "apply",
    [exact_dedup.exact_dedup, sharding.assign_shards, simhash.near_duplicates, lambda d: decontaminate.contamination(d, d.sparkSession.createDataFrame([(1, "a b c d e")], "item_id long, text string"))],
)
def test_no_column_is_lost(spark, apply):
    out = apply(clashing(spark))
    outputs = {c.lower() for c in (*exact_dedup.OUT, *sharding.OUT, *simhash.OUT, *decontaminate.OUT)}
    names = {c.lower() for c in out.columns}
    assert len(names) == len(out.columns) and {c.lower() for c in CLASH} <= names
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r[c] == c for r in rows for c in CLASH if c.lower() not in outputs)


@pytest.mark.parametrize("apply", [exact_dedup.drop_copies, simhash.one_of_each, lambda d: decontaminate.drop_contaminated(d, d.sparkSession.createDataFrame([(1, "a b c d e")], "item_id long, text string"))])
def test_filters_leave_columns_as_they_are(spark, apply):
    rows = apply(clashing(spark)).collect()
    assert rows and all(r[c] == c for r in rows for c in CLASH) and apply(clashing(spark, [])).count() == 0


def slow_jump(key, n):
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_shards(spark, sf):
    keys = np.arange(-2000, 2000, dtype=np.int64) * 982451653
    for n in (1, 2, 40, 41):
        assert sharding.jump(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]
    out = queries.op6_jump_shards(spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(out) == len(texts)
    by, key = {}, {i: xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42) for i in texts}
    assert all((r.shard, r.grown_shard) == (slow_jump(key[r.doc_id], 40), slow_jump(key[r.doc_id], 41)) for r in out)
    for r in out:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    odd = sharding.assign_shards(docs(spark), 3).collect()
    assert len(odd) == len(ODD) and len({(r.shard, r.slot) for r in odd}) == len(ODD)
    assert sharding.assign_shards(docs(spark, []), 3).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit(1), 0)


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(prints):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def test_simhash_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = [slow_print(r.text) for r in rows]
    cls = slow_classes(prints)
    least = {}
    for r, c in zip(rows, cls, strict=True):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = {r.doc_id: (f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, cls, strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize(("bucket", "keys"), [(4, 20_000), (4, 3), (512, 20_000)])
def test_pigeonring_links_lose_nothing(spark, monkeypatch, bucket, keys):
    """Thousands of prints around few centres: buckets are hot, and are dealt anew; many hot ones are marked by a salted join."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", keys)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = set()
    for c in centres.tolist():
        for _ in range(150):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    got = [found.get(p, p) for p in signed]
    cls = slow_classes(prints)
    assert len(set(zip(got, cls, strict=True))) == len(set(got)) == len(set(cls))


def test_fingerprint_in_blocks(monkeypatch):
    texts = ["", " \t", "One", "one two", "A b\u00a0c d", " lead and trail ", "w\x0bx\x0cy z " * 40, "\u00e9\u00c9 \u65e5\u672c " * 30]
    for block in (1, 7, 1 << 20):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert [simhash.fingerprint(t) for t in texts] == [slow_print(t) for t in texts]


def test_simhash_defined_cases(spark):
    out = simhash.near_duplicates(docs(spark)).collect()
    assert len(out) == len(ODD)
    assert {r.component_id for r in out if not (r.text or "").split()} == {2}
    assert {r.component_id for r in out if r.text == "a b c d e"} == {1}
    one = simhash.one_of_each(docs(spark))
    assert one.columns == docs(spark).columns and one.count() == 4
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.one_of_each(docs(spark, [])).count() == 0


def slow_hits(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, got = find(text), set(), set()
    for item, t in items:
        own = find(t)
        k = min(13, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
        for i in range(len(words) - k + 1) if k else ():
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                got.add(item)
    ids = ",".join(sorted(str(i) if i is not None else "" for i in got))
    return len(words), len(hit), len(got), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block", [40, 200_000])
def test_contamination(spark, sf, block):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:12]
    items += [(900, "two words"), (901, "É"), (902, None), (903, "?! "), (904, "a b c d e f g h i j k l m n"), (905, "two  WORDS"), (None, "lonely")]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    texts += [items[0][1], "x " + items[1][1] + " y", "Two words, two words", "two\x00words é", None, "", "a b c d e f g h i j k l m n o", "a-b c d e f g h i j k l m", "lonely " * 50, "aé日本"]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    out = decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block=block).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out}
    want = {i: slow_hits(t, items) for i, t in enumerate(texts)}
    assert got == want and sum(w[4] for w in want.values()) > 4


def test_contamination_query(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {r.doc_id: slow_hits(r.text, items) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op8_decontaminate(spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out} == want
    assert any(w[4] for w in want.values())


def test_contamination_of_common_windows(spark, monkeypatch):
    """One passage in hundreds of items, and windows that share their rarest shingle: no link is lost, however they are dealt."""
    monkeypatch.setattr(decontaminate, "ITEMS", 4)
    common = " ".join(f"w{i}" for i in range(15))
    items = [(i, common) for i in range(120)] + [(200 + i, f"same same same same same x{i} a b c d e f g") for i in range(40)]
    texts = [f"say {common} now", "same same same same same x7 a b c d e f g", "same same same same same x99 a b c d e f g", common[:-4]]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    for block in (50, 200_000):
        out = decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block=block).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out} == {i: slow_hits(t, items) for i, t in enumerate(texts)}


def test_contamination_beyond_broadcasts(spark, sf, monkeypatch):
    """Every item joined in place of broadcast, by a sieve that lets much through and counts sent on often: the same rows."""
    monkeypatch.setattr(decontaminate, "GATHER", 40)
    monkeypatch.setattr(decontaminate, "SIEVE", 15)
    given = spark.read.parquet(f"{sf}/documents.parquet")
    more = given.selectExpr("concat('d', doc_id) AS item_id", "text").filter("length(text) < 400")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("CAST(item_id AS STRING) AS item_id", "text").unionByName(more)
    one, other = (decontaminate.contamination(given, items, block=b, text_stays=False) for b in (0, 1_000_000))
    assert one.dtypes == other.dtypes
    rows = sorted(map(tuple, one.collect()))
    assert rows == sorted(map(tuple, other.collect())) and sum(r[-1] for r in rows) > 10
    left = decontaminate.drop_contaminated(given, items, block=0)
    assert left.columns == given.columns and left.count() == sum(not r[-1] for r in rows)


def test_contamination_beside_very_long_words(spark):
    """A word of a million characters next to a passage, and a document that is one: nothing is lost, with or without a broadcast."""
    passage = " ".join(f"p{i}" for i in range(14))
    texts = [f"{'é' * 1_000_000} {passage} {'y' * 1_000_000}", "z" * 1_000_000, passage, None, ""]
    for block in (0, 100):
        out = decontaminate.contamination(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), spark.createDataFrame([(5, passage)], "item_id long, text string"), block=block).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in out} == {0: (16, 14, 1), 1: (1, 0, 0), 2: (14, 14, 1), 3: (0, 0, 0), 4: (0, 0, 0)}


def test_contamination_defined_cases(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.contamination(docs(spark), none).collect()
    assert len(out) == len(ODD) and not any(r.contaminated for r in out)
    item = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs(spark), item)
    assert left.columns == docs(spark).columns and left.count() == 5
    assert decontaminate.contamination(docs(spark, []), item).count() == 0


def test_bpe_query_and_round_trip(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op9_byte_bpe(spark, sf).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    coded = bpe.encode(docs(spark), path, public_tokenizers.PATTERN, ids=True)
    for r in bpe.decode(coded, path, public_tokenizers.PATTERN).collect():
        assert r.decoded == (r.text or "") and r.token_ids == own.encode_ordinary(r.text or "")
    assert bpe.encode(docs(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_odd_merge_orders():
    """Rank files in which a merge makes a pair of a lower rank, and overlapping like pairs."""
    rng = np.random.default_rng(5)
    for seed in range(60):
        tokens = [bytes((b,)) for b in range(256)]
        more = sorted({bytes(rng.choice(list(b"ab"), rng.integers(2, 6)).tolist()) for _ in range(10)})
        rng.shuffle(more)
        ranks = {t: i for i, t in enumerate([*tokens, *more])}
        own = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        words = ["".join(rng.choice(list("ab"), rng.integers(1, 24))) for _ in range(30)]
        ids, size = bpe.replay([w.encode() for w in words], bpe.Merges(ranks))
        at = 0
        for w, n in zip(words, size.tolist(), strict=True):
            assert ids[at : at + n].tolist() == own.encode_ordinary(w), (seed, w)
            at += n


def test_bpe_bounds_change_nothing(monkeypatch):
    """However few new words a replay takes and however soon words are forgotten, ids are the library's; a long text in parts too."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = ["The   quick brown fox, isn't it? 12345\n\n  ", "", "na\u00efve \u65e5\u672c\u8a9e  \t x " * 50, "Words of words of it. " * 30]
    for name, value in (("MEMORY", 3), ("NEW_WORDS", 2), ("NEW_CHARS", 5), ("LONG", 20), ("PART", 3), ("IDS", 2)):
        monkeypatch.setattr(bpe, name, value)
        codec = bpe.Codec(path, public_tokenizers.PATTERN)
        for _ in range(2):
            got = [c.tolist() for c in codec.encode(texts)]
            assert got == [own.encode_ordinary(t) for t in texts], name
        assert [b"".join(codec.decode(np.array(c, np.int64))).decode() for c in got] == texts


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    raw = "one two three four " * 40 + "x" * 500 + " one two"
    whole = common.Words([raw.encode(), b"two one"], np.array([b != 32 for b in range(256)]))
    hashes = {}
    for a, b, h in zip(whole.starts.tolist(), whole.ends.tolist(), whole.hashes.tolist(), strict=True):
        assert hashes.setdefault(whole.raw[a:b], h) == h
    assert len(set(hashes.values())) == len(hashes) == 5
    monkeypatch.setattr(common, "HASH_BLOCK", 64)
    small = common.Words([raw.encode(), b"two one"], np.array([b != 32 for b in range(256)]))
    assert small.hashes.tolist() == whole.hashes.tolist()


def test_stretches_join_small_batches_only():
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.string())], names=["text"]) for t in (["a" * 4, None], ["b" * 4], ["c" * 20], [], ["d" * 3, "e" * 3], ["f" * 6])]
    got = [b.column(0).to_pylist() for b in common.stretches(batches, 12)]
    assert sum(got, []) == ["aaaa", None, "bbbb", "c" * 20, "ddd", "eee", "ffffff"]
    assert got == [["aaaa", None, "bbbb"], ["c" * 20], ["ddd", "eee", "ffffff"]]
    assert list(common.stretches([], 12)) == []


def test_batches_are_bounded_and_lose_no_row(spark):
    rows = spark.range(3000).select(F.col("id"), F.repeat(F.lit("x"), 9000).alias("text")).coalesce(1)
    made = common.append_columns(rows, lambda b: {"n": pa.array([b.nbytes] * len(b), pa.int64())}, T.StructType([T.StructField("n", T.LongType())]), ["text"], rows=1 << 30)
    got = made.agg(F.count("*"), F.sum("id"), F.max("n")).first()
    assert got[:2] == (3000, 3000 * 2999 // 2) and got[2] < 1.1 * common.BATCH_BYTES
    assert spark.conf.get(common.BATCH_SETTING) == f"{common.BATCH_BYTES}b"
    spark.conf.set(common.BATCH_SETTING, "1m")  # a session's own bound stays
    try:
        common.small_batches(spark)
        assert spark.conf.get(common.BATCH_SETTING) in ("1m", "1048576b")
    finally:
        spark.conf.unset(common.BATCH_SETTING)
