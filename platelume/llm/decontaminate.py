"""Benchmark decontamination by a prefix-filtered set join with exact verification.

Each item gives windows of WINDOW consecutive words (an item of fewer words is one window), and each window is the set
of its word shingles. All of a window's shingles must occur where the window occurs, so the prefix that
the join has to look at is |w| - |w| + 1 = 1 shingle long: the rarest one, by counts over all documents. The steps are
  1. windows and their shingles, from the items (Spark);
  2. how often each of these shingles occurs in the documents (one pass, summed in each task before the shuffle);
  3. each window's rarest shingle and its place in the window;
  4. the join (one pass, no shuffle): where a document has a prefix shingle, the window must fit between the
     document's first and last word (length and position), and its words must equal the document's.

BLOCK windows at most are broadcast. More are joined instead: the documents are numbered and written once, and read twice, whatever the number of
windows. A table of bits (SIEVE of them at most, whatever the number) rules out most shingles where they are; the others are counted, or go with the words around them
to the places where a window can begin, and the words that then lie there go to the windows. A sieve that lets more through costs time only.
A window of many items is as many rows of ITEMS items or so, each of which counts as a window, so that neither a task nor a join
holds all items of a common passage. Two windows are the same only if their words are.

Defined cases: null and wordless texts have no words, no hits and no items; items without words have no
windows; equal items count each; a null item id is written as the empty string; no items, or no documents, give
zero hits or no rows; extra columns pass through, and one named like an output is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.contract import hot_keys, join_by
from ..functions.scratch import drop, keep
from .common import LOWER, Words, append_columns, numbered, slices, small_batches, texts_of

WINDOW = 13
SHINGLE = 5
#: Windows that are broadcast at most, of about 150 bytes and ITEMS ids at most each.
BLOCK = 150_000
#: Bits of the broadcast table that rules shingles out, as a power of two, at most (32 MB); 16 for each shingle or so while there are fewer.
SIEVE = 28
#: Distinct shingles that a task gathers before it sends their counts on.
GATHER = 1 << 19
#: Ids that a window's row holds, about; a further row holds more of them.
ITEMS = 16
OUT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
#: Word bytes once A-Z is lower-cased: digits, a-z, and every byte of a character above 0x7F.
IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def words_of(texts: list[str]) -> Words:
    return Words([t.encode().translate(LOWER) for t in texts], IS_WORD)


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """items -> (words, width, part, tokens, items): one row a window and ITEMS of its items, tokens being its shingles' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x or "" for x in batch.column(0).to_pylist()]
            for item, text in zip(ids, texts_of(batch, "text"), strict=True):
                w = words_of([text])
                n = len(w.hashes)
                if not n:
                    continue
                width = min(window, n)
                step = min(SHINGLE, width)
                tokens = w.shingles(step).view(np.int64)
                rows = [(item, w.joined(i, i + width), width, tokens[i : i + width - step + 1].tolist()) for i in range(n - width + 1)]
                for k in range(0, len(rows), 5000):
                    cols = list(zip(*rows[k : k + 5000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.int64()))], names=["item", "words", "width", "tokens"])

    small_batches(items.sparkSession)
    source = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    rows = source.mapInArrow(run, "item string, words binary, width int, tokens array<long>")
    rows = keep(rows.groupBy("words", "width", "item").agg(F.first("tokens").alias("tokens")), "item-windows")
    # windows with the same words are one window of several items, whose ids are dealt over parts
    size = rows.groupBy("words").agg(F.ceil(F.count("*") / ITEMS).cast("int").alias("parts"))
    many = size.filter("parts > 1")
    dealt = join_by(rows, many, "words", hot_keys(rows, "words")).withColumn("part", F.coalesce(F.pmod(F.xxhash64("item"), F.col("parts")), F.lit(0)))
    return dealt.groupBy("words", "width", "part").agg(F.first("tokens").alias("tokens"), F.array_sort(F.collect_list("item")).alias("items"))


def shingle_counts(docs: DataFrame, text_col: str, tokens: np.ndarray, widths: list[int]) -> DataFrame:
    """How often each of tokens occurs in docs -> (token, n); each task sums before it sends."""
    near = _Near(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(near.tokens), np.int64)
        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in slices(list(map(len, texts))):
                w = words_of(texts[a:b])
                for width in widths:
                    _, which = near.find(w.shingles(width))
                    counts += np.bincount(which, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(near.tokens[some].view(np.int64)), pa.array(counts[some])], names=["token", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token long, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


class _Near:
    """Which of many hashes are among few: a bit table rules most out before the search."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = np.unique(tokens.astype(np.int64).view(np.uint64))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.tokens >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are there, and which tokens they are."""
        if not len(self.tokens):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[hashes >> np.uint64(44)])
        which = np.searchsorted(self.tokens, hashes[at])
        ok = self.tokens[np.minimum(which, len(self.tokens) - 1)] == hashes[at]
        return at[ok], which[ok]


class Index:
    """Windows by their prefix shingle."""

    def __init__(self, rows: list):
        """rows: (token, offset, width, words, items)"""
        self.near = _Near(np.array([r[0] for r in rows], np.int64))
        places: list[set] = [set() for _ in self.near.tokens]
        by = np.searchsorted(self.near.tokens, np.array([r[0] for r in rows], np.int64).view(np.uint64))
        self.items: dict[bytes, list] = {}
        for i, (_, offset, width, words, items) in zip(by.tolist(), rows, strict=True):
            places[i].add((offset, width))
            self.items.setdefault(words, []).extend(items)
        # where a window with this shingle can begin, and how long it can be: few, however many windows share the shingle
        self.places = [sorted(p) for p in places]
        self.widths = sorted({min(SHINGLE, r[2]) for r in rows})

    def hits(self, w: Words) -> tuple[np.ndarray, list[set]]:
        """Which words lie in an occurring window, and for each text the items whose windows occur."""
        n = len(w.hashes)
        edge = np.zeros(n + 1, np.int64)
        items: list[set] = [set() for _ in range(len(w.bounds) - 1)]
        found: list[set] = [set() for _ in items]
        seen = set()
        for step in self.widths:
            at, which = self.near.find(w.shingles(step))
            text = np.searchsorted(w.bounds, at, side="right") - 1
            for i, t, d in zip(at.tolist(), which.tolist(), text.tolist(), strict=True):
                for offset, width in self.places[t]:
                    start = i - offset
                    # position and length: the window must lie in this text
                    if min(SHINGLE, width) != step or start < w.bounds[d] or start + width > w.bounds[d + 1] or (start, width) in seen:
                        continue
                    words = w.joined(start, start + width)
                    if words in self.items:
                        seen.add((start, width))
                        edge[start] += 1
                        edge[start + width] -= 1
                        if words not in found[d]:
                            found[d].add(words)
                            items[d].update(self.items[words])
        return np.cumsum(edge[:-1]) > 0, items


def block_index(docs: DataFrame, part: DataFrame, text_col: str) -> Index:
    """The index of BLOCK windows at most, which come to the driver."""
    terms = part.select("win", F.posexplode("tokens").alias("offset", "token"))
    tokens = np.array([r[0] for r in terms.select("token").distinct().collect()], np.int64)
    widths = sorted(r[0] for r in part.select(F.least(F.lit(SHINGLE), "width")).distinct().collect())
    counts = shingle_counts(docs, text_col, tokens, widths)
    rarest = terms.join(counts, "token", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), F.col("token"), F.col("offset"))).alias("s"))
    rows = part.join(rarest, "win").select("s.token", "s.offset", "width", "words", "items").collect()
    return Index([(r.token, r.offset, r.width, bytes(r.words), r["items"]) for r in rows])


RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])


def matcher(sent, text_col: str, share: int):
    """What the pass with a broadcast index does with a batch."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = texts_of(batch, text_col)
        n_words, n_hit, n_items, digests = [], [], [], []
        for a, b in slices(list(map(len, texts))):
            w = words_of(texts[a:b])
            hit, items = sent.value.hits(w)
            n_words += np.diff(w.bounds).tolist()
            n_hit += [int(hit[x:y].sum()) for x, y in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)]
            n_items += map(len, items)
            digests += [hashlib.sha256(",".join(sorted(v)).encode()).hexdigest() for v in items]
        n, h = np.array(n_words, np.int64), np.array(n_hit, np.int64)
        return {"n_words": pa.array(n), "n_hit": pa.array(h), "n_items": pa.array(n_items, pa.int64()), "items_sha256": pa.array(digests, pa.string()), "contaminated": pa.array((h > 0) & (share * h >= n))}

    return make


# ---- more windows than can be broadcast -------------------------------------------------------


class Sieve:
    """A table of bits, two for each hash of a set: what it rules out is not in the set."""

    def __init__(self, tokens: DataFrame, limit: int):
        """tokens (token), about limit of them; the table's lines of 4 KB come to the driver, 2^SIEVE bits at most."""
        self.log = min(SIEVE, max(15, (16 * limit).bit_length()))
        places = F.array(F.shiftrightunsigned("token", 64 - self.log), F.shiftrightunsigned("token", 8).bitwiseAND(F.lit((1 << self.log) - 1)))
        at = tokens.select(F.explode(places).alias("p"))
        lines = at.groupBy(F.shiftright("p", 15).alias("line")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("bits"))
        self.bits = np.zeros(1 << (self.log - 3), np.uint8)
        for r in lines.collect():
            self.bits[r.line * 4096 : (r.line + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be in the set."""

        def there(p: np.ndarray) -> np.ndarray:
            return self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1 == 1

        at = np.flatnonzero(there(hashes >> np.uint64(64 - self.log)))
        return at[there(hashes[at] >> np.uint64(8) & np.uint64((1 << self.log) - 1))]


def sieved_counts(docs: DataFrame, text_col: str, sieve, widths: list[int]) -> DataFrame:
    """docs -> (token, n): how often each shingle that the broadcast sieve lets through occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts, fresh, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])

        def summed() -> tuple[np.ndarray, np.ndarray]:
            both, which = np.unique(np.concatenate([tokens, *fresh]), return_inverse=True)
            n = np.zeros(len(both), np.int64)
            np.add.at(n, which, np.concatenate([counts, np.ones(size, np.int64)]))
            return both, n

        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in slices(list(map(len, texts))):
                w = words_of(texts[a:b])
                for width in widths:
                    s = w.shingles(width)
                    fresh.append(s[sieve.value.find(s)])
                    size += len(fresh[-1])
                if size > GATHER:
                    tokens, counts = summed()
                    fresh, size = [], 0
                    if len(tokens) > GATHER:
                        yield sent()
                        tokens, counts = tokens[:0], counts[:0]
        tokens, counts = summed()
        yield sent()

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token long, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, text_col: str, sieve, widths: list[int], window: int, longest: int) -> DataFrame:
    """docs (row, text) -> (row, pos, step, token, at, near): each place of a shingle that the sieve lets through, and the words around it.

    near holds what a window of window words can reach from there, word pos at its place at (from 0). Words of over longest bytes are in no window, and are empty in near.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "pos", "step", "token", "at", "near"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.string())]
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return batch

        for batch in batches:
            rows, texts = batch.column(0).to_pylist(), texts_of(batch, "text")
            for a, b in slices(list(map(len, texts))):
                w = words_of(texts[a:b])
                for step in widths:
                    s = w.shingles(step)
                    at = sieve.value.find(s)
                    text = np.searchsorted(w.bounds, at, side="right") - 1
                    for i, d, token in zip(at.tolist(), text.tolist(), s[at].view(np.int64).tolist(), strict=True):
                        begin, end = int(w.bounds[d]), int(w.bounds[d + 1])
                        if i + step > end:
                            continue
                        x, y = max(begin, i - window + step), min(end, i + window)
                        near = [w.raw[p:q].decode() if q - p <= longest else "" for p, q in zip(w.starts[x:y].tolist(), w.ends[x:y].tolist(), strict=True)]
                        out.append((rows[a + d], i - begin, step, token, i - x, near))
                        if len(out) == 5000:
                            yield made()
        if out:
            yield made()

    schema = "row long, pos long, step int, token long, at int, near array<string>"
    return docs.select("row", F.col(text_col).alias("text")).mapInArrow(run, schema)


def _joined(docs: DataFrame, windows: DataFrame, text_col: str, share: int) -> DataFrame:
    """docs with OUT, by joins; windows: (words, width, part, tokens, items, win)."""

    def counted_words(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = texts_of(batch, text_col)
        return {"n_words": pa.array([n for a, b in slices(list(map(len, texts))) for n in np.diff(words_of(texts[a:b]).bounds).tolist()], pa.int64())}

    context = docs.sparkSession.sparkContext
    docs = keep(append_columns(docs, counted_words, T.StructType(RESULT.fields[:1])).withColumn("row", F.monotonically_increasing_id()), "documents")
    named = windows.groupBy(F.col("words").cast("string").alias("words")).agg(F.first("width").alias("width"), F.first("tokens").alias("tokens"), F.min("win").alias("id"), (F.max("part") + 1).alias("parts"))
    named = keep(named, "named")
    widths = sorted(r[0] for r in named.select(F.least(F.lit(SHINGLE), "width")).distinct().collect())
    window, longest = named.agg(F.max("width"), F.max(F.array_max(F.transform(F.split("words", " "), F.octet_length)))).first()

    # the rarest shingle of each window; one that no document has rules its window out
    terms = named.select("id", "width", F.posexplode("tokens").alias("offset", "token"))
    counts = keep(sieved_counts(docs, text_col, context.broadcast(Sieve(terms, terms.count())), widths), "counts")
    rarest = join_by(terms, counts, "token", hot_keys(terms, "token")).groupBy("id", "width")
    rarest = rarest.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"), F.col("offset"))).alias("s")).filter("s.n > 0")
    prefix = keep(rarest.select("s.token", "s.offset", "width").distinct(), "prefixes")
    # where a window with this shingle can begin, and how long it can be: few, however many windows share the shingle
    places = prefix.groupBy("token").agg(F.collect_set(F.struct("offset", "width")).alias("places"))

    met = keep(candidates(docs, text_col, context.broadcast(Sieve(prefix, prefix.count())), widths, window, longest), "candidates")
    there = join_by(met, places, "token", hot_keys(met, "token")).withColumn("place", F.explode("places"))
    first, width = F.col("at") - F.col("place.offset"), F.col("place.width")
    there = there.filter((F.least(F.lit(SHINGLE), width) == F.col("step")) & (first >= 0) & (first + width <= F.size("near")))
    there = keep(there.select("row", (F.col("pos") - F.col("place.offset")).alias("start"), width.alias("width"), F.array_join(F.slice("near", first + 1, width), " ").alias("words")).distinct(), "there")
    found = join_by(there, named.select("words", "id", "parts"), "words", hot_keys(there, "words")).filter("id IS NOT NULL")
    found = keep(found.select("row", "start", "width", "id", "parts"), "found")
    drop(counts, prefix, met, there)

    # words that a window covers and no earlier one does
    end = F.col("start") + F.col("width")
    before = F.max(end).over(W.partitionBy("row").orderBy("start", "width").rowsBetween(W.unboundedPreceding, -1))
    hits = found.withColumn("more", F.greatest(F.lit(0), end - F.greatest("start", before))).groupBy("row").agg(F.sum("more").alias("n_hit"))
    key = F.struct("id", "part").alias("key")
    links = found.select("row", "id", "parts").distinct().select("row", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part")).select("row", key)
    held = windows.select(F.col("words").cast("string").alias("words"), F.col("part").cast("long").alias("part"), "items")
    held = join_by(held, named.select("words", "id"), "words", hot_keys(held, "words")).select(key, "items")
    ids = join_by(links, held, "key", hot_keys(links, "key")).select("row", F.explode("items").alias("item"))
    ids = ids.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("ids"))
    out = docs.join(hits, "row", "left").join(ids, "row", "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "ids": F.coalesce("ids", F.array().cast("array<string>"))})
    out = out.withColumns({"n_items": F.size("ids").cast("long"), "items_sha256": F.sha2(F.array_join("ids", ","), 256), "contaminated": (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))})
    return out.drop("row", "ids")


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: int = 20, text_stays: bool = True, block: int = BLOCK) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    plain, number, own = numbered(docs)
    return own(_matched(plain, items, number(text_col), item_id, item_text, share, block), OUT, [] if text_stays else [text_col])


def _matched(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, share: int, block: int) -> DataFrame:
    """docs (c0, c1, ..) with OUT."""
    # numbered once and written: a number is a window row's key from here on
    windows = keep(item_windows(items, item_id, item_text).withColumn("win", F.monotonically_increasing_id()), "windows")
    if windows.count() > block:
        return _joined(docs, windows, text_col, share)
    sent = docs.sparkSession.sparkContext.broadcast(block_index(docs, windows, text_col))
    return append_columns(docs, matcher(sent, text_col, share), RESULT)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: int = 20, block: int = BLOCK) -> DataFrame:
    """docs without its contaminated rows; its columns are those of docs."""
    plain, number, own = numbered(docs)
    return own(_matched(plain, items, number(text_col), item_id, item_text, share, block).filter(~F.col("contaminated")))
