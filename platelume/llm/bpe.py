"""Byte-level BPE by corpus-level merge replay.

A task takes its part of the corpus a stretch at a time: the stretch's new distinct words (matches of the
splitting pattern) are laid side by side as one sequence of tokens, an inverted index leads from each
adjacent token pair (by the rank it merges to) to its positions, and merges are applied in rank order to all words at
once. A merge touches its two neighbours' pairs only. If it makes a pair of a lower rank than its own, that
word is done again alone, so each word ends as the rank file's library would have it. Words stay known until the task ends, up to MEMORY of
them, and a stretch ends early at NEW_WORDS new words or NEW_CHARS characters of them, inside a text too; these
bounds change how often a word is replayed, never its result. Memory beyond them grows with the longest text and the longest word.

Defined cases: null text counts as empty and has no ids; special tokens are not recognised, their strings are
ordinary text; a text whose bytes are all unknown can't be, as each byte is a token; no rows give no rows; equal
rows count each; extra columns pass through, and one named like an output is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

#: Words whose ids a task remembers.
MEMORY = 1 << 18
#: New words, and characters of them, that are replayed together at most.
NEW_WORDS, NEW_CHARS = 1 << 17, 1 << 20
#: A longer text's words are taken in parts of this many, a text of LONG characters at most at once.
PART, LONG = 1 << 16, 1 << 19
#: Bytes of text whose words are replayed together, unless bounds on new words come first.
STRETCH = 16 << 20
#: Ids that are turned into bytes at once.
IDS = 1 << 17
OUT = ("n_tokens", "ids_sha256", "decoded_sha256")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """A rank file as arrays: the rank that each adjacent pair of tokens merges to, and each token's bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.to = keys, np.array([pairs[k] for k in keys.tolist()], np.int32)
        self.byte = np.array([ranks[bytes((b,))] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        names = [b""] * size
        for t, r in ranks.items():
            names[r] = t
        self.size = np.array(list(map(len, names)), np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        self.flat = np.frombuffer(b"".join(names), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1 where the pair isn't merged."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (size[0] of them), start[1], .."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def by_word(word: bytes, merges: Merges) -> list[int]:
    """One word alone, its lowest pair first, again and again."""
    parts = [bytes((b,)) for b in word]
    while len(parts) > 1:
        r, i = min((merges.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if r == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [merges.ranks[p] for p in parts]


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The words' ids one after the other, and each word's number of ids."""
    flat = np.frombuffer(b"".join(words), np.uint8)
    n, sizes = len(flat), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    first = np.zeros(n + 1, bool)  # where a word begins
    first[ends - sizes] = first[n] = True
    token = merges.byte[flat]  # -1 once merged into the one before
    token = np.append(token, -2).astype(np.int32)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    index: dict[int, list[np.ndarray]] = {}  # by rank: positions whose token and next one merged to it when they were put here
    heap: list[int] = []

    def put(places: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for r, part in zip(ranks[np.concatenate(([0], cut))].tolist(), np.split(places, cut), strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(heap, r)

    def pairs(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of these positions, those that make a pair with the next one in their word, and its rank."""
        left = left[~first[after[left]]]
        r = merges.rank(token[left], token[after[left]])
        return left[r >= 0], r[r >= 0]

    at, ranks = pairs(np.arange(n, dtype=np.int32))
    if len(at):
        put(at, ranks)
    again: list[np.ndarray] = []
    while heap:
        r = heapq.heappop(heap)
        got = index.pop(r)
        at = np.unique(np.concatenate(got)) if len(got) > 1 else np.sort(got[0])
        at = at[token[at] >= 0]
        right = after[at]
        ok = ~first[right]
        at, right = at[ok], right[ok]
        ok = merges.rank(token[at], token[right]) == r
        at, right = at[ok], right[ok]
        if len(at) > 1 and (touch := right[:-1] == at[1:]).any():
            # overlapping pairs of like tokens: the left one is merged, the next no longer stands
            use, gone = np.ones(len(at), bool), touch.tolist()
            for k in np.flatnonzero(touch).tolist():
                if use[k] and gone[k]:
                    use[k + 1] = False
            at, right = at[use], right[use]
        if not len(at):
            continue
        nxt = after[right]
        # one after the other, each merge would stand beside a next token that this round merges as well
        x = np.where(first[nxt], -1, merges.rank(np.full(len(at), r), token[nxt]))
        if ((x >= 0) & (x < r)).any():
            again.append(at[(x >= 0) & (x < r)])
        token[at], token[right] = r, -1
        after[at] = nxt
        before[nxt] = at
        left = at[~first[at]]
        new, ranks = pairs(np.unique(np.concatenate((at, before[left]))))
        if len(new):
            if (ranks < r).any():  # a pair that had to go first: its word is done again alone
                again.append(new[ranks < r])
            put(new, ranks)
    lone = np.unique(np.searchsorted(ends, np.concatenate(again), side="right")) if again else np.zeros(0, np.int64)
    stays = token[:-1] >= 0
    count = np.add.reduceat(stays, ends - sizes, dtype=np.int64) if n else np.zeros(len(words), np.int64)
    ids = token[:-1][stays]
    # a word that is a token as a whole is that token; so are words that must be done alone put in their place
    other = {k: by_word(words[k], merges) for k in lone.tolist()}
    get = merges.ranks.get
    for k in np.flatnonzero(count > 1).tolist():
        if (w := get(words[k])) is not None:
            other[k] = [w]
    if other:
        starts = np.cumsum(count) - count
        keep_, put_at, values = np.ones(len(ids), bool), [], []
        for k in sorted(other):
            keep_[starts[k] : starts[k] + count[k]] = False
            put_at += [starts[k]] * len(other[k])
            values += other[k]
            count[k] = len(other[k])
        at = np.cumsum(keep_) - keep_
        at = np.append(at, keep_.sum())
        ids = np.insert(ids[keep_], at[put_at], values)
    return ids.astype("<u4"), count


class _Numbers(dict):
    """Numbers words in order of appearance; what is new since the last replay is listed."""

    def __init__(self):
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        self.chars += len(word)
        return n


class Codec:
    """Encodes and decodes texts by a rank file; one to a Python worker, which keeps no words from task to task."""

    _known: dict[tuple[str, ...], Codec] = {}

    def __init__(self, path: str, pattern: str):
        self.merges = Merges(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.ids, self.size, self.start = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @classmethod
    def of(cls, *how: str) -> Codec:
        if how not in cls._known:
            cls._known[how] = cls(*how)
        return cls._known[how]

    def words(self, text: str) -> Iterator[list[str]]:
        """The text's words in order, a part at a time."""
        if len(text) <= LONG:
            yield self.pattern.findall(text)
            return
        found = (m[0] for m in self.pattern.finditer(text))
        while part := list(islice(found, PART)):
            yield part

    def replay(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return replay([w.encode() for w in words], self.merges)

    def digest(self, ids: np.ndarray) -> str:
        return hashlib.sha256(ids.tobytes()).hexdigest()

    def learn(self) -> None:
        """Replays the new words."""
        if self.number.new:
            ids, size = self.replay(self.number.new)
            self.ids, self.size = np.concatenate((self.ids, ids)), np.concatenate((self.size, size))
            self.start = np.cumsum(self.size) - self.size
            self.number.new, self.number.chars = [], 0

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Each text's ids. The texts are a stretch of the corpus, whose new words are replayed together."""
        got: list[list[np.ndarray]] = []
        waiting: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            self.learn()
            for i, p in waiting:
                got[i].append(self.ids[spread(self.start[p], self.size[p])])
            waiting.clear()
            if len(self.number) > MEMORY:
                self.forget()

        for i, t in enumerate(texts):
            got.append([])
            for part in self.words(t):
                waiting.append((i, np.fromiter(map(self.number.__getitem__, part), np.int32, len(part))))
                if len(self.number.new) > NEW_WORDS or self.number.chars > NEW_CHARS:
                    settle()
        settle()
        for parts in got:
            yield parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, "<u4")])

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """The ids' bytes, in blocks."""
        for a in range(0, len(ids), IDS):
            part = ids[a : a + IDS]
            yield self.merges.flat[spread(self.merges.start[part], self.merges.size[part])].tobytes()


def encode_by(docs: DataFrame, codec_of: Callable[[], Codec], text_col: str, ids: bool, text_stays: bool) -> DataFrame:
    """docs with what codec_of()'s codec, one to a worker, says of each text."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        codec = codec_of()
        n, digest, back, all_ids = [], [], [], []
        texts = batch.column(batch.schema.get_field_index(text_col))
        for coded in codec.encode(t.as_py() or "" for t in texts):  # a text at a time is a Python object
            n.append(len(coded))
            digest.append(codec.digest(coded))
            again = hashlib.sha256()
            for part in codec.decode(coded):
                again.update(part)
            back.append(again.hexdigest())
            if ids:
                all_ids.append(coded.astype(np.int32))
        made = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(digest, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
        return made | ({"token_ids": pa.array(all_ids, pa.list_(pa.int32()))} if ids else {})

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * ids
    # the more words are replayed together, the less a replay costs: a stretch is bounded by its bytes alone
    return append_columns(docs, make, T.StructType(fields), [] if text_stays else [text_col], rows=1 << 30, size=STRETCH, end=lambda: codec_of().forget())


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", ids: bool = False, text_stays: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 (of the ids decoded again), and with ids also token_ids.

    ranks: path of a rank file that every executor has, as the installed vocabularies are.
    """
    return encode_by(docs, lambda: Codec.of(ranks, pattern), text_col, ids, text_stays)


def decode(encoded: DataFrame, ranks: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """encoded with decoded: the text of its ids (bytes that are no text are replaced); null ids give the empty text."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        codec = Codec.of(ranks, pattern)
        rows = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
        return {"decoded": pa.array([b"".join(codec.decode(np.array(r or [], np.int64))).decode(errors="replace") for r in rows], pa.string())}

    return append_columns(encoded, make, T.StructType([T.StructField("decoded", T.StringType())]))
