"""SentencePiece BPE by vectorised merge rounds.

The words of a stretch of a task's texts (runs of spaces with what follows them, which no piece of the model crosses) lie side
by side in flat arrays of symbols. A round finds each word's least pair rank, merges all its pairs of that rank from the left
on, and closes the gaps; words without a pair leave, and the rounds go on until none is left. A round whose merge makes a pair
that would have come no later than the pair itself (pieces of equal scores, or out of order) is not what one merge after the
other gives: that word is done again alone, as are words of over LONE characters, by a heap of pairs over a linked list.

The model file says how texts are written: a space in front, spaces as U+2581, characters without a piece as byte pieces.
Models that change texts otherwise, or hold pieces that users defined or that are unused, are refused.

Defined cases: null text counts as empty and has no ids; strings that look like control pieces are ordinary text; U+2581 in a
text is a space; runs of spaces stay; no rows give no rows; equal rows count each; extra columns pass through, and one named
like an output is replaced. Memory grows with the longest text and the longest word only.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import IDS, LONG, PART, Codec, encode_by, spread
from .common import append_columns

SPACE = "▁"
#: Longer words are done alone.
LONE = 400
#: No pair.
NONE = np.int32(2**31 - 1)
#: Kinds of pieces and of models in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE_MODEL = 1, 2, 3, 6, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in the wire format of protocol buffers."""

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """A model file as arrays: symbols (pieces, then characters that only occur in pieces), the piece that each pair makes, ranks, bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        trainer, norm = (dict(_fields(next((v for k, v in parts if k == n), b""))) for n in (2, 3))
        names, scores, kinds = [], [], []
        for piece in (dict(_fields(v)) for k, v in parts if k == 1):
            names.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        plain = trainer.get(3, 1) == BPE_MODEL and trainer.get(35, 0) and not trainer.get(24, 0)
        as_is = not norm.get(2, b"") and not norm.get(4, 1) and norm.get(5, 1)
        if not plain or not as_is or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: only BPE models with byte pieces that leave texts as they are and have no user-defined or unused pieces")
        self.prefix = bool(norm.get(3, 1))
        self.size = len(names)
        symbols = {n: i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == NORMAL}
        pieces = dict(symbols)
        for c in sorted(set("".join(pieces)) - set(symbols)):
            symbols[c] = len(names) + len(symbols) - len(pieces)
        self.symbol = np.full(0x110000, -1, np.int32)  # of a character; -1: it is in no piece
        for s, i in symbols.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
        pairs = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.to = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        # equal scores are one rank: the leftmost pair goes first
        self.rank = np.unique(-np.array(scores), return_inverse=True)[1].astype(np.int32)
        self.byte = np.zeros(256, np.int32)
        for i, (n, k) in enumerate(zip(names, kinds, strict=True)):
            if k == BYTE:
                self.byte[int(n[1:-1], 16)] = i
        crossing = any(regex.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.word = regex.compile(".+" if crossing else f"{SPACE}*[^{SPACE}]+|{SPACE}+", regex.DOTALL)
        # what ids are written as
        unknown = trainer.get(44, " ⁇ ".encode())
        own = {NORMAL: lambda n: n.replace(SPACE, " ").encode(), UNKNOWN: lambda n: unknown, CONTROL: lambda n: b"", BYTE: lambda n: bytes((int(n[1:-1], 16),))}
        text = [own[k](n) for n, k in zip(names, kinds, strict=True)]
        self.length = np.array(list(map(len, text)), np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(text), np.uint8)
        self.kind = np.array(kinds)
        self.leads = np.array([n.startswith(SPACE) and k == NORMAL for n, k in zip(names, kinds, strict=True)])

    def made(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair makes and its rank; -1 and NONE where it makes none."""
        if not len(self.keys) or not len(a):
            return np.full(len(a), -1, np.int32), np.full(len(a), NONE)
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(ok, self.to[at], -1), np.where(ok, self.rank[self.to[at]], NONE)


def alone(symbols: list[int], model: Model) -> list[tuple[int, int]]:
    """One word, a merge at a time: the best rank first, the leftmost among equals. (place, symbol) of what stays."""
    n = len(symbols)
    now, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[int] = []

    def put(i: int) -> None:
        if i >= 0 and after[i] < n and (p := model.pairs.get(now[i] << 32 | now[after[i]])) is not None and now[i] >= 0:
            heapq.heappush(heap, int(model.rank[p]) << 32 | i)

    for i in range(n - 1):
        put(i)
    while heap:
        top = heapq.heappop(heap)
        i = top & 0xFFFFFFFF
        j = after[i]
        if now[i] < 0 or j >= n or (p := model.pairs.get(now[i] << 32 | now[j])) is None or model.rank[p] != top >> 32:
            continue  # no longer what was put here
        now[i], now[j] = p, -2
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        put(i)
        put(before[i])
    return [(i, s) for i, s in enumerate(now) if s != -2]


def rounds(symbols: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """Merges the words of the given sizes that lie in symbols one after the other. At each place the symbol that begins there in the end, or -2."""
    out = np.full(len(symbols), -2, np.int32)
    starts = np.cumsum(sizes) - sizes
    redo = np.zeros(len(sizes), bool)
    redo[sizes > LONE] = True
    place = np.flatnonzero(~np.repeat(redo, sizes)).astype(np.int64)
    word = np.repeat(np.arange(len(sizes)), sizes)[place]
    now = symbols[place]
    to = np.full(len(now), -1, np.int32)
    rank = np.full(len(now), NONE)

    def look(at: np.ndarray) -> None:
        """The pairs that begin at these places of the arrays, within their words."""
        at = at[at + 1 < len(now)]
        inner = word[at] == word[at + 1]
        to[at[~inner]], rank[at[~inner]] = -1, NONE
        at = at[inner]
        to[at], rank[at] = model.made(now[at], now[at + 1])

    look(np.arange(len(now)))
    while len(now):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        count = np.diff(np.append(first, len(now)))
        least = np.minimum.reduceat(rank, first)
        live = np.repeat(least != NONE, count)
        if not live.all():
            done = ~live
            out[place[done]] = now[done]
            place, word, now, to, rank = place[live], word[live], now[live], to[live], rank[live]
            least, count = least[least != NONE], count[least != NONE]
            if not len(now):
                break
        at = np.flatnonzero(rank == np.repeat(least, count))
        # of pairs that overlap every second one is merged, from the left
        run = np.concatenate(([True], at[1:] != at[:-1] + 1))
        at = at[(np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
        made, own = to[at], rank[at]
        # what each merge stands beside before those to its right are done
        right = np.minimum(at + 2, len(now) - 1)
        beside = np.where((at + 2 < len(now)) & (word[right] == word[at]), model.made(made, now[right])[1], NONE)
        early = word[at[beside <= own]]
        now[at] = made
        stays = np.ones(len(now), bool)
        stays[at + 1] = False
        at = at - np.arange(len(at))  # each merge before it has taken one place
        place, word, now, to, rank = place[stays], word[stays], now[stays], to[stays], rank[stays]
        look(at)
        left = at[(at > 0)] - 1
        look(left)
        least = own
        early = np.concatenate((early, word[at[rank[at] <= least]], word[left[rank[left] <= own[at > 0]]]))
        if len(early):
            redo[early] = True
            keep = ~redo[word]
            place, word, now, to, rank = place[keep], word[keep], now[keep], to[keep], rank[keep]
    for w in np.flatnonzero(redo).tolist():
        a = int(starts[w])
        out[a : a + int(sizes[w])] = -2
        for i, s in alone(symbols[a : a + int(sizes[w])].tolist(), model):
            out[a + i] = s
    return out


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    if not isinstance(error, UnicodeDecodeError):
        raise error
    return "�", error.start + 1


codecs.register_error("platelume.each_byte", _each_byte)


class PieceCodec(Codec):
    """Encodes and decodes texts by a model file; one to a Python worker."""

    _known: dict[tuple[str, ...], Codec] = {}

    def __init__(self, path: str):
        self.model = Model(path)
        self.forget()

    def words(self, text: str) -> Iterator[list[str]]:
        if not text:
            return
        text = (SPACE if self.model.prefix else "") + text.replace(" ", SPACE)
        if len(text) <= LONG:
            yield self.model.word.findall(text)
            return
        found = (m[0] for m in self.model.word.finditer(text))
        while part := list(islice(found, PART)):
            yield part

    def replay(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        m = self.model
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        got = rounds(m.symbol[points], sizes, m)
        place = np.flatnonzero(got != -2)
        ids = got[place]
        # a character without a piece is written as its bytes
        bare = (ids < 0) | (ids >= m.size)
        if bare.any():
            raw = points[place[bare]].astype("<u4").tobytes().decode("utf-32-le")
            wide = np.fromiter((len(c.encode()) for c in raw), np.int64, len(raw))
            count = np.ones(len(ids), np.int64)
            count[bare] = wide
            place, ids = np.repeat(place, count), np.repeat(ids, count)
            ids[np.repeat(bare, count)] = m.byte[np.frombuffer(raw.encode(), np.uint8)]
        size = np.bincount(np.searchsorted(np.cumsum(sizes), place, side="right"), minlength=len(words))
        return ids.astype("<u4"), size

    def digest(self, ids: np.ndarray) -> str:
        own = hashlib.sha256()
        for a in range(0, len(ids), IDS):
            own.update((b"," if a else b"") + ",".join(map(str, ids[a : a + IDS].tolist())).encode())
        return own.hexdigest()

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """The ids' text in UTF-8, in blocks: without the space in front, and each byte that is no text as U+FFFD."""
        m = self.model
        control = m.kind[ids] == CONTROL if len(ids) else np.zeros(0, bool)
        some = np.flatnonzero(~control)
        cut = m.prefix and len(some) and bool(m.leads[ids[some[0]]])
        for own in np.split(ids, np.flatnonzero(control)):  # no character reaches over a control piece
            reader = codecs.getincrementaldecoder("utf-8")("platelume.each_byte")
            for a in range(0, len(own), IDS):
                part = own[a : a + IDS]
                raw = m.flat[spread(m.start[part], m.length[part])].tobytes()
                if cut and raw:
                    raw, cut = raw[1:], False
                yield reader.decode(raw, a + IDS >= len(own)).encode()


def encode(docs: DataFrame, model: str, text_col: str = "text", ids: bool = False, text_stays: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256 (of the ids in decimal, joined by commas) and decoded_sha256 (of the text that they decode to), and with ids also token_ids.

    model: path of a model file that every executor has, as the installed vocabularies are.
    """
    return encode_by(docs, lambda: PieceCodec.of(model), text_col, ids, text_stays)


def decode(encoded: DataFrame, model: str, ids_col: str = "token_ids") -> DataFrame:
    """encoded with decoded: the text of its ids; null ids give the empty text."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        codec = PieceCodec.of(model)
        rows = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
        return {"decoded": pa.array([b"".join(codec.decode(np.array(r or [], np.int64))).decode() for r in rows], pa.string())}

    return append_columns(encoded, make, T.StructType([T.StructField("decoded", T.StringType())]))
