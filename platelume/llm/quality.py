"""Quality by a factorisation machine (Rendle 2010) over hashed words, structure statistics and metadata.

A text's features are its hashed words (presence, scaled so that their squares sum to one), its structure
statistics (shares of upper case, digits and marks, word and line lengths, repetition, size) and the metadata columns META
of its row, statistics and metadata each cut into BINS bins by the training sample's quantiles, with a bin of its own for metadata that is not there.
A score is the logistic of
  w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2],
linear in the number of features. w and v are fitted by AdaGrad on TRAIN_ROWS labelled rows at most, chosen by
a hash of the id; scoring covers all rows and whole texts.

Defined cases: null text counts as empty and has a score like any text (its statistics are zero); metadata that is null or has no
column is missing; with no labelled rows of either class every score is the prior (0 with no labels at all); rows alike are scored alike,
each; ids may be of any type; no rows give no rows; extra columns pass through, and one named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Words, append_columns, held_out, slices, small_batches, texts_of
from .toxicity import marked, sample

WORD_BITS = 16
WORDS = 1 << WORD_BITS
RANK = 6
BINS = 8
#: Labelled rows that the machine is fitted on.
TRAIN_ROWS = 5000
#: Numeric columns of a document's row that say something about it besides its text.
META = ("n_chars",)
OUT = ("held_out", "score", "predicted")
_SPACE = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
#: Kinds of bytes whose shares are statistics.
_KINDS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", "#$%&*@~^=+<>/\\_{}[]", ".,;:", "\n", "|"]
_KIND = np.zeros(256, np.uint8)
for _i, _chars in enumerate(_KINDS, 1):
    _KIND[[ord(c) for c in _chars]] = _i
_KIND[128:] = len(_KINDS) + 1
#: The kinds' shares, then size, mean and spread of word lengths, shares of distinct words, word pairs and lines, line length.
STATS = len(_KINDS) + 1 + 7
STEP = 1 << 18


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' distinct word buckets one text after the other, each text's number of them, and its statistics."""
    n = len(texts)
    raw = [t.encode() for t in texts]
    w = Words([r.translate(LOWER) for r in raw], _SPACE)
    count = np.diff(w.bounds)
    text = np.repeat(np.arange(n), count)
    bucket = (w.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key = np.unique(text * WORDS + bucket)
    words, own = key % WORDS, np.bincount(key // WORDS, minlength=n)
    # how often a word stands where it stood before it: lines and phrases said again
    inside = text[1:] == text[:-1]
    pair = np.unique(text[1:][inside] * (WORDS * 32) + (bucket[:-1] * 31 + bucket[1:])[inside])
    pairs = np.bincount(pair // (WORDS * 32), minlength=n)

    size = np.array([len(r) for r in raw])
    kinds = np.zeros((n, len(_KINDS) + 2))
    for d, r in enumerate(raw):
        for a in range(0, len(r), STEP):
            kinds[d] += np.bincount(_KIND[np.frombuffer(r, np.uint8, min(STEP, len(r) - a), a)], minlength=kinds.shape[1])
    lines = kinds[:, _KINDS.index("\n") + 1] + 1
    length = (w.ends - w.starts).astype(float)
    total, square = (np.bincount(text, weights=x, minlength=n) for x in (length, length * length))
    many = np.maximum(count, 1)
    mean = total / many
    stats = np.column_stack((
        kinds[:, 1:] / np.maximum(size, 1)[:, None],
        np.log1p(size),
        mean,
        np.sqrt(np.maximum(0, square / many - mean * mean)),
        own / many,
        pairs / np.maximum(1, count - 1),
        np.array([len(set(r.split(b"\n"))) for r in raw]) / lines,
        np.log1p(size / lines),
    ))
    stats[size == 0] = 0
    return words, own, stats


class Machine:
    """One-hot statistics and metadata take the places after the word buckets; a statistic's last bin is for what is missing."""

    def __init__(self, cuts: np.ndarray, seed: int = 1):
        self.cuts = cuts  # (statistics and metadata, BINS - 1)
        size = WORDS + len(cuts) * (BINS + 1)
        self.w0, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, RANK))

    def places(self, stats: np.ndarray) -> np.ndarray:
        """(texts, statistics)"""
        at = np.column_stack([np.where(np.isnan(s), BINS, np.searchsorted(c, s, side="right")) for c, s in zip(self.cuts, stats.T, strict=True)])
        return WORDS + np.arange(len(self.cuts)) * (BINS + 1) + at

    def rows(self, words: np.ndarray, sizes: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and values of all features, one text after the other, and where each text's begin."""
        n, k = stats.shape
        all_sizes = sizes + k
        starts = np.cumsum(all_sizes) - all_sizes
        last = (starts + sizes)[:, None] + np.arange(k)
        at, x = np.empty(int(all_sizes.sum()), np.int64), np.empty(int(all_sizes.sum()))
        is_word = np.ones(len(at), bool)
        is_word[last.ravel()] = False
        at[is_word], x[is_word] = words, np.repeat(1 / np.sqrt(np.maximum(1, sizes)), sizes)
        at[last.ravel()], x[last.ravel()] = self.places(stats).ravel(), 0.5
        return at, x, starts

    def raw(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's value before the logistic, and its sums of v_f x."""
        vx = self.v[at] * x[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        return self.w0 + np.add.reduceat(self.w[at] * x, starts) + 0.5 * ((total * total).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts)), total

    def score(self, words: np.ndarray, sizes: np.ndarray, stats: np.ndarray) -> np.ndarray:
        if not len(sizes):
            return np.zeros(0)
        return _logistic(self.raw(*self.rows(words, sizes, stats))[0])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(words: np.ndarray, sizes: np.ndarray, stats: np.ndarray, labels: np.ndarray, rounds: int = 6, part: int = 32, rate: float = 0.15, penalty: float = 2e-4, seed: int = 1) -> Machine:
    """AdaGrad on the mean log loss of part texts at a time."""
    n, pos = len(labels), int(labels.sum())
    prior = (pos + 1e-9) / max(1, n)
    cuts = np.zeros((stats.shape[1], BINS - 1))
    for k in range(stats.shape[1]):
        known = stats[~np.isnan(stats[:, k]), k]
        if len(known):
            cuts[k] = np.quantile(known, np.arange(1, BINS) / BINS)
    m = Machine(cuts, seed)
    m.w0 = float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
    if not pos or pos == n:
        m.v[:] = 0
        return m
    at, x, starts = m.rows(words, sizes, stats)
    ends = np.append(starts[1:], len(at))
    gw, gv, g0 = np.full(len(m.w), 1e-3), np.full(m.v.shape, 1e-3), 1e-3
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        order = rng.permutation(n)
        for a in range(0, n, part):
            own = order[a : a + part]
            size = ends[own] - starts[own]
            take = np.concatenate([np.arange(starts[i], ends[i]) for i in own.tolist()])
            p, xs, begin = at[take], x[take], np.cumsum(size) - size
            z, total = m.raw(p, xs, begin)
            g = _logistic(z) - labels[own]
            gx = np.repeat(g, size) * xs
            by = np.argsort(p, kind="stable")
            at_new = np.flatnonzero(np.append(True, p[by][1:] != p[by][:-1]))
            some = p[by[at_new]]
            each = np.column_stack((gx, gx[:, None] * (np.repeat(total, size, axis=0) - m.v[p] * xs[:, None])))
            sums = np.add.reduceat(each[by], at_new, axis=0)
            dw, dv = sums[:, 0] + penalty * m.w[some], sums[:, 1:] + penalty * m.v[some]
            gw[some] += dw * dw
            gv[some] += dv * dv
            g0 += float((g * g).sum())
            m.w[some] -= rate * dw / np.sqrt(gw[some])
            m.v[some] -= rate * dv / np.sqrt(gv[some])
            m.w0 -= rate * 0.1 * float(g.sum()) / np.sqrt(g0)
    return m


def _meta(batch: pa.RecordBatch, names: Iterable[str]) -> np.ndarray:
    """Metadata as numbers on a logarithmic scale, NaN where there is none."""
    cols = []
    for name in names:
        i = batch.schema.get_field_index(name)
        got = np.full(len(batch), np.nan) if i < 0 else np.array([np.nan if v is None else float(v) for v in batch.column(i).to_pylist()])
        cols.append(np.sign(got) * np.log1p(np.abs(got)))
    return np.column_stack(cols) if cols else np.zeros((len(batch), 0))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, ...] = META) -> Machine:
    """Only the features of the sampled texts, not the texts, come to the driver."""
    small_batches(docs.sparkSession)
    there = [c for c in meta if c.lower() in {n.lower() for n in docs.columns}]
    ids = marked(labels, label).orderBy(F.xxhash64("id"), "id", "label").limit(most)
    rows = sample(docs, ids, id_col, text_col, *there)
    rows = rows.toDF("id", "label", "text", *there) if there else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, more = texts_of(batch, "text"), _meta(batch, meta)
            for a, b in slices(list(map(len, texts))):
                words, own, stats = features(texts[a:b])
                stats = np.column_stack((stats, more[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(np.split(words, np.cumsum(own)[:-1]), pa.list_(pa.int64())), pa.array(list(stats), pa.list_(pa.float64()))], names=["id", "label", "words", "stats"])

    schema = T.StructType([rows.schema["id"], T.StructField("label", T.IntegerType()), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("stats", T.ArrayType(T.DoubleType()))])
    got = rows.mapInArrow(run, schema).toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    words, stats = got["words"].combine_chunks(), got["stats"].combine_chunks()
    sizes = words.value_lengths().to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    return fit(words.flatten().to_numpy(), sizes, stats.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATS + len(meta)), got["label"].to_numpy().astype(np.int64))


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, ...] = META, text_stays: bool = True) -> DataFrame:
    """docs with held_out, score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    there = [next((c for c in docs.columns if c.lower() == m.lower()), m) for m in meta]

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, more, scores = texts_of(batch, text_col), _meta(batch, there), [np.zeros(0)]
        for a, b in slices(list(map(len, texts))):
            words, own, stats = features(texts[a:b])
            scores.append(sent.value.score(words, own, np.column_stack((stats, more[a:b]))))
        scores = np.concatenate(scores)
        return {"score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))}

    new = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return append_columns(docs, make, new, [] if text_stays else [text_col]).withColumn("held_out", held_out(F.col(id_col), 5, 0))
