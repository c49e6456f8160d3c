"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios (Wang and Manning 2012).

A text's features are which character n-grams (NGRAMS long, lower-cased, hashed to BUCKETS) it has, over the whole
text. On the training sample, each gram's ratio r is the log of its smoothed share in toxic over that in clean texts, taken
in full where it stands SURE standard errors off the common share and less, by the square, where it is less sure. A logistic
regression with an L2 penalty is fitted on presence times r over all buckets; a score is read off r * weight per gram.

The classifier is fitted on TRAIN_ROWS labelled rows of each class at most, chosen by a hash of the id; the intercept is put right
for the classes' shares among all labelled rows outside the held-out fifth. Scoring covers all rows.

Defined cases: null text counts as empty, and the empty text has the score of the bare intercept; with no labelled
rows of either class every score is the prior (0 with no labels at all); rows with the same id or text are scored
alike, each; ids may be of any type; no rows give no rows; extra columns pass through, and one named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, held_out, numbered, slices, small_batches, texts_of

NGRAMS = (1, 2, 3, 4, 5)
BITS = 18
BUCKETS = 1 << BITS
#: Labelled rows of each class (1: toxic) that the classifier is fitted on.
TRAIN_ROWS = {1: 1000, 0: 3000}
SURE = 6.0
#: Texts are read in stretches of this many characters, which overlap by a gram.
STRETCH = 1 << 17
OUT = ("held_out", "score", "predicted")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str) -> Iterator[np.ndarray]:
    """Hash bucket of each character n-gram, repeats included, a stretch of the text at a time."""
    low = text.lower()
    for a in range(0, max(1, len(low)), STRETCH):
        chars = np.frombuffer(low[a : a + STRETCH + max(NGRAMS) - 1].encode("utf-32-le"), np.uint32).astype(np.uint64)
        h, out = np.zeros(len(chars) + 1, np.uint64), []
        for n in range(1, max(NGRAMS) + 1):
            h = h[:-1] * np.uint64(0x100000001B3) + chars[n - 1 :] if len(chars) >= n else h[:0]
            if n in NGRAMS:
                own = h[:STRETCH]
                out.append((((own ^ (own >> np.uint64(29))) * _MULTIPLY + np.uint64(n)) * _MULTIPLY >> np.uint64(64 - BITS)).astype(np.int32))
        yield np.concatenate(out)


def gram_set(text: str, seen: np.ndarray) -> np.ndarray:
    """Each bucket that the text has, once; seen is a worker's own array of BUCKETS places, used again and again."""
    parts = []
    for buckets in grams(text):
        at = np.arange(len(buckets), dtype=np.int32)
        seen[buckets] = at
        parts.append(buckets[seen[buckets] == at])
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept
        self.seen = np.zeros(len(weights), np.int32)

    def score(self, text: str) -> float:
        z = self.intercept + float(self.weights[gram_set(text, self.seen)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def ratios(toxic: np.ndarray, clean: np.ndarray, pos: int, n: int) -> np.ndarray:
    """Each bucket's log-count ratio, by how sure it is, from how many texts of each class have it; 0 for buckets never seen."""
    ratio = np.log(((toxic + 1) / (pos + 2)) / ((clean + 1) / (n - pos + 2)))
    share = (toxic + clean) / n
    off = np.abs(toxic / pos - share) / np.sqrt(share * (1 - share) / pos + 1e-9)
    return np.where(toxic + clean > 0, ratio * np.minimum(1, off / SURE) ** 2, 0)


def fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, rounds: int = 16, parts: int = 8, penalty: float = 3.0, rate: float = 0.05, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic regression, by Adam on parts of the rows in turn.

    rows: which buckets each text has, each a feature of value ratio; emptied, as the parts take the rows' place.
    """
    n, pos = len(labels), int(labels.sum())
    rng = np.random.default_rng(seed)
    parts = max(1, min(parts, n))
    order, own = rng.permutation(n), []
    for k in range(parts):
        at = np.sort(order[k::parts])
        size = np.array([len(rows[i]) for i in at.tolist()])
        own.append((np.concatenate([rows[i] for i in at.tolist()]), np.cumsum(size) - size, size, labels[at]))
    rows.clear()
    w, b = np.zeros(len(ratio)), float(np.log(pos / (n - pos)))
    m, v, mb, vb, t = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
    for _ in range(rounds):
        for k in rng.permutation(parts).tolist():
            t += 1
            col, at, size, y = own[k]
            g = 1 / (1 + np.exp(-np.clip(b + np.add.reduceat((w * ratio)[col], at), -60, 60))) - y
            gw = ratio * np.bincount(col, weights=np.repeat(g, size), minlength=len(w)) / len(y) + penalty * w / n
            gb = float(g.mean())
            m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            step, c1, c2 = rate * (1 - (t - 1) / (rounds * parts)), 1 - 0.9**t, 1 - 0.999**t
            w -= step * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            b -= step * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def marked(labels: DataFrame, label: str, mod: int = 5, id_col: str = "doc_id") -> DataFrame:
    """(id, label 0 or 1) of what is labelled outside the held-out fifth; an id with both labels has both rows."""
    plain, number, _ = numbered(labels)
    marks = plain.select(F.col(number(id_col)).alias("id"), F.col(number(label)).alias("label")).filter("label is not null and id is not null")
    return marks.select("id", (F.col("label").cast("int") == 1).cast("int").alias("label")).distinct().filter(~held_out(F.col("id"), mod, 0))


def sample(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, label, text, more..) of the documents with these ids, a bounded number of them; repeated rows of an id count once."""
    plain, number, _ = numbered(docs)
    own = plain.select(F.col(number(id_col)).alias("id"), F.coalesce(F.col(number(text_col)), F.lit("")).alias("text"), *[F.col(number(c)).alias(f"more{i}") for i, c in enumerate(more)])
    rows = own.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.min(F.struct("text", *[f"more{i}" for i in range(len(more))])).alias("s"))
    return rows.select("id", "label", "s.*")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: dict[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """To the driver come the buckets of the sampled texts, not the texts."""
    small_batches(docs.sparkSession)
    marks, most = marked(labels, label), most or TRAIN_ROWS
    shares = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    by = lambda k: marks.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(most[k])
    rows = sample(docs, by(1).unionByName(by(0)), id_col, text_col)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            for a, b in slices([1] * len(batch), 100):
                own = batch.slice(a, b - a)
                got = [np.sort(gram_set(t.as_py(), seen)) for t in own.column(2)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(got, pa.list_(pa.int32()))], names=["id", "label", "features"])

    schema = T.StructType([rows.schema["id"], T.StructField("label", T.IntegerType()), T.StructField("features", T.ArrayType(T.IntegerType()))])
    got = rows.mapInArrow(pick, schema).toArrow()
    order = pc.sort_indices(got.select(["id", "label"]), [("id", "ascending"), ("label", "ascending")]).to_numpy()
    y = got["label"].to_numpy()[order]
    n, pos = len(y), int(y.sum())
    weights = np.zeros(BUCKETS)
    if not pos or pos == n:
        prior = (pos + 1e-9) / max(1, n)
        return Model(weights, float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    column = got["features"].combine_chunks()
    del got
    flat, at = column.values.to_numpy(), column.offsets.to_numpy()
    texts = [flat[at[i] : at[i + 1]] for i in order.tolist()]
    counts = np.zeros((2, BUCKETS))
    for text, k in zip(texts, y.tolist(), strict=True):
        counts[k, text] += 1
    ratio = ratios(counts[1], counts[0], pos, n)
    del column, flat, text
    w, b = fit(texts, y, ratio)
    return Model(w * ratio, b + float(np.log(shares[1] / shares[0]) - np.log(pos / (n - pos))))


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", text_stays: bool = True) -> DataFrame:
    """docs with held_out, score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        scores = np.array([sent.value.score(t) for t in texts_of(batch, text_col)], float)
        return {"score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))}

    new = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return append_columns(docs, make, new, [] if text_stays else [text_col]).withColumn("held_out", held_out(F.col(id_col), 5, 0))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows predicted toxic; its columns are those of docs."""
    plain, number, own = numbered(docs)
    return own(score(plain, model, threshold, number(id_col), number(text_col)).filter("predicted = 0"))
