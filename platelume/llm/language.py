"""Language ID by compression: the language whose raw-content zstandard dictionary makes the text smallest.

Each language's dictionary is DICT_BYTES of its own sampled text, lower-cased like the texts. A text is compressed as a whole
with each dictionary at a few levels, whose sizes are summed, as one size in whole bytes tells too little; the smallest wins (ties: the alphabetically first), and the lead over the second, as a share of
the second's size, is the margin. A margin under REJECT marks the row rejected; the best guess is still given.

A language with little text keeps its small dictionary and the others keep theirs whole. As a larger dictionary compresses any
text better, what a smaller one misses is taken off its size: what the larger ones, cut to its length, lose on as long a text in another language.

Defined cases: null text, and text without a letter, is `und` with score 0; with no learned language every text is
`und`; rows alike are judged alike; no rows give no rows; extra columns pass through, and one named like an output is replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, held_out

DICT_BYTES = 110 << 10
#: Twice ROWS texts of a language at most, chosen by a hash, are what its dictionary is cut from; of each PIECE characters at most, from a hashed place on.
ROWS, PIECE = 150, 4000
#: A text's size is the sum of its sizes at these levels: one size in whole bytes often ties.
LEVELS = (2, 6)
REJECT = 0.004
#: A score of one half stands for this margin.
HALF = 0.01
#: Text lengths in bytes that a smaller dictionary's miss is measured at, larger dictionaries that it is measured on, and texts of each.
LENGTHS, LARGER, TRIED = (25, 50, 100, 200, 400, 800, 1600, 3200), 4, 8
OUT = ("held_out", "lang_pred", "score", "margin", "rejected")
_LETTER = regex.compile(r"\p{L}")


@lru_cache(maxsize=8)
def _compressors(dictionaries: tuple[bytes, ...], level: int) -> list:
    made = []
    for d in dictionaries:
        zd = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        zd.precompute_compress(level=level)
        made.append(zstandard.ZstdCompressor(dict_data=zd, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def _sizes(raw: bytes, dictionaries: tuple[bytes, ...]) -> list[int]:
    sizes = [0] * len(dictionaries)
    for level in LEVELS:
        for i, c in enumerate(_compressors(dictionaries, level)):
            sizes[i] += len(c.compress(raw))
    return sizes


def misses(dictionaries: tuple[bytes, ...]) -> list[tuple[float, ...]]:
    """For each dictionary, how many bytes it misses at each of LENGTHS for being smaller than others; nothing for the largest."""
    out: list[tuple[float, ...]] = []
    whole: dict[tuple, list[list[int]]] = {}
    for own in dictionaries:
        larger = tuple(sorted((d for d in dictionaries if len(d) > len(own)), key=len, reverse=True)[:LARGER])
        if not larger:
            out.append((0.0,) * len(LENGTHS))
            continue
        # texts from the larger dictionaries, each tried with the others; with a single larger one, texts from the own
        sources = larger if len(larger) > 1 else (own,)
        starts = [(j, n, max(0, len(s) - n) * k // TRIED) for j, s in enumerate(sources) for n in LENGTHS for k in range(TRIED)]
        texts = [sources[j][at : at + n] for j, n, at in starts]
        key = (larger, sources)
        if key not in whole:
            whole[key] = [_sizes(t, larger) for t in texts]
        cut = tuple(d[: len(own)] for d in larger)
        lost: dict[int, list[int]] = {n: [] for n in LENGTHS}
        for (j, n, _), text, known in zip(starts, texts, whole[key], strict=True):
            lost[n] += [c - w for i, (c, w) in enumerate(zip(_sizes(text, cut), known, strict=True)) if larger[i] is not sources[j]]
        out.append(tuple(max(0.0, float(np.median(lost[n]))) for n in LENGTHS))
    if whole:
        _compressors.cache_clear()
    return out


def judge(text: str | None, languages: list[str], dictionaries: tuple[bytes, ...], missed: list[tuple[float, ...]] | None = None) -> tuple[str, float, float]:
    """(language, score, margin); missed: the misses of the dictionaries, where they are of several sizes."""
    if not languages or not text or not _LETTER.search(text):
        return "und", 0.0, 0.0
    raw = text.lower().encode()
    sizes = _sizes(raw, dictionaries)
    if missed:
        sizes = [n - float(np.interp(len(raw), (0, *LENGTHS), (0.0, *m))) if any(m) else n for n, m in zip(sizes, missed, strict=True)]
    best = min(range(len(sizes)), key=lambda i: (sizes[i], languages[i]))
    if len(sizes) == 1:
        return languages[0], 1.0, 1.0
    second = min(s for i, s in enumerate(sizes) if i != best)
    margin = (second - sizes[best]) / second
    return languages[best], margin / (margin + HALF), margin


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Each language's dictionary, from a bounded sample of rows outside the held-out quarter."""
    own = docs.filter(~held_out(F.col(id_col), 4, 2) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # by the text, so that its copies, whatever their ids, are drawn once and give one piece
    own = own.select(F.col(lang_col).alias("__lang"), F.xxhash64(F.lit(11), text_col).alias("draw"), F.xxhash64(F.lit(12), text_col).alias("place"), F.col(text_col).alias("__text"))
    counts = {r[0]: r[1] for r in own.groupBy("__lang").agg(F.approx_count_distinct("draw", 0.02)).collect()}  # a row a language
    if not counts:
        return {}
    unit = lambda c: F.pmod(F.col(c), F.lit(1 << 30)) / float(1 << 30)
    # more than enough are drawn, and the first of them by their hash are taken
    share = docs.sparkSession.createDataFrame([(k, min(1.0, 3 * ROWS / max(n, 1))) for k, n in counts.items()], "__lang string, __share double")
    start = F.floor(unit("place") * F.greatest(F.length("__text") - PIECE + 1, F.lit(1))).cast("int") + 1
    piece = F.lower(F.substring(F.col("__text"), start, F.lit(PIECE)))
    drawn = own.join(F.broadcast(share), "__lang").filter(unit("draw") < F.col("__share")).select("__lang", unit("draw").alias("u"), "draw", unit("place").alias("place"), piece.alias("piece"))
    once = drawn.groupBy("__lang", "u", "draw").agg(F.min("place").alias("place"), F.min("piece").alias("piece"))
    nth = F.row_number().over(Window.partitionBy("__lang").orderBy("u", "draw"))
    pieces: dict[str, list[tuple[str, float]]] = {}
    for r in once.withColumn("nth", nth).filter(F.col("nth") <= 2 * ROWS).orderBy("__lang", "nth").collect():
        pieces.setdefault(r["__lang"], []).append((r.piece, r.place))
    made = {}
    for lang in sorted(pieces):
        seen = pieces[lang]
        # an even cut of each piece, so that no long one fills the dictionary, from the same hashed place in it
        each = max(256, 2 * DICT_BYTES // max(1, len(seen)))
        made[lang] = "\n".join(p[int(at * max(0, len(p) - each + 1)) :][:each] for p, at in seen).encode()[:DICT_BYTES]
    return {k: v for k, v in made.items() if v}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", text_stays: bool = True) -> DataFrame:
    """docs with held_out, lang_pred, score, margin and rejected."""
    known = tuple(dictionaries.values())
    sent = docs.sparkSession.sparkContext.broadcast((list(dictionaries), known, misses(known)))

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        languages, known, missed = sent.value
        got = [judge(t.as_py(), languages, known, missed) for t in batch.column(batch.schema.get_field_index(text_col))]
        margins = np.array([g[2] for g in got], float)
        return {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64()), "margin": pa.array(margins), "rejected": pa.array(margins < REJECT)}

    new = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return append_columns(docs, make, new, [] if text_stays else [text_col]).withColumn("held_out", held_out(F.col(id_col), 4, 2))
