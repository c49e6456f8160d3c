"""Vector codes against measuring every entry in every round, and against SQL."""

import hashlib

import numpy as np
import pytest
from platelume.llm import codes, queries
from pyspark.sql import functions as F


def _plain(vectors, parts, entries, rounds):
    """codes, errors and codebooks; vectors in order of their ids."""
    q = np.floor(np.array(vectors, np.float64) * 256).astype(np.int64)
    x = q.reshape(len(q), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d2 = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        near = d2.argmin(2)
        if r < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = x[near[:, p] == e, p]
                    if len(own):
                        books[p, e] = own.sum(0) // len(own)
    return near, d2.min(2).sum(1), books


def _check(rows, vectors, labels, parts, entries, rounds, out, books):
    near, error, plain = _plain(vectors, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, plain.reshape(-1).tolist())).encode()).hexdigest()
    assert (books.books == plain).all() and books.sha256 == digest
    total = {}
    for label, e in zip(labels, error.tolist(), strict=True):
        total[label] = total.get(label, 0) + e
    want = {i: (bytes(n.tolist()).hex(), e, total[label], digest) for i, n, e, label in zip(rows, near, error.tolist(), labels, strict=True)}
    got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in out.collect()}
    assert got == want


@pytest.mark.parametrize(("spread_", "entries", "rounds", "width"), [(0.2, 64, 2, 4), (300.0, 40, 4, 2), (0.01, 64, 3, 1), (0.5, 2, 2, 4)])
def test_against_every_distance(spark, spread_, entries, rounds, width):
    """Far and close vectors (bounds that saturate, ties, bounds of 0), many rounds, few entries."""
    rng = np.random.default_rng(int(spread_ * 100) + rounds)
    n, parts = 700, 16
    middle = rng.normal(0, spread_, (12, parts * width))
    vectors = (middle[rng.integers(0, 12, n)] + rng.normal(0, spread_ / 3, (n, parts * width))).astype(np.float32)
    vectors[5:9] = vectors[4]
    labels = [None if i % 7 == 0 else i % 3 for i in range(n)]
    rows = spark.createDataFrame([(i, v.tolist(), x) for i, (v, x) in enumerate(zip(vectors, labels, strict=True))], "vec_id long, embedding array<float>, label int")
    out, books = codes.fit(rows.repartition(3), parts=parts, entries=entries, rounds=rounds)
    _check(range(n), vectors, labels, parts, entries, rounds, out, books)


def test_bounds_hold():
    """Whatever moves, what was written never lies above a true distance, and b shrinks to what is needed."""
    rng = np.random.default_rng(9)
    x, book = rng.integers(-900, 900, (400, 4)), rng.integers(-900, 900, (64, 4))
    made, _ = codes.Bounds.measured(x, book, 16)
    for step in (0, 3, 40, 400):
        new = codes.Codebooks((book + rng.integers(-step, step + 1, book.shape))[None])
        way = new.ways(codes.Codebooks(book[None]))[0]
        book = new.books[0]
        made, d2, used = made.after(x, book, way)
        made = made.cut(12)
        low = codes.unpacked(codes.packed(made.low))
        true = np.sqrt(codes.distances(x, book))
        assert (d2 == codes.distances(x, book).min(1)).all() and (used >= -1).all()
        near = np.take_along_axis(true, made.near, 1)
        assert (low[:, :-1] <= near + 1e-9).all() and (np.diff(low, axis=1) >= 0).all()
        rest = true.copy()
        np.put_along_axis(rest, np.concatenate((made.near, made.entry[:, None]), 1), np.inf, 1)
        assert (low[:, -1] <= rest.min(1) + 1e-9).all()
        made = codes.Bounds(made.entry, made.near, low)


def test_cases(spark):
    """Nulls, NaN, infinities, other lengths, extreme components, clashing names, repeated and null ids, no rows."""
    good = [[float(i % 5) / 8] * 16 for i in range(70)]
    rows = [(i, v, 1) for i, v in enumerate(good)] + [(100, None, 1), (101, [None] + [0.5] * 15, 1), (102, [float("nan")] + [0.5] * 15, 1), (103, [float("-inf")] * 16, 1), (104, [], 1), (105, [0.5] * 32, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    wide = df.select("vec_id", F.lit("own").alias("CODE"), F.col("embedding").alias("Embedding"), "label", F.lit(7).alias("c2"), F.lit(8).alias("q"))
    out, books = codes.fit(wide)
    assert out.columns == ["vec_id", "label", "c2", "q", "code", "error", "label_error", "codebooks_sha256"]
    assert {r.q for r in out.collect()} == {8}
    _check(range(70), good, [1] * 70, 16, 64, 2, out, books)
    back = codes.restored(out, books).collect()
    assert all(np.abs(np.array(r.restored) - good[r.vec_id]).max() <= 1 / 256 for r in back)

    twins = spark.createDataFrame([(3, [2.0] * 16, None), (3, [1.0] * 16, None), (None, [0.0] * 16, 1), (4, [-1e30] * 16, 1), (5, [1e30] * 16, 1)], "vec_id long, embedding array<double>, label int")
    out, books = codes.fit(twins, entries=2)
    assert (books.books == _plain([[v] * 16 for v in (1.0, 2.0, -32768.0, 32768.0, 0.0)], 16, 2, 2)[2]).all()
    assert out.count() == 5 and out.filter("error < 0").isEmpty()
    assert [r.restored for r in codes.restored(out.limit(1).withColumn("code", F.lit(None).cast("string")), books).collect()] == [None]
    assert codes.fit(df.limit(0))[0].count() == 0 and codes.fit(df.filter("vec_id > 99 AND vec_id < 105"))[0].count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.fit(df.filter("vec_id < 9"), parts=5)


def test_query_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = queries.op12_vector_codes(spark, sf)
    found = con.execute(queries.ORACLE["op12_vector_codes"])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())
