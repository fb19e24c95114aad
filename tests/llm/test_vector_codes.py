import math

import numpy as np
import pytest
from loanlens.llm import orchard, vector_codes
from loanlens.llm.queries import ORACLE_SQL
from oracle_harness import compare
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType())])


def slow_codes(rows, entries=256, rounds=4, parts=4):
    """{row number: (code, error)} and books, every part against every entry."""
    rows = [(k, i, v) for k, (i, v, _) in enumerate(rows) if v is not None and all(
        x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2]))[:entries]
    whole = {k: [math.floor(1024 * np.float32(x).item()) for x in v] for k, _, v in rows}
    step = len(rows[0][2]) // parts
    cut = lambda k, p: tuple(whole[k][p * step:(p + 1) * step])
    books = [[cut(k, p) for k, _, _ in seeds] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            to = [(nearest(cut(k, p), book)[1], cut(k, p)) for k, _, _ in rows]
            books[p] = [tuple(sum(c) // len(own) for c in zip(*own)) if (own := [x for j, x in to if j == e]) else y
                        for e, y in enumerate(book)]
    out = {}
    for k, _, _ in rows:
        near = [nearest(cut(k, p), books[p]) for p in range(parts)]
        out[k] = ("".join(f"{j:02x}" for _, j in near), sum(d for d, _ in near))
    return out, books


def made(n, width=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 12] + 0.2 * rng.normal(size=width)], int(i % 3))
            for i in rng.permutation(n)]
    rows[3:6] = [(rows[3][0], rows[3][1], None)] * 3  # repeated rows, null labels
    return rows + [(9000, None, 1), (9001, [None] * width, 1), (9002, [float("nan")] + [0.0] * (width - 1), 1),
                   (9003, [float("-inf")] + [0.0] * (width - 1), 2), (None, [0.25] * width, 2)]


def test_orchard_equals_brute_force():
    rng = np.random.default_rng(2)
    for k in (1, 2, 31, 32, 33, 256):
        for width in (1, 2, 16):
            book = rng.integers(-6, 6, (k, width)).astype(np.float64)  # many ties and equal entries
            points = rng.integers(-8, 8, (500, width)).astype(np.float64)
            entry, dist = orchard.Orchard(book).nearest(points)
            every = ((points[:, None] - book) ** 2).sum(2)
            assert (entry == every.argmin(1)).all() and (dist == every.min(1)).all()
    assert [len(x) for x in orchard.Orchard(book).nearest(points[:0])] == [0, 0]


def test_search_passes_over_most_entries():
    rng = np.random.default_rng(3)
    book = np.round(1000 * rng.normal(size=(256, 2)))
    points = book[rng.integers(0, 256, 2000)] + np.round(rng.normal(size=(2000, 2)))
    o, seen = orchard.Orchard(book), []
    plain = o.distances
    o.distances = lambda p, n, e: seen.append(len(p) * len(e)) or plain(p, n, e)
    entry, _ = o.nearest(points)
    assert (entry == ((points[:, None] - book) ** 2).sum(2).argmin(1)).all()
    assert sum(seen) < 0.8 * points.shape[0] * 256


def test_codes_equal_brute_force(spark):
    rows = made(330)
    df = spark.createDataFrame(rows, SCHEMA)
    coded, codes = vector_codes.compress(df)
    want, books = slow_codes(rows)
    got = sorted(map(tuple, coded.select("vec_id", "label", "code", "error").collect()), key=str)
    assert got == sorted(((rows[k][0], rows[k][2], *want[k]) for k in want), key=str)
    assert [[tuple(int(c) for c in e) for e in b] for b in codes.books] == books
    sums = {}
    for k, (_, e) in want.items():
        sums[rows[k][2]] = sums.get(rows[k][2], 0) + e
    assert all(r.label_error == sums[r.label] for r in coded.collect())


def test_query_equals_sql(spark):
    import __spark_entry__ as entry
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        ok, why = compare(entry.queries()["op11_vector_codes"](spark, sf), ORACLE_SQL["op11_vector_codes"], sf)
        assert ok, why


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    coded, codes = vector_codes.compress(empty)
    assert codes is None and vector_codes.code_digest(coded, codes).collect() == []
    only_bad = spark.createDataFrame([(1, None, 1), (2, [None], 2)], SCHEMA)
    assert vector_codes.compress(only_bad)[0].count() == 0
    mixed = spark.createDataFrame([(1, [0.0] * 4, 1), (2, [1.0], 1), (3, [], 1), (4, [1.0] * 4, 1)], SCHEMA)
    got = {r.vec_id: (r.code, r.error) for r in vector_codes.compress(mixed)[0].collect()}
    assert got == {1: ("00000000", 0), 2: (None, None), 3: (None, None), 4: ("01010101", 0)}
    extra = mixed.selectExpr("*", "1 as v", "2 as code", "3 as error", "4 as part", "5 as salt")
    assert vector_codes.compress(extra)[0].columns == ["vec_id", "label", "code", "error", "label_error"]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0, 2.0], 1)], SCHEMA))
    with pytest.raises(ValueError, match="64 bits"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], SCHEMA))
    large = spark.createDataFrame([(1, [0.0] * 4, 1), (2, [400_000.0, 0.0, 0.0, 0.0], 1)], SCHEMA)
    assert {r.error for r in vector_codes.compress(large, entries=1, rounds=0)[0].collect()} == {0, 409_600_000 ** 2}
