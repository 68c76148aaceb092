import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import compression as C


def plain(vectors, parts=8, entries=16, rounds=6):
    """Lloyd's rounds with every distance; vectors by key."""
    parts = min(parts, len(vectors[0]))
    v = np.floor(np.array(vectors, np.float64) * C.SCALE).astype(np.int64)
    bounds = [i * v.shape[1] // parts for i in range(parts + 1)]
    codes, errors, books = [], np.zeros(len(v), np.int64), []
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        x, book = v[:, a:z], v[:entries, a:z].copy()
        for i in range(rounds + 1):
            d = ((x[:, None] - book[None]) ** 2).sum(2)
            near = d.argmin(1)
            if i < rounds:
                for e in range(len(book)):
                    if (near == e).any():
                        book[e] = x[near == e].sum(0) // (near == e).sum()
        codes.append(near)
        errors += d.min(1)
        books.append(book)
    return np.array(codes).T, errors, books


def coded(spark, rows, schema="vec_id long, embedding array<float>, label int", **more):
    fitted = C.fit(spark.createDataFrame(rows, schema).repartition(3), **more)
    return fitted, C.label_errors(C.encode(fitted))


@pytest.mark.parametrize(("n", "d"), [(700, 16), (300, 64), (40, 11), (9, 8), (1, 8), (50, 3)])
def test_equals_plain_rounds(spark, monkeypatch, n, d):
    monkeypatch.setattr(C, "BLOCK_BYTES", 128 * 4 * d)
    r = np.random.default_rng(n)
    v = (r.normal(size=(n, d)) * 0.2 + r.integers(0, 3, (n, 1))).astype(np.float32)
    v[n // 2] = v[0]
    rows = [(i, v[i].tolist(), int(i % 4) if i % 5 else None) for i in range(n)]
    fitted, out = coded(spark, rows)
    codes, errors, books = plain(v)
    got = {x.key: x for x in out.collect()}
    assert all(np.array_equal(a, b) for a, b in zip(fitted.books.entries, books, strict=True))
    assert all(list(got[i].code) == codes[i].tolist() and got[i].error == errors[i] for i in range(n))
    sums = {}
    for _, _, label in rows:
        sums[label] = sum(errors[j] for j in range(n) if rows[j][2] == label)
    assert all(got[i].label_error == sums[rows[i][2]] for i in range(n))


def test_ties_and_equal_vectors(spark):
    """Integers that are few, so that distances tie often, and one vector that is a third of all."""
    r = np.random.default_rng(1)
    v = r.integers(0, 3, (900, 16)).astype(np.float32) / 1024
    v[300:600] = v[7]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    _, out = coded(spark, rows)
    codes, errors, _ = plain(v)
    got = {x.key: x for x in out.collect()}
    assert all(list(got[i].code) == codes[i].tolist() and got[i].error == errors[i] for i in range(len(v)))


def test_nodes_are_assigned_whole_and_leaves_singly():
    r = np.random.default_rng(2)
    centres = r.integers(-4000, 4000, (16, 8))
    parts = (centres[r.integers(0, 16, 4096)] + r.integers(-60, 60, (4096, 8))).astype(np.int64)
    order = C.tree_order(parts)
    assert sorted(order) == list(range(4096))
    tree, book = C.PartTree(parts[order], order, 4000), C.EntryTree(centres.astype(np.int64))
    found = C.assign(tree, book)
    wanted = ((parts[order][:, None] - centres[None]) ** 2).sum(2).argmin(1)
    real = order < 4000
    assert np.array_equal(found.entry, wanted)
    assert np.array_equal(found.count, np.bincount(wanted[real], minlength=16))
    assert np.array_equal(found.total, np.array([parts[order][real & (wanted == e)].sum(0) for e in range(16)]))
    assert found.singly < 2048


def test_rows_that_fall_out_and_odd_keys(spark):
    good = [[0.1 * i + 0.01 * j for j in range(8)] for i in range(6)]
    bad = [None, [], [None] * 8, [float("nan")] + [0.0] * 7, [float("inf")] * 8, [-float("inf")] + [1.0] * 7, [1.0] * 9, [1.0, None] * 4]
    rows = [(i, v, 1, "x") for i, v in enumerate(good)] + [(100 + i, v, 1, "x") for i, v in enumerate(bad)]
    rows += [(None, good[3], None, None), (3, good[3], 2, "x"), (3, good[4], 2, "x")]
    schema = "vec_id long, embedding array<double>, label int, code string"
    _, out = coded(spark, rows, schema)
    got = out.collect()
    assert sorted((r.key is None, r.key or 0) for r in got) == sorted([(False, k) for k in (0, 1, 2, 3, 3, 3, 4, 5)] + [(True, 0)])
    assert sum(r.error for r in got) == 0
    fitted, none = coded(spark, [], schema)
    assert none.count() == 0 and [len(e) for e in fitted.books.entries] == [0]
    assert coded(spark, rows[6:14][:6], schema)[1].count() == 0


def test_string_keys_without_labels_and_decoding(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(200, 12)).astype(np.float32)
    rows = [(f"k{i:03d}", x.tolist(), None) for i, x in enumerate(v)]
    fitted, out = coded(spark, rows, "vec_id string, embedding array<float>, label string", parts=4, entries=32, rounds=3)
    codes, errors, books = plain(v, 4, 32, 3)
    got = {x.key: x for x in out.withColumn("back", C.decoded(F.col("code"), fitted.books)).collect()}
    for i in range(200):
        row = got[f"k{i:03d}"]
        assert list(row.code) == codes[i].tolist() and row.label_error == errors.sum()
        assert row.back == [x / C.SCALE for p in range(4) for x in books[p][codes[i][p]].tolist()]


def test_too_large_components_are_an_error():
    with pytest.raises(ValueError, match="too large"):
        C._images(np.array([1e9]), C.SCALE, 8)
