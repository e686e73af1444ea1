import math
from fractions import Fraction

import numpy as np
import pytest

from fleetgauge.llm import jacobi_davidson, whitening
from fleetgauge.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute(rows, components=4):
    """{(place of the row, component): (n, deviation, |whitened|, explained)} from a whole covariance matrix."""
    usable = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(dims)]
    mean = [Fraction(s, n) for s in sums]
    centred = np.array([[float(x[j] - mean[j]) for j in range(dims)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, x in usable:
        c = np.array([float(x[j] - mean[j]) for j in range(dims)])
        for k in range(min(components, dims)):
            e = values[-1 - k]
            out[i, k + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), abs(c @ vectors[:, -1 - k]) / math.sqrt(e), e / values.sum())
    return out


def check(got, want):
    assert set(got) == set(want)
    for key, row in got.items():
        n, deviation, size, explained = want[key]
        assert (row["n"], row["deviation"]) == (n, deviation if deviation < 1 << 63 else None)
        assert abs(abs(row["whitened"]) - size) < 1e-9 and abs(row["explained"] / explained - 1) < 1e-11
        assert row["identity_error"] < 1e-12


@pytest.fixture
def frame(spark):
    def build(vectors):
        rows = [(i, v and [None if c is None else float(c) for c in v], "x", 1) for i, v in enumerate(vectors)]
        return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, wide int").repartition(3)

    return build


def test_against_brute_force(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    got = {}
    for row in QUERIES["op11_jacobi_davidson"](spark, FOLDER).collect():
        got[[r["vec_id"] for r in table].index(row["vec_id"]), row["component"]] = row
    check(got, brute([r["embedding"] for r in table]))
    # One sign for all rows of a component.
    mean = np.mean([[got[i, k]["whitened"] for k in range(1, 5)] for i in range(len(table))], axis=0)
    assert np.abs(mean).max() < 1e-9


@pytest.mark.parametrize("name", ["spread", "clustered", "rank", "small"])
def test_pairs_of_matrices(name):
    draw = np.random.default_rng(5)
    size = 5 if name == "small" else 90
    values = {
        "spread": np.linspace(1, 50, size),
        "clustered": np.append(np.linspace(1, 2, size - 5), [9, 9, 9 + 1e-9, 9 + 1e-7, 9 - 1e-8]),
        "rank": np.append(np.zeros(size - 3), [1e-9, 5, 1e6]),
        "small": np.array([1.0, 2, 3, 3, 8]),
    }[name]
    turned = np.linalg.qr(draw.standard_normal((size, size)))[0]
    matrix = turned * values @ turned.T
    matrix = (matrix + matrix.T) / 2
    calls = []

    def product(block):
        calls.append(block.shape[1])
        return matrix @ block

    found, vectors = jacobi_davidson.largest_pairs(product, size, 4)
    largest = values.max()
    assert np.abs(found - np.sort(values)[::-1][:4]).max() < 1e-13 * largest
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13
    assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() < 4 * size * 2.3e-16 * largest
    assert max(calls) <= 20


def test_minres_solves_indefinite_systems():
    draw = np.random.default_rng(7)
    turned = np.linalg.qr(draw.standard_normal((12, 12)))[0]
    matrix = turned * np.array([-3, -2, -1.5, -1, -0.5, 0.5, 1, 1.5, 2, 2.5, 3, 4]) @ turned.T
    target = np.hstack([draw.standard_normal((12, 3)), np.zeros((12, 1))])
    x = jacobi_davidson.minres(lambda v: matrix @ v, target, 40, 1e-13)
    assert np.abs(matrix @ x - target).max() < 1e-10


def test_odd_rows(frame):
    draw = np.random.default_rng(9)
    vectors = [list(map(float, v)) for v in draw.standard_normal((40, 6)) * [5, 4, 3, 2, 1, 1]]
    vectors[30:33] = [vectors[2]] * 3
    vectors[33] = [c + 1e-7 for c in vectors[3]]
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0, 5.0], [1.0, math.nan, 0, 0, 0, 0], [math.inf, 0.0, 0, 0, 0, 0]]
    df = frame(vectors + bad)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whitened(df).collect()}
    check(got, brute(vectors))
    # Vectors of another length are left out; so are the empty table and equal vectors, which have no variance.
    mixed = {(r["vec_id"], r["component"]): r for r in whitening.whitened(frame(vectors + [[1.0, 2.0]] * 9 + [[3.0]])).collect()}
    assert {k: v["deviation"] for k, v in mixed.items()} == {k: v["deviation"] for k, v in got.items()}
    assert whitening.whitened(frame([])).count() == 0
    assert whitening.whitened(frame([[1.0, 2.0]] * 5)).count() == 0
    assert whitening.whitened(frame(bad)).count() == 0


def test_fewer_dimensions_and_wide_entries(frame):
    check({(r["vec_id"], r["component"]): r for r in whitening.whitened(frame([[1.0, 5.0], [2.0, 3.0], [4.5, 4.5], [-0.001, 0.0]])).collect()}, brute([[1.0, 5.0], [2.0, 3.0], [4.5, 4.5], [-0.001, 0.0]]))
    wide = [[1e6 * i, 3e5 * i * i, 2e5 * (i % 3)] for i in range(9)]
    check({(r["vec_id"], r["component"]): r for r in whitening.whitened(frame(wide)).collect()}, brute(wide))
    # Beyond a long: entries stay at the greatest one, and the exact deviation is null.
    far = whitening.whitened(frame([[1e300, 1.0], [-1e300, 2.0], [0.0, 3.0]])).collect()
    assert far and all(r["deviation"] is None for r in far if r["vec_id"] < 2)


def test_repeated_ids_and_floats(spark):
    df = spark.createDataFrame([(1, [0.1, 2.0]), (1, [0.1, 2.0]), (None, [3.0, 1.0]), (2, [0.5, 0.25])], "vec_id int, embedding array<float>")
    rows = whitening.whitened(df).collect()
    assert len(rows) == 8 and {r["n"] for r in rows} == {3}
