import numpy as np
from llm_rows import rows_of

from fleetgauge.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    def sound(r):
        v = r[1]
        return r[0] is not None and r[2] is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.float32(r[1]).astype(float) / np.linalg.norm(np.float32(r[1]).astype(float)) if sound(r) else None for r in rows]
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    found = [least.get(find(i)) for i in range(n)]
    return sorted(((r[0], links[i], found[i], found[i] == r[0]) for i, r in enumerate(rows)), key=repr)


def check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rep", "2 AS least", "3 AS many", "4 AS node", "5 AS bucket")
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows_of(embedding_dedup.near_vectors(frame), "vec_id")]
    assert sorted(got, key=repr) == brute(rows)


def clusters(seed=0, dims=64, sizes=(30, 8, 2, 2, 1, 1, 1, 1), labels=3, noise=0.12):
    draw = np.random.default_rng(seed)
    rows = []
    for label in range(labels):
        for size in sizes:
            center = draw.standard_normal(dims)
            center /= np.linalg.norm(center)
            for _ in range(size):
                rows.append((len(rows), (center + noise * draw.standard_normal(dims) / dims**0.5).tolist(), label))
    return [rows[i] for i in draw.permutation(len(rows)).tolist()]


def test_like_brute_force(spark):
    check(spark, clusters())


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 6)
    check(spark, clusters(3, sizes=(40, 25, 3)))


def test_other_lengths(spark):
    check(spark, clusters(1, dims=7, sizes=(4, 2, 1), labels=2) + [(900 + i, [1.0 + i / 1000, 2.0], 0) for i in range(3)] + [(990, [5.0], 0), (991, [3.0], 0), (992, [-3.0], 0)])


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    check(spark, [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0, 0.0], 0), (4, [1.0, None, 2.0], 0), (5, [float("nan"), 1.0, 1.0], 0), (6, [float("inf"), 1.0, 1.0], 0),
        (7, one, None), (8, one, None), (9, one, 0), (10, one, 0), (10, one, 0), (11, one, 1), (None, one, 0), (12, [2.0, 4.0, 6.0], 0), (13, [1e30, 2e30, 3e30], 0),
        (14, [-0.0, 1.0, 0.0], 0), (15, [0.0, 1.0, 0.0], 0),
    ])
    check(spark, [])


def test_copies_of_one_vector(spark):
    check(spark, [(i, [0.5, 0.25, 0.125], 0) for i in range(300)] + [(400, [0.5, 0.25, 0.13], 0)])


def test_recall_at_the_limit():
    draw = np.random.default_rng(0)
    a = draw.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = draw.standard_normal((2000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    found = embedding_dedup.buckets(a)[:, :, :, None] == embedding_dedup.buckets(0.98 * a + (1 - 0.98**2) ** 0.5 * b)[:, :, None, :]
    assert found.any(axis=(1, 2, 3)).mean() > 0.999
