import random

import numpy as np
import pytest
import xxhash
from llm_rows import docs, rows_of  # noqa: F401

from fleetgauge.llm import simhash
from fleetgauge.llm.components import components


def print_of(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ")
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def check(docs, rows):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(simhash.near_copies(docs(rows)))]
    prints = [print_of(t) for _, t in rows]
    want = zip([d for d, _ in rows], [f"{p:016x}" for p in prints], classes([d for d, _ in rows], prints))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def some_rows():
    draw = random.Random(5)
    rows = []
    for i in range(60):
        words = [draw.choice("abcdefghij") * draw.randint(1, 4) for _ in range(draw.randint(1, 200))]
        for k in range(draw.choice([1, 1, 4])):
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
            words[draw.randrange(len(words))] = "Éa" + str(k)
    return rows


def test_like_brute_force(docs):
    check(docs, some_rows())


def test_odd_rows(docs):
    check(docs, [(5, None), (3, ""), (9, " \n"), (1, "One"), (2, "one"), (None, "one"), (2, "one"), (None, "lone some text here now"),
                 (7, "a b c"), (8, "a\x0bb\x1cc"), (10, "w " * 30_000), (11, "w " * 30_001 + "x")])
    check(docs, [])


def ball(n, seed=1, center=0x0123456789ABCDEF):
    draw = random.Random(seed)
    return np.unique(np.array([center ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))) for _ in range(n)], np.uint64))


@pytest.mark.parametrize("tile", [4096, 16])
def test_links_of_a_dense_group(spark, monkeypatch, tile):
    """Small tiles force the way of too large buckets."""
    monkeypatch.setattr(simhash, "TILE", tile)
    draw = np.random.default_rng(2)
    prints = np.unique(np.concatenate([ball(150), ball(60, 2, 0xFFFF0000FFFF0000), draw.integers(0, 1 << 64, 300, np.uint64)]))
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()}
    signed = prints.view(np.int64).tolist()
    by_class = {}
    for p, c in zip(signed, classes(list(range(len(prints))), [int(p) for p in prints])):
        by_class.setdefault(c, []).append(p)
    for members in by_class.values():
        assert {roots.get(p, p) for p in members} == {min(members)}


def test_one_of_each(docs):
    rows = some_rows() + [(None, "x y"), (4000, "x y"), (4001, "x y")]
    frame = docs(rows)
    out = simhash.one_of_each(frame)
    assert out.columns == frame.columns
    want = classes([d for d, _ in rows], [print_of(t) for _, t in rows])
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted((d for (d, _), c in zip(rows, want) if d is None or d == c), key=repr)


def test_one_of_each_with_repeated_ids(docs):
    """Id 2 is a copy in one group and stands for another; id 7 has both texts of its group."""
    rows = [(1, "a b c"), (2, "A b c"), (2, "other words stand here"), (3, "Other words stand here"), (7, "lone"), (7, "Lone"), (2, "Lone")]
    out = [(r["doc_id"], r["text"]) for r in simhash.one_of_each(docs(rows[:-1])).collect()]
    assert len(out) == 3 and {(1, "a b c"), (2, "other words stand here")} < set(out) and {r[1].lower() for r in out} >= {"lone"}
    out = [(r["doc_id"], r["text"]) for r in simhash.one_of_each(docs(rows)).collect()]
    assert sorted(out) == [(1, "a b c"), (2, "Lone"), (2, "other words stand here")]


def test_components(spark):
    links = [(1, 2), (2, 1), (2, 3), (9, 9), (10, 11), (None, 4)] + [(i, i + 1) for i in range(100, 200)] + [(500, 500 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 11: 10, **{i: 100 for i in range(101, 201)}, **{500 + i: 500 for i in range(1, 50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_round_of_components_shuffles_little(spark):
    from fleetgauge.llm.components import _stars

    links = spark.createDataFrame([(2, 1), (3, 2), (5, 4), (9, 3), (9, 8)], "a long, b long")
    made = _stars(links)
    assert sorted(map(tuple, made.collect())) == [(2, 1), (3, 1), (5, 4), (8, 2), (9, 2)]
    # Links are shuffled for the join on b, its distinct rows by a, and the result; subtrees that recur count again.
    assert plan_of(_stars(links)).count("Exchange hashpartitioning(") <= 10


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
