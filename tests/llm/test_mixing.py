import random
from collections import Counter

import pytest
from llm_rows import docs, rows_of  # noqa: F401
from pyspark.sql import functions as F

from fleetgauge.llm.mixing import hypergeometric, mix_plan, mixture


def fill(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / share for s in names}
        more = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not more:
            return target
        full |= more


def words(n):
    return " ".join(["w"] * n)


def plan_of(docs, rows):
    return rows_of(mix_plan(docs(rows)))


def test_targets_and_taken_words(docs):
    draw = random.Random(1)
    rows = [(i, words(draw.randint(1, 60)), None, draw.choice(["a", "b", "c", "d", None, "small"] if i % 50 == 0 else ["a", "b", "c", "é"])) for i in range(1500)]
    got = plan_of(docs, rows)
    source = {r[0]: r[3] for r in rows}
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r["size"] == len(rows[r["doc_id"]][1].split())
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    target = fill(sizes)
    for r in got:
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 60
    assert got == plan_of(docs, rows[::-1])


def test_odd_rows(docs):
    rows = [(1, None, None, "a"), (2, "", None, "a"), (3, " \n", None, None), (None, words(5), None, "b"), (5, words(7), None, "b"), (5, words(7), None, "b"), (6, words(30_000), None, "")]
    got = plan_of(docs, rows)
    assert [r["size"] for r in got] == [0, 0, 0, 7, 7, 30_000, 5]
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert plan_of(docs, []) == []
    assert [r["target"] for r in plan_of(docs, [(1, None, None, "a")])] == [0.0]


def test_mixture_repeats_rows(docs):
    rows = [(i, words(10), None, "abc"[i % 3]) for i in range(300)]
    frame = docs(rows)
    copies = {r["doc_id"]: r["copies"] for r in mix_plan(frame).collect()}
    out = mixture(frame)
    assert out.columns == frame.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})


def test_hypergeometric_draws(spark):
    cases = [(10, 20, 12), (0, 5, 3), (5, 0, 3), (7, 7, 14), (3, 4, 0), (1000, 3000, 900)]
    u = (F.col("id") + 0.5) / 2000
    for left, right, drawn in cases:
        row = spark.range(2000).select(
            hypergeometric(F.lit(left).cast("long"), F.lit(right).cast("long"), F.lit(drawn).cast("long"), u).alias("k")
        ).agg(F.avg("k"), F.min("k"), F.max("k"), F.var_pop("k")).first()
        n = left + right
        mean = drawn * left / n
        spread = mean * right / n * (n - drawn) / max(n - 1, 1)
        assert row[0] == pytest.approx(mean, abs=0.02) and row[3] == pytest.approx(spread, rel=0.03, abs=0.01)
        assert max(0, drawn - right) <= row[1] and row[2] <= min(left, drawn)


def test_long_documents_are_passed_over(docs):
    """One document of 40 percent of a source's words, or longer than its target, wherever it is drawn."""
    rows = []
    for k in range(12):
        size, n, long = (100, 299, 20_000) if k % 2 else (10, 900, 6000)
        rows += [(10_000 * k + i, words(size), None, f"s{k:02d}") for i in range(n)] + [(10_000 * k + n, words(long), None, f"s{k:02d}")]
    got = plan_of(docs, rows)
    most = {}
    for r in got:
        most.setdefault(r["doc_id"] // 10_000, []).append(r)
    for some in most.values():
        missed = some[0]["target"] - sum(r["taken"] for r in some)
        least = min(r["copies"] for r in some)
        undrawn = [r["size"] for r in some if r["copies"] == least]
        assert -1 <= missed < min(undrawn)
