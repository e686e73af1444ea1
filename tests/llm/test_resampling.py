import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import docs, rows_of  # noqa: F401

from fleetgauge.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]).encode() for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, items):
    """(doc_id, n_features, weight, score, rank, n_words) of every row, one feature at a time."""
    bucket = lambda f: zlib.crc32(f) % 10000
    s, t = Counter(), Counter()
    for counter, texts in ((s, [r[1] for r in rows]), (t, items)):
        for text in texts:
            counter.update(bucket(f) for f in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for doc_id, text in rows:
        words, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, row in enumerate(fit[: 5 * len(fit) // 100], 1):
        row[4] = place
    return sorted(map(tuple, out), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"], r["n_words"]) for r in df.collect()), key=repr)


def made(n, seed=1):
    draw = random.Random(seed)
    words = ["the", "Haus", "élan", "x", "12", "long" * 9, "straße", "ab" * 150, "我们", "A1b2", "eightlet", "ninelette", "sixteenletterswo", "\U0001f600"]
    gaps = [" ", "  ", "\n", ", ", "-", "\x00", "\x7f", "[", "`"]
    return [(i, "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randrange(60)))) for i in range(n)]


@pytest.fixture
def items(spark):
    return lambda texts: spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "item_id long, text string, gain int")


def test_against_brute_force(docs, items):
    rows, target = made(300), [t for _, t in made(20, 2)] + [None, ""]
    df = resampling.resampled(docs(rows), items(target))
    assert got(df) == brute(rows, target)
    assert [t for _, t in df.dtypes[:5]] == ["bigint"] * 5


@pytest.mark.parametrize("stretch", [1, 17, 300])
def test_cuts_make_no_difference(stretch, monkeypatch):
    column = pa.array([t for _, t in made(40)] + ["", None, "one", "a " * 200, "b" * 5000])

    def found():
        out, words = Counter(), Counter()
        for part, rows in resampling.stretches(column):
            words.update(rows[part.own].tolist())
            for n, (last, kept, hashed) in enumerate(part.features(10000)):
                out.update((n, int(rows[i]), int(hashed[k])) for i, k in zip(last, kept))
        return out, words

    whole = found()
    monkeypatch.setattr(resampling, "STRETCH", stretch)
    assert found() == whole
    want = Counter()
    for row, text in enumerate(column.to_pylist()):
        words, _ = features(text)
        want.update((n, row, zlib.crc32(" ".join(words[i : i + n + 1]).encode()) % 10000) for n in range(3) for i in range(len(words) - n))
    assert whole[0] == want


def test_sliced_and_large_columns():
    texts = [t for _, t in made(20)]
    for column in (pa.array(["zz zz", *texts])[1:], pa.array(texts, pa.large_string()), pa.array(texts)[:0]):
        words = sum(len(rows[part.own]) for part, rows in resampling.stretches(column))
        assert words == sum(len(features(t)[0]) for t in column.to_pylist())


def test_crc_of_matrices():
    rows = np.random.default_rng(3).integers(0, 256, (50, 33), dtype=np.uint8)
    assert resampling.crc_matrix(rows).tolist() == [zlib.crc32(r.tobytes()) for r in rows]
    stream, starts, lengths = rows.ravel(), np.array([0, 5, 9, 100, 3]), np.array([7, 1, 7, 400, 0])
    assert resampling.crcs(stream, starts, lengths).tolist() == [zlib.crc32(stream[s : s + n].tobytes()) for s, n in zip(starts, lengths)]


def test_odd_rows(docs, items):
    long = "many different words " * 40_000
    rows = [(1, None), (2, ""), (None, "w " * 30), (None, "w " * 30), (3, "w " * 30), (3, "w " * 30), (4, long), (5, "..."), (6, "w " * 19), (7, "w " * 20)]
    rows += [(100 + i, "equal words " * 12) for i in range(60)]
    target = ["many words"]
    assert got(resampling.resampled(docs(rows), items(target))) == brute(rows, target)
    assert got(resampling.resampled(docs([]), items(target))) == []
    assert got(resampling.resampled(docs(rows[:8]), items([]))) == brute(rows[:8], [])


def test_ties_go_to_the_smaller_id(spark):
    scored = spark.createDataFrame([(i % 50, 30, 7) for i in range(400)] + [(60 + i, 30, 3) for i in range(400)], "doc_id long, n_words long, score long")
    rows = [r for r in resampling.drawn(scored).collect() if r["rank"] is not None]
    assert sorted((r["rank"], r["doc_id"], r["score"]) for r in rows) == [(k, (k - 1) // 8, 7) for k in range(1, 41)]
