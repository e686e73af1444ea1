import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from llm_rows import docs, rows_of  # noqa: F401

from fleetgauge.llm import lm_score, storage

FOLDER = "/root/testdata/sf0.001"


def brute(rows):
    """(n_tokens, n_known, tokens, base, score) of each row, by plain counting."""
    lines = [(d, (t or "").encode().lower().split() + [b"\n"]) for d, t in rows]
    single, pairs, starts = Counter(), Counter(), 0
    for d, line in lines:
        if d is not None and zlib.crc32(str(d).encode()) % 5 != 1:
            starts += 1
            single.update(line)
            pairs.update(zip([b"\t", *line], line))
    tokens, distinct = sum(single.values()), len(single)
    single_p = lambda w: (single[w] + 0.5) / (tokens + 0.5 * (distinct + 1))
    total = lambda c: starts if c == b"\t" else single[c]
    kept = {k: n for k, n in pairs.items() if n >= lm_score.LEAST}
    seen, below = Counter(), Counter()
    for (c, w), n in kept.items():
        seen[c] += (n - lm_score.DISCOUNT) / total(c)
        below[c] += single_p(w)
    out = []
    for d, line in lines:
        score = 0
        for c, w in zip([b"\t", *line], line):
            if (c, w) in kept:
                score += math.log10((kept[c, w] - lm_score.DISCOUNT) / total(c))
            else:
                score += math.log10(single_p(w)) + (math.log10((1 - seen[c]) / (1 - below[c])) if c in seen else 0)
        out.append((d, len(line), sum(single[w] > 0 for w in line), tokens, sum(math.log10(single_p(w)) for w in line), score))
    return out


def check(frame, rows):
    got = rows_of(lm_score.lm_scores(frame))
    want = sorted(brute(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]))
    assert len(got) == len(want)
    for g, (d, n, known, tokens, base, score) in zip(got, want):
        assert (g["doc_id"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (d, n, known, tokens)
        assert g["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 5 == 1)
        assert g["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert g["score"] == pytest.approx(score, rel=1e-3, abs=1e-3 * n)


def test_like_brute_force(spark):
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    check(spark.read.parquet(f"{FOLDER}/documents.parquet"), rows)


def test_odd_rows(docs):
    rows = [(1, "A b a B c"), (2, None), (3, ""), (4, " \n"), (None, "a b"), (6, "a b"), (6, "a b"), (8, "a b c " * 500), (10, "new É words\x0bhere"), (11, "a b"), (12, "q " * 30_000)]
    check(docs(rows), rows)


def test_stretches(docs, monkeypatch):
    for name, value in (("TOGETHER", 5), ("COUNTED", 7), ("STRETCH", 6), ("REMEMBERED", 3)):
        monkeypatch.setattr(lm_score, name, value)
    rows = [(i, "to be or not to be that is the question " * (i % 4)) for i in range(20)]
    check(docs(rows), rows)


def test_nothing_to_learn_from(docs):
    assert rows_of(lm_score.lm_scores(docs([]))) == []
    (row,) = rows_of(lm_score.lm_scores(docs([(None, "a b")])))
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)


def test_probabilities_add_up(spark, docs):
    """Behind any context the model's probabilities of all words sum to one, but for the unknown word's share."""
    words = "a b c d e".split()
    text = "a b a b a c a b d e d e d a a b c c c b"
    train = [(i, text) for i in range(2, 12)]
    tests = [(None, f"{c} {w}") for c in words for w in words] + [(None, c) for c in words]
    scored = {}
    spec = lm_score.train(docs(train), lm_score.shared_folder(spark, "lm-test"))
    for (_, t), r in zip(tests, lm_score.scored(docs([(i, t) for i, (_, t) in enumerate(tests)]), spec).orderBy("doc_id").collect()):
        scored[t] = r["score"]
    trie = lm_score.Trie(spec)
    keys = lm_score.word_keys([b"a", b"b", b"c", b"d", b"e", b"\n"])
    ids, counts = trie.look_up(keys)
    base = trie.unigram(counts)
    for before in ids[:5]:
        total = (10 ** trie.bigram(np.full(6, before), ids, base)).sum()
        missing = 0.5 / (spec["tokens"] + 0.5 * (spec["distinct"] + 1))
        assert total == pytest.approx(1, abs=2 * missing + 1e-3)


def test_folder_that_is_not_mounted(docs, monkeypatch):
    """Files are read block by block, and few blocks are kept, with the same scores."""
    rows = [(i, f"{'to be or not to be that is the question ' * (i % 4)} word{i} word{i // 2}") for i in range(600)]
    want = sorted(rows_of(lm_score.lm_scores(docs(rows))), key=str)
    for name, value in (("BLOCK", 64), ("KEPT", 2), ("SMALL", 16)):
        monkeypatch.setattr(storage, name, value)
    monkeypatch.setattr(storage, "is_mounted", lambda uri: False)
    assert sorted(rows_of(lm_score.lm_scores(docs(rows))), key=str) == want


def test_many_words(spark, docs):
    """Ids whose product has over 63 bits: of a model in many shards, one of them much the largest."""
    trie = lm_score.Trie(lm_score.Model(1, 1, 30, 1 << 6, {}, {}, {}, []).__dict__)
    ids = np.array([0, 1, 1 << 35, (1 << 36) - 1])
    places = trie.likely_place(ids, np.full(4, 10), np.full(4, 1 << 33))
    assert places[0] == 10 and (np.diff(places) >= 0).all() and places[-1] < 10 + (1 << 33)
    trie.first_places, trie.first_words = np.array([0, 7, 7, 7, 9]), np.array([0, 5, 1 << 35, 1 << 36, 2])
    asked = np.array([(3, 1), (7, 4), (7, 5), (7, (1 << 35) + 1), (7, 1 << 36), (8, 1), (9, 1), (9, 2)])
    got = {int(i): part for part, own in trie._holders(asked[:, 0], asked[:, 1]) for i in own}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 3, 6: 3, 7: 4}
