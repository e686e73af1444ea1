import random
import re
from itertools import combinations, product
from zlib import crc32

import duckdb
import numpy as np
import pytest
from llm_rows import docs, rows_of  # noqa: F401

from fleetgauge.llm import toxicity
from fleetgauge.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, toxic int, text string, label string")


def plain_terms(text):
    """The buckets of a text, word by word."""
    out = set()
    for word in re.findall(r"[^\W_]+", (text or "").lower()):
        for term in [word] + [word[:n] + "*" for n in (4, 5, 6) if len(word) > n]:
            out.add(crc32(term.encode()) % toxicity.BUCKETS)
    return out


def test_terms_and_scores_against_brute_force():
    draw = np.random.default_rng(4)
    texts = ["Hello, WORLD hello-world", "übermäßig_groß idiotisch 123456789", "", None, "a " * 1000, "x" * 300 + " y"]
    every = sorted(set().union(*map(plain_terms, texts)))
    kept = np.array(every[::2])
    machine = toxicity.Machine(-0.3, kept, draw.standard_normal(len(kept)), draw.standard_normal((len(kept), toxicity.FACTORS)))
    terms, whole = toxicity.Terms(kept), toxicity.Terms()
    for text in texts * 2:
        assert whole.of(text) == sorted(plain_terms(text))
        places = [i for i, b in enumerate(kept) if b in plain_terms(text)]
        value = -0.3 + sum(machine.weights[i] for i in places) + sum(float(machine.factors[i] @ machine.factors[j]) for i, j in combinations(places, 2))
        assert terms.of(text) == places and abs(machine.score(places) - 1 / (1 + np.exp(-value))) < 1e-12


def test_held_out_documents(spark):
    got = {r["doc_id"]: r for r in QUERIES["op12_factorization_machine"](spark, FOLDER).collect()}
    db = duckdb.connect()
    assert len(got) == db.execute(f"SELECT count(*) FROM '{FOLDER}/documents.parquet'").fetchone()[0]
    truth = dict(db.execute(f"SELECT doc_id, toxic FROM '{FOLDER}/labels.parquet'").fetchall())
    assert all(r["held_out"] == (crc32(str(d).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for d, r in got.items())
    held = [(got[d]["predicted"], t) for d, t in truth.items() if d in got and got[d]["held_out"]]
    toxic = [p for p, t in held if t]
    # About one in twelve of the documents marked toxic here is junk (rows of tables, one word again and again) without any such word.
    assert len(toxic) > 50 and sum(toxic) / len(toxic) > 0.85
    assert sum(p for p, t in held if not t) / (len(held) - len(toxic)) < 0.01


def test_pairs_mean_what_neither_word_does(docs, labels):
    draw = random.Random(6)
    filler = [a + b for a, b in product(("ka", "lo", "mi", "ne", "su"), repeat=2)]
    rows, marks = [], []
    for i in range(1500):
        words = draw.choices(filler, k=12)
        insult, group = draw.random() < 0.4, draw.random() < 0.4
        words += ["vermin"] * insult + ["strangers"] * group
        draw.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, int(insult and group)))
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs(rows), labels(marks)).collect()}
    held = [(got[i]["predicted"], t) for i, t in marks if got[i]["held_out"]]
    assert sum(p == t for p, t in held) == len(held) > 200


def test_odd_rows(docs, labels):
    rows = [(i, "clean words of a text") for i in range(60)] + [(100 + i, "scoundrel words of a text") for i in range(60)]
    odd = [(500, None), (501, ""), (502, "..."), (None, "scoundrel"), (503, "clean " * 50_000 + "scoundrel"), (504, "Scoundrels"), (504, "Scoundrels"), (1, "clean words of a text")]
    marks = [(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(60)] + [(None, 1), (3, None), (5, 0), (999, 1)]
    got = rows_of(toxicity.toxicity(docs(rows + odd), labels(marks)))
    assert len(got) == 128
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["predicted"] for i in (None, 503, 504, 500, 501, 502)] == [1, 1, 1, 0, 0, 0]
    assert by[500]["score"] == by[501]["score"] == by[502]["score"] and not by[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got) and sum(r["doc_id"] == 504 for r in got) == 2


def test_nothing_to_tell_apart(docs, labels):
    rows = [(i, f"text {i}") for i in range(20)]
    assert rows_of(toxicity.toxicity(docs([]), labels([(1, 1)]))) == []
    assert {r["predicted"] for r in rows_of(toxicity.toxicity(docs(rows), labels([])))} == {0}
    assert {r["predicted"] for r in rows_of(toxicity.toxicity(docs(rows), labels([(i, 1) for i in range(20)])))} == {1}
    # No term goes with the label: all score the share of toxic rows.
    alike = rows_of(toxicity.toxicity(docs([(i, "same") for i in range(40)]), labels([(i, i % 2) for i in range(40)])))
    assert len({r["score"] for r in alike}) == 1 and 0.2 < alike[0]["score"] < 0.8
