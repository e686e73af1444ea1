import hashlib
import re

import pytest
from llm_rows import docs, rows_of  # noqa: F401

from fleetgauge.llm.exact_dedup import content_sort, keep_first

LONG = "word " * 40_000


def brute(rows):
    groups = {}
    for place, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, place, doc_id))
    out = []
    for body, members in groups.items():
        members.sort()
        for i, m in enumerate(members):
            out.append((m[4], members[0][4], len(members), i == 0, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


CASES = {
    "plain": [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "x"), (5, "a\tb ")],
    "nulls": [(1, None), (2, ""), (3, " \n"), (None, "q"), (7, "q"), (None, "alone"), (None, "alone")],
    "ties": [(9, "a b"), (3, "b"), (4, "a b"), (2, "ab ")],
    "repeated rows": [(1, "same"), (1, "same"), (1, "same"), (1, "other")],
    "long": [(1, LONG), (2, LONG + "."), (3, LONG.replace(" ", "\n"))],
    "hot": [(i, "hot text" + " " * (i % 3)) for i in range(200)] + [(i, f"t{i}") for i in range(200, 260)],
    "common start": [(i, "the very same first line of a good many texts " + str(i % 7)) for i in range(50)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_like_brute_force(docs, name):
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows_of(content_sort(docs(CASES[name])))]
    assert sorted(got, key=repr) == brute(CASES[name])


def test_rows_that_stay_keep_all_columns(docs):
    frame = docs(CASES["hot"] + CASES["nulls"])
    kept = keep_first(frame)
    assert kept.columns == frame.columns
    want = [d for d, _, _, kept_, _ in brute(CASES["hot"] + CASES["nulls"]) if kept_]
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, want))


def test_one_shuffle_of_texts(docs):
    plan = content_sort(docs(CASES["plain"]))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(start" in plan and "Python" not in plan
    assert "hashpartitioning(start" not in plan
