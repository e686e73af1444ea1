import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetgauge.llm.elias_fano import EliasFano


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 1), (5, 5), (1000, 10**6), (900, 1000), (50_000, 2**62), (200_000, 10**12)])
def test_finds_what_is_there(n, universe):
    draw = np.random.default_rng(n)
    values = np.unique(draw.integers(0, universe, n).astype(np.uint64))
    made = EliasFano.build(values, universe)
    assert (made.find(values) == np.arange(len(values))).all()
    asked = draw.integers(0, universe, 2000).astype(np.uint64)
    place = np.searchsorted(values, asked)
    there = np.append(values, 2**63)[place] == asked
    assert (made.find(asked) == np.where(there, place, -1)).all()
    at = draw.integers(0, len(values), 500) if len(values) else np.empty(0, np.int64)
    assert (made.access(at) == values[at]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_pointers_may_repeat(values):
    line = np.array(sorted(values), np.int64)
    made = EliasFano.build(line, 5001)
    assert made.access(np.arange(len(line))).tolist() == line.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6) | st.integers(0, 40), min_size=2, max_size=300))
def test_two_at_once(values):
    line = np.array(sorted(values), np.int64)
    made = EliasFano.build(line, 10**6 + 1)
    here, after = made.access_two(np.arange(len(line) - 1))
    assert here.tolist() == line[:-1].tolist() and after.tolist() == line[1:].tolist()


def test_is_compact():
    values = np.sort(np.random.default_rng(0).integers(0, 10**9, 100_000)).astype(np.uint64)
    bits = sum(p.nbytes for p in EliasFano.build(values, 10**9).parts()) * 8 / len(values)
    assert bits < np.log2(10**9 / 100_000) + 5
