from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm.elias_fano import Sequence, encode


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 300), max_size=300), st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_access_and_find(values, others):
    rising = np.array(sorted(values), np.uint64)
    sequence = Sequence(encode(rising, 2**64))
    assert (sequence.access(np.arange(len(rising))) == rising).all()
    asked = np.array(values + others, np.uint64)
    want = [int(np.searchsorted(rising, x)) if x in values else -1 for x in asked.tolist()]
    assert sequence.find(asked).tolist() == want


def test_small_universes():
    for n, universe in ((0, 1), (1, 1), (64, 64), (1000, 10), (129, 2**40)):
        values = np.sort(np.random.default_rng(n).integers(0, universe, n, dtype=np.uint64))
        sequence = Sequence(encode(values, universe))
        assert (sequence.access(np.arange(n)) == values).all()


def test_find_stays_inside_its_range():
    sequence = Sequence(encode(np.array([3, 5, 9, 12], np.uint64), 16))
    asked = np.array([5, 5, 9], np.uint64)
    assert sequence.find(asked, np.array([0, 2, 2]), np.array([2, 4, 2])).tolist() == [1, -1, -1]


def test_size_is_near_the_bound():
    values = np.sort(np.random.default_rng(0).integers(0, 2**40, 100_000, dtype=np.uint64))
    arrays = encode(values, 2**40)
    bits = 8 * (arrays["low"].nbytes + arrays["upper"].nbytes) / len(values)
    assert bits < np.log2(2**40 / len(values)) + 3
