"""Short texts: sets of few shingles that are similar must meet in a band, however many rounds each takes."""

import itertools

import numpy as np
from spanloom.llm import near_dedup


def test_similar_small_sets_share_a_band():
    rng = np.random.default_rng(7)
    missed = []
    for n, less in itertools.product(range(5, 41), range(1, 11)):
        if not 0.75 <= (n - less) / n <= 0.9:
            continue
        for _ in range(20):
            items = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            a, b = near_dedup.sketch(np.sort(items)), near_dedup.sketch(np.sort(items[less:]))
            bits = [np.frombuffer(near_dedup.last_bits(s), np.uint8) for s in (a, b)]
            if not (near_dedup.band_keys(a) == near_dedup.band_keys(b)).any() or near_dedup.agreeing(bits[0][None], bits[1])[0] < near_dedup.LEAST_EQUAL:
                missed.append((n, n - less))
    assert not missed


def test_a_coordinate_is_the_first_round_that_fills_it():
    """Against a plain loop over all rounds, one at a time."""
    rng = np.random.default_rng(8)
    size, mix = near_dedup.SIZE, near_dedup._mix
    for n in (1, 4, 9, 16, 31, 40):
        items = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        want: dict[int, tuple[int, int]] = {}
        for r in range(2 * size):
            for x in mix(items ^ mix(np.uint64([r]) * near_dedup._M1 + np.uint64(1))).tolist():
                at = x % size if r < size else r - size
                want[at] = min(want.get(at, (r, x)), (r, x))
        got = near_dedup.sketch(items).tolist()
        shift = 64 - near_dedup.ROUND_BITS
        assert [(v >> shift, v & (1 << shift) - 1) for v in got] == [(want[j][0], want[j][1] >> near_dedup.ROUND_BITS) for j in range(size)]
