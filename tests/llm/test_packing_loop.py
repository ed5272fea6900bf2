"""The packing loop against a plain one that tries every open gap."""

import random

import numpy as np
import pytest

from habitatrix.llm.packing import sum_of_squares


def plain(lengths, capacity):
    """Bins as lists of items: each item goes where the squared counts of bins per gap add up to least."""
    gaps, bins, where = [], [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size, best = lengths[i], None
        for gap in sorted({g for g in gaps if g >= size}):
            after = list(gaps)
            after[after.index(gap)] = gap - size
            total = sum(sum(g == x for g in after) ** 2 for x in set(after) if x > 0)
            if best is None or total < best[0]:
                best = total, gap
        if best is None:
            gaps.append(capacity)
            bins.append([])
            k = len(bins) - 1
        else:
            # of bins with one gap, the one that got it last
            k = max((b for b in range(len(gaps)) if gaps[b] == best[1]), key=lambda b: bins[b][-1][1])
        bins[k].append((i, len(where)))
        where[i] = k, capacity - gaps[k]
        gaps[k] -= size
    return [where[i][0] for i in range(len(lengths))], [where[i][1] for i in range(len(lengths))]


@pytest.mark.parametrize("seed", range(12))
def test_loop_equals_the_plain_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 70))]
    bins, offsets = sum_of_squares(np.array(lengths, dtype="int64"), capacity)
    want = plain(lengths, capacity)
    assert bins.tolist() == want[0] and offsets.tolist() == want[1]
