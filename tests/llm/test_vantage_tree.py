"""The shards of the vantage-point tree stay small."""

import numpy as np
import pytest

from tripleweft.llm import simhash


def test_largest_leaf_is_bounded():
    for k in range(8):
        points = np.random.default_rng(k).integers(0, 1 << 64, 20_000, np.uint64)
        tree = simhash.VantageTree(points, 25)
        sizes = np.bincount(tree.home(points), minlength=tree.leaves)
        assert tree.leaves == 25
        assert sizes.max() < 0.15 * len(points)


@pytest.mark.parametrize("v", [0, 1])
def test_a_vantage_point_of_zero_can_win(v):
    points = np.array([v] * 10 + [0xFFFFFFFF00000000] * 10, np.uint64)
    assert simhash.VantageTree(points, 2).leaves == 2
