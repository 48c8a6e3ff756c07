"""Crowded shards that can't be split, and pairs that become a forest as they come, lose no link."""

import numpy as np
import pytest

from tripleweft.llm import simhash


@pytest.mark.parametrize("sizes", [{"most_rows": 10}, {"most_rows": 10, "most_pairs": 50}, {"shard_rows": 20, "most_pairs": 1}])
def test_balls_of_close_fingerprints(spark, sizes):
    """Two balls, each of a centre and all fingerprints at one bit from it (so all within two bits of each other), and a pair that touches neither."""
    a, b = 0x0F0F0F0F0F0F0F0F, 0x7777000000007777
    fps = [a, *[a ^ (1 << i) for i in range(63)], b, *[b ^ (1 << i) for i in range(63)], 0x0000FFFFFFFF0000, 0x0000FFFFFFFF0003]
    reps = spark.createDataFrame([(p, i) for i, p in enumerate(fps)], "fp long, rep long")
    low = {i: i for i in range(len(fps))}
    edges = simhash.links(reps, 2, **sizes).collect()
    for _ in range(len(fps)):
        for e in edges:
            low[e.u] = low[e.v] = min(low[e.u], low[e.v])
    assert [low[i] for i in range(len(fps))] == [0] * 64 + [64] * 64 + [128, 128]


def test_chunks_are_all_pairs():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 1 << 16, 700).astype(np.uint64) << np.uint64(3)
    got = {tuple(p) for c in simhash.close_pairs(points, points[:200], 2, small=16) for p in c.tolist()}
    assert got == {(i, j) for i in range(700) for j in range(200) if (int(points[i]) ^ int(points[j])).bit_count() <= 2}
