"""Rounds of centres and blocks against exact similarities, and how many rows go to the blocks."""

import numpy as np
import pytest

from tripleweft.llm import near_copies

from test_near_copies import hot, kept_by_brute_force


def run(spark, rows, monkeypatch, **sizes):
    """(documents kept, rows that went to blocks, the largest band)"""
    seen, plain = [], near_copies.blocks

    def counted(apart, small, part):
        out = plain(apart, small, part)
        seen.append((out.count(), apart.selectExpr("max(size)").first()[0] or 0, apart.count()))
        return out

    monkeypatch.setattr(near_copies, "blocks", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    return sorted(r.doc_id for r in near_copies.deduplicated(docs, **sizes).collect()), *seen[0]


@pytest.mark.parametrize("sizes", [{"part": 40, "small": 8}, {"part": 40, "small": 8, "rounds": 0}, {"part": 7, "small": 2}])
def test_small_parts(spark, monkeypatch, sizes):
    kept, *_ = run(spark, hot(), monkeypatch, **sizes)
    assert kept == kept_by_brute_force(hot())


def test_similarities_near_the_bound(spark, monkeypatch):
    """Pairs at 0.75 to 0.85, of 300 texts each with a copy."""
    rng, rows = np.random.default_rng(21), []
    for k in range(300):
        words = [f"v{x}" for x in rng.integers(0, 90_000, 200)]
        own, step = list(words), int(rng.integers(3, 6))
        for at in range(10, 10 + 12 * step, 12):
            own[at] = f"new{k}_{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(own))]
    kept, *_ = run(spark, rows, monkeypatch)
    want = kept_by_brute_force(rows)
    assert 310 < len(want) < 590 and kept == want


@pytest.mark.parametrize("n", [500, 20_000])
def test_rows_to_the_blocks_are_linear_in_the_band(spark, monkeypatch, n):
    """Copies of one text with a few changed words, some beyond reach: a set goes to two blocks on average at most, not to one for every thousand of its band."""
    rng = np.random.default_rng(5)
    words, rows = [f"w{x}" for x in range(60)], []
    for d in range(n):
        own = list(words)
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            own[at] = f"n{rng.integers(40)}"
        rows.append((d, " ".join(own)))
    kept, sent, largest, apart = run(spark, rows, monkeypatch)
    assert largest > n / 10 and sent <= 3 * apart
    assert len(kept) < n / 2
