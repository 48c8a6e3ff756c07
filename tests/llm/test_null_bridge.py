"""Rows without a doc_id link others; rows of one doc_id link only by their own fingerprints."""

import numpy as np
from pyspark.sql import functions as F

from tripleweft.llm import simhash


def brute(rows, reach):
    """Rows (doc_id, fp) -> the least doc_id of each row's component."""
    distinct = sorted({p for _, p in rows})
    group = {p: p for p in distinct}
    for a in distinct:
        for b in distinct:
            if (a ^ b).bit_count() <= reach and group[a] != group[b]:
                old, new = group[a], group[b]
                group = {p: new if g == old else g for p, g in group.items()}
    least: dict = {}
    for d, p in rows:
        if d is not None:
            least[group[p]] = min(d, least.get(group[p], d))
    return sorted(((d, f"{p:016x}", least.get(group[p])) for d, p in rows), key=repr)


def test_null_bridge(spark, monkeypatch):
    rng = np.random.default_rng(11)
    centres = rng.integers(0, 1 << 62, 60)
    rows = []
    for i in range(900):
        p = int(centres[rng.integers(60)])
        for bit in rng.integers(0, 64, rng.integers(0, 4)):
            p ^= 1 << int(bit)
        rows.append((None if rng.random() < 0.2 else int(rng.integers(0, 700)), p))
    rows += [(1001, 0x6361), (None, 0x6061), (1002, 0x4061)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: docs.select("doc_id", F.col("fp")))
    signed = [(d, p - (1 << 64) if p >> 63 else p) for d, p in rows]
    got = simhash.near_duplicates(spark.createDataFrame(signed, "doc_id long, fp long"))
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == brute(rows, 2)
    assert ("0000000000006061", 1001) in {r[1:] for r in got if r[0] is None}
