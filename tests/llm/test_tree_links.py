"""The pipeline's near-duplicate stage links what lies near in its fingerprints' tree, whether or not a band is shared."""

import numpy as np

import corpus_pipeline
from tripleweft.llm import near_copies

from test_near_copies import DATA


def test_tree_without_bands(spark, monkeypatch):
    rng, rows, want = np.random.default_rng(31), [], []
    for k in range(12):
        words = [f"w{x}" for x in rng.integers(0, 9000, 2000)]
        texts = [" ".join(words), " ".join([*words[:700], f"new{k}", *words[701:]])]
        a, b = (near_copies.fingerprint(near_copies.shingles(t)) for t in texts)
        near = (a ^ b).bit_count() if a ^ b >= 0 else ((a ^ b) + (1 << 64)).bit_count()
        rows += [(2 * k, texts[0]), (2 * k + 1, texts[1])]
        want += [2 * k] if near <= near_copies.NEAR else [2 * k, 2 * k + 1]
    assert len(want) < 22  # some copies lie near
    monkeypatch.setattr(near_copies, "band_keys", lambda found: found[: near_copies.BANDS].view(np.int64) * 0 + (found[-1:].view(np.int64) ^ found[:1].view(np.int64) ^ len(found)) + np.int64(found.sum() >> np.uint64(1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()) == want
