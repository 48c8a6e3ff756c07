"""The pipeline's near-duplicate stage against exact five-word Jaccard similarities."""

import numpy as np

import corpus_pipeline

DATA = "/root/testdata/sf0.01"


def kept_by_brute_force(rows):
    """The least doc_id of each component at Jaccard >= 0.8."""
    sets = []
    for d, t in rows:
        words = (t or "").encode().lower().split()
        sets.append((d, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()))
    low, where = {d: d for d, _ in sets}, {}
    for d, s in sets:
        for x in s or [None]:
            where.setdefault(x, []).append(d)
    own, links = dict(sets), []
    pairs = {(a, b) for x, found in where.items() for i, a in enumerate(found) for b in found[i + 1 :]}
    for a, b in pairs:
        both = len(own[a] & own[b])
        if 9 * both >= 4 * (len(own[a]) + len(own[b])):
            links.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return sorted(set(low.values()))


def planted():
    rng = np.random.default_rng(6)
    rows = []
    for k in range(30):
        words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        for copy in range(6):
            own = list(words)
            for at in rng.integers(0, 150, copy):
                own[at] = f"new{k}_{copy}_{at}"
            rows.append((len(rows), " ".join(own)))
    return [*rows, (900, rows[0][1].upper()), (901, "a b"), (902, "A  b"), (903, ""), (904, None)]


def hot(n=500):
    """Copies of one text with up to 14 changed words, many of them near each other but not near the text."""
    rng = np.random.default_rng(7)
    words, rows = [f"w{x}" for x in range(140)], []
    for d in range(n):
        own = list(words)
        for at in rng.integers(0, 140, rng.integers(0, 15)):
            own[at] = f"new{rng.integers(3)}"
        rows.append((d, " ".join(own)))
    return rows


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect())


def test_planted_near_copies(spark):
    rows = planted()
    want = kept_by_brute_force(rows)
    assert len(want) < len(rows) - 60
    assert kept(spark, rows) == want


def test_one_large_group(spark):
    assert kept(spark, hot()) == kept_by_brute_force(hot())


def test_documents_and_rows_without_an_id(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert kept(spark, rows) == kept_by_brute_force(rows)
    docs = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (5, "x y z"), (5, "x y z"), (6, "x y z")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()) == ["5", "None", "None"]
