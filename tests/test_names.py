"""Lookups over names that many anchors share, and over grams that must not be broadcast."""

import random

from tripleweft.operators import resolution


def brute(tokens, anchors, limit, few):
    out = set()
    for t in tokens:
        starts = [a for a in anchors if a[1] is not None and a[1].lower().startswith(t)]
        holds = [a for a in anchors if a[1] is not None and t in a[1].lower() and not a[1].lower().startswith(t)]
        key = lambda a: (-a[2], a[0])
        both = [(a, 0) for a in sorted(starts, key=key)] + ([(a, 1) for a in sorted(holds, key=key)] if len(starts) < few else [])
        out |= {(t, a[0], tier, i + 1) for i, (a, tier) in enumerate(both[:limit])}
    return out


def test_lookup_over_shared_names(spark):
    g = random.Random(2)
    names = ["Red Ring", "red ring", "Ring Red", "blue wheel", "Wheel", None, "bolt", "x"]
    anchors = [(f"a{i}", g.choice(names), g.randint(0, 9) / 2) for i in range(300)] + [("b0", "Redder", 1.0), ("b1", "a redder one", 2.0)]
    tokens = ["red", "ring", "redder", "heel", "zz", "bo"]
    got = resolution.lookup(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame(anchors, "id string, canonical string, maturity double")).collect()
    assert {(r.token, r.id, r.tier, r.place) for r in got} == brute(tokens, anchors, 8, 3)


def test_grams_are_not_broadcast(spark, tmp_path):
    """Spark believes exploded grams of a file to be as few as its names, so at 1 GB they filled the driver."""
    spark.createDataFrame([("p1", "red ring"), ("p2", "blue ring")], "id string, name string").write.parquet(str(tmp_path / "n"))
    names = spark.read.parquet(str(tmp_path / "n"))
    found = resolution.containing(spark.createDataFrame([("ring",)], "term string"), names)
    assert {r.id for r in found.collect()} == {"p1", "p2"}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [gram" in plan and "BroadcastHashJoin [gram" not in plan.split("SortMergeJoin [gram")[0]
