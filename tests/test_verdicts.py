"""Conclusions, and scenes, from small tables by hand."""

from tripleweft.operators import scenes, verdicts


def test_comparison_verdicts(spark):
    features = spark.createDataFrame([("a", "is_a", "x", 1.0), ("a", "has", "y", 0.5), ("b", "is_a", "x", 1.0), ("b", "has", "y", 0.5), ("c", "is_a", "x", 0.5), ("c", "has", "z", 0.5), ("d", "is_a", "w", 1.0)], "id string, p string, o string, w double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("e", "f")], "a string, b string")
    got = {(r.a, r.b): (r.n_shared, r.only_a, r.only_b, round(r.similarity, 3), r.verdict) for r in verdicts.compare(pairs, features).collect()}
    assert got == {("a", "b"): (2, 0, 0, 1.0, "similar"), ("a", "c"): (1, 1, 1, 0.25, "different"), ("a", "d"): (0, 2, 1, 0.0, "distinct"), ("e", "f"): (0, 0, 0, 0.0, "distinct")}


def test_contradiction_and_empty(spark):
    schema = "query_id string, s string, p string, o string, w double"
    edges = spark.createDataFrame([("q", "a", "refutes", "b", 1.0), ("q", "a", "is_a", "c", 0.5), ("n", "a", "knows", "b", 0.9)], schema)
    got = {r.query_id: r for r in verdicts.contradictions(edges).collect()}
    assert got["q"].status == "contradicted" and got["q"].evidence == ["a is_a c (strength=0.50)"]
    assert got["n"].status == "insufficient_memory" and abs(got["n"].confidence - 0.2) < 1e-9 and got["n"].evidence == []
    assert verdicts.contradictions(spark.createDataFrame([], schema)).count() == 0 and verdicts.gaps(spark.createDataFrame([], schema)).count() == 0


def test_transitions(spark):
    seen = spark.createDataFrame([("v", 1, "cat_1"), ("v", 2, "cat_1"), ("v", 4, "cat_1"), ("v", 2, "cup_1")], "stream string, frame int, item string")
    got = {(r.frame, r.item, r.change) for r in scenes.transitions(seen).collect()}
    assert got == {(1, "cat_1", "appeared"), (3, "cat_1", "disappeared"), (4, "cat_1", "appeared"), (2, "cup_1", "appeared"), (3, "cup_1", "disappeared")}
