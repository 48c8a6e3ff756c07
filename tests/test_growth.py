"""Steps that must not grow faster than their input: what is shuffled, joined and kept."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tripleweft.operators import dialogue, features, graph, packets, paths, patterns, wavefront
from tripleweft.plans import catalog


def test_reach_is_the_same_for_few_and_many_nodes(spark, monkeypatch):
    g = random.Random(1)
    edges = spark.createDataFrame([(f"n{g.randint(0, 30)}", f"n{g.randint(0, 30)}") for _ in range(90)] * 2, "src string, dst string")
    seeds = spark.createDataFrame([("n1",), ("n2",)], "seed string")
    few = sorted(map(tuple, paths.reach(edges, seeds, 3).collect()))
    monkeypatch.setattr(paths, "FEW_NODES", 0)
    assert few == sorted(map(tuple, paths.reach(edges, seeds, 3).collect())) and len(few) > 10


def test_multihop_stops_at_full_seeds_and_carries_no_paths(spark, monkeypatch):
    kept = []
    own = paths.keep
    monkeypatch.setattr(paths, "keep", lambda df: kept.append(own(df)) or kept[-1])
    rows = [(f"a{i}", "p", f"b{j}", 5) for i in range(3) for j in range(6)] + [(f"b{j}", "p", f"c{j}{k}", 5) for j in range(6) for k in range(6)]
    paths.multihop(spark.createDataFrame(rows, "src string, p string, dst string, seen long"), spark.createDataFrame([("a0",), ("a1",)], "seed string"), max_nodes=5).count()
    entered = [df for df in kept if {"_pos", "_r", "seed"} <= set(df.columns)]
    assert entered and all("path" not in df.columns for df in entered)
    assert [df.count() for df in entered] == [12, 0]  # with six nodes known, no more is looked at


def test_patterns_don_t_pair_all_under_a_frequent_value(spark):
    """Suppliers of a nation are paired by the part between them, not by the nation."""
    facts = [(f"p{i}", r, f"s{(i * k) % 40}") for i in range(60) for r, k in (("causes", 1), ("inhibits", 7))] + [(f"s{i}", "lies_in", f"n{i % 2}") for i in range(40)]
    edges = spark.createDataFrame([(*f, 0.5, False) for f in facts], "subject_id string, predicate string, object_id string, local_confidence double, is_bridge boolean")
    rows, _ = patterns.bindings([("?P", "causes", "?S"), ("?P", "inhibits", "?T"), ("?S", "lies_in", "?N"), ("?T", "lies_in", "?N")], edges, [("?S", "!=", "?T")])
    assert rows.columns.index("?P") < rows.columns.index("?T")
    found = {(a[0], a[2], b[2]) for a in facts for b in facts if a[0] == b[0] and a[1] == "causes" and b[1] == "inhibits" and a[2] != b[2] and int(a[2][1:]) % 2 == int(b[2][1:]) % 2}
    assert {(r["?P"], r["?S"], r["?T"]) for r in rows.collect()} == found


def test_most_shared(spark):
    g = random.Random(4)
    held = list({(f"a{i % 3}", f"c{i}", f"o{g.randint(0, 8)}") for i in range(90) for _ in range(5)})
    rows = spark.createDataFrame(held, "area string, concept string, o string")
    want = set()
    for c in {h[1] for h in held}:
        mine = {(a, o) for a, k, o in held if k == c}
        shared = Counter(k for a, k, o in held if k != c and (a, o) in mine)
        want |= {(c, k, n) for k, n in sorted(shared.items(), key=lambda x: (-x[1], x[0]))[:4]}
    for block in (2000, 7):
        found = features.most_shared(rows, 4, block)
        assert {(r.concept, r.other, r.shared) for r in found.collect()} == want


def test_packets_are_alike_by_query_and_by_joins(spark, monkeypatch):
    """Queries of few edges are shuffled whole, others are joined after most edges are dropped; either way all are ranked, with ties, loops, a query among its nodes and weights of 0 and null."""
    g = random.Random(7)
    pick = lambda q: g.choice([f"n{g.randint(0, 25)}", f"n{g.randint(0, 25)}", q])
    rows = {(q := f"q{g.choice((1, 1, 1, 2, 3))}", pick(q), g.choice("ab"), pick(q)): g.choice([0.0, 0.02, 0.1, 0.3, 0.9, None]) for _ in range(700)}
    edges = spark.createDataFrame([(*k, w) for k, w in rows.items()] + [("q4", "n1", "a", "n2", 0.5)], "query_id string, s string, p string, o string, w double")
    most, nodes, top = {}, {}, []
    for (q, s, _, o), w in [*rows.items(), (("q4", "n1", "a", "n2"), 0.5)]:
        for n, a in ((s, w), (o, None if w is None else 0.8 * w), (q, 1.0)):
            if a is not None:
                nodes[q, n] = max(nodes.get((q, n), a), a)
    for q in {k[0] for k in nodes}:
        most[q] = max(a for (k, _), a in nodes.items() if k == q)
    for (q, s, p, o), w in [*rows.items(), (("q4", "n1", "a", "n2"), 0.5)]:
        if w is not None and ((score := nodes[q, s] / most[q] * w * (nodes[q, o] / most[q])) >= 0.002 or w >= 0.3):
            top.append((q, -score, s, p, o))
    want_top = sorted(x for q in most for x in sorted(t for t in top if t[0] == q)[:60])
    want_nodes = sorted((q, n) for q in most for _, n in sorted((-a, n) for (k, n), a in nodes.items() if k == q and a / most[q] >= 0.05)[:30])
    for many in (10_000, 50, 0):
        monkeypatch.setattr(packets, "MANY", many)
        best, found = packets.ranked(edges)
        assert sorted((r.query_id, r.node) for r in best.collect()) == want_nodes
        assert sorted((r.query_id, -r.score, r.s, r.p, r.o) for r in found.collect()) == want_top


def test_packets_shuffle_their_edges_once(spark):
    """A query's edges are shuffled by query alone, and not joined by node."""
    edges = spark.createDataFrame([(f"q{i // 3}", f"n{i % 7}", "a", f"n{i % 5}", 0.5) for i in range(60)], "query_id string, s string, p string, o string, w double")
    best, found = packets.ranked(edges)
    for df in (best, found):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_wavefronts_list_the_neighbors_of_their_nodes_only(spark, monkeypatch):
    """A level looks up the nodes it goes on from; what lies beyond the last level is not listed."""
    kept = []
    own = wavefront.keep
    monkeypatch.setattr(wavefront, "keep", lambda df: kept.append(own(df)) or kept[-1])
    edges = spark.createDataFrame([(f"n{i}", "causes", f"n{i + 1}", "causal", "") for i in range(20)], "subject_id string, predicate string, object_id string, edge_type string, domain_tags string")
    anchors = spark.createDataFrame([(f"n{i}", f"name {i}", 1e9, 0, "wikidata", None) for i in range(21)], "id string, canonical string, maturity double, attractor long, object_domain string, sem_domain string")
    queries = spark.createDataFrame([("q", "n0", "name 0")], "query_id string, id string, text string")
    found = {(r.s, r.o) for r in wavefront.infer(queries, edges, anchors, levels=3).collect()}
    assert found == {(f"name {i}", f"name {i + 1}") for i in range(3)}
    listed = {r.node for df in kept if "rank" in df.columns for r in df.select("node").collect()}
    assert listed == {"n0", "n1", "n2"}
    monkeypatch.setattr(wavefront, "FEW_NODES", 0)
    assert found == {(r.s, r.o) for r in wavefront.infer(queries, edges, anchors, levels=3).collect()}


def test_units_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    """Units of one small file are dealt by their number, and once."""
    monkeypatch.setattr(features, "UNITS_PER_TASK", 10)
    units = spark.createDataFrame([(i, f"word{i % 7} alpha", "log_build") for i in range(100)], "unit_id long, code string, source string").coalesce(1)
    found = features.retrieved(spark.createDataFrame([("t", "word3 alpha")], "task_id string, text string"), units, [])
    assert [(r.unit_id, r.place) for r in found.orderBy("place").collect()] == [(3 + 7 * i, i + 1) for i in range(5)]
    dealt = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x]
    assert len(dealt) == 1 and dealt[0].rstrip().endswith(", 11")


def test_rows_of_edges_are_shuffled_once_for_nodes_and_edges(spark, monkeypatch):
    """Rows that repeat edges are dealt by query; what a plan reads of edges, nodes and ranks shares that shuffle, and says the same as ranks of the edges themselves. Ends without a name are of no edge."""
    g = random.Random(3)
    name = lambda: g.choice([f"n{g.randint(0, 9)}", f"n{g.randint(0, 9)}", f"n{g.randint(0, 9)}", None])
    rows = [(g.choice([f"q{g.randint(0, 30)}"] * 9 + [None]), name(), g.choice("ab"), name(), g.choice([0.01, 0.3, 0.6, 0.9, None])) for _ in range(900)]
    rows = spark.createDataFrame(rows, "query_id string, s string, p string, o string, w double")
    edges = rows.groupBy("query_id", "s", "p", "o").agg(F.max("w").alias("w"))
    said = lambda parts: [sorted(map(str, df.collect())) for df in parts]
    want = said([packets.packets(edges), *packets.ranked(edges)])
    for per_task, many in ((100_000, 10_000), (50, 10_000), (100_000, 5)):
        monkeypatch.setattr(packets, "PER_TASK", per_task)
        monkeypatch.setattr(packets, "MANY", many)
        own, parts = packets.merged(rows)
        assert said([packets.packets(own, parts), *parts]) == want
    monkeypatch.setattr(packets, "MANY", 10_000)
    found = packets.packets(*packets.merged(rows))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("REPARTITION_BY_NUM") == 2  # a plan names the exchange where it is reused too


def test_named_triples_are_counted_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """Edges are dealt by subject and by object, into tasks by their number."""
    g = random.Random(2)
    lines = [(i, g.randint(1, 20), g.randint(1, 9), i % 7, g.choice("AN"), "O", 0.1, 0.1) for i in range(300)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, f"part {i % 5}", 1.0, "b") for i in range(1, 21)], "p_partkey long, p_name string, p_retailprice double, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(i, f"supplier {i}", 1.0, 1) for i in range(1, 10)], "s_suppkey long, s_name string, s_acctbal double, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(catalog, "EDGES_PER_TASK", 30, raising=False)
    found = catalog.QUERIES["jn02_named_triples"](spark, str(tmp_path))
    want = Counter((f"part {p % 5}", {"A": "causes", "N": "requires"}[f], f"supplier {s}") for _, p, s, _, f, *_ in lines)
    assert {(r.subject, r.predicate, r.object): r.n for r in found.collect()} == want
    dealt = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x]
    assert len(dealt) == 2 and all(x.rstrip().endswith(", 11") for x in dealt)


def _least_paths(pairs, seed, depth):
    """Level by level, the least path from seed to each node that no level before has."""
    levels, seen = [{seed: (seed,)}], {seed}
    for _ in range(depth):
        new = {}
        for a, b in pairs:
            if a in levels[-1] and b not in seen:
                new[b] = min(new.get(b, ("~",)), (*levels[-1][a], b))
        seen |= set(new)
        levels.append(new)
    return levels


def test_reach_looks_for_ends_alone_in_its_last_level(spark, monkeypatch):
    kept = []
    own = paths.keep
    monkeypatch.setattr(paths, "keep", lambda df: kept.append(own(df)) or kept[-1])
    g = random.Random(8)
    pairs = sorted({(f"n{g.randint(0, 40)}", f"n{g.randint(0, 40)}") for _ in range(110)})
    edges, seeds = spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("n1",), ("n2",), ("n9",)], "seed string")
    ends = [f"n{i}" for i in range(0, 40, 7)]
    want = {s: _least_paths(pairs, s, 3) for s in ("n1", "n2", "n9")}
    for few in (500_000, 0):
        monkeypatch.setattr(paths, "FEW_NODES", few)
        got = {(r.seed, r.node, tuple(r.path)) for r in paths.reach(edges, seeds, 3, spark.createDataFrame([(e,) for e in ends], "node string")).collect()}
        assert got == {(s, n, p) for s in want for level in want[s] for n, p in level.items() if n in ends} and len({len(p) for *_, p in got}) > 1
        assert {r.node for df in kept for r in df.where("size(path) = 4").collect()} <= set(ends)
        assert {(r.seed, r.node, tuple(r.path)) for r in paths.reach(edges, seeds, 3).collect()} == {(s, n, p) for s in want for level in want[s] for n, p in level.items()}
        kept.clear()


def test_longest_makes_no_last_level(spark, monkeypatch):
    """The last level holds most nodes; of it only a path for each seed is made."""
    kept = []
    own = paths.keep
    monkeypatch.setattr(paths, "keep", lambda df: kept.append(own(df)) or kept[-1])
    g = random.Random(5)
    pairs = [(f"a{g.randint(0, 60)}", f"b{g.randint(0, 60)}") for _ in range(90)] + [("lone", "pair"), ("a1", "a1"), ("hub", "z0"), ("z0", "z1"), ("z0", "z2")] + [("z2", f"y{i}") for i in range(50)]
    seeds = ["a1", "a2", "b3", "lone", "hub", "z1", "nowhere"]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    both = pairs + [p[::-1] for p in pairs]
    for depth in (1, 3, 4):
        want = {s: min((len(level) and (-k, min(level.values())) or (0, (s,))) for k, level in enumerate(_least_paths(both, s, depth)))[1] for s in seeds}
        for looked, few in ((100, 500_000), (1, 0)):
            monkeypatch.setattr(paths, "FIRST_LOOKED", looked, raising=False)
            monkeypatch.setattr(paths, "FEW_NODES", few)
            kept.clear()
            got = {r.seed: tuple(r.path) for r in paths.longest(edges, spark.createDataFrame([(s,) for s in seeds], "seed string"), depth).collect()}
            assert got == want
            last = [len(df.where(F.size("path") == depth + 1).select("seed").collect()) for df in kept if "path" in df.columns]
            assert sum(last) <= len(seeds)


def test_focus_sends_no_texts_or_exploded_words_to_the_driver(spark, monkeypatch):
    """Words go with a number instead of their text, and they are never the side that is broadcast; bounds of ranges hold beginnings of texts only."""
    g = random.Random(6)
    turns = [(f"s{g.randint(0, 5)}", g.choice([0, 1, 2, 3, None]), g.choice(["x" * 80, ""]) + " ".join(g.choice(["alpha", "beta", "gamma", "delta", "what is", "term", "is", "and in physics"]) for _ in range(g.randint(0, 4)))) for _ in range(120)]
    turns = spark.createDataFrame([*turns, ("s1", 1, None)], "session string, turn long, text string")
    senses = spark.createDataFrame([("alpha", 3), ("beta", 3), ("gamma", 5)], "word string, n long")
    given, own, found = [], dialogue.keep, []
    monkeypatch.setattr(dialogue, "keep", lambda df: given.append(df) or own(df))
    for few in (100_000, 1):
        monkeypatch.setattr(dialogue, "FEW_WORDS", few, raising=False)
        given.clear()
        found.append(sorted(map(str, dialogue.focus(turns, senses).collect())))
        plan = [x for df in given for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]
        joins = [x for x in plan if " Join " in x or "- Join" in x]
        assert not any("text#" in x for x in joins) and any("word#" in x and "Inner" in x and f"strategy={'broadcast' if few > 1 else 'merge'}" in x for x in joins)
        dealt = [x for x in plan if "RepartitionByExpression" in x]
        assert len(dealt) == 1 and "substring(text#" in dealt[0]
    assert found[0] == found[1] and len(found[0]) == 121
    by = {}
    for r in turns.collect():
        if r.text is not None and "what is" not in r.text:
            words = {w for w in r.text.split() if w in ("alpha", "beta", "gamma")}
            by[r.session, r.turn, r.text] = min(words, key=lambda w: ({"alpha": -3, "beta": -3, "gamma": -5}[w], w)) if words else None
    told = dialogue.focus(turns, senses).join(turns.where("text NOT LIKE '%what is%' AND text NOT LIKE 'and in%'"), ["session", "turn"])
    assert {(r.session, r.turn, r.term) for r in told.collect()} >= {(s, n, t) for (s, n, x), t in by.items() if n is not None and not x.startswith("and in")}


def test_shared_pairs_are_counted_by_numbers_and_never_shuffled(spark, monkeypatch):
    """Lists of numbers go to blocks in one shuffle; pairs are counted some at a time, and concepts of two areas are counted in each."""
    monkeypatch.setattr(features, "PAIRS_AT_ONCE", 20, raising=False)
    g = random.Random(11)
    held = sorted({(g.choice("ab"), f"c{g.randint(0, 25)}", f"o{g.randint(0, 9)}") for _ in range(160)} | {("z", "alone", "o1")})
    rows = spark.createDataFrame(held, "area string, concept string, o string")
    want = Counter()
    for a, c, o in held:
        want.update((a, c, k) for b, k, p in held if a == b and o == p and c != k)
    best = sorted((c, k, n) for a in "ab" for c in {h[1] for h in held} for n, k in sorted((-n, k) for (b, d, k), n in want.items() if b == a and d == c)[:3] for n in [-n])
    for block in (10_000, 4):
        found = features.most_shared(rows, 3, block)
        assert sorted(tuple(r) for r in found.collect()) == best
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("FlatMapGroupsInArrow") == 1


def test_multihop_keeps_no_paths_and_deals_a_level_once(spark, monkeypatch):
    """Paths are made of the places of nodes at the end; what a level meets goes by seed in one shuffle."""
    given, own = [], paths.keep
    monkeypatch.setattr(paths, "keep", lambda df: given.append(df) or own(df))
    rows = [("a", "p", f"b{j}", 9 - j) for j in range(4)] + [(f"b{j}", "q", f"c{j}{k}", 5) for j in range(3) for k in range(2)] + [("c00", "r", "d", 5), ("c01", "r", "d", 5), ("d", "s", "e", 5)]
    found = paths.multihop(spark.createDataFrame(rows, "src string, p string, dst string, seen long"), spark.createDataFrame([("a",), ("d",), ("e",)], "seed string"), max_nodes=9, most=5)
    got = {(r.seed, r.place): (r.hops, " ".join(r.path)) for r in found.collect()}
    assert got == {("a", 1): (2, "a p b0 q c00"), ("a", 2): (2, "a p b0 q c01"), ("a", 3): (2, "a p b1 q c10"), ("a", 4): (2, "a p b1 q c11"), ("a", 5): (1, "a p b2"), ("d", 1): (1, "d s e")}
    assert given and all("path" not in df.columns for df in given)
    dealt = [df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [seed#") for df in given]
    assert max(dealt) == 1


def test_cosines_are_of_packs_of_vectors(spark, monkeypatch):
    """Both sides are packed, so a vector isn't sent with a pack of queries for each row; all pairs are there."""
    import math

    met = []
    own = graph.keep
    monkeypatch.setattr(graph, "keep", lambda df: met.append(own(df)) or met[-1])
    g = random.Random(9)
    vectors = {i: [g.gauss(0, 1) for _ in range(5)] for i in range(83)} | {200: [0.0] * 5}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 3 = 0")
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    cosine = lambda x, y: dot(x, y) / (math.sqrt(dot(x, x)) * math.sqrt(dot(y, y)) + 1e-9)
    want = {(a, b): cosine(x, y) for a, x in vectors.items() if a % 3 == 0 for b, y in vectors.items() if a != b and cosine(x, y) >= 0.3}
    for block in (2000, 10):
        met.clear()
        got = {(r.a, r.b): r.cosine for r in graph.cosine_neighbors(asked, rows, "vec_id", "embedding", 0.3, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
        assert sorted(df.count() <= -(-84 // block) for df in met) == [True, True]
