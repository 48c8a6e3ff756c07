"""Named queries over patterns, paths by breadth and weights that spread, all on the edges between parts, suppliers and nations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, paths, patterns
from ..sources.tables import anchors, relations, table
from .catalog import ANC, REL, query

# --- edges of every line: parts to suppliers and back ---
BOTH = f"{REL}, own AS (SELECT subject_id, predicate, object_id, CAST(sum(coalesce(seen_count, 1)) AS BIGINT) AS seen FROM relations GROUP BY 1, 2, 3), both_ways AS (SELECT subject_id AS src, predicate AS p, object_id AS dst, seen FROM own UNION ALL SELECT object_id, 'by_' || predicate, subject_id, seen FROM own)"


def both_ways(spark, d):
    own = relations(spark, d).groupBy("subject_id", "predicate", "object_id").agg(F.sum(F.coalesce("seen_count", F.lit(1))).alias("seen"))
    back = own.select(F.col("object_id").alias("src"), F.concat(F.lit("by_"), "predicate").alias("p"), F.col("subject_id").alias("dst"), "seen")
    return own.select(F.col("subject_id").alias("src"), F.col("predicate").alias("p"), F.col("object_id").alias("dst"), "seen").unionByName(back)


def hop_sql(hops: int, nodes: int) -> str:
    """CTEs from steps(node, r, p, dst) and q0(seed, node, path, pos) to ended(seed, path, hops, pos)."""
    out = ["v0 AS (SELECT seed, node FROM q0), known0 AS (SELECT seed, 1 AS known FROM q0)"]
    for h in range(hops):
        out.append(f"""ent{h} AS MATERIALIZED (SELECT q.seed, q.pos, s.r, q.path, s.p, s.dst AS node FROM q{h} q JOIN steps s ON s.node = q.node WHERE NOT EXISTS (SELECT 1 FROM v{h} v WHERE v.seed = q.seed AND v.node = s.dst) QUALIFY row_number() OVER (PARTITION BY q.seed, s.dst ORDER BY q.pos, s.r) = 1),
  que{h} AS MATERIALIZED (SELECT q.seed, q.node, q.path, q.pos, coalesce(n, 0) AS fresh, known, known + coalesce(sum(n) OVER (PARTITION BY q.seed ORDER BY q.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {nodes} AS looked, q.node IN (SELECT node FROM steps) AS has
    FROM q{h} q JOIN known{h} USING (seed) LEFT JOIN (SELECT seed, pos, count(*) AS n FROM ent{h} GROUP BY 1, 2) USING (seed, pos)),
  known{h + 1} AS (SELECT seed, max(known) + sum(CASE WHEN looked THEN fresh ELSE 0 END) AS known FROM que{h} GROUP BY 1),
  q{h + 1} AS MATERIALIZED (SELECT e.seed, e.node, list_concat(e.path, [e.p, e.node]) AS path, row_number() OVER (PARTITION BY e.seed ORDER BY e.pos, e.r) AS pos FROM ent{h} e JOIN que{h} USING (seed, pos) WHERE looked),
  v{h + 1} AS MATERIALIZED (SELECT * FROM v{h} UNION ALL SELECT seed, node FROM q{h + 1})""")
    ends = [f"SELECT seed, path, {h} AS hops, pos FROM que{h} WHERE NOT looked OR NOT has" for h in range(1, hops)]
    return ", ".join(out) + f", ended AS ({' UNION ALL '.join([*ends, f'SELECT seed, path, {hops}, pos FROM q{hops}'])})"


@query("gr08_multihop_paths", f"""WITH {BOTH}, {ANC}, steps AS (SELECT src AS node, p, dst, row_number() OVER (PARTITION BY src ORDER BY seen DESC, dst, p) AS r FROM both_ways WHERE seen >= 2 QUALIFY r <= 8),
  q0 AS (SELECT id AS seed, id AS node, [id] AS path, 1 AS pos FROM anchors WHERE id[1] = 'p'), {hop_sql(3, 60)}
  SELECT seed, array_to_string(path, ' ') AS path, hops, row_number() OVER (PARTITION BY seed ORDER BY hops DESC, pos) AS place FROM ended QUALIFY place <= 25""")
def gr08_multihop(spark, d):
    """Paths by breadth with every part as a seed, over the edges of all lines."""
    seeds = anchors(spark, d).where(F.col("id").startswith("p")).select(F.col("id").alias("seed"))
    found = paths.multihop(both_ways(spark, d), seeds)
    return found.select("seed", F.array_join("path", " ").alias("path"), "hops", F.col("place").cast("long").alias("place"))


# --- paths from the dearest part of each brand, over the edges of all lines, both ways ---
SEEDS = "seeds AS (SELECT id AS seed FROM anchors WHERE id[1] = 'p' QUALIFY row_number() OVER (PARTITION BY domain ORDER BY maturity DESC, id) = 1)"


def reach_sql(edges: str, depth: int) -> str:
    """CTEs from seeds(seed) to reached(seed, node, path): each node by the least of its shortest paths."""
    out = [f"steps AS MATERIALIZED (SELECT DISTINCT src, dst FROM {edges}), r0 AS (SELECT seed, seed AS node, [seed] AS path FROM seeds), s0 AS (SELECT * FROM r0)"]
    for i in range(1, depth + 1):
        out.append(f"r{i} AS MATERIALIZED (SELECT r.seed, dst AS node, min(list_append(r.path, dst)) AS path FROM r{i - 1} r JOIN steps ON src = r.node WHERE NOT EXISTS (SELECT 1 FROM s{i - 1} s WHERE s.seed = r.seed AND s.node = dst) GROUP BY 1, 2), s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL SELECT * FROM r{i})")
    return ", ".join(out) + f", reached AS (SELECT * FROM s{depth})"


def dearest(spark, d):
    p = anchors(spark, d).where(F.col("id").startswith("p"))
    return p.groupBy("domain").agg(F.min(F.struct(-F.col("maturity"), "id"))["id"].alias("seed")).select("seed")


@query("gr13_longest_path", f"WITH {BOTH}, {ANC}, {SEEDS}, {reach_sql('both_ways', 4)} SELECT seed, array_to_string(path, ' ') AS path FROM reached QUALIFY row_number() OVER (PARTITION BY seed ORDER BY len(path) DESC, path) = 1")
def gr13(spark, d):
    e = relations(spark, d).select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))
    return paths.longest(e, dearest(spark, d), 4).select("seed", F.array_join("path", " ").alias("path"))


@query("gr14_forward_and_reverse", f"""WITH {REL}, {ANC}, {SEEDS}, labelled AS (SELECT src, dst, min(p) AS p FROM (SELECT subject_id AS src, object_id AS dst, predicate AS p FROM relations UNION ALL SELECT object_id, subject_id, '←' || predicate FROM relations) GROUP BY 1, 2), {reach_sql('labelled', 3)},
  t AS (SELECT seed, path, row_number() OVER (PARTITION BY seed ORDER BY len(path), path) AS place FROM reached WHERE len(path) > 1 QUALIFY place <= 12)
  SELECT seed, seed || string_agg(' —[' || p || ']→ ' || dst, '' ORDER BY i) AS chain, place FROM (SELECT *, unnest(range(1, len(path))) AS i FROM t) x JOIN labelled l ON l.src = x.path[i] AND l.dst = x.path[i + 1] GROUP BY seed, path, place""")
def gr14(spark, d):
    e = relations(spark, d).select(F.col("subject_id").alias("s"), F.col("predicate").alias("p"), F.col("object_id").alias("o"))
    return paths.inferred(e, dearest(spark, d), depth=3).withColumn("place", F.col("place").cast("long"))


@query("gr16_path_between", f"WITH {BOTH}, {ANC}, {SEEDS}, {reach_sql('both_ways', 4)} SELECT seed AS src, node AS dst, array_to_string(path, ' ') AS path FROM reached WHERE node IN (SELECT 's' || s_suppkey FROM supplier)")
def gr16(spark, d):
    """The shortest path from the dearest part of each brand to every supplier of any part of the brand's neighbours, over all lines."""
    e = relations(spark, d).select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))
    ends = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node")).distinct()
    found = paths.reach(e.union(e.select("dst", "src")), dearest(spark, d), 4, ends)
    return found.select(F.col("seed").alias("src"), F.col("node").alias("dst"), F.array_join("path", " ").alias("path"))


# --- patterns: parts cause, require or inhibit suppliers, suppliers lie in nations, nations want parts ---
FACTS = f"""{REL}, facts AS (SELECT subject_id, predicate, object_id, greatest(max(confidence), 1e-6 :: DOUBLE) AS c, max(edge_type) AS truth, bool_or(polarity = '-' AND seen_count IS NULL) AS bridge FROM relations GROUP BY 1, 2, 3
  UNION ALL SELECT 's' || s_suppkey, 'lies_in', 'n' || s_nationkey, 0.9, 'O', false FROM supplier
  UNION ALL SELECT 'p' || l_partkey, 'wanted_in', 'n' || c_nationkey, greatest(max(l_tax) * 10, 1e-6 :: DOUBLE), 'O', false FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3)"""


def facts(spark, d):
    t = lambda n: table(spark, d, n)
    name = lambda k, c: F.concat(F.lit(k), c)
    own = relations(spark, d).groupBy("subject_id", "predicate", "object_id").agg(F.max("confidence").alias("local_confidence"), F.max("edge_type").alias("local_truth"), F.bool_or((F.col("polarity") == "-") & F.col("seen_count").isNull()).alias("is_bridge"))
    told = lambda df: df.withColumns({"local_truth": F.lit("O"), "is_bridge": F.lit(False)})
    lies = told(t("supplier").select(name("s", "s_suppkey").alias("subject_id"), F.lit("lies_in").alias("predicate"), name("n", "s_nationkey").alias("object_id"), F.lit(0.9).alias("local_confidence")))
    wanted = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    wanted = told(wanted.groupBy(name("p", "l_partkey").alias("subject_id"), F.lit("wanted_in").alias("predicate"), name("n", "c_nationkey").alias("object_id")).agg((F.max("l_tax") * 10).alias("local_confidence")))
    return own.unionByName(lies).unionByName(wanted)


@query("gr20_triangle", f"""WITH {FACTS} SELECT a.subject_id AS "P", a.object_id AS "S", b.object_id AS "N", a.c * b.c * w.c AS score, a.bridge OR b.bridge OR w.bridge AS hit_bridge
  FROM facts a JOIN facts b ON b.subject_id = a.object_id JOIN facts w ON w.subject_id = a.subject_id AND w.object_id = b.object_id WHERE a.predicate = 'causes' AND b.predicate = 'lies_in' AND w.predicate = 'wanted_in' ORDER BY score DESC, 1, 2, 3 LIMIT 64""", rounded="score")
def gr20_triangle(spark, d):
    """A cycle: a supplier in a nation that wants the part it is caused by."""
    return patterns.unify([("?P", "causes", "?S"), ("?S", "lies_in", "?N"), ("?P", "wanted_in", "?N")], facts(spark, d), k=64)


@query("gr20_chain", f"""WITH {FACTS} SELECT a.subject_id AS "P", a.object_id AS "S", b.object_id AS "N", q.subject_id AS "Q", a.c * b.c * q.c AS score, a.bridge OR b.bridge OR q.bridge AS hit_bridge
  FROM facts a JOIN facts b ON b.subject_id = a.object_id JOIN facts q ON q.object_id = b.object_id WHERE a.predicate = 'inhibits' AND a.subject_id = 'p7' AND b.predicate = 'lies_in' AND q.predicate = 'wanted_in' ORDER BY score DESC, 1, 2, 3, 4 LIMIT 64""".replace('a.subject_id AS "P", a.object_id', 'a.object_id'), rounded="score")
def gr20_chain(spark, d):
    """Three edges in a row from a named part."""
    return patterns.unify([("p7", "inhibits", "?S"), ("?S", "lies_in", "?N"), ("?Q", "wanted_in", "?N")], facts(spark, d), k=64)


@query("gr20_constrained", f"""WITH {FACTS} SELECT a.subject_id AS "P", a.object_id AS "S", r.object_id AS "T", b.object_id AS "N", a.c * r.c * b.c * l.c AS score, a.bridge OR r.bridge AS hit_bridge
  FROM facts a JOIN facts r ON r.subject_id = a.subject_id JOIN facts b ON b.subject_id = a.object_id JOIN facts l ON l.subject_id = r.object_id AND l.object_id = b.object_id
  WHERE a.predicate = 'causes' AND r.predicate = 'inhibits' AND b.predicate = 'lies_in' AND l.predicate = 'lies_in' AND a.object_id <> r.object_id AND b.object_id >= 'n2' ORDER BY score DESC, 1, 2, 3, 4 LIMIT 64""", rounded="score")
def gr20_constrained(spark, d):
    """Four edges round a cycle, of two suppliers that differ, in nations from n2 on."""
    cycle = [("?P", "causes", "?S"), ("?P", "inhibits", "?T"), ("?S", "lies_in", "?N"), ("?T", "lies_in", "?N")]
    return patterns.unify(cycle, facts(spark, d), k=64, constraints=[("?S", "!=", "?T"), ("?N", ">=", "n2")])


@query("flt13_truth_floor", f"""WITH {FACTS}, e AS (SELECT * FROM facts WHERE truth = 'F' OR bridge) SELECT a.subject_id AS "P", a.object_id AS "S", a.c * b.c AS score, a.bridge OR b.bridge AS hit_bridge
  FROM e a JOIN e b USING (subject_id, object_id) WHERE a.predicate = 'causes' AND b.predicate = 'inhibits' ORDER BY score DESC, 1, 2 LIMIT 64""", rounded="score")
def flt13(spark, d):
    """Edges of one truth only, but bridges of any (FLT-13)."""
    return patterns.unify([("?P", "causes", "?S"), ("?P", "inhibits", "?S")], facts(spark, d), truth_floor=["F"], k=64)


# --- weights that spread over bridges ---
STEPS = 39


def spread_sql(steps: int, damping: float) -> str:
    out = ["w0 AS (SELECT node, base AS weight FROM base)"]
    for i in range(steps):
        out.append(f"w{i + 1} AS MATERIALIZED (SELECT node, {1 - damping} * base + {damping} * CASE WHEN node IN (SELECT node FROM shares) THEN coalesce(got, 0) ELSE weight END AS weight FROM base JOIN w{i} USING (node) LEFT JOIN (SELECT dst AS node, sum(weight * share) AS got FROM w{i} JOIN shares USING (node) GROUP BY 1) USING (node))")
    return ", ".join(out)


@query("gr40_bridge_propagation", f"""WITH {REL}, {ANC}, bridges AS (SELECT subject_id AS a, object_id AS b, max(confidence) :: DOUBLE AS r FROM relations WHERE predicate = 'inhibits' GROUP BY 1, 2 HAVING max(confidence) > 0.7 :: DOUBLE),
  linked AS (SELECT a AS node, b AS dst, r FROM bridges UNION ALL SELECT b, a, r FROM bridges), shares AS MATERIALIZED (SELECT node, dst, r / sum(r) OVER (PARTITION BY node) AS share FROM linked),
  base AS MATERIALIZED (SELECT id AS node, 0.5 :: DOUBLE + abs(maturity) / 10000 AS base FROM anchors), {spread_sql(STEPS, 0.5)} SELECT node, weight FROM w{STEPS}""", rounded="weight")
def gr40_propagation(spark, d):
    """The weights of all parts and suppliers once they have spread over the inhibiting edges of high confidence."""
    bridges = relations(spark, d).where("predicate = 'inhibits'").groupBy(F.col("subject_id").alias("a"), F.col("object_id").alias("b")).agg(F.max("confidence").alias("resonance")).where("resonance > 0.7D")
    start = anchors(spark, d).select(F.col("id").alias("node"), (0.5 + F.abs("maturity") / 10000).alias("weight"))
    return graph.propagated(bridges, start, tolerance=1e-11)
