"""Accounts, plans, closures and weights again, on the edges of all lines instead of those between nations: a graph for each brand, in which suppliers have many edges."""

from pyspark.sql import functions as F

from ..operators import features, graph, packets, paths
from ..sources import sinks
from ..sources.storage import keep, shared_path
from ..sources.tables import first_by_key, relations, table
from .catalog import REL, SQL, query
from .path_queries import ACTS
from .search_queries import BOTH, both_ways

OWN_ACTS = f"""{BOTH}, e AS (SELECT p_brand AS query_id, src AS s, CASE seen % 4 WHEN 0 THEN 'causes' WHEN 1 THEN 'enables' WHEN 2 THEN 'is_a' ELSE 'requires' END AS p, dst AS o, max(seen) / (max(seen) + 40.0 :: DOUBLE) AS w
  FROM both_ways JOIN part ON 'p' || p_partkey = CASE WHEN src[1] = 'p' THEN src ELSE dst END GROUP BY ALL)"""


def own_acts(spark, d):
    """query_id, s, p, o, w: the edges between a brand's parts and their suppliers, both ways; counted one way, mirrored and kept, since all that follows reads them several times."""
    brands = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("part"), F.col("p_brand").alias("query_id")).distinct()
    own = relations(spark, d).groupBy(F.col("subject_id").alias("part"), "predicate", F.col("object_id").alias("supplier")).agg(F.sum(F.coalesce("seen_count", F.lit(1))).alias("seen"))
    k = F.col("seen") % 4
    p = F.when(k == 0, "causes").when(k == 1, "enables").when(k == 2, "is_a").otherwise("requires")
    e = own.groupBy("part", p.alias("p"), "supplier").agg(F.max("seen").alias("n")).join(brands, "part")
    ends = lambda s, o: F.struct(F.col(s).alias("s"), F.col(o).alias("o"))
    e = e.withColumn("x", F.explode(F.array(ends("part", "supplier"), ends("supplier", "part"))))
    return keep(e.select("query_id", "x.s", "p", "x.o", (F.col("n") / (F.col("n") + 40.0)).alias("w")))


@query("cg02_explanations_by_brand", SQL["cg02_explanations"].replace(ACTS, OWN_ACTS), rounded="confidence")
def cg02_brand(spark, d):
    return paths.explain(own_acts(spark, d)).withColumn("narrative", F.array_join("narrative", " → "))


@query("cg03_traced_causes_by_brand", SQL["cg03_traced_causes"].replace(ACTS, OWN_ACTS), rounded="confidence")
def cg03_brand(spark, d):
    return paths.trace_cause(own_acts(spark, d)).withColumn("chain", F.array_join("chain", " → ")).withColumn("roots", F.array_join("roots", ","))


@query("gr24_top_paths_by_brand", SQL["gr24_top_paths"].replace(ACTS, OWN_ACTS), rounded="log_score")
def gr24_brand(spark, d):
    e = own_acts(spark, d)
    nodes, top = packets.ranked(e)
    seeds = nodes.where("place <= 3").select("query_id", "node", "a")
    found = paths.top_paths(top, seeds, 0.2, ["causes", "enables", "requires"], ["is_a"], depth=2)
    return found.withColumn("nodes", F.array_join("nodes", " ")).withColumn("place", F.col("place").cast("long"))


@query("cg07_plans_by_brand", SQL["cg07_plans"].replace(ACTS, OWN_ACTS), rounded="plan_score confidence")
def cg07_brand(spark, d):
    return paths.plan_next(own_acts(spark, d)).drop("utilities").withColumn("actions", F.array_join("actions", ","))


@query("gr17_closure_of_parts", """WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2),
  c AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT c.src, e.dst, depth + 1 FROM c JOIN e ON c.dst = e.src WHERE depth < 3) SELECT src, dst, min(depth) AS depth FROM c GROUP BY 1, 2""")
def gr17_parts(spark, d):
    """All that three steps up join, where each part lies under half and under a third of its number."""
    k = F.col("p_partkey")
    up = lambda n: table(spark, d, "part").where(k >= n).select(k.cast("long").alias("src"), F.floor(k / n).cast("long").alias("dst"))
    return graph.closure(up(2).union(up(3)), 3)


@query("gr40_lattice_weights_of_parts", f"WITH {BOTH} SELECT src AS term, count(*) AS degree, CAST(sum(seen) AS BIGINT) AS weight, row_number() OVER (ORDER BY count(*) DESC, sum(seen) DESC, src) <= 3 AS top FROM both_ways GROUP BY 1")
def gr40_parts(spark, d):
    b = both_ways(spark, d).groupBy(F.col("src").alias("term")).agg(F.count("*").alias("degree"), F.sum("seen").alias("weight"))
    best = b.orderBy(F.desc("degree"), F.desc("weight"), "term").limit(3).select("term", F.lit(True).alias("top"))
    return b.join(best, "term", "left").select("term", "degree", "weight", F.coalesce("top", F.lit(False)).alias("top"))


SOURCES = "SELECT s_nationkey AS k, s_name AS v, 0 AS src FROM supplier UNION ALL SELECT c_nationkey, c_name, 1 FROM customer UNION ALL SELECT n_nationkey, n_name, 2 FROM nation"


@query("wn02_first_of_three_sources", f"SELECT k, v, src FROM ({SOURCES}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY src, v) = 1")
def wn02(spark, d):
    """One row of each key, from the first source that has it."""
    one = lambda t, k, v, i: table(spark, d, t).select(F.col(k).alias("k"), F.col(v).alias("v"), F.lit(i).alias("src"))
    rows = one("supplier", "s_nationkey", "s_name", 0).union(one("customer", "c_nationkey", "c_name", 1)).union(one("nation", "n_nationkey", "n_name", 2))
    return first_by_key(rows, ["k"], ["src", "v"])


@query("snk13_text_report", """WITH c AS (SELECT p_brand AS section, p_type AS name, count(*) AS n FROM part GROUP BY 1, 2), l AS (SELECT section, 0 AS place, '== ' || section || ' (' || sum(n) || ')' AS line FROM c GROUP BY 1 UNION ALL SELECT section, row_number() OVER (PARTITION BY section ORDER BY n DESC, name), '  ' || name || ': ' || n FROM c)
  SELECT row_number() OVER (ORDER BY section, place) AS number, line AS value FROM l""")
def snk13(spark, d):
    """A report of counts by section, written as text and read back in order."""
    path = shared_path(spark, "report")
    counts = table(spark, d, "part").groupBy(F.col("p_brand").alias("section"), F.col("p_type").alias("name")).agg(F.count("*").alias("n"))
    sinks.write_report(counts, path)
    return sinks.read_report(spark, path)


@query("gr28_proposals_by_brand", f"""WITH {REL}, e AS (SELECT DISTINCT subject_id AS s, predicate AS p, object_id AS o FROM relations), held AS (SELECT DISTINCT p_brand AS brand, s, o FROM e JOIN part ON s = 'p' || p_partkey),
  near AS (SELECT a.s AS concept, b.s AS other, count(*) / 30 AS similarity FROM held a JOIN held b ON a.brand = b.brand AND a.o = b.o AND a.s <> b.s GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY a.s ORDER BY count(*) DESC, b.s) <= 4),
  x AS (SELECT concept, e.p, e.o, max(similarity * CASE e.p WHEN 'causes' THEN 0.9 :: DOUBLE WHEN 'requires' THEN 1.0 :: DOUBLE ELSE 0.65 :: DOUBLE END * 0.7 :: DOUBLE * 0.55 :: DOUBLE) AS confidence FROM near JOIN e ON e.s = other GROUP BY 1, 2, 3)
  SELECT concept, p, o, confidence, row_number() OVER (PARTITION BY concept ORDER BY confidence DESC, p, o) AS place FROM x WHERE (concept, o) NOT IN (SELECT (s, o) FROM e) AND NOT (p = 'inhibits' AND o = 's1') QUALIFY place <= 10""", rounded="confidence")
def gr28_brand(spark, d):
    """What each part may inherit from the four parts of its brand with which it shares most suppliers."""
    brands = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("s"), F.col("p_brand").alias("brand")).distinct()
    e = relations(spark, d).select(F.col("subject_id").alias("s"), F.col("predicate").alias("p"), F.col("object_id").alias("o")).repartition("s")  # dealt once; what follows reads what is kept
    held = keep(e.groupBy("s", "o").agg(F.collect_set("p").alias("ps")).join(brands.groupBy("s").agg(F.collect_list("brand").alias("brands")), "s"))
    near = features.most_shared(held.select(F.explode("brands").alias("area"), F.col("s").alias("concept"), "o"), 4)
    near = near.select("concept", "other", (F.col("shared") / 30).alias("similarity"))
    rejected = brands.select(F.col("s").alias("concept"), F.lit("inhibits").alias("p"), F.lit("s1").alias("o"))
    found = features.proposals(near, held.select("s", F.explode("ps").alias("p"), "o"), held.select(F.col("s").alias("concept"), "o"), rejected, {"causes": 0.9, "requires": 1.0}, F.lit(0.7), neighbors=4)
    return found.withColumn("place", F.col("place").cast("long"))
