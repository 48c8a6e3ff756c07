"""Named queries over packets, paths, names and boxes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import packets
from ..sources.tables import anchors, relations, table
from .catalog import ANC, NATIONS, REL, nation_edges, query

PACKET = f"""{REL}, e AS (SELECT 'q' || capsule_id AS query_id, subject_id AS s, CASE predicate WHEN 'causes' THEN 'is_a' WHEN 'inhibits' THEN 'used_for' ELSE predicate END AS p, object_id AS o, max(confidence) AS w FROM relations GROUP BY ALL),
  u AS (SELECT query_id, s AS node, w AS a FROM e UNION ALL SELECT query_id, o, 0.8 * w FROM e UNION ALL SELECT query_id, query_id, 1.0 FROM e), m AS (SELECT query_id, node, max(a) AS a FROM u GROUP BY ALL),
  n AS (SELECT query_id, node, a / max(a) OVER (PARTITION BY query_id) AS a FROM m), top_nodes AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, node) AS place FROM n WHERE a >= 0.05 QUALIFY place <= 30),
  j AS (SELECT e.*, x.a AS a_s, y.a AS a_o, x.a * w * y.a AS score FROM e JOIN n x ON e.query_id = x.query_id AND e.s = x.node JOIN n y ON e.query_id = y.query_id AND e.o = y.node),
  top_edges AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s, p, o) AS place FROM j WHERE score >= 0.002 OR w >= 0.3 QUALIFY place <= 60),
  packets AS (SELECT query_id, n_nodes, coalesce(n_edges, 0) AS n_edges, round(0.7 * best + 0.3 * least(coalesce(n_edges, 0) / 20, 1.0), 3) AS confidence
    FROM (SELECT query_id, count(*) AS n_nodes, avg(a) FILTER (place <= 5) AS best FROM top_nodes GROUP BY 1) LEFT JOIN (SELECT query_id, count(*) AS n_edges FROM top_edges GROUP BY 1) USING (query_id))"""


def packet_edges(spark, d, needs: bool = False):
    """(edges, ranked nodes and edges) of every order; with needs, edges of kind tell what they block."""
    p = F.when(F.col("predicate") == "causes", "blocks" if needs else "is_a").when(F.col("predicate") == "inhibits", "used_for").otherwise(F.col("predicate"))
    return packets.merged(relations(spark, d).select(F.concat(F.lit("q"), "capsule_id").alias("query_id"), F.col("subject_id").alias("s"), p.alias("p"), F.col("object_id").alias("o"), F.col("confidence").alias("w")))


@query("cg00_packets", f"WITH {PACKET} SELECT * FROM packets")
def cg00(spark, d):
    return packets.packets(*packet_edges(spark, d))


@query("cg01_definitions", f"""WITH {PACKET}, h AS (SELECT query_id, CASE p WHEN 'is_a' THEN 'genus' WHEN 'used_for' THEN 'function' ELSE 'relations' END AS slot, o, a_s * CASE p WHEN 'requires' THEN 0.85 ELSE 1.0 END * w AS hit FROM top_edges),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id, slot ORDER BY hit DESC, o) AS place FROM h QUALIFY place <= 3),
  f AS (SELECT query_id, max(o) FILTER (place = 1 AND slot = 'genus') AS genus, coalesce(string_agg(o, ',' ORDER BY place) FILTER (slot = 'function'), '') AS functions, count(*) FILTER (place = 1) / 4 AS completeness, avg(hit) FILTER (place = 1 AND hit > 0) AS mean FROM r GROUP BY 1)
  SELECT query_id, genus, coalesce(functions, '') AS functions, coalesce(completeness, 0.0) AS completeness, round(coalesce(CASE WHEN mean > 1 THEN 1.0 ELSE mean END, 0.5 * confidence), 9) AS confidence FROM packets LEFT JOIN f USING (query_id)""")
def cg01(spark, d):
    return packets.definitions(*packet_edges(spark, d))


@query("cg08_confidence", f"""WITH {PACKET}, near AS (SELECT query_id, node FROM top_nodes WHERE place <= 15),
  k AS (SELECT t.*, CASE WHEN place <= 30 AND x.node IS NOT NULL AND y.node IS NOT NULL THEN a_s * a_o END AS pair FROM top_edges t LEFT JOIN near x ON t.query_id = x.query_id AND t.s = x.node LEFT JOIN near y ON t.query_id = y.query_id AND t.o = y.node),
  z AS (SELECT query_id, 1 - product(1 - 0.7 * w) FILTER (place <= 20) AS evidence, sum(pair * w) / nullif(sum(pair), 0) AS coherence, avg(w) FILTER (place <= 10) AS trust, max(w) FILTER (p = 'used_for') AS against FROM k GROUP BY 1),
  c AS (SELECT query_id, least(count(*) / 10, 1.0) AS coverage FROM top_nodes GROUP BY 1)
  SELECT query_id, round(1 / (1 + exp(-(4 * (0.25 * coalesce(evidence, 0) + 0.2 * coverage + 0.2 * least(coalesce(coherence, 0.5), 1.0) + 0.15 * coalesce(trust, 0) - 0.1 * coalesce(against, 0) - 0.025 * (1 - coverage)) - 2))), 3) AS confidence FROM c LEFT JOIN z USING (query_id)""")
def cg08(spark, d):
    edges, parts = packet_edges(spark, d)
    return packets.confidence(edges, ["used_for"], parts)


NAMED = f"""{NATIONS}, e AS (SELECT a.n_name AS s, CASE n % 3 WHEN 0 THEN 'causes' WHEN 1 THEN 'is_a' ELSE 'knows' END AS p, b.n_name AS o FROM nation_edges JOIN nation a ON a.n_nationkey = subject_id JOIN nation b ON b.n_nationkey = object_id),
  k AS (SELECT *, CASE p WHEN 'causes' THEN 0.9 WHEN 'is_a' THEN 1.0 ELSE 0.65 END * CASE WHEN len(string_split(o, ' ')) >= 3 THEN 0.9 WHEN len(string_split(o, ' ')) = 2 THEN 0.7 WHEN length(o) <= 4 THEN 0.3 ELSE 0.42 END AS hop FROM e),
  paths AS (SELECT a.s AS src, a.p AS p1, a.o AS mid, b.p AS p2, b.o AS dst, a.hop * b.hop AS score FROM k a JOIN k b ON a.o = b.s WHERE a.s <> a.o AND a.s <> b.o AND a.o <> b.o)"""


def named_edges(spark, d):
    """The edges between nations are 625 at most, as are their names."""
    n = table(spark, d, "nation")
    e = nation_edges(spark, d).join(F.broadcast(n.select(F.col("n_nationkey").alias("subject_id"), F.col("n_name").alias("s"))), "subject_id")
    e = e.join(F.broadcast(n.select(F.col("n_nationkey").alias("object_id"), F.col("n_name").alias("o"))), "object_id")
    return e.select("s", F.when(F.col("n") % 3 == 0, "causes").when(F.col("n") % 3 == 1, "is_a").otherwise("knows").alias("p"), "o")


@query("gr09_path_scores", f"WITH {NAMED} SELECT src, p1, mid, p2, dst, CAST(round(score, 6) AS DOUBLE) AS score FROM paths")
def gr09(spark, d):
    return packets.two_hops(named_edges(spark, d)).withColumn("score", F.round("score", 6))


@query("gr10_hop_conclusions", f"""WITH {NAMED} SELECT src, CASE WHEN p1 = 'causes' AND p2 = 'causes' THEN 'CAUSAL CHAIN: ' || src || ' → ' || mid || ' → ' || dst WHEN p1 = 'is_a' THEN 'CLASSIFICATION CHAIN: ' || src || ' is_a ' || mid || ', which ' || p2 || ' ' || dst
  WHEN p2 = 'causes' THEN 'DERIVED: ' || src || ' ' || p1 || ' ' || mid || ', enabling ' || dst ELSE 'PATH: ' || src || ' —[' || p1 || ']→ ' || mid || ' —[' || p2 || ']→ ' || dst END AS conclusion FROM paths QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(score, 6) DESC, mid, dst, p1, p2) <= 8""")
def gr10(spark, d):
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.round("score", 6).desc(), "mid", "dst", "p1", "p2"))
    rows = packets.two_hops(named_edges(spark, d)).withColumn("place", rank).where("place <= 8")
    say = lambda form: F.format_string(form, "src", "p1", "mid", "p2", "dst")
    causal = F.col("p2") == "causes"
    text = F.when((F.col("p1") == "causes") & causal, say("CAUSAL CHAIN: %1$s → %3$s → %5$s")).when(F.col("p1") == "is_a", say("CLASSIFICATION CHAIN: %1$s is_a %3$s, which %4$s %5$s"))
    return rows.select("src", text.when(causal, say("DERIVED: %1$s %2$s %3$s, enabling %5$s")).otherwise(say("PATH: %1$s —[%2$s]→ %3$s —[%4$s]→ %5$s")).alias("conclusion"))


@query("gr27_malformed_names", """WITH a AS (SELECT p_partkey AS id, p_size AS n, CASE p_partkey % 6 WHEN 0 THEN '_ ' || p_name WHEN 1 THEN p_name || '''' WHEN 2 THEN ' the ' || p_name WHEN 3 THEN '- ' || p_name || ';' WHEN 4 THEN '_ ''' ELSE p_name END AS name FROM part),
  o AS (SELECT id, n, lower(trim(regexp_replace(regexp_replace(trim(name), '^[_-]\\s+', ''), '''+$', ''))) AS target FROM a WHERE name LIKE '_ %' OR name <> trim(name) OR (ends_with(name, '''') AND NOT regexp_matches(lower(name), '''s$|''t$|''s |''ll|''re|''ve')))
  SELECT id, CASE WHEN target = '' THEN 'DELETE' WHEN n >= 40 THEN 'REVIEW' WHEN len(string_split(target, ' ')) > 5 OR contains(target, ';') OR starts_with(target, 'the ') THEN 'DELETE' ELSE 'MERGE' END AS cls, target FROM o""")
def gr27(spark, d):
    k, own = F.col("p_partkey") % 6, F.col("p_name")
    name = F.when(k == 0, F.concat(F.lit("_ "), own)).when(k == 1, F.concat(own, F.lit("'"))).when(k == 2, F.concat(F.lit(" the "), own)).when(k == 3, F.concat(F.lit("- "), own, F.lit(";"))).when(k == 4, "_ '").otherwise(own)
    return packets.name_verdicts(table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_size").alias("n")), high=40)


@query("gr33_concept_confidence", f"""WITH {REL}, {ANC}, r AS (SELECT subject_id AS id, count(*) AS n FROM relations GROUP BY 1), w AS (SELECT DISTINCT unnest(string_split(lower(canonical), ' ')) AS topic, id, maturity FROM anchors),
  t AS (SELECT topic, maturity, coalesce(n, 0) AS n FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY topic ORDER BY maturity DESC, id) <= 10) LEFT JOIN r USING (id)),
  s AS (SELECT topic, round(0.3 * least(count(*) / 5, 1.0) + 0.4 * least(avg(maturity) / 2000, 1.0) + 0.3 * least(avg(n) / 40, 1.0), 3) AS confidence FROM t GROUP BY 1)
  SELECT topic, confidence, CASE WHEN confidence >= 0.7 THEN 'strong' WHEN confidence >= 0.4 THEN 'moderate' WHEN confidence >= 0.15 THEN 'sparse' ELSE 'minimal' END AS verdict FROM s""")
def gr33(spark, d):
    """The scales of maturity and relations are those of the tables at hand."""
    n = relations(spark, d).groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("n"))
    w = anchors(spark, d).select(F.explode(F.split(F.lower("canonical"), " ")).alias("topic"), "id", "maturity").distinct()
    best = w.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("maturity"), "id"))).where("place <= 10")
    part = lambda c, full: F.least(c / full, F.lit(1.0))
    score = 0.3 * part(F.count("*"), 5) + 0.4 * part(F.avg("maturity"), 2000) + 0.3 * part(F.avg(F.coalesce("n", F.lit(0))), 40)
    s = best.join(n, "id", "left").groupBy("topic").agg(F.round(score, 3).alias("confidence"))
    c = F.col("confidence")
    return s.select("topic", "confidence", F.when(c >= 0.7, "strong").when(c >= 0.4, "moderate").when(c >= 0.15, "sparse").otherwise("minimal").alias("verdict"))


@query("gr43_spatial_relations", """WITH b AS (SELECT l_orderkey AS image, l_linenumber AS id, l_quantity * 12 AS x, l_partkey % 480 AS y FROM lineitem), p AS (SELECT a.image, a.id AS a, b.id AS b, b.x - a.x AS dx, b.y - a.y AS dy FROM b a JOIN b ON a.image = b.image AND a.id <> b.id)
  SELECT image, a, b, CASE WHEN abs(dy) > abs(dx) THEN CASE WHEN dy > 0 THEN 'above' ELSE 'below' END WHEN dx < 0 THEN 'left of' ELSE 'right of' END AS predicate, round(greatest(0.5, 1 - sqrt(dx * dx + dy * dy) / 200), 4) AS confidence FROM p WHERE sqrt(dx * dx + dy * dy) <= 200""")
def gr43(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("id"), (F.col("l_quantity") * 12).alias("x"), (F.col("l_partkey") % 480).alias("y"))
    return packets.spatial_relations(b).withColumn("confidence", F.round("confidence", 4))
