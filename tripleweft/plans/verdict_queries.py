"""Named queries over what is concluded from packets."""

from pyspark.sql import functions as F

from ..operators import packets, verdicts
from ..sources.tables import table
from .catalog import query
from .packet_queries import PACKET, packet_edges

WEIGHTS = "CASE p WHEN 'requires' THEN 1.0 WHEN 'is_a' THEN 0.7 END"


@query("cg04_comparisons", """WITH f AS (SELECT c_nationkey AS id, c_mktsegment AS p, o_orderpriority AS o, count(*) / (count(*) + 20.0) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
  k AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b, p, o FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey JOIN f ON f.id IN (x.n_nationkey, y.n_nationkey) GROUP BY ALL),
  w AS (SELECT k.a, k.b, coalesce(f.w, 0) AS x, coalesce(g.w, 0) AS y FROM k LEFT JOIN f ON f.id = k.a AND f.p = k.p AND f.o = k.o LEFT JOIN f g ON g.id = k.b AND g.p = k.p AND g.o = k.o),
  s AS (SELECT a, b, count(*) FILTER (x > 0 AND y > 0) AS n_shared, count(*) FILTER (x > 0 AND y = 0) AS only_a, count(*) FILTER (y > 0 AND x = 0) AS only_b, round(sum(least(x, y)) / sum(greatest(x, y)), 6) AS similarity FROM w GROUP BY 1, 2)
  SELECT *, CASE WHEN round(similarity, 3) >= 0.65 THEN 'similar' WHEN round(similarity, 3) >= 0.35 THEN 'related' WHEN round(similarity, 3) >= 0.15 THEN 'different' ELSE 'distinct' END AS verdict FROM s""")
def cg04(spark, d):
    n = F.count("*")
    f = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("p"), F.col("o_orderpriority").alias("o")).agg((n / (n + 20.0)).alias("w"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("a"))
    pairs = nations.join(F.broadcast(nations.withColumnRenamed("a", "b")), F.col("a") < F.col("b"))  # 25 nations
    return verdicts.compare(pairs, f).withColumn("similarity", F.round("similarity", 6))


@query("cg05_contradictions", f"""WITH {PACKET}, x AS (SELECT *, p = 'used_for' AS contra, 0.7 * w * pow(score, 0.3) AS proof FROM top_edges),
  z AS (SELECT query_id, max(proof) FILTER (contra) AS against, 1 - product(1 - proof) FILTER (NOT contra) AS support, least(count(*) / 10, 1.0) AS n FROM x GROUP BY 1),
  t AS (SELECT query_id, string_agg(says, '; ' ORDER BY r) AS evidence FROM (SELECT query_id, format('{{}} {{}} {{}} (strength={{:.2f}})', s, p, o, w::DOUBLE) AS says, row_number() OVER (PARTITION BY query_id ORDER BY proof DESC, place) AS r FROM x WHERE NOT contra) WHERE r <= 5 GROUP BY 1),
  v AS (SELECT query_id, coalesce(against, 0) AS against, coalesce(support, 0) AS support, coalesce(n, 0) AS n, coalesce(evidence, '') AS evidence FROM (SELECT DISTINCT query_id FROM e) LEFT JOIN z USING (query_id) LEFT JOIN t USING (query_id))
  SELECT query_id, CASE WHEN against > 0.35 THEN 'contradicted' WHEN support > 0.55 THEN 'supported' ELSE 'insufficient_memory' END AS status, round(against, 6) AS against, round(support, 6) AS support, round(least(abs(support - against) * n + 0.2, 1.0), 6) AS confidence, evidence FROM v""")
def cg05(spark, d):
    edges, parts = packet_edges(spark, d)
    found = verdicts.contradictions(edges, ["used_for"], parts=parts)
    return found.withColumns({c: F.round(c, 6) for c in ("against", "support", "confidence")}).withColumn("evidence", F.array_join("evidence", "; "))


GAPS = f"""{PACKET}, need AS (SELECT *, count(*) OVER (PARTITION BY query_id, o) AS fans, row_number() OVER (PARTITION BY query_id, o ORDER BY place) AS first FROM top_edges WHERE p IN ('requires', 'is_a')),
  scored AS (SELECT query_id, o AS item, s AS required_by, CASE p WHEN 'is_a' THEN 'blocks' ELSE p END AS p, place, round(w * {WEIGHTS} * 0.8 * (fans / max(fans) OVER (PARTITION BY query_id)) * (1 - coalesce(t.a, 0)), 4) AS gap FROM (SELECT * FROM need WHERE first = 1) q LEFT JOIN (SELECT query_id, node AS o, a FROM top_nodes) t USING (query_id, o)),
  gaps AS (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY query_id ORDER BY gap DESC, place) AS place FROM scored)"""


@query("cg06_gaps", f"WITH {GAPS} SELECT query_id, place, item, required_by, p, gap FROM gaps WHERE gap >= 0.2 AND place <= 8")
def cg06(spark, d):
    return verdicts.gaps(*packet_edges(spark, d, needs=True)).where("place IS NOT NULL").select("query_id", F.col("place").cast("long").alias("place"), "item", "required_by", "p", "gap")


@query("cg06_coverage", f"""WITH {GAPS}, z AS (SELECT query_id, string_agg(item, ',' ORDER BY place) FILTER (gap >= 0.2 AND place <= 8) AS missing, count(*) - count(*) FILTER (gap >= 0.2 AND place <= 8) AS held, count(*) AS n, CAST(sum(CAST(round(gap * 10000) AS BIGINT)) AS BIGINT) AS total FROM gaps GROUP BY 1),
  k AS (SELECT *, CAST(round(confidence * 1000) AS BIGINT) AS c FROM packets LEFT JOIN z USING (query_id))
  SELECT query_id, coalesce(missing, '') AS missing, coalesce(held / n, 1.0) AS coverage, CASE WHEN n IS NULL THEN (c * 4) / 10000 ELSE least((c * 10 * n + total + 3000 * n) / (20000 * n), 0.95) END AS confidence FROM k""")
def cg06_coverage(spark, d):
    return verdicts.coverage(*packet_edges(spark, d, needs=True)).withColumn("missing", F.array_join("missing", ","))


def responses(definitions, assessed, last):
    """query_id, confidence, quality: definitions as responses; the last digit of a query's id stands for its lane and whether it goes on."""
    sure = verdicts.blended(F.col("confidence"), F.col("assessed"))
    rows = definitions.join(assessed.select("query_id", F.col("confidence").alias("assessed")), "query_id").withColumn("sure", sure)
    quality = verdicts.quality(F.lit(True), F.col("completeness"), F.col("sure"), last.isin("3", "4"), F.when(F.col("genus").isNull(), 1).otherwise(0), ~last.isin("0", "1", "2"))
    return rows.select("query_id", F.col("sure").alias("confidence"), quality.alias("quality"))


@query("cg11_response_quality", f"""WITH {PACKET}, h AS (SELECT query_id, CASE p WHEN 'is_a' THEN 'genus' WHEN 'used_for' THEN 'function' ELSE 'relations' END AS slot, o, a_s * CASE p WHEN 'requires' THEN 0.85 ELSE 1.0 END * w AS hit FROM top_edges),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id, slot ORDER BY hit DESC, o) AS place FROM h QUALIFY place = 1),
  f AS (SELECT query_id, max(o) FILTER (slot = 'genus') AS genus, count(*) / 4 AS complete, avg(hit) FILTER (hit > 0) AS mean FROM r GROUP BY 1),
  near AS (SELECT query_id, node FROM top_nodes WHERE place <= 15),
  k AS (SELECT t.*, CASE WHEN place <= 30 AND x.node IS NOT NULL AND y.node IS NOT NULL THEN a_s * a_o END AS pair FROM top_edges t LEFT JOIN near x ON t.query_id = x.query_id AND t.s = x.node LEFT JOIN near y ON t.query_id = y.query_id AND t.o = y.node),
  z AS (SELECT query_id, 1 - product(1 - 0.7 * w) FILTER (place <= 20) AS evidence, sum(pair * w) / nullif(sum(pair), 0) AS coherence, avg(w) FILTER (place <= 10) AS trust, max(w) FILTER (p = 'used_for') AS against FROM k GROUP BY 1),
  c AS (SELECT query_id, least(count(*) / 10, 1.0) AS coverage FROM top_nodes GROUP BY 1),
  a AS (SELECT query_id, round(1 / (1 + exp(-(4 * (0.25 * coalesce(evidence, 0) + 0.2 * coverage + 0.2 * least(coalesce(coherence, 0.5), 1.0) + 0.15 * coalesce(trust, 0) - 0.1 * coalesce(against, 0) - 0.025 * (1 - coverage)) - 2))), 3) AS assessed FROM c LEFT JOIN z USING (query_id)),
  b AS (SELECT query_id, genus, coalesce(complete, 0.0) AS complete, round(coalesce(CASE WHEN mean > 1 THEN 1.0 ELSE mean END, 0.5 * confidence), 9) AS own, assessed, right(query_id, 1) AS last FROM packets LEFT JOIN f USING (query_id) JOIN a USING (query_id)),
  v AS (SELECT *, CASE WHEN own > 0 THEN 0.7 * own + 0.3 * assessed ELSE assessed END AS sure FROM b)
  SELECT query_id, round(sure, 6) AS confidence, round(0.25 + 0.25 * complete + 0.2 * sure + 0.15 * CASE WHEN last IN ('3', '4') THEN 0.7 ELSE 0.5 END - CASE WHEN genus IS NULL THEN 0.02 ELSE 0 END - CASE WHEN last IN ('0', '1', '2') THEN 0.01 ELSE 0 END, 6) AS quality FROM v""")
def cg11(spark, d):
    """The quality of definitions as responses, by the confidence blended from theirs and the packet's (CG-12)."""
    e, parts = packet_edges(spark, d)
    rows = responses(packets.definitions(e, parts), packets.confidence(e, ["used_for"], parts), F.right(F.col("query_id"), F.lit(1)))
    return rows.select("query_id", F.round("confidence", 6).alias("confidence"), F.round("quality", 6).alias("quality"))
