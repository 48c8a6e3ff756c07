"""Named queries over joins, aggregations, windows and sorts that the other modules don't have."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import resolution, sessions
from ..sources.tables import anchors, relations, table
from .catalog import ANC, REL, query
from .packet_queries import PACKET, packet_edges


@query("jn10_anti_join_of_names", f"""WITH {REL}, {ANC}, offered AS (SELECT DISTINCT a.canonical AS s, b.canonical AS o FROM relations JOIN anchors a ON a.id = subject_id JOIN anchors b ON b.id = object_id WHERE predicate = 'causes'),
  known AS (SELECT DISTINCT a.canonical AS s, b.canonical AS o FROM relations JOIN anchors a ON a.id = subject_id JOIN anchors b ON b.id = object_id JOIN orders ON o_orderkey = capsule_id WHERE o_orderstatus = 'F' AND predicate = 'requires')
  SELECT s, o FROM offered WHERE (s, o) NOT IN (SELECT (s, o) FROM known)""")
def jn10(spark, d):
    """Offered relations whose names no known relation has; the known ones come from four tables."""
    a = anchors(spark, d)
    name = lambda r: r.join(a.select(F.col("id").alias("subject_id"), F.col("canonical").alias("s")), "subject_id").join(a.select(F.col("id").alias("object_id"), F.col("canonical").alias("o")), "object_id").select("s", "o").distinct()
    r = relations(spark, d)
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("capsule_id"))
    known = r.where("predicate = 'requires'").join(done, "capsule_id", "left_semi").select("subject_id", "object_id").distinct()
    return name(r.where("predicate = 'causes'").select("subject_id", "object_id").distinct()).join(name(known), ["s", "o"], "left_anti")


@query("jn14_missing_sides", """SELECT CASE WHEN o_orderkey IS NULL THEN 'no_session' WHEN c_custkey IS NULL THEN 'no_result' ELSE c_mktsegment END AS bucket, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY 1""")
def jn14(spark, d):
    """Lines by their order's customer, with a bucket for each side that is missing; lines are counted by order first."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", F.lit(True).alias("_o"))
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.lit(True).alias("_c"))
    j = n.join(o, "o_orderkey", "left").join(c, "o_custkey", "left")
    return j.groupBy(F.when(F.col("_o").isNull(), "no_session").when(F.col("_c").isNull(), "no_result").otherwise(F.col("c_mktsegment")).alias("bucket")).agg(F.sum("n").alias("n"))


@query("jn15_enrichment", f"""WITH {REL}, {ANC}, e AS (SELECT DISTINCT subject_id, object_id FROM relations), dom AS (SELECT id, domain FROM anchors WHERE maturity > 1000), sem AS (SELECT id, canonical FROM anchors WHERE id LIKE 's%'), att AS (SELECT object_id AS id, count(*) AS n FROM relations GROUP BY 1 HAVING count(*) > 620)
  SELECT subject_id, object_id, coalesce(dom.domain, '') AS domain, coalesce(sem.canonical, '') AS sem, coalesce(att.n, 0) AS attractor FROM e LEFT JOIN dom ON dom.id = subject_id LEFT JOIN sem ON sem.id = object_id LEFT JOIN att ON att.id = object_id""")
def jn15(spark, d):
    r, a = relations(spark, d), anchors(spark, d)
    att = r.groupBy("object_id").agg(F.count("*").alias("attractor")).where("attractor > 620")
    e = r.select("subject_id", "object_id").distinct().join(a.where("maturity > 1000").select(F.col("id").alias("subject_id"), "domain"), "subject_id", "left")
    e = e.join(a.where(F.col("id").startswith("s")).select(F.col("id").alias("object_id"), F.col("canonical").alias("sem")), "object_id", "left").join(att, "object_id", "left")
    return e.select("subject_id", "object_id", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("sem", F.lit("")).alias("sem"), F.coalesce("attractor", F.lit(0)).alias("attractor"))


@query("jn17_pairs_of_models", """WITH r AS (SELECT o_custkey AS session, o_orderpriority AS model, max(o_orderstatus) AS says FROM orders GROUP BY 1, 2)
  SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, count(*) FILTER (a.says = b.says) AS agree FROM r a JOIN r b ON a.session = b.session AND a.model < b.model GROUP BY 1, 2""")
def jn17(spark, d):
    """Pairs of models in a session, by name; a session has one row for each of five models, so its pairs are made in its own array."""
    r = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("session"), F.col("o_orderpriority").alias("model")).agg(F.max("o_orderstatus").alias("says"))
    s = r.groupBy("session").agg(F.collect_list(F.struct("model", "says")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: y["model"] > x["model"]), lambda y: F.struct(x["model"].alias("model_a"), y["model"].alias("model_b"), (x["says"] == y["says"]).alias("same")))))
    return s.select(F.explode(pairs).alias("p")).groupBy("p.model_a", "p.model_b").agg(F.count("*").alias("n"), F.count_if("p.same").alias("agree"))


@query("jn23_fixes_by_class", "SELECT p_type AS class, l_partkey AS fix, count(*) AS uses FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, l_partkey) <= 3")
def jn23(spark, d):
    uses = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("fix")).agg(F.count("*").alias("uses"))
    j = uses.join(table(spark, d, "part").select(F.col("p_partkey").alias("fix"), F.col("p_type").alias("class")), "fix")
    return j.withColumn("_n", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("uses"), "fix"))).where("_n <= 3").select("class", "fix", "uses")


@query("jn24_messages_of_conversations", "WITH c AS (SELECT conv_id, count(*) AS turns, max(length(text)) AS longest FROM conversations GROUP BY 1) SELECT m.conv_id, m.turn, m.role, turns FROM conversations m JOIN c USING (conv_id) WHERE length(m.text) = longest")
def jn24(spark, d):
    m = table(spark, d, "conversations")
    c = m.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max(F.length("text")).alias("longest"))
    return m.join(c, "conv_id").where(F.length("text") == F.col("longest")).select("conv_id", "turn", "role", "turns")


@query("jn26_contained_terms", "WITH t AS (SELECT DISTINCT p_name AS term, 'name' AS layer FROM part UNION ALL SELECT DISTINCT unnest(string_split(p_name, ' ')), 'word' FROM part UNION ALL SELECT DISTINCT lower(p_type), 'type' FROM part) SELECT a.term AS part, a.layer AS part_layer, b.term AS whole, b.layer AS whole_layer FROM t a JOIN t b ON a.layer <> b.layer AND contains(b.term, a.term)")
def jn26(spark, d):
    """Terms that lie in a term of another layer, joined by the rarest string of three characters."""
    p = table(spark, d, "part")
    layers = [p.select(F.col("p_name").alias("term")).distinct().withColumn("layer", F.lit("name")), p.select(F.explode(F.split("p_name", " ")).alias("term")).distinct().withColumn("layer", F.lit("word")), p.select(F.lower("p_type").alias("term")).distinct().withColumn("layer", F.lit("type"))]
    t = layers[0].unionByName(layers[1]).unionByName(layers[2])
    found = resolution.containing(t.select("term").distinct(), t.select(F.struct("term", "layer").alias("id"), F.col("term").alias("name")))
    j = found.join(t.select("term", F.col("layer").alias("part_layer")), "term").select(F.col("term").alias("part"), "part_layer", F.col("id.term").alias("whole"), F.col("id.layer").alias("whole_layer"))
    return j.where("part_layer <> whole_layer")


@query("ag19_coherence", f"WITH {PACKET} SELECT query_id, sum(a_s * a_o * w) / nullif(sum(a_s * a_o), 0) AS coherence FROM top_edges GROUP BY 1", rounded="coherence")
def ag19(spark, d):
    both = F.col("a_s") * F.col("a_o")
    return packet_edges(spark, d)[1][1].groupBy("query_id").agg((F.sum(both * F.col("w")) / F.nullif(F.sum(both), F.lit(0.0))).alias("coherence"))


@query("ag25_relation_density", f"""WITH {REL}, {ANC}, a AS (SELECT domain, count(*) AS anchors, count(*) FILTER (maturity < 1000) AS low FROM anchors GROUP BY 1 HAVING count(*) >= 5), i AS (SELECT domain, count(*) AS n FROM relations JOIN anchors ON id = subject_id GROUP BY 1), t AS (SELECT l_linestatus AS domain, count(*) AS n FROM lineitem GROUP BY 1),
  r AS (SELECT a.*, greatest(coalesce(i.n, 0), coalesce(t.n, 0)) AS rels FROM a LEFT JOIN i USING (domain) LEFT JOIN t USING (domain)) SELECT domain, anchors, rels, low, 1 / (rels / anchors + 0.01 :: DOUBLE) + low / anchors * 2 AS score FROM r""")
def ag25(spark, d):
    """Domains of five anchors or more: relations for each anchor (by subject or by tag, the greater), the share of immature anchors, and the score of a gap. All ids count."""
    r, a = relations(spark, d), anchors(spark, d)
    by_id = r.groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("n")).join(a.select("id", "domain"), "id").groupBy("domain").agg(F.sum("n").alias("i"))
    by_tag = r.groupBy(F.col("edge_type").alias("domain")).agg(F.count("*").alias("t"))
    own = a.groupBy("domain").agg(F.count("*").alias("anchors"), F.count_if(F.col("maturity") < 1000).alias("low")).where("anchors >= 5").join(by_id, "domain", "left").join(by_tag, "domain", "left")
    rels = F.greatest(F.coalesce("i", F.lit(0)), F.coalesce("t", F.lit(0)))
    return own.select("domain", "anchors", rels.alias("rels"), "low", (1 / (rels / F.col("anchors") + 0.01) + F.col("low") / F.col("anchors") * 2).alias("score"))


@query("ag27_recent_outcomes", "WITH r AS (SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) SELECT event_type AS outcome, count(*) AS n, count(*) / (SELECT count(*) FROM r) AS rate FROM r GROUP BY 1")
def ag27(spark, d):
    """Outcomes of the last day before the latest event; the latest moment and the total are one row each."""
    e = table(spark, d, "events")
    since = e.agg((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("since"))
    g = e.crossJoin(F.broadcast(since)).where("ts >= since").groupBy(F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("all")))).select("outcome", "n", (F.col("n") / F.col("all")).alias("rate"))


@query("ag32_noise_ratio", r"""WITH x AS (SELECT lang AS domain, source AS subtype, unnest(string_split(text, chr(10))) AS expr FROM documents WHERE text IS NOT NULL), p AS (SELECT lang AS domain, count(*) AS n, count(DISTINCT source) AS pairs FROM documents WHERE text IS NOT NULL GROUP BY 1),
  g AS (SELECT domain, count(*) AS total, count(*) FILTER (contains(lower(expr), 'license') OR contains(lower(expr), 'reserved') OR contains(lower(expr), ' the ')) AS noisy FROM x GROUP BY 1) SELECT g.domain, total, noisy, noisy / total AS ratio, pairs, n < 100 AS thin FROM g JOIN p ON g.domain IS NOT DISTINCT FROM p.domain""")
def ag32(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    lines = F.split("text", "\n")
    low = lambda x: F.lower(x)
    noisy = F.size(F.filter(lines, lambda x: low(x).contains("license") | low(x).contains("reserved") | low(x).contains(" the ")))
    g = docs.groupBy(F.col("lang").alias("domain")).agg(F.sum(F.size(lines)).alias("total"), F.sum(noisy).alias("noisy"), F.count_distinct("source").alias("pairs"), F.count("*").alias("_n"))
    return g.select("domain", "total", "noisy", (F.col("noisy") / F.col("total")).alias("ratio"), "pairs", (F.col("_n") < 100).alias("thin"))


@query("wn09_echoes", """WITH w AS (SELECT conv_id AS session, turn, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '' AND x NOT IN ('the', 'a', 'to', 'of', 'and', 'in', 'for', 'is', 'on', 'with'))) AS w FROM conversations),
  b AS (SELECT *, list(w) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM w) SELECT session, turn, CASE WHEN len(list_filter(before, lambda x: len(list_intersect(x, w)) >= 4)) > 0 THEN 0.65 :: DOUBLE ELSE 1.0 :: DOUBLE END AS factor FROM b""")
def wn09_echoes(spark, d):
    return sessions.echoes(table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", "text"), ["the", "a", "to", "of", "and", "in", "for", "is", "on", "with"])


@query("wn10_temperatures", """WITH RECURSIVE r AS (SELECT user_id AS session, event_id AS turn, coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), false) AS again, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  h AS (SELECT *, CASE WHEN again THEN 0.85 :: DOUBLE ELSE 0.6 :: DOUBLE END AS heat FROM r WHERE n = 1 UNION ALL SELECT r.*, CASE WHEN r.again THEN least(1.0 :: DOUBLE, heat + 0.25 :: DOUBLE) ELSE greatest(0.6 :: DOUBLE, heat - 0.15 :: DOUBLE) END FROM h JOIN r ON r.session = h.session AND r.n = h.n + 1)
  SELECT session, turn, heat FROM h""", rounded="heat")
def wn10(spark, d):
    return sessions.temperatures(table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("turn"), F.col("event_type").alias("said")))


LADDER = "CASE s WHEN 'candidate' THEN 0 WHEN 'verified_static' THEN 1 WHEN 'verified_runtime' THEN 2 WHEN 'regression_tested' THEN 3 WHEN 'benchmarked' THEN 4 WHEN 'trusted' THEN 5 ELSE -1 END"


@query("wn16_state_ladder", f"""WITH u AS (SELECT o_orderkey AS id, ['candidate', 'verified_runtime', 'benchmarked', 'failed', 'deprecated', NULL][1 + o_custkey % 6] AS s, ['passed_minimal', 'passed_verified', 'passed_benchmarked', 'failed_runtime', 'odd', NULL][1 + o_orderkey % 6] AS v FROM orders),
  t AS (SELECT *, {LADDER} AS r, CASE v WHEN 'passed_minimal' THEN 2 WHEN 'passed_verified' THEN 3 WHEN 'passed_benchmarked' THEN 4 ELSE -1 END AS k FROM u)
  SELECT id, CASE WHEN s IS NOT DISTINCT FROM 'deprecated' OR v IS NULL THEN NULL WHEN v = 'failed_runtime' THEN CASE WHEN s IS DISTINCT FROM 'failed' THEN 'failed' END WHEN r < k THEN CASE v WHEN 'passed_minimal' THEN 'verified_runtime' WHEN 'passed_verified' THEN 'regression_tested' ELSE 'benchmarked' END END AS state FROM t""")
def wn16(spark, d):
    """The promotion ladder (WN-16, FM-17)."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + i % 6).cast("int"))
    state, verdict = pick(["candidate", "verified_runtime", "benchmarked", "failed", "deprecated", None], F.col("o_custkey")), pick(["passed_minimal", "passed_verified", "passed_benchmarked", "failed_runtime", "odd", None], F.col("o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), sessions.promoted(state, verdict).alias("state"))


STEPS = "steps AS (SELECT p_partkey AS node, CASE WHEN p_partkey < 3 THEN (p_partkey + 1) % 3 WHEN p_size <= p_partkey THEN p_partkey - p_size END AS parent FROM part)"


@query("wn17_lineage", f"""WITH RECURSIVE {STEPS}, up AS (SELECT node AS first, node AS now FROM steps UNION SELECT first, parent FROM up JOIN steps ON node = now WHERE parent IS NOT NULL), r AS (SELECT first, now FROM up JOIN steps ON node = now WHERE parent IS NULL)
  SELECT node, r.now AS origin, r.now IS NULL AS looped FROM steps LEFT JOIN r ON first = node""")
def wn17(spark, d):
    k = F.col("p_partkey")
    return sessions.lineage(table(spark, d, "part").select(k.alias("node"), F.when(k < 3, (k + 1) % 3).when(F.col("p_size") <= k, k - F.col("p_size")).alias("parent")))


@query("srt05_best_of_all", f"WITH {REL}, e AS (SELECT subject_id, object_id, max(confidence) AS c FROM relations GROUP BY 1, 2) SELECT subject_id, object_id, c FROM e ORDER BY c DESC, subject_id, object_id LIMIT 64")
def srt05(spark, d):
    """The ceiling is put on the sorted rows, not on the search, so which rows are met first changes nothing."""
    return relations(spark, d).groupBy("subject_id", "object_id").agg(F.max("confidence").alias("c")).orderBy(F.desc("c"), "subject_id", "object_id").limit(64)


@query("srt07_seeded_order", "SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def srt07(spark, d):
    """A sample in an order that a seed gives: reruns agree."""
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id").limit(50)


@query("srt09_filter_then_limit", "SELECT p_partkey, p_retailprice FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') ORDER BY p_retailprice * p_size DESC, p_partkey LIMIT 12")
def srt09(spark, d):
    return table(spark, d, "part").where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).orderBy((F.col("p_retailprice") * F.col("p_size")).desc(), "p_partkey").limit(12).select("p_partkey", "p_retailprice")
