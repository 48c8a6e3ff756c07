"""The named queries, each with the SQL that says the same."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import graph
from ..sources.tables import anchors, relations, table
from ..streaming import events as temporal

QUERIES: dict = {}
SQL: dict = {}

REL = """relations AS (SELECT 'p' || l_partkey AS subject_id, CASE l_returnflag WHEN 'A' THEN 'causes' WHEN 'N' THEN 'requires' ELSE 'inhibits' END AS predicate, 's' || l_suppkey AS object_id,
  CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' || l_linestatus ELSE l_linestatus END AS domain_tags, l_linestatus AS edge_type, CASE WHEN l_linenumber <= 5 THEN CAST(l_linenumber AS BIGINT) END AS seen_count,
  CAST(NULL AS BIGINT) AS evidence_count, l_discount * 10 AS confidence, l_tax AS edge_weight, CASE WHEN l_tax > 0.04 THEN '+' ELSE '-' END AS polarity, l_orderkey AS capsule_id FROM lineitem)"""
ANC = """anchors AS (SELECT 'p' || p_partkey AS id, p_name AS canonical, p_retailprice AS maturity, p_brand AS domain FROM part UNION ALL
  SELECT 's' || s_suppkey, s_name, s_acctbal, CAST(s_nationkey AS VARCHAR) FROM supplier)"""


EDGES_PER_TASK = 500_000  # whatever the size of the table


def query(name: str, sql: str | None = None, rounded: str = ""):
    """Registers a query with its SQL; the double columns named in rounded are rounded to nine places in both, since engines add up in different orders."""
    columns = rounded.split()

    def add(f):
        QUERIES[name] = (lambda spark, d: f(spark, d).withColumns({c: F.round(c, 9) for c in columns})) if columns else f
        if sql:
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in columns)}) FROM ({sql})" if columns else sql
        return f

    return add


@query("ag01_edge_aggregation", f"""WITH {REL} SELECT subject_id, predicate, object_id, trim(coalesce(domain_tags, '')) AS domain_tags, trim(coalesce(edge_type, '')) AS edge_type,
  CAST(sum(coalesce(seen_count, 1)) AS BIGINT) AS seen_count, CAST(sum(coalesce(evidence_count, 1)) AS BIGINT) AS evidence_count, max(coalesce(confidence, 1.0)) AS confidence, max(edge_weight) AS edge_weight, max(polarity) AS polarity
  FROM relations GROUP BY ALL""")
def ag01(spark, d):
    return graph.aggregate_edges(relations(spark, d))


@query("ag03_maturity", f"""WITH {REL}, s AS (SELECT subject_id, count(*) AS n, count(DISTINCT object_id) AS objects, count(DISTINCT predicate) AS predicates, count(DISTINCT capsule_id) AS capsules FROM relations GROUP BY 1)
  SELECT *, CAST(n AS DOUBLE) * (1 + CAST(0.5 AS DOUBLE) * objects) * (1 + CAST(0.3 AS DOUBLE) * predicates) * (1 + CAST(0.1 AS DOUBLE) * capsules) AS maturity, CASE WHEN n < 2 THEN 'isolated' WHEN n < 10 THEN 'emerging' WHEN n < 50 THEN 'stable' ELSE 'core' END AS state, n >= 2 AS visible FROM s""")
def ag03(spark, d):
    s = relations(spark, d).groupBy("subject_id").agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(k) for c, k in (("object_id", "objects"), ("predicate", "predicates"), ("capsule_id", "capsules"))])
    return s.withColumn("maturity", F.col("n") * (1 + 0.5 * F.col("objects")) * (1 + 0.3 * F.col("predicates")) * (1 + 0.1 * F.col("capsules"))).withColumn("state", scores.state(F.col("n"))).withColumn("visible", F.col("n") >= 2)


NATIONS = "nation_edges AS (SELECT c_nationkey AS subject_id, s_nationkey AS object_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


def nation_edges(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("c_nationkey").alias("subject_id"), F.col("s_nationkey").alias("object_id")).agg(F.count("*").alias("n"))


@query("ag04_attractor_score", f"""WITH {NATIONS}, i AS (SELECT object_id AS node, count(*) AS incoming FROM nation_edges GROUP BY 1), o AS (SELECT subject_id AS node, count(*) AS outgoing FROM nation_edges GROUP BY 1)
  SELECT node, incoming, outgoing, incoming * outgoing AS score FROM i JOIN o USING (node) ORDER BY score DESC, node LIMIT 10""")
def ag04(spark, d):
    return graph.degrees(nation_edges(spark, d)).withColumn("score", F.col("incoming") * F.col("outgoing")).orderBy(F.desc("score"), "node").limit(10)


@query("ag06_conditional_counts", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus <> 'F') AS other, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 5")
def ag06(spark, d):
    done = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(done).alias("done"), F.count_if(~done).alias("other"), F.count("*").alias("n")).where("n >= 5")


BAND = "CASE WHEN v IS NULL THEN 'unknown' WHEN v > 2 THEN 'winning' WHEN v > 0.5 THEN 'better' WHEN v > -0.5 THEN 'equal' WHEN v > -2 THEN 'worse' ELSE 'losing' END"
MOVES = f"moves AS (SELECT o_orderpriority AS model, CASE WHEN o_orderkey % 60 < 20 THEN 'opening' WHEN o_orderkey % 60 < 40 THEN 'middlegame' ELSE 'endgame' END AS phase, {BAND} AS band, o_orderstatus = 'F' AS correct, c FROM (SELECT *, CASE WHEN o_orderkey % 11 <> 0 THEN (o_custkey % 9 - 4) / 1.5 END AS v, CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE (o_orderkey % 4) / 4 END AS c FROM orders))"


def moves(spark, d):
    o = table(spark, d, "orders")
    value = F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_custkey") % 9 - 4) / 1.5)
    given = (F.col("o_orderkey") % 4) / 4
    return o.select(F.col("o_orderpriority").alias("model"), scores.game_phase(F.col("o_orderkey") % 60).alias("phase"), scores.eval_band(value).alias("band"), (F.col("o_orderstatus") == "F").alias("correct"), F.when(given.isNull() | (given == 0), 0.5).otherwise(given).alias("c"))


@query("ag10_calibration_buckets", f"WITH {MOVES} SELECT model, phase, band, count(*) AS total, count(*) FILTER (correct) AS right_ones, round(avg(c), 6) AS confidence, round(avg(c) - count(*) FILTER (correct) / count(*), 6) AS gap FROM moves GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def ag10(spark, d):
    g = moves(spark, d).groupBy("model", "phase", "band").agg(F.count("*").alias("total"), F.count_if("correct").alias("right_ones"), F.avg("c").alias("confidence"))
    return g.where("total >= 2").withColumn("gap", F.round(F.col("confidence") - F.col("right_ones") / F.col("total"), 6)).withColumn("confidence", F.round("confidence", 6))


@query("ag12_routing_rules", f"""WITH {MOVES}, u AS (SELECT 'phase' AS kind, phase AS value, model, correct FROM moves UNION ALL SELECT 'band', band, model, correct FROM moves),
  g AS (SELECT kind, value, model, count(*) AS n, count(*) FILTER (correct) / count(*) AS accuracy FROM u GROUP BY 1, 2, 3 HAVING count(*) >= 3)
  SELECT kind, value, model, n, round(accuracy, 6) AS accuracy FROM g QUALIFY row_number() OVER (PARTITION BY kind, value ORDER BY accuracy DESC, model) = 1""")
def ag12(spark, d):
    u = moves(spark, d).select("model", "correct", F.explode(F.array(F.struct(F.lit("phase").alias("kind"), F.col("phase").alias("value")), F.struct(F.lit("band").alias("kind"), F.col("band").alias("value")))).alias("u")).select("u.*", "model", "correct")
    g = u.groupBy("kind", "value", "model").agg(F.count("*").alias("n"), (F.count_if("correct") / F.count("*")).alias("accuracy")).where("n >= 3")
    best = F.row_number().over(Window.partitionBy("kind", "value").orderBy(F.desc("accuracy"), "model"))
    return g.withColumn("_n", best).where("_n = 1").drop("_n").withColumn("accuracy", F.round("accuracy", 6))


@query("ag13_splits", """SELECT o_custkey AS session, count(*) AS n, count(DISTINCT o_orderpriority) AS models, count(*) FILTER (o_orderstatus = f) AS agree, CASE WHEN count(DISTINCT o_orderstatus) = 2 THEN 'binary' ELSE 'multi' END AS split_type
  FROM (SELECT *, first_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders) GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1 AND count(DISTINCT o_orderpriority) >= 2""")
def ag13(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").withColumn("f", F.first("o_orderstatus").over(w))
    g = o.groupBy(F.col("o_custkey").alias("session")).agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("models"), F.count_if(F.col("o_orderstatus") == F.col("f")).alias("agree"), F.count_distinct("o_orderstatus").alias("k"))
    return g.where("k > 1 AND models >= 2").withColumn("split_type", F.when(F.col("k") == 2, "binary").otherwise("multi")).drop("k")


@query("ag15_stability", f"WITH {MOVES} SELECT model, round(avg(c) * greatest(0.5, 1 - var_pop(c) * 0.5), 6) AS stability FROM moves GROUP BY 1")
def ag15(spark, d):
    return moves(spark, d).groupBy("model").agg(F.round(F.avg("c") * F.greatest(F.lit(0.5), 1 - F.var_pop("c") * 0.5), 6).alias("stability"))


@query("ag17_noisy_or", f"WITH {REL} SELECT subject_id, CASE WHEN max(confidence / 2) >= 1 THEN 1.0 ELSE round(1 - exp(sum(ln(1 - confidence / 2))), 6) END AS belief FROM relations GROUP BY 1")
def ag17(spark, d):
    return relations(spark, d).groupBy("subject_id").agg(F.round(scores.noisy_or(F.col("confidence") / 2), 6).alias("belief"))


@query("ag18_generalised_jaccard", """WITH f AS (SELECT l_suppkey AS s, l_partkey % 50 AS k, CAST(sum(l_quantity) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2), i AS (SELECT s, lead(s) OVER (ORDER BY s) AS t FROM (SELECT DISTINCT s FROM f)),
  u AS (SELECT i.s, i.t, k, max(w) FILTER (f.s = i.s) AS a, max(w) FILTER (f.s = i.t) AS b FROM i JOIN f ON f.s IN (i.s, i.t) WHERE i.t IS NOT NULL GROUP BY ALL)
  SELECT s, t, sum(least(coalesce(a, 0), coalesce(b, 0))) / sum(greatest(coalesce(a, 0), coalesce(b, 0))) AS similarity FROM u GROUP BY 1, 2""")
def ag18(spark, d):
    """Each supplier against the next by key. The keys are ranked over the suppliers' table, which has a row for each."""
    f = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 50).alias("k")).agg(F.sum("l_quantity").cast("long").alias("w"))
    keys = f.select("s").distinct()
    # the next key is the least one above, found among the keys of the same or the next cell of a hundred
    nxt = keys.select("s", F.explode(F.array(F.floor(F.col("s") / 100), F.floor(F.col("s") / 100) + 1)).alias("cell")).join(keys.select(F.col("s").alias("t"), F.floor(F.col("s") / 100).alias("cell")), "cell").where("t > s").groupBy("s").agg(F.min("t").alias("t"))
    ends = nxt.select("s", "t", F.explode(F.array("s", "t")).alias("own")).join(f.withColumnRenamed("s", "own"), "own")
    of = lambda c: F.coalesce(F.max(F.when(F.col("own") == F.col(c), F.col("w"))), F.lit(0))
    u = ends.groupBy("s", "t", "k").agg(of("s").alias("a"), of("t").alias("b"))
    return u.groupBy("s", "t").agg((F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("similarity"))


@query("jn02_named_triples", f"WITH {REL}, {ANC} SELECT a.canonical AS subject, predicate, b.canonical AS object, count(*) AS n FROM relations r JOIN anchors a ON r.subject_id = a.id JOIN anchors b ON r.object_id = b.id GROUP BY 1, 2, 3")
def jn02(spark, d):
    """Edges are dealt by subject before they are counted and by object before that is named, so that a task's counts and sorts don't grow with the table."""
    r, a = relations(spark, d).select("subject_id", "predicate", "object_id"), anchors(spark, d)
    tasks = r.count() // EDGES_PER_TASK + 1
    r = r.repartition(tasks, "subject_id").groupBy("subject_id", "predicate", "object_id").agg(F.count("*").alias("n"))
    name = lambda k, c: a.select(F.col("id").alias(k), F.col("canonical").alias(c))
    return r.join(name("subject_id", "subject"), "subject_id").repartition(tasks, "object_id").join(name("object_id", "object"), "object_id").groupBy("subject", "predicate", "object").agg(F.sum("n").alias("n"))


@query("jn04_zero_degree_kept", f"WITH {REL}, {ANC} SELECT a.id, count(r.subject_id) AS degree FROM anchors a LEFT JOIN relations r ON r.subject_id = a.id AND r.seen_count >= 2 GROUP BY 1")
def jn04(spark, d):
    n = relations(spark, d).where("seen_count >= 2").groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("degree"))
    return anchors(spark, d).select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("jn05_either_end", f"WITH {NATIONS} SELECT n_nationkey, count(*) AS n FROM nation JOIN nation_edges ON n_nationkey = subject_id OR n_nationkey = object_id GROUP BY 1")
def jn05(spark, d):
    e = nation_edges(spark, d)
    ends = e.select(F.col("subject_id").alias("n_nationkey")).union(e.where("subject_id <> object_id").select("object_id"))  # a self-loop counts once
    return table(spark, d, "nation").select("n_nationkey").join(ends.groupBy("n_nationkey").agg(F.count("*").alias("n")), "n_nationkey")


@query("jn06_groupwise_max_ties", f"WITH {REL} SELECT DISTINCT subject_id, object_id, confidence FROM relations QUALIFY rank() OVER (PARTITION BY subject_id ORDER BY confidence DESC) = 1")
def jn06(spark, d):
    w = Window.partitionBy("subject_id").orderBy(F.desc("confidence"))
    return relations(spark, d).withColumn("_n", F.rank().over(w)).where("_n = 1").select("subject_id", "object_id", "confidence").distinct()


@query("jn07_two_hops", f"WITH {NATIONS} SELECT a.subject_id, b.object_id, max(a.n * b.n) AS strength, count(*) AS paths FROM nation_edges a JOIN nation_edges b ON a.object_id = b.subject_id GROUP BY 1, 2")
def jn07(spark, d):
    e = nation_edges(spark, d)
    a, b = e.select("subject_id", F.col("object_id").alias("mid"), F.col("n").alias("n1")), e.select(F.col("subject_id").alias("mid"), "object_id", F.col("n").alias("n2"))
    return a.join(b, "mid").groupBy("subject_id", "object_id").agg(F.max(F.col("n1") * F.col("n2")).alias("strength"), F.count("*").alias("paths"))


@query("jn09_anti_join", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def jn09(spark, d):
    return table(spark, d, "part").join(table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("jn12_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def jn12(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("jn19_events_within_an_hour", """WITH e AS (SELECT user_id, event_type, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, count(*) AS n FROM events GROUP BY 1, 2, 3)
  SELECT a.event_type AS first_type, b.event_type AS second_type, CAST(sum(a.n * b.n) AS BIGINT) AS n, sum(a.n * b.n * (3600 - (b.s - a.s))) / (3600 * sum(a.n * b.n)) AS confidence FROM e a JOIN e b ON a.user_id = b.user_id AND b.s > a.s AND b.s - a.s <= 3600 GROUP BY 1, 2""")
def jn19(spark, d):
    """An event and a later one of the same user within an hour, by types; equal seconds are counted together before the join, and the join goes by user and hour."""
    e = table(spark, d, "events").groupBy("user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).agg(F.count("*").alias("n"))
    cell = F.floor(F.col("s") / 3600)
    a = e.select("user_id", F.col("event_type").alias("first_type"), F.col("s").alias("sa"), F.col("n").alias("na"), F.explode(F.array(cell, cell + 1)).alias("cell"))
    b = e.select("user_id", F.col("event_type").alias("second_type"), F.col("s").alias("sb"), F.col("n").alias("nb"), cell.alias("cell"))
    gap, n = F.col("sb") - F.col("sa"), F.col("na") * F.col("nb")
    return a.join(b, ["user_id", "cell"]).where((gap > 0) & (gap <= 3600)).groupBy("first_type", "second_type").agg(F.sum(n).alias("n"), (F.sum(n * (3600 - gap)) / (3600 * F.sum(n))).alias("confidence"))


@query("jn22_latest_as_of", "SELECT o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def jn22(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("wn01_top_neighbors", f"""WITH {REL}, {ANC}, b AS (SELECT subject_id AS node, object_id AS id FROM relations UNION SELECT object_id, subject_id FROM relations)
  SELECT node, id, maturity, row_number() OVER (PARTITION BY node ORDER BY maturity DESC, id) AS place FROM b JOIN anchors USING (id) QUALIFY place <= 5""")
def wn01(spark, d):
    return graph.top_neighbors(relations(spark, d), anchors(spark, d), 5).select("node", "id", "maturity", F.col("place").cast("long").alias("place"))


@query("wn08_event_trigrams", """WITH s AS (SELECT event_type AS event_1, lead(event_type, 1) OVER w AS event_2, lead(event_type, 2) OVER w AS event_3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_1, event_2, event_3, count(*) AS frequency FROM s WHERE event_2 IS NOT NULL AND event_3 IS NOT NULL GROUP BY 1, 2, 3""")
def wn08(spark, d):
    return temporal.sequences(table(spark, d, "events"))


@query("wn14_next_event_prediction", """WITH s AS (SELECT event_type AS event_1, lead(event_type, 1) OVER w AS event_2, lead(event_type, 2) OVER w AS event_3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  c AS (SELECT event_1, event_2, event_3, count(*) AS frequency FROM s WHERE event_3 IS NOT NULL GROUP BY 1, 2, 3), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY event_1, event_2 ORDER BY frequency DESC, event_3) <= 3)
  SELECT event_1, event_2, event_3, frequency, round(frequency / sum(frequency) OVER (PARTITION BY event_1, event_2), 6) AS confidence FROM t""")
def wn14(spark, d):
    return temporal.predictions(temporal.sequences(table(spark, d, "events"))).drop("place").withColumn("confidence", F.round("confidence", 6))


@query("wn09_last_three", """SELECT conv_id, turn, list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l FROM conversations""".join(("SELECT conv_id, turn, coalesce(len(l), 0) AS held, coalesce(list_contains(l, 'user'), false) AS had_user FROM (", ")")))
def wn09(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    return table(spark, d, "conversations").select("conv_id", "turn", F.collect_list("role").over(w).alias("l")).select("conv_id", "turn", F.size("l").cast("long").alias("held"), F.array_contains("l", "user").alias("had_user"))


@query("wn19_question_answer_pairs", "SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant' AND length(answer) >= 20")
def wn19(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return c.where("role = 'user' AND next_role = 'assistant' AND length(answer) >= 20").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query("st04_refire_suppression", """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS second, row_number() OVER (PARTITION BY user_id, event_type ORDER BY date_trunc('second', ts), event_id) AS n FROM events),
  w AS (SELECT *, second AS last, true AS fired FROM e WHERE n = 1 UNION ALL SELECT e.*, CASE WHEN e.second - last >= 900 THEN e.second ELSE last END, e.second - last >= 900 FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.n = w.n + 1)
  SELECT event_id, user_id, event_type, second, fired FROM w""")
def st04(spark, d):
    return temporal.suppress(table(spark, d, "events"), 900)


@query("st08_rare_transitions", """WITH s AS (SELECT event_type AS event_1, lead(event_type, 1) OVER w AS event_2, lead(event_type, 2) OVER w AS event_3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  c AS (SELECT event_1, event_2, event_3, count(*) AS f FROM s WHERE event_3 IS NOT NULL GROUP BY 1, 2, 3), p AS (SELECT event_1, event_2, f FROM c UNION ALL SELECT event_2, event_3, f FROM c)
  SELECT event_1, event_2, CAST(sum(f) AS BIGINT) AS frequency, round(1 - sum(f) / 2000, 6) AS score FROM p GROUP BY 1, 2 HAVING sum(f) < 2000""")
def st08(spark, d):
    return temporal.anomalies(temporal.sequences(table(spark, d, "events")), 2000).withColumn("score", F.round("score", 6))


@query("st14_tumbling_hours", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st14(spark, d):
    return temporal.windowed(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("st14_sliding_failure_rate", """WITH h AS (SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1, 2)
  SELECT user_id, hour, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(failed) OVER w AS BIGINT) AS failed, sum(failed) OVER w / sum(n) OVER w AS rate FROM h WINDOW w AS (PARTITION BY user_id ORDER BY hour RANGE BETWEEN 82800 PRECEDING AND CURRENT ROW)""")
def st14_sliding(spark, d):
    return temporal.trailing(table(spark, d, "events"), F.col("event_type") == "error")


@query("srt02_weighted_order", "SELECT p_partkey, round(p_retailprice / (p_size + 1), 6) AS score FROM part ORDER BY p_retailprice / (p_size + 1) DESC, p_partkey LIMIT 20")
def srt02(spark, d):
    score = F.col("p_retailprice") / (F.col("p_size") + 1)
    return table(spark, d, "part").orderBy(score.desc(), "p_partkey").limit(20).select("p_partkey", F.round(score, 6).alias("score"))


@query("set02_local_first", "SELECT k, v, src FROM (SELECT c_nationkey AS k, min(c_name) AS v, 0 AS src FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, min(s_name), 1 FROM supplier GROUP BY 1) QUALIFY row_number() OVER (PARTITION BY k ORDER BY src) = 1")
def set02(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_name").alias("v")).withColumn("src", F.lit(0))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("v")).withColumn("src", F.lit(1))
    return a.unionByName(b).withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy("src"))).where("_n = 1").drop("_n")


@query("set03_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set03(spark, d):
    return table(spark, d, "part").select("p_partkey").subtract(table(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("flt02_keyword_match", "SELECT doc_id, lang FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%stupid%'")
def flt02(spark, d):
    text = F.lower("text")
    return table(spark, d, "documents").where(text.contains("license") | text.contains("stupid")).select("doc_id", "lang")


@query("flt08_clean_names", """SELECT p_partkey, p_name FROM part WHERE length(p_name) <= 35 AND NOT regexp_matches(p_name, '^[_-] ') AND NOT ends_with(p_name, '''') AND len(string_split(p_name, ' ')) <= 4
  AND NOT list_has_any(string_split(p_name, ' '), ['the', 'of', 'and', 'a', 'in', 'to', 'for', 'with'])""")
def flt08(spark, d):
    return table(spark, d, "part").where(scores.clean_name(F.col("p_name"))).select("p_partkey", "p_name")


@query("flt24_terms_in_order", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(?s)the.*with.*from')")
def flt24(spark, d):
    return table(spark, d, "documents").where(graph.in_order(F.lower("text"), ["the", "with", "from"])).select("doc_id")


@query("ag31_json_groups", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1")
def ag31(spark, d):
    return table(spark, d, "events").groupBy((F.get_json_object("props", "$.k").cast("long") % 10).alias("k")).agg(F.count("*").alias("n"))


@query("gr02_activation", f"""WITH {ANC} SELECT id, round((0.6 * least(ln(1 + greatest(maturity, 0)) / ln(1 + 1.023e11), 1) + 0.4 * CASE WHEN domain = 'Brand#11' THEN 1.0 ELSE 0.2 END * 0.5) * exp(-0.35 * 2), 6) AS a FROM anchors""")
def gr02(spark, d):
    return anchors(spark, d).select("id", F.round(scores.activation(F.col("maturity"), F.lit(0.5), F.col("domain") == "Brand#11", F.lit(2)), 6).alias("a"))


@query("gr08_breadth_first", f"""WITH RECURSIVE {NATIONS}, e AS (SELECT subject_id AS src, object_id AS dst FROM nation_edges), walk AS (SELECT 0 AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN e ON node = src WHERE depth < 4) SELECT node, min(depth) AS depth FROM walk GROUP BY 1""")
def gr08(spark, d):
    e = nation_edges(spark, d).select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))
    return graph.levels(e, spark.range(1).select(F.lit(0).alias("node")), 4)


@query("gr08_hops_between_parts", f"""WITH RECURSIVE {REL}, e AS (SELECT DISTINCT l.subject_id AS src, r.subject_id AS dst FROM (SELECT object_id, min(subject_id) AS subject_id FROM relations GROUP BY 1) l JOIN relations r USING (object_id) WHERE l.subject_id <> r.subject_id),
  walk AS (SELECT min(src) AS node, 0 AS depth FROM e UNION SELECT dst, depth + 1 FROM walk JOIN e ON node = src WHERE depth < 3) SELECT node, min(depth) AS depth FROM walk GROUP BY 1""")
def gr08_parts(spark, d):
    """From each supplier's first part to its other parts, over all lines."""
    r = relations(spark, d).select("subject_id", "object_id").distinct()
    first = r.groupBy("object_id").agg(F.min("subject_id").alias("src"))
    e = first.join(r, "object_id").where("src <> subject_id").select("src", F.col("subject_id").alias("dst")).distinct()
    return graph.levels(e, e.agg(F.min("src").alias("node")), 3)


@query("gr18_mined_rules", f"""WITH {NATIONS}, e AS (SELECT subject_id AS s, CASE n % 3 WHEN 0 THEN 'causes' WHEN 1 THEN 'is_a' ELSE 'knows' END AS p, object_id AS o FROM nation_edges)
  SELECT DISTINCT 'transitive' AS rule, a.p, a.s AS s, b.o AS o FROM e a JOIN e b ON a.p = b.p AND a.o = b.s WHERE a.s <> b.o AND a.s <> a.o AND b.s <> b.o UNION ALL SELECT DISTINCT 'symmetric', a.p, a.o, a.s FROM e a WHERE a.s <> a.o UNION ALL SELECT DISTINCT 'reflexive', p, s, s FROM e""")
def gr18(spark, d):
    p = F.when(F.col("n") % 3 == 0, "causes").when(F.col("n") % 3 == 1, "is_a").otherwise("knows")
    return graph.mined_rules(nation_edges(spark, d).select(F.col("subject_id").alias("s"), p.alias("p"), F.col("object_id").alias("o")))


@query("gr20_unification", f"""WITH {REL}, e AS (SELECT subject_id, predicate, object_id, max(confidence) AS c FROM relations GROUP BY 1, 2, 3)
  SELECT a.subject_id AS "X", a.object_id AS "Y", greatest(a.c, 1e-6) * greatest(b.c, 1e-6) AS score, false AS hit_bridge FROM e a JOIN e b USING (subject_id, object_id) WHERE a.predicate = 'causes' AND b.predicate = 'requires' ORDER BY score DESC, 1, 2 LIMIT 8""")
def gr20(spark, d):
    e = relations(spark, d).groupBy("subject_id", "predicate", "object_id").agg(F.max("confidence").alias("local_confidence")).withColumns({"local_truth": F.lit("asserted"), "is_bridge": F.lit(False)})
    return graph.unify([("?X", "causes", "?Y"), ("?X", "requires", "?Y")], e)


@query("gr25_anchor_merge", f"""WITH {REL}, r AS (SELECT CASE WHEN subject_id IN ('p2', 'p3') THEN 'p1' ELSE subject_id END AS subject_id, predicate, CASE WHEN object_id = 's2' THEN 's1' ELSE object_id END AS object_id, domain_tags, edge_type, seen_count, confidence FROM relations)
  SELECT subject_id, predicate, object_id, trim(coalesce(domain_tags, '')) AS domain_tags, edge_type, CAST(sum(coalesce(seen_count, 1)) AS BIGINT) AS seen_count, max(coalesce(confidence, 1.0)) AS confidence FROM r GROUP BY ALL""")
def gr25(spark, d):
    merges = spark.createDataFrame([("p2", "p1"), ("p3", "p1"), ("s2", "s1")], "old string, new string")
    return graph.merge_nodes(relations(spark, d), merges).select("subject_id", "predicate", "object_id", "domain_tags", "edge_type", "seen_count", "confidence")


@query("gr32_contradictions", f"WITH {REL} SELECT subject_id, object_id, count(*) FILTER (predicate = 'causes') AS causes, count(*) FILTER (predicate = 'inhibits') AS inhibits FROM relations GROUP BY 1, 2 HAVING count(*) FILTER (predicate = 'causes') > 0 AND count(*) FILTER (predicate = 'inhibits') > 0")
def gr32(spark, d):
    g = relations(spark, d).groupBy("subject_id", "object_id").agg(*[F.count_if(F.col("predicate") == p).alias(p) for p in ("causes", "inhibits")])
    return g.where("causes > 0 AND inhibits > 0")


@query("gr40_cosine_neighbors", """WITH q AS (SELECT vec_id AS a, embedding AS x FROM embeddings WHERE vec_id % 20 = 0), n AS (SELECT vec_id AS b, embedding AS y FROM embeddings),
  s AS (SELECT a, b, list_dot_product(x::DOUBLE[], y::DOUBLE[]) / (sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[])) * sqrt(list_dot_product(y::DOUBLE[], y::DOUBLE[])) + 1e-9) AS c FROM q, n WHERE a <> b) SELECT a, b, round(c, 4) AS cosine FROM s WHERE c >= 0.25""")
def gr40(spark, d):
    """The stated queries against all vectors, in blocks: a block of queries is multiplied with each batch of vectors."""
    e = table(spark, d, "embeddings")
    return graph.cosine_neighbors(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 0.25).withColumn("cosine", F.round("cosine", 4))


@query("gr40_lattice_weights", f"WITH {NATIONS}, b AS (SELECT subject_id AS term, n FROM nation_edges UNION ALL SELECT object_id, n FROM nation_edges) SELECT term, count(*) AS degree, CAST(sum(n) AS BIGINT) AS weight, row_number() OVER (ORDER BY count(*) DESC, sum(n) DESC, term) <= 3 AS top FROM b GROUP BY 1")
def gr40_lattice(spark, d):
    """Degree and weight of each term, and whether it is among the three that weigh most."""
    b = nation_edges(spark, d)
    b = b.select(F.col("subject_id").alias("term"), "n").union(b.select("object_id", "n")).groupBy("term").agg(F.count("*").alias("degree"), F.sum("n").alias("weight"))
    best = b.orderBy(F.desc("degree"), F.desc("weight"), "term").limit(3).select("term", F.lit(True).alias("top"))
    return b.join(best, "term", "left").select("term", "degree", "weight", F.coalesce("top", F.lit(False)).alias("top"))


@query("fm15_policy_zones", """WITH z AS (SELECT l_suppkey AS k, count(*) FILTER (l_returnflag = 'R') / count(*) AS defect, avg(l_discount) AS doubt, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT k, CASE WHEN defect > 0.3 THEN 'defect' WHEN doubt > 0.052 THEN 'uncertain' WHEN n < 550 THEN 'weak' ELSE 'stable' END AS zone FROM z""")
def fm15(spark, d):
    """Zones of suppliers. Discounts are summed as decimals, so that a mean of just 0.052 is no question of the order in which doubles are summed; where one is no such decimal (NaN), as doubles."""
    exact = F.col("l_discount").try_cast("decimal(28,18)")
    over = F.when(F.count(exact) == F.count("l_discount"), F.sum(exact) > F.lit("0.052").cast("decimal(4,3)") * F.count("l_discount").cast("decimal(18,0)")).otherwise(F.avg("l_discount") > 0.052)
    z = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg((F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("defect"), over.alias("doubtful"), F.count("*").alias("n"))
    return z.select("k", F.when(F.col("defect") > 0.3, "defect").when(F.col("doubtful"), "uncertain").when(F.col("n") < 550, "weak").otherwise("stable").alias("zone"))


from . import dialogue_queries, feature_queries, filter_queries, join_queries, name_queries, packet_queries, path_queries, relational, scene_queries, search_queries, storage_queries, temporal_queries, verdict_queries  # noqa: E402, F401 (add their queries to those above)
from . import brand_queries  # noqa: E402, F401 (builds on those)
