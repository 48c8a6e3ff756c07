"""More named queries: aggregations, joins, windows, sorts, sets, filters, sinks and graph scores."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.tables import anchors, relations, table
from .catalog import ANC, MOVES, NATIONS, REL, SQL, moves, nation_edges, query


@query("ag02_incremental_aggregation", SQL["ag01_edge_aggregation"])
def ag02(spark, d):
    """What was aggregated before and what is new, aggregated together: sums of sums, maxima of maxima."""
    r = relations(spark, d)
    old, new = (graph.aggregate_edges(r.where(F.col("capsule_id") % 2 == i)) for i in (0, 1))
    return graph.aggregate_edges(old.unionByName(new))


@query("ag05_top_counts", "SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_shipdate LIMIT 15")
def ag05(spark, d):
    return table(spark, d, "lineitem").groupBy("l_shipdate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_shipdate").limit(15)


@query("ag07_filtered_groups", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(*) >= 5")
def ag07(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 1000").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 5")


@query("ag08_global_aggregates", "SELECT count(*) AS n, max(l_quantity) AS largest, round(avg(l_discount), 6) AS mean, round(sum(l_tax), 3) AS total FROM lineitem")
def ag08(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.max("l_quantity").alias("largest"), F.round(F.avg("l_discount"), 6).alias("mean"), F.round(F.sum("l_tax"), 3).alias("total"))


@query("ag09_model_statistics", f"WITH {MOVES} SELECT model, count(*) AS n, count(*) FILTER (correct) AS right_ones, round(avg(c), 6) AS confidence FROM moves GROUP BY 1")
def ag09(spark, d):
    return moves(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.count_if("correct").alias("right_ones"), F.round(F.avg("c"), 6).alias("confidence"))


@query("ag11_unpivoted_dimensions", f"WITH {MOVES} SELECT model, kind, value, count(*) AS n, count(*) FILTER (correct) AS right_ones FROM (SELECT model, correct, unnest(['phase', 'band']) AS kind, unnest([phase, band]) AS value FROM moves) GROUP BY 1, 2, 3")
def ag11(spark, d):
    long = moves(spark, d).unpivot(["model", "correct"], ["phase", "band"], "kind", "value")
    return long.groupBy("model", "kind", "value").agg(F.count("*").alias("n"), F.count_if("correct").alias("right_ones"))


@query("ag14_agreement_with_first", "SELECT conv_id, count(*) FILTER (role = f) AS agree, count(*) FILTER (role <> f) AS disagree FROM (SELECT *, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM conversations) GROUP BY 1")
def ag14(spark, d):
    """The first row is found by an aggregation, so no conversation is sorted."""
    by_role = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.min("turn").alias("turn"))
    first = by_role.groupBy("conv_id").agg(F.min_by("n", "turn").alias("agree"), F.sum("n").alias("n"))
    return first.select("conv_id", "agree", (F.col("n") - F.col("agree")).alias("disagree"))


@query("ag16_weighted_consensus", f"""WITH {MOVES}, w AS (SELECT model, count(*) FILTER (correct) / count(*) AS weight FROM moves GROUP BY 1), s AS (SELECT phase, band, round(sum(weight * c), 6) AS score FROM moves JOIN w USING (model) GROUP BY 1, 2)
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY phase ORDER BY score DESC, band) = 1""")
def ag16(spark, d):
    g = moves(spark, d).groupBy("model", "phase", "band").agg(F.sum("c").alias("c"), F.count("*").alias("n"), F.count_if("correct").alias("k"))
    w = g.groupBy("model").agg((F.sum("k") / F.sum("n")).alias("weight"))
    s = g.join(w, "model").groupBy("phase", "band").agg(F.round(F.sum(F.col("weight") * F.col("c")), 6).alias("score"))
    return s.withColumn("_n", F.row_number().over(Window.partitionBy("phase").orderBy(F.desc("score"), "band"))).where("_n = 1").drop("_n")


@query("ag20_fan_in_importance", f"WITH {REL}, f AS (SELECT object_id AS node, count(*) AS n FROM relations GROUP BY 1) SELECT node, n, round(n / (SELECT max(n) FROM f), 6) AS importance FROM f")
def ag20(spark, d):
    """The largest count is a one-row side, not a window over all nodes."""
    f = relations(spark, d).groupBy(F.col("object_id").alias("node")).agg(F.count("*").alias("n"))
    return f.crossJoin(F.broadcast(f.agg(F.max("n").alias("most")))).select("node", "n", F.round(F.col("n") / F.col("most"), 6).alias("importance"))


@query("ag21_node_activation", f"WITH {REL}, u AS (SELECT subject_id AS node, confidence AS a FROM relations UNION ALL SELECT object_id, 0.8 * confidence FROM relations), m AS (SELECT node, max(a) AS a FROM u GROUP BY 1) SELECT node, round(a / (SELECT max(a) FROM m), 6) AS activation FROM m")
def ag21(spark, d):
    r = relations(spark, d)
    u = r.select(F.col("subject_id").alias("node"), F.col("confidence").alias("a")).union(r.select("object_id", 0.8 * F.col("confidence")))
    m = u.groupBy("node").agg(F.max("a").alias("a"))
    return m.crossJoin(F.broadcast(m.agg(F.max("a").alias("most")))).select("node", F.round(F.col("a") / F.col("most"), 6).alias("activation"))


@query("ag22_most_common", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def ag22(spark, d):
    """The mode, the least of equals; min_by keeps one value for each key while it aggregates."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.min_by(F.struct("event_type", "n"), F.struct(-F.col("n"), "event_type")).alias("s")).select("user_id", "s.*")


@query("ag23_json_counts", "SELECT json_extract_string(props, '$.k') AS k, event_type, count(*) AS n, round(max(value), 6) AS top FROM events GROUP BY 1, 2 HAVING count(*) > 2")
def ag23(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k"), "event_type").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("top")).where("n > 2")


@query("ag26_unified_ranking", """WITH u AS (SELECT 'customer' AS src, c_custkey AS id, c_acctbal / (SELECT max(c_acctbal) FROM customer) AS score FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal / (SELECT max(s_acctbal) FROM supplier) FROM supplier
  UNION ALL SELECT 'part', p_partkey, p_retailprice / (SELECT max(p_retailprice) FROM part) FROM part) SELECT src, id, round(score, 6) AS score FROM u ORDER BY u.score DESC, src, id LIMIT 30""")
def ag26(spark, d):
    def scaled(name, key, value):
        t = table(spark, d, name)
        return t.crossJoin(F.broadcast(t.agg(F.max(value).alias("most")))).select(F.lit(name).alias("src"), F.col(key).alias("id"), (F.col(value) / F.col("most")).alias("score"))

    u = scaled("customer", "c_custkey", "c_acctbal").unionByName(scaled("supplier", "s_suppkey", "s_acctbal")).unionByName(scaled("part", "p_partkey", "p_retailprice"))
    return u.orderBy(F.desc("score"), "src", "id").limit(30).withColumn("score", F.round("score", 6))


@query("ag28_precision_recall", """WITH want AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), got AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 100000)
  SELECT count(*) FILTER (want.k IS NOT NULL AND got.k IS NOT NULL) AS tp, count(*) FILTER (want.k IS NULL) AS fp, count(*) FILTER (got.k IS NULL) AS fn FROM want FULL JOIN got ON want.k = got.k""")
def ag28(spark, d):
    """Both sets come from one pass, by flags of each key."""
    k = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("w"), F.bool_or(F.col("o_totalprice") > 100000).alias("g"))
    return k.agg(F.count_if(F.col("w") & F.col("g")).alias("tp"), F.count_if(~F.col("w") & F.col("g")).alias("fp"), F.count_if(F.col("w") & ~F.col("g")).alias("fn"))


@query("ag29_keyword_overlap", """WITH k AS (SELECT DISTINCT o_orderpriority AS model, l_shipdate AS word FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT word, count(*) AS models FROM k GROUP BY 1)
  SELECT count(*) FILTER (models = 5) AS common, count(*) FILTER (models = 1) AS single FROM n""")
def ag29(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    k = table(spark, d, "lineitem").join(o, "l_orderkey").groupBy(F.col("l_shipdate").alias("word")).agg(F.count_distinct("o_orderpriority").alias("models"))
    return k.agg(F.count_if(F.col("models") == 5).alias("common"), F.count_if(F.col("models") == 1).alias("single"))


@query("ag30_running_average", "SELECT event_id, user_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS mean FROM events", rounded="mean")
def ag30(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.avg("value").over(w).alias("mean"))


@query("ag34_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ag34(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("ag34_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderpriority) AS rolled FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def ag34_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderpriority").cast("long").alias("rolled"))


@query("ag34_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def ag34_sets(spark, d):
    return table(spark, d, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("ag34_approximate_distinct", "SELECT o_orderstatus, abs(count(DISTINCT o_custkey) - count(DISTINCT o_custkey)) <= 0.1 * count(DISTINCT o_custkey) AS near FROM orders GROUP BY 1")
def ag34_approximate(spark, d):
    """Whether the estimate lies within a tenth of the count."""
    g = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.02).alias("k"), F.count_distinct("o_custkey").alias("n"))
    return g.select("o_orderstatus", (F.abs(F.col("k") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


@query("jn03_either_domain", f"WITH {REL}, {ANC} SELECT predicate, count(*) AS n FROM relations r JOIN anchors a ON r.subject_id = a.id JOIN anchors b ON r.object_id = b.id WHERE a.domain LIKE 'Brand#1%' OR b.domain = '7' GROUP BY 1")
def jn03(spark, d):
    a = anchors(spark, d).select("id", "domain")
    r = relations(spark, d).groupBy("subject_id", "object_id", "predicate").agg(F.count("*").alias("n"))
    j = r.join(a.select(F.col("id").alias("subject_id"), F.col("domain").alias("x")), "subject_id").join(a.select(F.col("id").alias("object_id"), F.col("domain").alias("y")), "object_id")
    return j.where(F.col("x").startswith("Brand#1") | (F.col("y") == "7")).groupBy("predicate").agg(F.sum("n").alias("n"))


@query("jn11_leaves", f"WITH {NATIONS} SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM nation_edges WHERE subject_id = n_nationkey AND n > 250)")
def jn11(spark, d):
    e = nation_edges(spark, d).where("n > 250").select(F.col("subject_id").alias("n_nationkey"))
    return table(spark, d, "nation").join(e, "n_nationkey", "left_anti").select("n_nationkey", "n_name")


@query("jn13_two_keys", "SELECT p_partkey, s_suppkey, coalesce(n, 0) AS n FROM (SELECT p_partkey, p_partkey % 10 + 1 AS s_suppkey FROM part) LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) ON p_partkey = l_partkey AND s_suppkey = l_suppkey")
def jn13(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 10 + 1).alias("s_suppkey")).join(n, ["p_partkey", "s_suppkey"], "left").select("p_partkey", "s_suppkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("jn16_pairs_within_record", "WITH k AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS first, b.l_suppkey AS second, count(*) AS n FROM k a JOIN k b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def jn16(spark, d):
    """An order has at most seven lines, so its pairs are made in its own array."""
    k = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("first"), y.alias("second")))))
    return k.select(F.explode(pairs).alias("p")).groupBy("p.first", "p.second").agg(F.count("*").alias("n"))


@query("wn03_keep_strongest", f"WITH {REL} SELECT subject_id, object_id, predicate, confidence FROM relations QUALIFY row_number() OVER (PARTITION BY subject_id, object_id ORDER BY confidence DESC, predicate) = 1")
def wn03(spark, d):
    best = F.min_by(F.struct("predicate", "confidence"), F.struct(-F.col("confidence"), "predicate"))
    return relations(spark, d).groupBy("subject_id", "object_id").agg(best.alias("s")).select("subject_id", "object_id", "s.*")


@query("wn07_previous_element", "SELECT event_id, event_type, lag(event_type) OVER w AS previous, event_type IS DISTINCT FROM lag(event_type) OVER w AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def wn07(spark, d):
    previous = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("event_id", "event_type", previous.alias("previous"), (~F.col("event_type").eqNullSafe(previous)).alias("changed"))


@query("wn11_domain_trail", "SELECT event_id, len(list_filter(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), lambda x: x = event_type)) >= 2 AS settled FROM events")
def wn11(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    times = sum(F.coalesce((F.lag("event_type", k).over(w) == F.col("event_type")).cast("int"), F.lit(0)) for k in (1, 2))
    return table(spark, d, "events").select("event_id", (times >= 1).alias("settled"))


@query("wn12_recency_penalty", "SELECT event_id, round(1 - CASE WHEN lag(event_type, 1) OVER w = event_type THEN 0.5 ELSE 0 END - CASE WHEN lag(event_type, 2) OVER w = event_type THEN 0.25 ELSE 0 END, 6) :: DOUBLE AS weight FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def wn12(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    lost = lambda k, x: F.when(F.lag("event_type", k).over(w) == F.col("event_type"), x).otherwise(0.0)
    return table(spark, d, "events").select("event_id", (1.0 - lost(1, 0.5) - lost(2, 0.25)).alias("weight"))


@query("wn18_gap_pressure", """WITH g AS (SELECT user_id, event_id, ts, CAST(count(*) FILTER (event_type = 'error') OVER w AS BIGINT) AS gaps, row_number() OVER w AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  c AS (SELECT *, lag(gaps) OVER w AS g0, lag(turn) OVER w AS t0 FROM g WHERE turn % 5 = 0 WINDOW w AS (PARTITION BY user_id ORDER BY turn))
  SELECT user_id, turn, (gaps - coalesce(g0, 0)) / (turn - coalesce(t0, 0)) AS pressure FROM c""")
def wn18(spark, d):
    """At every fifth turn of a user, the new gaps (errors) for each turn since the last check."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = table(spark, d, "events").select("user_id", F.sum((F.col("event_type") == "error").cast("long")).over(w).alias("gaps"), F.row_number().over(w).cast("long").alias("turn")).where("turn % 5 = 0")
    before = Window.partitionBy("user_id").orderBy("turn")
    since = lambda c: F.col(c) - F.coalesce(F.lag(c).over(before), F.lit(0))
    return g.select("user_id", "turn", (since("gaps") / since("turn")).alias("pressure"))


@query("srt01_mixed_order", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50")
def srt01(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("srt06_beam", f"WITH {REL}, s AS (SELECT subject_id, object_id, max(confidence) AS c FROM relations GROUP BY 1, 2) SELECT subject_id, object_id, c FROM s QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY c DESC, object_id) <= 6")
def srt06(spark, d):
    s = relations(spark, d).groupBy("subject_id", "object_id").agg(F.max("confidence").alias("c"))
    return s.withColumn("_n", F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("c"), "object_id"))).where("_n <= 6").drop("_n")


@query("set01_branches_not_merged", """SELECT * FROM (SELECT event_type AS k, 'small' AS branch, count(*) AS n FROM events WHERE value < 10 GROUP BY 1 UNION ALL SELECT event_type, 'large', count(*) FROM events WHERE value >= 10 GROUP BY 1) ORDER BY n DESC, k, branch LIMIT 3""")
def set01(spark, d):
    e = table(spark, d, "events")
    count = lambda rows, b: rows.groupBy(F.col("event_type").alias("k")).agg(F.lit(b).alias("branch"), F.count("*").alias("n"))
    return count(e.where("value < 10"), "small").unionByName(count(e.where("value >= 10"), "large")).orderBy(F.desc("n"), "k", "branch").limit(3)


@query("set04_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set04(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("set06_mixed_axes", "SELECT 'user' AS axis, CAST(user_id AS VARCHAR) AS k, count(*) AS n, NULL :: DOUBLE AS top FROM events GROUP BY 2 UNION ALL SELECT 'type', event_type, count(*), round(max(value), 6) FROM events GROUP BY 2")
def set06(spark, d):
    e = table(spark, d, "events")
    a = e.groupBy(F.col("user_id").cast("string").alias("k")).agg(F.lit("user").alias("axis"), F.count("*").alias("n"))
    b = e.groupBy(F.col("event_type").alias("k")).agg(F.lit("type").alias("axis"), F.count("*").alias("n"), F.round(F.max("value"), 6).alias("top"))
    return a.unionByName(b, allowMissingColumns=True)


@query("flt01_ranges_and_lists", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT') AND o_totalprice BETWEEN 50000 AND 150000")
def flt01(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O") & ~F.col("o_orderpriority").isin("1-URGENT") & F.col("o_totalprice").between(50000, 150000)).select("o_orderkey", "o_totalprice")


@query("flt06_null_rules", f"WITH {REL} SELECT coalesce(nullif(trim(domain_tags), ''), 'none') AS tag, count(*) AS n, count(seen_count) AS counted FROM relations GROUP BY 1")
def flt06(spark, d):
    tag = F.coalesce(F.nullif(F.trim("domain_tags"), F.lit("")), F.lit("none"))
    return relations(spark, d).groupBy(tag.alias("tag")).agg(F.count("*").alias("n"), F.count("seen_count").alias("counted"))


@query("flt17_blocklist", "SELECT doc_id, len(list_filter(['password', 'secret', 'token', 'http://', 'key'], lambda p: contains(lower(text), p))) AS hits FROM documents WHERE regexp_matches(lower(text), 'password|secret|token|http://|key')")
def flt17(spark, d):
    text = F.lower("text")
    hits = sum(text.contains(p).cast("long") for p in ("password", "secret", "token", "http://", "key"))
    return table(spark, d, "documents").select("doc_id", hits.alias("hits")).where("hits > 0")


@query("flt20_dynamic_where", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45")
def flt20(spark, d):
    return graph.narrowed(table(spark, d, "lineitem"), l_returnflag="R", l_quantity=(45, None), l_linestatus=None).select("l_orderkey", "l_linenumber")


@query("snk01_insert_or_ignore", "SELECT * FROM (SELECT s_suppkey AS k, s_name AS v FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier))")
def snk01(spark, d):
    old, new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return old.unionByName(new.join(old.select("k"), "k", "left_anti"))


@query("snk02_insert_or_replace", "SELECT * FROM (SELECT c_custkey AS k, c_name AS v FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer))")
def snk02(spark, d):
    old, new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return new.unionByName(old.join(new.select("k"), "k", "left_anti"))


@query("snk07_update_from_query", "SELECT c_custkey, coalesce((SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey), c_acctbal) AS v FROM customer")
def snk07(spark, d):
    top = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    return table(spark, d, "customer").join(top, "c_custkey", "left").select("c_custkey", F.coalesce("top", "c_acctbal").alias("v"))


@query("gr17_transitive_closure", f"""WITH RECURSIVE {NATIONS}, e AS (SELECT DISTINCT subject_id AS src, object_id AS dst FROM nation_edges),
  c AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT c.src, e.dst, depth + 1 FROM c JOIN e ON c.dst = e.src WHERE depth < 3) SELECT src, dst, min(depth) AS depth FROM c GROUP BY 1, 2""")
def gr17(spark, d):
    return graph.closure(nation_edges(spark, d).select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")), 3)


@query("gr30_sparse_nodes", f"WITH {REL}, {ANC}, n AS (SELECT subject_id AS id, count(*) AS n FROM relations GROUP BY 1) SELECT id, coalesce(n, 0) AS n, round(maturity / (coalesce(n, 0) + 1), 6) AS gap FROM anchors LEFT JOIN n USING (id) WHERE maturity >= 1000 AND coalesce(n, 0) <= 30")
def gr30(spark, d):
    n = relations(spark, d).groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("n"))
    a = anchors(spark, d).where("maturity >= 1000").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <= 30")
    return a.select("id", "n", F.round(F.col("maturity") / (F.col("n") + 1), 6).alias("gap"))


@query("gr31_concept_gravity", f"""WITH {REL}, {ANC}, n AS (SELECT subject_id AS id, count(*) AS n, count(DISTINCT predicate) AS hits FROM relations GROUP BY 1)
  SELECT id, round(0.45 * least(1, ln(1 + greatest(maturity, 0)) / 12) + 0.45 * least(1, ln(1 + n) / 10) + least(0.3, 0.1 * hits), 6) :: DOUBLE AS gravity FROM anchors JOIN n USING (id)""")
def gr31(spark, d):
    n = relations(spark, d).groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("n"), F.count_distinct("predicate").alias("hits"))
    one, own = F.lit(1.0), anchors(spark, d).join(n, "id")
    g = 0.45 * F.least(one, F.log1p(F.greatest("maturity", F.lit(0.0))) / 12) + 0.45 * F.least(one, F.log1p("n") / 10) + F.least(F.lit(0.3), 0.1 * F.col("hits"))
    return own.select("id", F.round(g, 6).alias("gravity"))
