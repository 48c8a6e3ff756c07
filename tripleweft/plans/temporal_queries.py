"""Named queries over frames and events in time."""

from pyspark.sql import functions as F

from ..operators import sessions
from ..sources.tables import table
from ..streaming import events as temporal
from .catalog import query


@query("st01_tracks")
def st01(spark, d):
    """Tracks of detections: the lines of orders, by supplier, as boxes in frames (also JN-20). No SQL: greedy and stateful; tests hold it against plain Python."""
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("stream"), F.col("l_orderkey").alias("frame"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("label"), (F.col("l_quantity") * 4).alias("x"), (F.col("l_partkey") % 50).cast("double").alias("y"))
    return sessions.track(t.groupBy("stream", "frame", "id").agg(F.min("label").alias("label"), F.min("x").alias("x"), F.min("y").alias("y")))


KINDS = ["person_entered", "interaction_start", "placement", "cup_left", "removal", "relation_formed", "proximity_start"]
LEADS = " OR ".join(f"(a.k = '{k}' AND b.k IN ({', '.join(repr(x) for x in v)}))" for k, v in sessions.LEADS.items())


@query("st05_causal_links", f"""WITH e AS (SELECT l_orderkey // 1000 AS stream, l_orderkey * 10 + l_linenumber AS id, l_orderkey AS frame, min([{', '.join(repr(k) for k in KINDS)}][1 + l_partkey % 7]) AS type, 's' || min(l_suppkey) AS sub, CASE WHEN min(l_partkey) % 3 = 0 THEN 'p' || min(l_partkey % 100) END AS obj FROM lineitem GROUP BY 1, 2, 3),
  i AS (SELECT stream, id, frame, CASE WHEN contains(type, '_entered') THEN 'object_entered' WHEN contains(type, '_left') THEN 'object_left' ELSE type END AS k, unnest(list_filter([sub, obj], lambda x: x IS NOT NULL)) AS instance FROM e)
  SELECT a.stream, a.id AS first_id, b.id AS second_id, min(a.instance) AS shared, greatest(0.3 :: DOUBLE, 1 - min(b.frame - a.frame) / 10 * 0.7 :: DOUBLE) AS confidence FROM i a JOIN i b ON a.stream = b.stream AND a.instance = b.instance AND b.frame - a.frame BETWEEN 0 AND 10 AND (b.frame > a.frame OR a.id < b.id) WHERE {LEADS} GROUP BY 1, 2, 3""")
def st05(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (1 + F.col("l_partkey") % 7).cast("int"))
    e = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 1000).alias("stream"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("frame")).agg(
        F.min(kind).alias("type"), F.concat(F.lit("s"), F.min("l_suppkey")).alias("sub"), F.when(F.min("l_partkey") % 3 == 0, F.concat(F.lit("p"), F.min(F.col("l_partkey") % 100))).alias("obj"))
    return sessions.causal_links(e)


SEQ = "s AS (SELECT event_type AS event_1, lead(event_type, 1) OVER w AS event_2, lead(event_type, 2) OVER w AS event_3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT event_1, event_2, event_3, count(*) AS f FROM s WHERE event_3 IS NOT NULL GROUP BY 1, 2, 3)"


@query("st09_promoted_anomalies", f"""WITH {SEQ}, p AS (SELECT event_1, event_2, f FROM c UNION ALL SELECT event_2, event_3, f FROM c), n AS (SELECT event_1, event_2, CAST(sum(f) AS BIGINT) AS frequency FROM p GROUP BY 1, 2), pending AS (SELECT DISTINCT event_type AS event_1, prev AS event_2 FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev > event_type)
  SELECT event_1, event_2, frequency FROM pending JOIN n USING (event_1, event_2) WHERE frequency >= 500""")
def st09(spark, d):
    """Pairs held to be anomalies whose frequency has reached the bound."""
    e = table(spark, d, "events")
    pending = temporal.sequences(e, 2).where("event_1 > event_2").select(F.col("event_2").alias("event_1"), F.col("event_1").alias("event_2"))
    return temporal.promoted(pending, temporal.sequences(e), 500)


@query("st15_live_state", "WITH l AS (SELECT user_id, event_type, max(ts) AS last, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type, n FROM l WHERE last + INTERVAL 6 HOUR > (SELECT max(ts) FROM events)")
def st15(spark, d):
    """State by user and type that has not expired six hours after its last event, as of the latest event."""
    e = table(spark, d, "events")
    return temporal.alive(e.groupBy("user_id", "event_type").agg(F.max("ts").alias("last"), F.count("*").alias("n")), "last", "6 HOURS", e.agg(F.max("ts").alias("now"))).select("user_id", "event_type", "n")


@query("st15_session_windows", """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions_(spark, d):
    """Sessions that end with a silence of over thirty minutes."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "1800000001 microseconds").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
