"""Named queries over frames, instances and concepts."""

from pyspark.sql import functions as F

from ..operators import scenes
from ..sources.tables import table
from .catalog import query

LABEL = "CASE l_returnflag WHEN 'R' THEN 'person' WHEN 'A' THEN 'car' ELSE 'tea_cup' END"
SEEN = f"seen AS (SELECT DISTINCT l_suppkey AS stream, l_orderkey % 50 AS frame, {LABEL} || '_' || (l_partkey % 5) AS item FROM lineitem)"
CHANGES = f"""{SEEN}, runs AS (SELECT *, lag(frame) OVER w AS p, lead(frame) OVER w AS q, max(frame) OVER (PARTITION BY stream) AS last FROM seen WINDOW w AS (PARTITION BY stream, item ORDER BY frame)),
  changes AS (SELECT stream, frame, item, 'appeared' AS change FROM runs WHERE p IS NULL OR p < frame - 1 UNION ALL SELECT stream, frame + 1, item, 'disappeared' FROM runs WHERE (q IS NULL OR q > frame + 1) AND frame < last)"""


def named(number):
    kind = F.when(F.col("l_returnflag") == "R", "person").when(F.col("l_returnflag") == "A", "car").otherwise("tea_cup")
    return F.concat(kind, F.lit("_"), number.cast("string"))


def seen(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("stream"), (F.col("l_orderkey") % 50).alias("frame"), named(F.col("l_partkey") % 5).alias("item")).distinct()


@query("st02_transitions", f"WITH {CHANGES} SELECT * FROM changes")
def st02(spark, d):
    return scenes.transitions(seen(spark, d))


@query("st03_event_types", f"""WITH {CHANGES} SELECT stream, frame, CASE WHEN item LIKE 'person%' THEN CASE change WHEN 'appeared' THEN 'person_entered' ELSE 'person_left' END WHEN item LIKE 'car%' THEN CASE change WHEN 'appeared' THEN 'car_appeared' ELSE 'car_departed' END
  ELSE CASE change WHEN 'appeared' THEN 'object_detected:tea_cup' ELSE 'object_removed:tea_cup' END END AS type, count(*) AS n FROM changes GROUP BY ALL""")
def st03(spark, d):
    kind = scenes.event_type(F.col("item"), F.col("change"), ["person"], ["car"])
    return scenes.transitions(seen(spark, d)).groupBy("stream", "frame", kind.alias("type")).agg(F.count("*").alias("n"))


@query("gr41_cooccurrences", """WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS pos, 'Field ' || (l_partkey % 50) AS name, l_linenumber % 3 AS level, l_discount * 10 AS score FROM lineitem WHERE l_discount * 10 >= 0.5),
  t AS (SELECT doc, name, level, row_number() OVER (PARTITION BY doc ORDER BY score DESC, pos, name) AS place FROM c QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, pos, name) <= 4),
  h AS (SELECT doc, coalesce('field_' || arg_min(name[7:], place) FILTER (level = 0), 'general') AS domain FROM t GROUP BY 1)
  SELECT a.name AS s, b.name AS o, domain, count(*) AS seen_count FROM t a JOIN t b ON a.doc = b.doc AND a.place < b.place JOIN h ON h.doc = a.doc GROUP BY 1, 2, 3""")
def gr41(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("position"), F.concat(F.lit("Field "), (F.col("l_partkey") % 50).cast("string")).alias("name"), (F.col("l_linenumber") % 3).alias("level"), (F.col("l_discount") * 10).alias("score"))
    return scenes.cooccurrences(c, k=4)


@query("gr44_projection", f"""SELECT {LABEL} AS s, CASE l_linestatus WHEN 'O' THEN 'interacts_with' ELSE 'F' END AS p, 'shelf' AS o, count(*) AS usage_count, max(l_discount) AS confidence, 'scenes' AS source FROM lineitem GROUP BY 1, 2""")
def gr44(spark, d):
    r = table(spark, d, "lineitem").select(named(F.col("l_partkey") % 5).alias("subject"), F.col("l_linestatus").alias("predicate"), F.concat(F.lit("shelf_"), F.col("l_suppkey").cast("string")).alias("object"), F.col("l_discount").alias("confidence"))
    return scenes.projected(r, {"O": "interacts_with"}, "scenes")


@query("fm12_training_samples", """SELECT o_orderkey AS id, round(least(1.0, c + CASE WHEN o_orderstatus = 'F' THEN 0.05 ELSE 0 END + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.1 ELSE 0 END), 6) AS quality
  FROM (SELECT *, 0.75 + (o_orderkey % 7 - 2) / 20 AS c FROM orders) WHERE c >= 0.75 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def fm12(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (0.75 + (F.col("o_orderkey") % 7 - 2) / 20).alias("confidence"), (F.col("o_orderstatus") == "F").alias("agrees"), F.when(F.col("o_orderpriority") == "1-URGENT", "validated").alias("outcome"))
    known = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return scenes.training_samples(rows, known).withColumn("quality", F.round("quality", 6))
