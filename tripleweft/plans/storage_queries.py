"""Named queries over sources and sinks: what is written to the shared folder, and read again."""

from pyspark.sql import functions as F

from ..sources import sinks, tables
from ..sources.storage import shared_path
from ..sources.tables import relations, table
from .catalog import REL, query


def lines(rows, column, path: str, **options) -> str:
    """Writes a column of texts as lines."""
    rows.select(column.alias("value")).write.options(**options).text(path)
    return path


@query("src03_range_scan", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey > 1000 AND l_orderkey <= 3000 GROUP BY 1")
def src03(spark, d):
    """Two chunks of a resumable scan; each is a pushed-down filter."""
    t = table(spark, d, "lineitem")
    return tables.chunk(t, "l_orderkey", 1000, 1000).unionByName(tables.chunk(t, "l_orderkey", 2000, 1000)).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("src04_gzip_json_lines", "SELECT event_type, count(*) FILTER (event_id % 10 NOT IN (3, 7)) AS good, count(*) FILTER (event_id % 10 = 7) AS bad FROM events GROUP BY 1 HAVING false UNION ALL SELECT event_type, good, 0 FROM (SELECT event_type, count(*) AS good FROM events WHERE event_id % 10 NOT IN (3, 7) GROUP BY 1) UNION ALL SELECT NULL, 0, count(*) FROM events WHERE event_id % 10 = 7")
def src04(spark, d):
    """Gzipped JSON lines, some of them blank or broken: blank ones are skipped, broken ones counted."""
    e = table(spark, d, "events")
    k = F.col("event_id") % 10
    text = F.when(k == 3, "").when(k == 7, F.lit('{"event_id": 1, "event_ty')).otherwise(F.to_json(F.struct("event_id", "event_type")))
    path = lines(e, text, shared_path(spark, "source"), compression="gzip")
    rows = tables.json_lines(spark, path, "event_id long, event_type string")
    return rows.groupBy(F.when(F.col("_bad").isNull(), F.col("event_type")).alias("event_type")).agg(F.count_if(F.col("_bad").isNull()).alias("good"), F.count_if(F.col("_bad").isNotNull()).alias("bad"))


@query("src05_ledger", "SELECT DISTINCT 'event_type=' || event_type AS name FROM events WHERE event_type NOT IN ('click', 'error')")
def src05(spark, d):
    """Folders written by type that the ledger of done ones lacks."""
    path = shared_path(spark, "source")
    table(spark, d, "events").select("event_id", "event_type").write.partitionBy("event_type").json(path)
    folders = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()
    return tables.not_done(folders, spark.createDataFrame([("event_type=click",), ("event_type=error",)], "name string"))


@query("src07_chat_export", "SELECT 'c' || conv_id AS title, role, trim(text) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE trim(text) <> ''")
def src07(spark, d):
    c = table(spark, d, "conversations")
    node = F.struct(F.struct(F.struct("role").alias("author"), F.col("turn").cast("double").alias("create_time"), F.struct(F.array("text").alias("parts")).alias("content")).alias("message"))
    whole = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n"), "turn"), node))).alias("mapping"))  # the turns of a conversation
    path = lines(whole, F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("title"), "mapping")), shared_path(spark, "source"))
    return tables.chats(spark, path, whole_files=False).select("title", "role", "text", F.col("place").cast("long").alias("place"))


@query("src08_games", "SELECT 'c' || o_custkey AS white, 'k' || o_orderkey AS black, CASE o_orderstatus WHEN 'F' THEN '1-0' WHEN 'O' THEN '0-1' ELSE '1/2-1/2' END AS result, 'e4 e5 Nf3 Nc6' AS moves FROM orders")
def src08(spark, d):
    result = F.when(F.col("o_orderstatus") == "F", "1-0").when(F.col("o_orderstatus") == "O", "0-1").otherwise("1/2-1/2")
    body = F.concat(F.lit('[Event "x"]\n[White "c'), "o_custkey", F.lit('"]\n[Black "k'), "o_orderkey", F.lit('"]\n[Result "'), result, F.lit('"]\n\n1. e4 {best (by test)} e5 $1 2. Nf3 (2. f4 (2. d4 (2. c4 d5) exd4 (2... d6 (2... f6))) exf4) 2... Nc6 '), result, F.lit("\n"))
    path = lines(table(spark, d, "orders"), body, shared_path(spark, "source"))
    return tables.games(spark, path).withColumn("moves", F.array_join("moves", " "))


@query("src11_triples", f"WITH {REL} SELECT subject_id AS subject, predicate, object_id || ' of ' || edge_type AS object, count(*) AS n FROM relations GROUP BY 1, 2, 3")
def src11(spark, d):
    r = relations(spark, d)
    text = F.concat_ws(" ", "subject_id", "predicate", "object_id", F.lit("of"), "edge_type", F.when(F.col("capsule_id") % 2 == 0, "| strength: 3"))
    path = lines(r, text, shared_path(spark, "source"))
    return tables.triples(spark, path).groupBy("subject", "predicate", "object").agg(F.count("*").alias("n"))


@query("src12_braids", f"WITH {REL} SELECT subject_id AS src, predicate AS rel, object_id AS dst, edge_weight AS weight, count(*) AS n FROM relations WHERE capsule_id % 5 <> 0 GROUP BY 1, 2, 3, 4")
def src12(spark, d):
    r = relations(spark, d)
    text = F.when(F.col("capsule_id") % 5 == 0, "@vectors 1 2 3").otherwise(F.concat_ws(" | ", "subject_id", "predicate", "object_id", F.col("edge_weight").cast("string")))
    return tables.braid(spark, lines(r, text, shared_path(spark, "source"))).groupBy("src", "rel", "dst", "weight").agg(F.count("*").alias("n"))


@query("src13_bridges", "SELECT CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS a, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS b, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS resonance, p_partkey % 4 <> 0 AS ok, count(*) AS n FROM part GROUP BY 1, 2, 3, 4")
def src13(spark, d):
    p = table(spark, d, "part")
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit(" <-> "), "p_type")).otherwise(F.concat("p_name", F.lit(" ↔ "), "p_type", F.lit(" [resonance: "), "p_size", F.lit("]")))
    return tables.bridges(spark, lines(p, text, shared_path(spark, "source"))).groupBy("a", "b", "resonance", "ok").agg(F.count("*").alias("n"))


@query("src14_tsv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src14(spark, d):
    """Written as tab-separated values with a header (SNK-13) and read back."""
    path = shared_path(spark, "source")
    sinks.write_tsv(table(spark, d, "nation"), path)
    return tables.tsv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("src15_trace_by_id", "SELECT event_type AS id, strftime(max(ts), '%Y-%m-%d') AS day FROM events WHERE event_type = 'click' GROUP BY 1")
def src15(spark, d):
    """The newest day's row of a trace, out of an append log by day (SNK-12)."""
    path = shared_path(spark, "source")
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    sinks.write_jsonl(e.where("n % 2 = 0"), path, "day")
    sinks.write_jsonl(e.where("n % 2 <> 0"), path, "day")
    return tables.trace(spark, path, "id string, n long", "id", "click").select("id", "day")


@query("src17_code_blocks", r"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(?:li)(?: [^>]*)?>(.*?)</(?:li)>', 1)) AS x FROM pages), p AS (SELECT page_id, trim(replace(replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS block FROM b)
  SELECT page_id, block, count(*) AS n FROM p WHERE block <> '' AND length(block) < 3000 GROUP BY 1, 2""")
def src17(spark, d):
    """Blocks of list items here, since these pages hold no code."""
    return table(spark, d, "pages").select("page_id", F.explode(tables.code_blocks(F.col("html"), "li")).alias("block")).groupBy("page_id", "block").agg(F.count("*").alias("n"))


@query("src20_columns", "SELECT column_name FROM (DESCRIBE lineitem)")
def src20(spark, d):
    return tables.columns_of(spark, table(spark, d, "lineitem"))


@query("src21_first_row_by_key", "SELECT o_custkey AS k, o_orderstatus AS v FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def src21(spark, d):
    return tables.first_by_key(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"))


@query("snk03_upsert", """WITH u AS (SELECT o_custkey AS k, 1 AS n, o_totalprice AS top, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 0.5 END AS old FROM orders) SELECT k, count(*) AS n, max(top) AS top, least(0.95 :: DOUBLE, CASE WHEN count(old) > 0 THEN 50 ELSE 60 END / 100 + count(*) FILTER (old IS NULL) * 2 / 100) AS confidence FROM u GROUP BY 1""")
def snk03(spark, d):
    """Old rows and new: counts add up, the greater value stays, the confidence rises by 0.02 with each new row up to 0.95 (new keys start at 0.6)."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("top"), F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    o = o.toDF("k", "top", "old")
    agg = lambda rows, old: rows.groupBy("k").agg(F.count("*").alias("n"), F.max("top").alias("top")).withColumns({"old": F.lit(old), "fresh": F.lit(0) if old else F.col("n")})
    start = F.when(F.bool_or("old"), 50).otherwise(60)
    merged = {"n": F.sum("n"), "top": F.max("top"), "confidence": F.least(F.lit(0.95), start / 100 + F.sum("fresh") * 2 / 100)}
    return sinks.upsert(agg(o.where("old"), True), agg(o.where("NOT old"), False), ["k"], merged)


@query("snk05_create_table_as", f"WITH {REL}, i AS (SELECT object_id AS node, count(*) AS n FROM relations GROUP BY 1) SELECT node, n FROM i WHERE n > (SELECT avg(n) FROM i)")
def snk05(spark, d):
    """A table made by a query, written once and read twice through a temporary view."""
    path = shared_path(spark, "table")
    relations(spark, d).groupBy(F.col("object_id").alias("node")).agg(F.count("*").alias("n")).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("tripleweft_degrees")
    return spark.sql("SELECT node, n FROM tripleweft_degrees WHERE n > (SELECT avg(n) FROM tripleweft_degrees)")


@query("snk06_point_updates", "WITH s AS (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_quantity > 48 GROUP BY 1) SELECT p_partkey, coalesce(q, p_retailprice) AS p_retailprice FROM part LEFT JOIN s ON l_partkey = p_partkey")
def snk06(spark, d):
    s = table(spark, d, "lineitem").where("l_quantity > 48").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("p_retailprice"))
    return sinks.update(table(spark, d, "part").select("p_partkey", "p_retailprice"), s, ["p_partkey"], ["p_retailprice"])


@query("snk08_first_rule", "SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'own' WHEN p_name LIKE 'red%' AND p_size > 20 THEN 'large red' WHEN p_name LIKE '%ring' THEN 'ring' ELSE 'open' END AS class FROM part")
def snk08(spark, d):
    rules = [(F.col("p_brand").isin("Brand#1", "Brand#2"), F.lit("own")), (F.col("p_name").startswith("red") & (F.col("p_size") > 20), F.lit("large red")), (F.col("p_name").endswith("ring"), F.lit("ring"))]
    return table(spark, d, "part").select("p_partkey", sinks.first_rule(rules, F.lit("open")).alias("class"))


@query("snk09_update_from_json", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'k' || json_extract_string(props, '$.k') ELSE event_type END AS domain FROM events")
def snk09(spark, d):
    own = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", sinks.first_rule([(F.col("event_type") == "click", own)], F.col("event_type")).alias("domain"))


@query("snk10_delete_by_query", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def snk10(spark, d):
    gone = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return sinks.delete(table(spark, d, "customer").select("c_custkey"), gone, ["c_custkey"])


@query("snk10_tree_purge", "WITH RECURSIVE t AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS parent, p_size < 48 AS expired FROM part), k AS (SELECT id, parent FROM t WHERE NOT expired UNION SELECT t.id, t.parent FROM k JOIN t ON t.id = k.parent) SELECT DISTINCT id FROM k")
def snk10_tree(spark, d):
    k = F.col("p_partkey")
    return sinks.purged(table(spark, d, "part").select(k.alias("id"), F.when(k > 0, F.floor(k / 3)).alias("parent"), (F.col("p_size") < 48).alias("expired")))


@query("snk11_export", "SELECT o_orderkey AS id, true AS exported, CASE WHEN o_orderstatus <> 'F' THEN 'b1' END AS batch FROM orders")
def snk11(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("move "), "o_custkey").alias("instruction"), F.col("o_orderpriority").alias("output"), (F.col("o_orderstatus") == "F").alias("exported"))
    return sinks.exported(s, shared_path(spark, "export"), "b1")


@query("snk14_a_folder_for_each_relation", f"WITH {REL} SELECT predicate, count(*) AS n FROM relations GROUP BY 1")
def snk14(spark, d):
    """Rows split by relation into folders, and counted from what was written."""
    path = shared_path(spark, "export")
    sinks.write_jsonl(relations(spark, d).select("subject_id", "predicate", "object_id"), path, "predicate")
    return spark.read.schema("subject_id string, object_id string, predicate string").json(path).groupBy("predicate").agg(F.count("*").alias("n"))


@query("snk16_strengths", f"WITH {REL} SELECT subject_id, predicate, object_id, capsule_id, row_number() OVER (PARTITION BY subject_id, predicate, object_id ORDER BY capsule_id > 7000, capsule_id, edge_weight, confidence) AS strength FROM relations QUALIFY capsule_id > 7000")
def snk16(spark, d):
    """New triples with the number of times each has come."""
    r = relations(spark, d)
    new = sinks.strengths(r.where("capsule_id <= 7000"), r.where("capsule_id > 7000"), ["subject_id", "predicate", "object_id"], ["capsule_id", "edge_weight", "confidence"])
    return new.select("subject_id", "predicate", "object_id", "capsule_id", F.col("strength").cast("long").alias("strength"))
