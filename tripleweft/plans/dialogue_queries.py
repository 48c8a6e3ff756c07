"""Named queries over dialogues, hierarchies and runs that go on where they stopped."""

from pyspark.sql import functions as F

from ..operators import dialogue, graph, hierarchy
from ..sources import resume
from ..sources.storage import shared_path
from ..sources.tables import relations, table
from .catalog import REL, SQL, query

ACT = "CASE " + " ".join(f"WHEN regexp_matches(low, '{words}') THEN '{act}'" for act, words in dialogue.ACTS.items()) + " ELSE 'question' END"
NEED = "CASE act " + " ".join(f"WHEN '{a}' THEN '{n}'" for a, n in dialogue.NEEDS.items()) + " END"
WORDS = "[" + ", ".join(f"'{w}'" for w in dialogue.PRESSURE) + "]"
LEVEL = "CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in dialogue.EXPERT) + " THEN 'expert' WHEN " + " OR ".join("contains(lower(text), '{}')".format(w.replace("'", "''")) for w in dialogue.NOVICE) + " THEN 'novice' ELSE 'familiar' END"


@query("fm21_user_acts", f"WITH t AS (SELECT conv_id AS session, turn, text, lower(trim(text)) AS low FROM conversations WHERE role = 'user'), a AS (SELECT *, {ACT} AS act FROM t) SELECT session, turn, act, {NEED} AS need, least(len(list_intersect(list_distinct(regexp_split_to_array(low, '\\s+')), {WORDS})) * 0.3 :: DOUBLE, 1) AS pressure, {LEVEL} AS level FROM a")
def fm21_acts(spark, d):
    """What the user does in each turn, needs by it, how pressed and how versed they are."""
    t = table(spark, d, "conversations").where("role = 'user'")
    act = dialogue.user_act(F.col("text"))
    return t.select(F.col("conv_id").alias("session"), "turn", act.alias("act"), dialogue.needs(act).alias("need"), dialogue.pressure(F.col("text")).alias("pressure"), dialogue.level(F.col("text")).alias("level"))


STOP = ", ".join(f"'{w}'" for w in dialogue.NO_FOCUS)


@query("fm21_focus", f"""WITH t AS (SELECT conv_id AS session, turn, lower(trim(text)) AS low, regexp_replace(lower(text), '[^a-z\\s]', '', 'g') AS plain FROM conversations WHERE role = 'user'),
  w AS (SELECT DISTINCT session, turn, unnest(regexp_split_to_array(plain, '\\s+')) AS word FROM t), senses AS (SELECT word, count(DISTINCT session) AS n FROM w WHERE length(word) > 2 GROUP BY 1 HAVING count(DISTINCT session) >= 2),
  best AS (SELECT session, turn, min(row(-n, word))[2] AS term FROM w JOIN senses USING (word) WHERE length(word) > 2 AND word NOT IN ({STOP}) GROUP BY 1, 2), a AS (SELECT t.*, term, {ACT} AS act FROM t LEFT JOIN best USING (session, turn))
  SELECT session, turn, act, {NEED} AS need, term, last_value(term IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn ROWS UNBOUNDED PRECEDING) AS focus FROM a""")
def fm21_focus(spark, d):
    """The focus of every dialogue after each of the user's turns; a word has as many senses as conversations use it. These texts hold no follow-ups; tests/test_dialogue.py has them."""
    t = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session"), "turn", "text")
    words = t.select("session", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("text"), "[^a-z\\s]", ""), "\\s+"))).alias("word")).where(F.length("word") > 2).distinct()
    senses = words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")
    return dialogue.focus(t, senses).select("session", "turn", "act", "need", "term", "focus")


# --- a forest: lines under parts, each part under half its number, customers under nations under regions ---
TREE = "tree AS (SELECT 'p' || p_partkey AS node, CASE WHEN p_partkey > 1 THEN 'p' || (p_partkey // 2) END AS parent FROM part UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"
COUNTS = "counts AS (SELECT 'p' || l_partkey AS node, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'c' || o_custkey, count(*) FROM orders GROUP BY 1)"
CLIMB = "climb AS (SELECT node, node AS ancestor, 0 AS distance FROM (SELECT node FROM tree UNION SELECT parent FROM tree WHERE parent IS NOT NULL) UNION ALL SELECT climb.node, parent, distance + 1 FROM climb JOIN tree ON tree.node = ancestor WHERE parent IS NOT NULL)"


def forest(spark, d):
    t = lambda n: table(spark, d, n)
    named = lambda k, c: F.concat(F.lit(k), c)
    half = F.floor(F.col("p_partkey") / 2).cast("long")
    tree = t("part").select(named("p", "p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, named("p", half)).alias("parent"))
    tree = tree.unionByName(t("customer").select(named("c", "c_custkey").alias("node"), named("n", "c_nationkey").alias("parent"))).unionByName(t("nation").select(named("n", "n_nationkey").alias("node"), named("r", "n_regionkey").alias("parent")))
    counts = t("lineitem").select(named("p", "l_partkey").alias("node")).unionByName(t("orders").select(named("c", "o_custkey").alias("node"))).groupBy("node").agg(F.count("*").alias("n"))
    return counts, tree


@query("gr41_topic_ancestors", f"WITH RECURSIVE {TREE}, {COUNTS}, {CLIMB} SELECT node, ancestor, CAST(distance AS BIGINT) AS distance, n FROM climb JOIN counts USING (node)")
def gr41_ancestors(spark, d):
    """A row for each topic with a count and each of its ancestors."""
    return hierarchy.rolled_up(*forest(spark, d))[0]


@query("gr41_topic_totals", f"WITH RECURSIVE {TREE}, {COUNTS}, {CLIMB} SELECT ancestor AS node, CAST(coalesce(sum(n) FILTER (distance = 0), 0) AS BIGINT) AS own, CAST(sum(n) AS BIGINT) AS total, count(*) AS below FROM climb JOIN counts USING (node) GROUP BY 1")
def gr41_totals(spark, d):
    return hierarchy.rolled_up(*forest(spark, d))[1]


@query("ag02_resumable_aggregation", SQL["ag01_edge_aggregation"])
def ag02_resumable(spark, d):
    """Edges aggregated by ranges of orders, stopped after two ranges and taken up again: the result of one pass."""
    r, folder = relations(spark, d), shared_path(spark, "ranges")
    size = 1 + r.agg(F.max("capsule_id")).first()[0] // 5
    keep_id = lambda rows: graph.aggregate_edges(rows)
    resume.aggregate_ranges(r, "capsule_id", size, folder, keep_id, most=2)
    resume.aggregate_ranges(r, "capsule_id", size, folder, keep_id)
    return resume.merged_ranges(spark, folder, graph.aggregate_edges)
