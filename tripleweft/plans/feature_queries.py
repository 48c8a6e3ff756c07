"""Named queries over scores, verdicts, classes and proposals."""

from pyspark.sql import functions as F

from ..operators import code, features
from ..sources import sinks
from ..sources.tables import anchors, relations, table
from .catalog import ANC, NATIONS, REL, nation_edges, query
from .filter_queries import listed

ASKED = ["what is the ring", "compare red vs blue", "why did it fail", "next step for the plan", "what is missing before it can run", "is it true that rings bind", "hello", "are you sure", "who are you"]
LANES = ["knowledge", "project", "identity", "relationship"]


def intent_sql(op: str) -> str:
    return f"CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])({features.INTENTS[op]})($|[^A-Za-z0-9_])') THEN 1.0 :: DOUBLE ELSE 0.0 :: DOUBLE END" if op in features.INTENTS else "0.0 :: DOUBLE"


def operator_sql(i: int, op: str) -> str:
    lane = f"CASE WHEN list_contains({listed([k for k, v in features.LANES.items() if op in v])} :: VARCHAR[], lane) THEN 1.0 :: DOUBLE ELSE 0.2 :: DOUBLE END"
    own = features.SUPPORTS.get(op)
    n = f"len(list_intersect(predicates, {listed(own)}))" if own else ""
    support = f"CASE WHEN {n} = 0 THEN 0.1 :: DOUBLE ELSE least({n} / {max(len(own) * 0.2, 1)} :: DOUBLE, 1) END" if own else f"{0.5 if op.startswith('RECALL') else 0.3} :: DOUBLE"
    score = f"0.40 :: DOUBLE * {intent_sql(op)} + 0.25 :: DOUBLE * {lane} + 0.20 :: DOUBLE * {support} + 0.05 :: DOUBLE"
    lift = {"ANSWER_UNCERTAIN": "0.80", "RECALL_IDENTITY": "CASE WHEN lane = 'identity' THEN 0.85 END", "RECALL_RELATIONSHIP": "CASE WHEN lane = 'relationship' THEN 0.85 END", "PLAN_NEXT": "CASE WHEN lane = 'project' THEN 0.85 END"}.get(op)
    score = f"CASE WHEN len(predicates) = 0 THEN greatest({score}, {lift}) ELSE {score} END" if lift else score
    return f"SELECT query_id, {i} AS i, '{op}' AS operator, round({score}, 4) AS score FROM q"


@query("cg10_selected_operators", f"""WITH p AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT CASE l_returnflag WHEN 'A' THEN 'causes' WHEN 'N' THEN 'requires' ELSE 'depends_on' END) FILTER (l_linenumber > 2)) AS p FROM lineitem GROUP BY 1),
  q AS (SELECT id AS query_id, {listed(ASKED)}[1 + id % 9] AS text, {listed(LANES)}[1 + id % 4] AS lane, coalesce(p, [] :: VARCHAR[]) AS predicates FROM p), s AS ({' UNION ALL '.join(operator_sql(i, op) for i, op in enumerate(features.OPERATORS))})
  SELECT query_id, operator, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, i) = 1""", rounded="score")
def cg10(spark, d):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + F.col("query_id") % n).cast("int"))
    p = F.when(F.col("l_returnflag") == "A", "causes").when(F.col("l_returnflag") == "N", "requires").otherwise("depends_on")
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.collect_set(F.when(F.col("l_linenumber") > 2, p)).alias("predicates"))  # three predicates at most
    return features.select_operators(q.select("query_id", pick(ASKED, 9).alias("text"), pick(LANES, 4).alias("lane"), "predicates"))


@query("cg09_recalled", """WITH r AS (SELECT o_custkey AS subject, o_orderpriority AS kind, o_orderkey AS place, 'Order of ' || o_orderstatus || (o_orderkey % 7) AS text FROM orders), o AS (SELECT subject, kind, lower(text[1:60]) AS k, min(row(place, text)) AS x FROM r GROUP BY 1, 2, 3),
  f AS (SELECT *, row_number() OVER (PARTITION BY subject, kind ORDER BY x) AS n FROM o QUALIFY n <= CASE kind WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE 0 END), t AS (SELECT subject, kind, string_agg(x[2], ',' ORDER BY n) AS t FROM f GROUP BY 1, 2)
  SELECT subject, string_agg(kind || '=' || t, ';' ORDER BY kind) AS items, least(count(*) / 5 + 0.2 :: DOUBLE, 0.95 :: DOUBLE) AS confidence FROM t GROUP BY 1""")
def cg09(spark, d):
    """What is recalled of each subject, by kind, each text once (recall of identity, project and relationship)."""
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("place"), F.concat(F.lit("Order of "), "o_orderstatus", (F.col("o_orderkey") % 7).cast("string")).alias("text"))
    found = features.recalled(r, {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1})
    return found.withColumn("items", F.array_join(F.transform("items", lambda x: F.concat(x["kind"], F.lit("="), F.array_join(x["texts"], ","))), ";"))


@query("fm02_promoted_rows", f"WITH {REL}, ok AS (SELECT DISTINCT subject_id, predicate, object_id FROM relations WHERE confidence >= 0.5 AND predicate = 'causes'), known AS (SELECT DISTINCT subject_id, object_id FROM relations WHERE predicate = 'requires') SELECT *, 'linguistics' AS sem_domain FROM ok WHERE (subject_id, object_id) NOT IN (SELECT (subject_id, object_id) FROM known)")
def fm02(spark, d):
    """Approved rows that aren't known yet, stamped with their domain."""
    r = relations(spark, d)
    known = r.where("predicate = 'requires'").select("subject_id", "object_id").distinct()
    ok = r.where("confidence >= 0.5 AND predicate = 'causes'").select("subject_id", "predicate", "object_id").distinct()
    return ok.join(known, ["subject_id", "object_id"], "left_anti").withColumn("sem_domain", F.lit("linguistics"))


@query("fm03_reviewed_rows", f"WITH {REL} SELECT predicate, CASE WHEN subject_id = 'p1' AND predicate = 'causes' THEN 0 WHEN predicate = 'inhibits' AND confidence < 0.5 THEN 0 WHEN confidence < 0.2 THEN 0 ELSE 1 END AS approved, count(*) AS n FROM relations GROUP BY 1, 2")
def fm03(spark, d):
    """A review by rules in order: a triple, a predicate, a confidence; the rest is approved."""
    p, c = F.col("predicate"), F.col("confidence")
    verdict = sinks.first_rule([((F.col("subject_id") == "p1") & (p == "causes"), F.lit(0)), ((p == "inhibits") & (c < 0.5), F.lit(0)), (c < 0.2, F.lit(0))], F.lit(1))
    return relations(spark, d).groupBy("predicate", verdict.alias("approved")).agg(F.count("*").alias("n"))


TERMS = {"license": 5, "the": 1, " und ": 2, "reserved": 7}


@query("fm05_highlights", f"""WITH s AS (SELECT doc_id, text, lower(text) AS low FROM documents WHERE text IS NOT NULL), t AS (SELECT *, {' + '.join(f"CASE WHEN contains(low, '{t}') THEN {w} ELSE 0 END" for t, w in TERMS.items())} AS score, list_filter({listed(list(TERMS))}, lambda x: contains(low, x)) AS hits FROM s),
  h AS (SELECT *, strpos(low, hits[1]) - 1 AS pos FROM t WHERE score >= 6) SELECT doc_id, score, array_to_string(hits, ',') AS hits, replace(text[greatest(pos - 80, 0) + 1 : pos + 160], chr(10), ' ') AS snippet FROM h""")
def fm05(spark, d):
    score, hits = features.scored_terms(F.col("text"), TERMS)
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", score.alias("score"), hits.alias("hits")).where("score >= 6")
    return rows.select("doc_id", "score", F.array_join("hits", ",").alias("hits"), features.highlight(F.col("text"), F.col("hits")).alias("snippet"))


GENERIC, SIGNALS, GUESSES = [" the ", " und "], ["ring", "tion", "ou"], ["license"]


@query("fm07_expression_scores", f"""WITH e AS (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL) SELECT doc_id, greatest(0, least(1, 0.5 :: DOUBLE - ({' + '.join(f"contains(low, '{t}') :: INT" for t in GENERIC)}) * 0.25 :: DOUBLE + least(({' + '.join(f"contains(low, '{t}') :: INT" for t in SIGNALS)}) * 0.15 :: DOUBLE, 0.40 :: DOUBLE) - contains(low, 'license') :: INT * 0.60 :: DOUBLE)) AS score FROM e""", rounded="score")
def fm07(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", features.expression_score(F.col("text"), GENERIC, SIGNALS, GUESSES).alias("score"))


@query("fm11_profiles", "WITH u AS (SELECT c_mktsegment AS name, c_nationkey AS v, c_acctbal AS trust FROM customer) SELECT name, '[' || string_agg(DISTINCT CAST(v AS VARCHAR), ',' ORDER BY CAST(v AS VARCHAR)) || ']' AS versions, max(trust) AS trust FROM u GROUP BY 1")
def fm11(spark, d):
    """Profiles by key: lists as JSON of distinct values in order, the greatest trust. A profile has a value for each of 25 nations at most."""
    c = table(spark, d, "customer")
    merged = {"versions": F.array_sort(F.collect_set("v")), "trust": F.max("trust")}
    old, new = (c.where(F.col("c_custkey") % 2 == i).select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("v"), F.col("c_acctbal").alias("trust")) for i in (0, 1))
    return sinks.upsert(old, new, ["name"], merged).withColumn("versions", F.concat(F.lit("["), F.array_join("versions", ","), F.lit("]")))


@query("fm13_curriculum", "SELECT md5(o_custkey || '|' || o_orderpriority) AS id, max(least(1.0, abs(o_totalprice - 250000) / 3 / 100000)) AS difficulty FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def fm13(spark, d):
    """Tasks of hard positions, one for each key."""
    value = (F.col("o_totalprice") - 250000)
    return table(spark, d, "orders").where("o_orderstatus <> 'F'").groupBy(F.md5(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority")).alias("id")).agg(F.max(F.least(F.lit(1.0), F.abs(value) / 3 / 100000)).alias("difficulty"))


@query("fm14_adjudication", """WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 <> 0 THEN (o_custkey % 61 - 30) / 10 END AS e, o_orderkey % 3 = 0 AS agrees, ['1-0', '0-1', '1/2-1/2', '*'][1 + o_orderkey % 4] AS result FROM orders),
  f AS (SELECT *, CASE WHEN e > 0.3 THEN 'white' WHEN e < -0.3 THEN 'black' END AS favoured, CASE result WHEN '1-0' THEN 'white' WHEN '0-1' THEN 'black' WHEN '1/2-1/2' THEN 'draw' END AS winner, CASE WHEN abs(e) > 2 THEN 1.0 :: DOUBLE WHEN abs(e) > 1 THEN 0.75 :: DOUBLE ELSE 0.5 :: DOUBLE END AS sure FROM m)
  SELECT id, CASE WHEN winner = 'draw' THEN 'draw' WHEN winner IS NULL THEN 'pending' WHEN favoured IS NULL OR abs(e) < 0.3 THEN 'neutral' WHEN agrees = (favoured = winner) THEN 'validated' ELSE 'failed' END AS outcome,
  CASE WHEN winner = 'draw' OR winner IS NULL OR favoured IS NULL OR abs(e) < 0.3 THEN 0.0 :: DOUBLE WHEN agrees AND favoured = winner THEN 0.05 :: DOUBLE * sure WHEN agrees THEN -0.03 :: DOUBLE * sure WHEN favoured = winner THEN -0.05 :: DOUBLE * sure ELSE 0.10 :: DOUBLE * sure END AS delta FROM f""", rounded="delta")
def fm14(spark, d):
    k = F.col("o_orderkey")
    e = F.when(k % 13 != 0, (F.col("o_custkey") % 61 - 30) / 10)
    result = F.element_at(F.array(*[F.lit(x) for x in ("1-0", "0-1", "1/2-1/2", "*")]), (1 + k % 4).cast("int"))
    return table(spark, d, "orders").select(k.alias("id"), features.adjudicated(e, k % 3 == 0, result).alias("v")).select("id", "v.outcome", "v.delta")


@query("fm16_retrieved_units", """WITH u AS (SELECT p_partkey AS unit_id, p_name || ' ' || lower(p_type) AS code, CASE WHEN p_size > 25 THEN 'web_search' ELSE 'log_build' END AS source FROM part), t AS (SELECT p_brand AS task_id, max(p_name) || ' ' || lower(min(p_type)) AS text FROM part GROUP BY 1),
  a AS (SELECT DISTINCT task_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM t), h AS (SELECT DISTINCT unit_id, source, unnest(regexp_extract_all(lower(code), '[a-z0-9_]+')) AS word FROM u), s AS (SELECT task_id, unit_id, count(*) * CASE source WHEN 'web_search' THEN 0.55 :: DOUBLE ELSE 1.0 :: DOUBLE END AS score FROM a JOIN h USING (word) WHERE length(word) > 2 GROUP BY task_id, unit_id, source)
  SELECT task_id, unit_id, score, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, unit_id) AS place FROM s QUALIFY place <= 5""")
def fm16(spark, d):
    p = table(spark, d, "part")
    units = p.select(F.col("p_partkey").alias("unit_id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("code"), F.when(F.col("p_size") > 25, "web_search").otherwise("log_build").alias("source"))
    tasks = p.groupBy(F.col("p_brand").alias("task_id")).agg(F.concat_ws(" ", F.max("p_name"), F.lower(F.min("p_type"))).alias("text"))
    return features.retrieved(tasks, units, ["the", "for", "and"]).withColumn("place", F.col("place").cast("long"))


@query("fm17_verification", """WITH b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 END AS parse, [0, 1, NULL, 1, 1][1 + o_custkey % 5] AS lint, o_custkey % 17 = 0 AS blocked, o_orderkey % 2 AS ran, [0, 1, NULL][1 + o_orderkey % 3] AS code, o_custkey % 2 AS present, o_orderkey % 4 AS passed, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS failed FROM orders)
  SELECT id, CASE WHEN parse = 0 THEN 'failed_parse' WHEN lint = 0 OR blocked THEN 'failed_static' WHEN ran = 1 AND coalesce(code, 0) <> 0 THEN 'failed_runtime' WHEN present = 1 AND failed > 0 THEN 'failed_runtime' WHEN present = 1 AND passed > 0 THEN 'passed_verified' ELSE 'passed_minimal' END AS verdict FROM b""")
def fm17(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v).cast("int") for v in values]), (1 + i % len(values)).cast("int"))
    v = features.verification(F.when(k % 11 == 0, 0).otherwise(1), [pick([0, 1, None, 1, 1], c)], c % 17 == 0, k % 2, pick([0, 1, None], k), c % 2, k % 4, F.when(k % 5 == 0, 1).otherwise(0))
    return table(spark, d, "orders").select(k.alias("id"), v.alias("verdict"))


@query("fm19_deficiencies", f"""WITH {ANC}, k AS (SELECT domain, count(*) AS n, avg(maturity) AS m FROM anchors GROUP BY 1), h AS (SELECT p_type AS domain, count(*) AS n FROM part WHERE p_size < 5 GROUP BY 1), c AS (SELECT o_orderpriority AS domain, count(*) AS n FROM orders GROUP BY 1),
  u AS (SELECT 'code' AS kind, domain, n / max(n) OVER () * 100 * 2 AS score FROM c UNION ALL SELECT 'knowledge', domain, (1 / (m / 1000 + 0.01 :: DOUBLE)) * log10(greatest(n, 10)) FROM k UNION ALL SELECT 'failure', domain, n * 1.5 :: DOUBLE FROM h) SELECT kind, domain, score FROM u ORDER BY round(score, 6) DESC, kind, domain LIMIT 40""", rounded="score")
def fm19(spark, d):
    """Three kinds of deficits in one ranking, as a report: code (of its greatest, twice), knowledge (by the logarithm of anchors), failures."""
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("domain")).agg(F.count("*").alias("n"))
    code = c.crossJoin(F.broadcast(c.agg(F.max("n").alias("top")))).select(F.lit("code").alias("kind"), "domain", (F.col("n") / F.col("top") * 100 * 2).alias("score"))
    k = anchors(spark, d).groupBy("domain").agg(F.count("*").alias("n"), F.avg("maturity").alias("m")).select(F.lit("knowledge").alias("kind"), "domain", (1 / (F.col("m") / 1000 + 0.01) * F.log10(F.greatest("n", F.lit(10)))).alias("score"))
    h = table(spark, d, "part").where("p_size < 5").groupBy(F.col("p_type").alias("domain")).agg((F.count("*") * 1.5).alias("score")).select(F.lit("failure").alias("kind"), "domain", "score")
    return code.unionByName(k).unionByName(h).orderBy(F.round("score", 6).desc(), "kind", "domain").limit(40)


ROUTES, GENERAL = {"project": "(?i)license|reserved", "relationship": "(?i) und | que ", "identity": "(?i)stupid|secret"}, "(?i)the|tion"


@query("fm20_lanes", f"""WITH f AS (SELECT doc_id, text, list_filter([{', '.join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in ROUTES.items())}], lambda x: x IS NOT NULL) AS f FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, array_to_string(CASE WHEN len(f) > 0 AND NOT regexp_matches(text, '{GENERAL}') THEN f ELSE list_append(f, 'knowledge') END, ',') AS lanes FROM f""")
def fm20(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(features.lanes(F.col("text"), ROUTES, GENERAL), ",").alias("lanes"))


@query("fm21_seed_matches", f"""WITH {ANC}, n AS (SELECT DISTINCT canonical, domain, maturity / 2000 AS c FROM anchors WHERE id LIKE 'p%'), s AS (SELECT domain AS pattern, max(c) AS c, list_distinct(flatten(list(string_split(canonical, ' ')))) AS w FROM n GROUP BY 1), q AS (SELECT DISTINCT canonical AS question, list_distinct(string_split(canonical, ' ')) AS w FROM n),
  x AS (SELECT question, pattern, sqrt(len(list_intersect(q.w, s.w)) / len(s.w) * len(list_intersect(q.w, s.w)) / len(q.w)) * c AS score FROM q, s) SELECT question, pattern, score FROM x WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY question ORDER BY round(score, 9) DESC, pattern) = 1""", rounded="score")
def fm21(spark, d):
    """For each question the pattern of best geometric overlap times confidence; joined by word, not pair by pair."""
    n = anchors(spark, d).where(F.col("id").startswith("p")).select("canonical", "domain", (F.col("maturity") / 2000).alias("c")).distinct()
    s = n.select(F.col("domain").alias("pattern"), "c", F.explode(F.split("canonical", " ")).alias("word")).groupBy("pattern", "word").agg(F.max("c").alias("c"))
    size = s.groupBy("pattern").agg(F.count("*").alias("np"), F.max("c").alias("top"))
    q = n.select(F.col("canonical").alias("question"), F.explode(F.array_distinct(F.split("canonical", " "))).alias("word"), F.size(F.array_distinct(F.split("canonical", " "))).alias("nq")).distinct()
    x = q.join(s.select("pattern", "word"), "word").groupBy("question", "pattern", "nq").agg(F.count("*").alias("k")).join(size, "pattern")
    x = x.withColumn("score", F.sqrt(F.col("k") / F.col("np") * F.col("k") / F.col("nq")) * F.col("top")).where("score >= 0.05")
    return x.groupBy("question").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "pattern", "score")).alias("b")).select("question", "b.pattern", "b.score")


SAID = ["{} is a thing", "{} are many", "{} relates to rings", "{} causes {}!", "Nothing here", "{} leads to it", "{} enables a {}"]


@query("fm23_parsed_relations", f"""WITH t AS (SELECT p_partkey AS id, trim(regexp_replace(lower(trim(replace({listed(SAID)}[1 + p_partkey % 7], '{{}}', p_name))), '[^a-z0-9_ ]+', '', 'g')) AS t FROM part),
  r AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(t, '{f}') THEN [regexp_extract(t, '{f}', 1), regexp_extract(t, '{f}', 2)]" for f in ['^(.*?)\\s+' + p + '\\s+(.*)' for p in ('is\\s+an?', 'is', 'are', 'relates\\s+to', 'causes', 'enables', 'creates', 'leads\\s+to')])} END AS x FROM t)
  SELECT id, x[1] AS s, CASE WHEN contains(t, 'leads') THEN 'leads_to' WHEN contains(t, 'enables') THEN 'enables' WHEN contains(t, 'causes') THEN 'causes' WHEN contains(t, 'creates') THEN 'creates' WHEN contains(t, 'relates') THEN 'relates_to' ELSE 'is_a' END AS p, x[2] AS o FROM r WHERE x IS NOT NULL""")
def fm23(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in SAID]), (1 + F.col("p_partkey") % 7).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), features.parsed_relation(F.replace(said, F.lit("{}"), F.col("p_name"))).alias("x"))
    return rows.where("x IS NOT NULL").select("id", "x.s", "x.p", "x.o")


WORDS = {"legal": ["license", "reserved", "copyright"], "german": [" und ", " der ", "heit"], "english": ["the", "tion"], "code": ["http", "key"]}


@query("fm25_keyword_classes", "WITH l AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), h AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS i, '{k}' AS class, {' + '.join(f'contains(t, {chr(39)}{w}{chr(39)}) :: INT' for w in own)} AS n FROM l" for i, (k, own) in enumerate(WORDS.items())) + ") SELECT doc_id, CASE WHEN n = 0 THEN 'general' ELSE class END AS class FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1")
def fm25(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", features.keyword_class(F.lower("text"), WORDS, "general").alias("class"))


@query("fm27_broken_claims", """WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}'']+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w), c AS (SELECT unnest(['of the', 'license', 'und der']) AS claim),
  h AS (SELECT id, claim, w[greatest(i - 3, 1) : i - 1] AS b, w[i + len(string_split(claim, ' ')) : i + len(string_split(claim, ' ')) + 2] AS a FROM p JOIN c ON w[i] = string_split(claim, ' ')[1] WHERE w[i : i + len(string_split(claim, ' ')) - 1] = string_split(claim, ' ')) SELECT DISTINCT id, claim FROM h WHERE NOT list_has_any(list_concat(b, a), ['not', 'under', 'nicht'])""")
def fm27(spark, d):
    claims = spark.createDataFrame([("of the",), ("license",), ("und der",)], "claim string")
    return features.broken_claims(table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text"), claims, ["not", "under", "nicht"])


@query("fm29_best_snapshots", "WITH s AS (SELECT conv_id, turn, length(text) // 10 + (turn % 3) * 20 + (turn % 2) * 15 + length(role) // 2 AS score FROM conversations) SELECT conv_id, turn, score FROM s QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) = 1")
def fm29(spark, d):
    """The most significant state of each conversation, the first of equals."""
    score = F.floor(F.length("text") / 10) + F.col("turn") % 3 * 20 + F.col("turn") % 2 * 15 + F.floor(F.length("role") / 2)
    s = table(spark, d, "conversations").select("conv_id", "turn", score.alias("score"))
    return s.groupBy("conv_id").agg(F.min(F.struct((-F.col("score")).alias("n"), "turn")).alias("x")).select("conv_id", "x.turn", (-F.col("x.n")).alias("score"))


@query("fm30_chosen_moves", """WITH c AS (SELECT l_orderkey AS g, l_linenumber * 10000 + l_partkey AS id, l_extendedprice / 100 AS cp, l_discount * 10 AS fit, l_tax * 10 AS v FROM lineitem), k AS (SELECT *, max(cp) OVER (PARTITION BY g) AS top FROM c),
  s AS (SELECT g, id, 0.55 :: DOUBLE * greatest(-1, least(1, cp / 3000)) + 0.15 :: DOUBLE * greatest(0, 1 - 0.4 :: DOUBLE * v) + 0.20 :: DOUBLE * greatest(-1, least(1, fit)) AS score FROM k WHERE cp >= top - 80) SELECT g AS "group", id, score FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY score DESC, id) = 1""", rounded="score")
def fm30(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group"), (F.col("l_linenumber") * 10000 + F.col("l_partkey")).alias("id"), (F.col("l_extendedprice") / 100).alias("cp"), (F.col("l_discount") * 10).alias("fit"), (F.col("l_tax") * 10).alias("var"))
    return features.chosen_moves(c)


@query("gr19_rule_fixpoint", f"""WITH RECURSIVE {NATIONS}, f AS (SELECT DISTINCT 'n' || subject_id || ' ' || CASE n % 3 WHEN 0 THEN 'glows' WHEN 1 THEN 'moves' ELSE 'rests' END || ' n' || object_id AS fact FROM nation_edges),
  c AS (SELECT fact FROM f UNION SELECT replace(conclusion, 'X', string_split(fact, ' ')[1]) FROM c JOIN (VALUES ('glows', 'X shines'), ('X shines', 'X warms all'), ('warms', 'all is warm'), ('moves n3', 'X glows')) r(condition, conclusion) ON contains(fact, replace(condition, 'X', ''))) SELECT fact FROM c""")
def gr19(spark, d):
    n = nation_edges(spark, d)
    verb = F.when(F.col("n") % 3 == 0, "glows").when(F.col("n") % 3 == 1, "moves").otherwise("rests")
    facts = n.select(F.concat(F.lit("n"), "subject_id", F.lit(" "), verb, F.lit(" n"), "object_id").alias("fact"))
    rules = spark.createDataFrame([("glows", "X shines"), ("X shines", "X warms all"), ("warms", "all is warm"), ("moves n3", "X glows")], "condition string, conclusion string")
    return features.fixpoint(facts, rules).select("fact")


@query("gr26_fragments", f"""WITH {REL}, {ANC}, g AS (SELECT id, canonical, maturity FROM anchors WHERE length(canonical) > 11 AND id LIKE 'p%'), l AS (SELECT DISTINCT g.id, object_id AS other, predicate FROM g JOIN relations ON subject_id = g.id UNION SELECT g.id, subject_id, predicate FROM g JOIN relations ON object_id = g.id)
  SELECT md5(canonical) AS fragment, canonical AS text, least(max(maturity) / 1e9, 1.0) AS confidence, count(other) AS links FROM g LEFT JOIN l USING (id) GROUP BY canonical""")
def gr26(spark, d):
    """Anchors that are fragments, with how many links to the field they keep, both ways."""
    g = anchors(spark, d).where((F.length("canonical") > 11) & F.col("id").startswith("p"))
    r = relations(spark, d).select("subject_id", "predicate", "object_id").distinct()
    links = r.select(F.col("subject_id").alias("id"), F.col("object_id").alias("other"), "predicate").union(r.select("object_id", "subject_id", "predicate")).distinct().join(g.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"))
    return g.join(links, "id", "left").groupBy(F.md5("canonical").alias("fragment"), F.col("canonical").alias("text")).agg(F.least(F.max("maturity") / 1e9, F.lit(1.0)).alias("confidence"), F.coalesce(F.sum("n"), F.lit(0)).alias("links"))


NEAR = f"""{NATIONS}, e AS (SELECT subject_id AS s, CASE n % 3 WHEN 0 THEN 'causes' WHEN 1 THEN 'is_a' ELSE 'enables' END AS p, object_id AS o, n FROM nation_edges), near AS (SELECT s AS concept, o AS other, n / 200 AS similarity FROM e WHERE s <> o QUALIFY row_number() OVER (PARTITION BY s ORDER BY n DESC, o) <= 4), known AS (SELECT s AS concept, o FROM e WHERE n > 100)"""


@query("gr28_proposals", f"""WITH {NEAR}, x AS (SELECT concept, e.p, e.o, max(similarity * CASE e.p WHEN 'causes' THEN 0.9 :: DOUBLE WHEN 'is_a' THEN 1.0 :: DOUBLE ELSE 0.65 :: DOUBLE END * 0.7 :: DOUBLE * 0.55 :: DOUBLE) AS confidence FROM near JOIN e ON e.s = other WHERE concept <> e.o GROUP BY 1, 2, 3)
  SELECT concept, p, o, confidence, row_number() OVER (PARTITION BY concept ORDER BY confidence DESC, p, o) AS place FROM x WHERE (concept, o) NOT IN (SELECT (concept, o) FROM known) AND NOT (p = 'is_a' AND o = 3) QUALIFY place <= 10""", rounded="confidence")
def gr28(spark, d):
    return _proposed(spark, d).withColumn("place", F.col("place").cast("long"))


def _proposed(spark, d):
    from pyspark.sql import Window

    p = F.when(F.col("n") % 3 == 0, "causes").when(F.col("n") % 3 == 1, "is_a").otherwise("enables")
    e = nation_edges(spark, d).select(F.col("subject_id").alias("s"), p.alias("p"), F.col("object_id").alias("o"), "n")
    near = e.where("s <> o").withColumn("_n", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("n"), "o"))).where("_n <= 4").select(F.col("s").alias("concept"), F.col("o").alias("other"), (F.col("n") / 200).alias("similarity"))
    known = e.where("n > 100").select(F.col("s").alias("concept"), "o")
    rejected = e.select(F.col("s").alias("concept"), F.lit("is_a").alias("p"), F.lit(3).alias("o")).distinct()
    return features.proposals(near, e.select("s", "p", "o"), known, rejected, {"causes": 0.9, "is_a": 1.0}, F.lit(0.7))


@query("gr29_applied_proposals", f"""WITH {NEAR}, x AS (SELECT concept, e.p, e.o, max(similarity * CASE e.p WHEN 'causes' THEN 0.9 :: DOUBLE WHEN 'is_a' THEN 1.0 :: DOUBLE ELSE 0.65 :: DOUBLE END * 0.7 :: DOUBLE * 0.55 :: DOUBLE) AS confidence FROM near JOIN e ON e.s = other WHERE concept <> e.o GROUP BY 1, 2, 3),
  t AS (SELECT * FROM x WHERE (concept, o) NOT IN (SELECT (concept, o) FROM known) AND NOT (p = 'is_a' AND o = 3) QUALIFY row_number() OVER (PARTITION BY concept ORDER BY confidence DESC, p, o) <= 10)
  SELECT concept AS s, p, o, CASE p WHEN 'is_a' THEN 'taxonomic' WHEN 'causes' THEN 'causal' ELSE 'functional' END AS edge_type FROM t WHERE confidence >= 0.15 AND (concept, p, o) NOT IN (SELECT (s, p, o) FROM e)""")
def gr29(spark, d):
    """Accepted proposals that are new, with the type of their predicate's family."""
    p = F.when(F.col("n") % 3 == 0, "causes").when(F.col("n") % 3 == 1, "is_a").otherwise("enables")
    e = nation_edges(spark, d).select(F.col("subject_id").alias("s"), p.alias("p"), F.col("object_id").alias("o"))
    kind = F.when(F.col("p") == "is_a", "taxonomic").when(F.col("p") == "causes", "causal").otherwise("functional")
    return _proposed(spark, d).where("confidence >= 0.15").select(F.col("concept").alias("s"), "p", "o", kind.alias("edge_type")).join(e, ["s", "p", "o"], "left_anti")


@query("gr39_plausibility", f"""WITH {REL}, r AS (SELECT subject_id AS s, predicate AS p, object_id AS o, count(*) AS n, max(confidence) AS c FROM relations GROUP BY 1, 2, 3), e AS (SELECT * FROM r UNION ALL SELECT o, p, s, n, c FROM r WHERE p = 'causes'), q AS (SELECT DISTINCT s AS a, 's' || (CAST(s[2:] AS BIGINT) % 100) AS b FROM r),
  d AS (SELECT s AS a, o AS b, 0.5 :: DOUBLE * least(sum(n) / 100, 1) + 0.5 :: DOUBLE * sum(CASE p WHEN 'causes' THEN 0.9 :: DOUBLE ELSE 0.5 :: DOUBLE END * n * c) / sum(n) AS x FROM e GROUP BY 1, 2), t AS (SELECT s, o, max(n) AS n FROM e GROUP BY 1, 2), h AS (SELECT a, b, least(max(t1.n * t2.n) / 500, 1) AS y FROM q JOIN t t1 ON t1.s = a JOIN t t2 ON t2.s = t1.o AND t2.o = b GROUP BY 1, 2)
  SELECT a, b, greatest(coalesce(x, 0), coalesce(y, 0)) AS score FROM q LEFT JOIN d USING (a, b) LEFT JOIN h USING (a, b)""", rounded="score")
def gr39(spark, d):
    r = relations(spark, d).groupBy(F.col("subject_id").alias("s"), F.col("predicate").alias("p"), F.col("object_id").alias("o")).agg(F.count("*").alias("n"), F.max("confidence").alias("c"))
    e = r.unionByName(r.where("p = 'causes'").select(F.col("o").alias("s"), "p", F.col("s").alias("o"), "n", "c"))
    pairs = r.select(F.col("s").alias("a"), F.concat(F.lit("s"), (F.expr("substring(s, 2)").cast("long") % 100).cast("string")).alias("b")).distinct()
    return features.plausibility(pairs, e, {"causes": 0.9})


@query("gr45_scene_graphs", f"""WITH {REL}, {ANC}, r AS (SELECT subject_id AS id, object_id AS o, predicate AS p, row_number() OVER (PARTITION BY subject_id ORDER BY max(confidence) DESC, object_id, predicate) AS n FROM relations GROUP BY 1, 2, 3 QUALIFY n <= 6)
  SELECT r.id, string_agg(a.canonical || ' ' || p || ' ' || o, ';' ORDER BY n) FILTER (p <> 'inhibits' AND k <= 5) AS relations, coalesce(string_agg(o, ';' ORDER BY n) FILTER (p = 'inhibits' AND m <= 4), '') AS attributes FROM (SELECT *, count(*) FILTER (p <> 'inhibits') OVER w AS k, count(*) FILTER (p = 'inhibits') OVER w AS m FROM r WINDOW w AS (PARTITION BY id ORDER BY n)) r JOIN anchors a ON a.id = r.id GROUP BY 1""".replace("SELECT r.id, string_agg(a.canonical || ' ' || p || ' ' || o, ';' ORDER BY n) FILTER (p <> 'inhibits' AND k <= 5) AS relations", "SELECT r.id, coalesce(string_agg(a.canonical || ' ' || p || ' ' || o, ';' ORDER BY n) FILTER (p <> 'inhibits' AND k <= 5), '') AS relations"))
def gr45(spark, d):
    """For each node, of its six best relations five as statements, and four of those that name an attribute."""
    from pyspark.sql import Window

    r = relations(spark, d).groupBy(F.col("subject_id").alias("id"), F.col("object_id").alias("o"), F.col("predicate").alias("p")).agg(F.max("confidence").alias("c"))
    r = r.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("c"), "o", "p"))).where("n <= 6").join(anchors(spark, d).select("id", "canonical"), "id")
    own = F.col("p") == "inhibits"
    listed_ = lambda cond, text, most: F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("n", text.alias("t"))))), lambda x: x["t"]), 1, most), ";")
    return r.groupBy("id").agg(listed_(~own, F.concat_ws(" ", "canonical", "p", "o"), 5).alias("relations"), listed_(own, F.col("o"), 4).alias("attributes"))


@query("gr46_game_relations", """WITH g AS (SELECT o_orderkey AS id, 'c' || o_custkey AS white, 'k' || (o_custkey % 7) AS opening, o_orderstatus = 'P' AS draw, o_orderkey % 5 AS blunders FROM orders),
  u AS (SELECT white AS s, 'uses' AS p, opening AS o, 0.75 :: DOUBLE AS c FROM g UNION ALL SELECT opening, 'leads_to', 'draw', 0.50 :: DOUBLE FROM g WHERE draw UNION ALL SELECT opening, 'requires', 'tactics', 0.80 :: DOUBLE FROM g WHERE blunders >= 2) SELECT s, p, o, count(*) AS seen, max(c) AS confidence FROM u GROUP BY 1, 2, 3""")
def gr46(spark, d):
    """Relations that games give evidence of, told once and counted."""
    g = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("white"), F.concat(F.lit("k"), F.col("o_custkey") % 7).alias("opening"), (F.col("o_orderstatus") == "P").alias("draw"), (F.col("o_orderkey") % 5).alias("blunders"))
    one = lambda s, p, o, c: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(c).alias("c"))
    u = F.array_compact(F.array(one(F.col("white"), "uses", F.col("opening"), 0.75), F.when(F.col("draw"), one(F.col("opening"), "leads_to", F.lit("draw"), 0.50)), F.when(F.col("blunders") >= 2, one(F.col("opening"), "requires", F.lit("tactics"), 0.80))))
    return g.select(F.explode(u).alias("x")).groupBy("x.s", "x.p", "x.o").agg(F.count("*").alias("seen"), F.max("x.c").alias("confidence"))


CODE = "CASE p_partkey % 5 WHEN 0 THEN 'def f' || p_partkey || '(x):' || chr(10) || '    return \"' || p_name || '\" * x' WHEN 1 THEN '{\"a\": true, \"b\": null' WHEN 2 THEN 'SELECT * FROM ' || replace(p_name, ' ', '_') WHEN 3 THEN '{\"a\": [true]}' ELSE 'echo \"' || p_name END"


def codes(spark, d):
    k, n = F.col("p_partkey"), F.col("p_name")
    text = (F.when(k % 5 == 0, F.concat(F.lit("def f"), k, F.lit('(x):\n    return "'), n, F.lit('" * x'))).when(k % 5 == 1, F.lit('{"a": true, "b": null')).when(k % 5 == 2, F.concat(F.lit("SELECT * FROM "), F.replace(n, F.lit(" "), F.lit("_"))))
            .when(k % 5 == 3, F.lit('{"a": [true]}')).otherwise(F.concat(F.lit('echo "'), n)))
    return table(spark, d, "part").select(k.alias("id"), text.alias("text"))


@query("fm18_languages", "SELECT p_partkey AS id, ['python', 'unknown', 'sql', 'python', 'bash'][1 + p_partkey % 5] AS language FROM part")
def fm18(spark, d):
    """A JSON text without null is a Python expression too, and Python is asked first."""
    return code.languages(codes(spark, d))


@query("fm26_code_units", f"WITH c AS (SELECT p_partkey AS id, {CODE} AS text FROM part) SELECT id, CASE WHEN id % 5 = 0 THEN 'function' ELSE 'module' END AS kind, CASE WHEN id % 5 = 0 THEN 'f' || id ELSE 'module' END AS name, md5(text) AS code FROM c WHERE id % 5 <> 3")
def fm26(spark, d):
    """Units under the hash of their text, each once."""
    return code.units(codes(spark, d)).withColumn("code", F.md5("code")).dropDuplicates(["id", "code"])


@query("fm09_stated_triples", "SELECT s, p, o, 'theory' AS domain FROM (VALUES ('tension', 'causes', 'motion'), ('motion', 'is_a', 'change')) t(s, p, o) UNION SELECT p_brand, 'part_of', p_type, 'theory' FROM part")
def fm09(spark, d):
    """Hand-stated triples beside those of a table, each once (FM-04, FM-09)."""
    stated = spark.createDataFrame([("tension", "causes", "motion"), ("motion", "is_a", "change")], "s string, p string, o string")
    return stated.unionByName(table(spark, d, "part").select(F.col("p_brand").alias("s"), F.lit("part_of").alias("p"), F.col("p_type").alias("o"))).distinct().withColumn("domain", F.lit("theory"))
