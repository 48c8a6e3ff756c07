"""Named queries over names found in questions."""

from pyspark.sql import functions as F

from ..operators import resolution
from ..sources.tables import anchors, relations, table
from .catalog import ANC, REL, query
from .filter_queries import listed

# a question for each brand, of its first names and types
QUESTIONS = """questions AS (SELECT p_brand AS query_id, CASE p_brand WHEN 'Brand#1' THEN min(p_name) WHEN 'Brand#2' THEN 'Tell me about: ' || min(p_name) || '?' WHEN 'Brand#3' THEN 'how do a zzz and it go' ELSE 'What is the ' || max(p_name) || ' compared to ' || split_part(min(p_name), ' ', 2) || '?' END AS text,
  CASE WHEN length(p_brand) = 7 THEN 'F' END AS domain FROM part GROUP BY 1)"""


def questions(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("query_id")).agg(F.min("p_name").alias("a"), F.max("p_name").alias("b"))
    text = (F.when(F.col("query_id") == "Brand#1", F.col("a")).when(F.col("query_id") == "Brand#2", F.concat(F.lit("Tell me about: "), "a", F.lit("?"))).when(F.col("query_id") == "Brand#3", "how do a zzz and it go")
            .otherwise(F.concat(F.lit("What is the "), "b", F.lit(" compared to "), F.split_part(F.col("a"), F.lit(" "), F.lit(2)), F.lit("?"))))
    return p.select("query_id", text.alias("text"), F.when(F.length("query_id") == 7, "F").alias("domain"))


NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"
STOPS = listed(resolution.STOP)


def resolved(source: str) -> str:
    """CTEs that resolve source(query_id, text) to found(query_id, term, id, maturity)."""
    return f"""n AS (SELECT query_id, {NORM.format('text')} AS norm FROM {source}), w AS (SELECT *, string_split(norm, ' ') AS w FROM n),
  c AS (SELECT query_id, 0 AS a, 0 AS b, norm AS term FROM w UNION ALL SELECT query_id, 1, 0, array_to_string(list_filter(w, lambda x: NOT list_contains({STOPS}, x)), ' ') FROM w
    UNION ALL SELECT query_id, 6 - n, i, array_to_string(w[i : i + n - 1], ' ') FROM w, range(1, 5) r(n), range(1, 40) s(i) WHERE i + n - 1 <= len(w) AND NOT list_contains({STOPS}, array_to_string(w[i : i + n - 1], ' '))),
  m AS (SELECT query_id, a, b, term, id, maturity, CASE WHEN lower(canonical) = term THEN 0 WHEN starts_with(lower(canonical), term) THEN 1 ELSE 2 END AS tier FROM c JOIN anchors ON contains(lower(canonical), term) WHERE length(term) >= 2),
  found AS (SELECT query_id, term, id, maturity FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY a, b, tier, maturity DESC, id) = 1)"""


@query("gr36_resolution", f"WITH {ANC}, {QUESTIONS}, {resolved('questions')} SELECT * FROM found")
def gr36(spark, d):
    return resolution.resolve(questions(spark, d), anchors(spark, d))


@query("gr37_pairs", f"""WITH {ANC}, {QUESTIONS}, sides AS (SELECT query_id || '/' || i AS query_id, trim(string_split(replace(text, 'compared to', '@'), '@')[i]) AS text FROM questions, range(1, 3) r(i) WHERE NOT contains(text, ' and ') AND i <= len(string_split(replace(text, 'compared to', '@'), '@'))
  UNION ALL SELECT query_id || '/' || i, trim(string_split(replace(text, ' and ', '@'), '@')[i]) FROM questions, range(1, 3) r(i) WHERE contains(text, ' and ')), {resolved('sides')}
  SELECT q.query_id, a.id AS left_id, b.id AS right_id FROM questions q LEFT JOIN found a ON a.query_id = q.query_id || '/1' LEFT JOIN found b ON b.query_id = q.query_id || '/2'""")
def gr37(spark, d):
    return resolution.resolve_pairs(questions(spark, d), anchors(spark, d))


MEMBERS = f"""{ANC}, {QUESTIONS}, w AS (SELECT query_id, string_split({NORM.format('text')}, ' ') AS w FROM questions), g AS (SELECT query_id, i AS position, array_to_string(w[i : i + n - 1], ' ') AS ngram FROM w, range(1, 3) r(n), range(1, 40) s(i) WHERE i + n - 1 <= len(w)),
  named AS (SELECT lower(canonical) AS ngram, min(id) AS id FROM anchors GROUP BY 1)"""


@query("jn25_ngram_members", f"WITH {MEMBERS} SELECT query_id, ngram, position, id FROM g JOIN named USING (ngram)")
def jn25(spark, d):
    return resolution.member_ngrams(questions(spark, d), anchors(spark, d)).withColumn("position", F.col("position").cast("long"))


@query("srt08_leftmost_candidates", f"WITH {MEMBERS} SELECT query_id, string_agg(ngram, ',' ORDER BY position, length(ngram) DESC) AS ordered FROM g JOIN named USING (ngram) GROUP BY 1")
def srt08(spark, d):
    """A question's candidates, leftmost first, the longer of those that start together first."""
    m = resolution.member_ngrams(questions(spark, d), anchors(spark, d))
    ordered = F.array_sort(F.collect_list(F.struct("position", (-F.length("ngram")).alias("n"), "ngram")))
    return m.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["ngram"]), ",").alias("ordered"))


NOISE = ["the", "and", "what", "tell", "about", "how", "compared"]


@query("gr34_knowledge", f"""WITH {REL}, {ANC}, {QUESTIONS}, a AS (SELECT query_id, list_filter(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]*'), lambda x: NOT list_contains({listed(NOISE)}, x) AND length(x) > 2) AS w FROM questions),
  t AS (SELECT query_id, i AS pos, w[i] AS token FROM a, range(1, 13) r(i) WHERE i <= len(w)), h AS (SELECT token, id, canonical, maturity, row_number() OVER (PARTITION BY token ORDER BY maturity DESC, id) AS place FROM (SELECT DISTINCT token FROM t) JOIN anchors ON starts_with(lower(canonical), token) QUALIFY place <= 4),
  o AS (SELECT query_id, id, canonical, maturity, min(row(pos, place)) AS k FROM t JOIN h USING (token) GROUP BY ALL), o2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k, id) AS place FROM o),
  s AS (SELECT query_id, count(*) AS n_anchors, count(*) FILTER (len(list_filter(w, lambda x: contains(canonical, x))) > 0) AS matched, max(len(list_distinct(w))) AS n, avg(maturity) AS mean FROM o2 JOIN a USING (query_id) GROUP BY 1),
  e AS (SELECT query_id, count(DISTINCT (subject_id, predicate, object_id)) AS n_relations FROM o2 JOIN relations ON id = subject_id OR id = object_id WHERE place <= 20 GROUP BY 1),
  f AS (SELECT query_id, n_anchors, coalesce(n_relations, 0) AS n_relations, round(0.5 :: DOUBLE * matched / greatest(n, 1) + 0.3 :: DOUBLE * least(mean / 50, 1) + 0.2 :: DOUBLE * least(coalesce(n_relations, 0) / 10, 1), 3) AS confidence FROM s LEFT JOIN e USING (query_id))
  SELECT *, confidence >= 0.25 AND n_anchors >= 2 AS has_knowledge FROM f""")
def gr34(spark, d):
    edges = relations(spark, d).select("subject_id", "predicate", "object_id").distinct()
    return resolution.knowledge(questions(spark, d), anchors(spark, d), edges, NOISE)


@query("gr35_memory_search", f"""WITH {REL}, {ANC}, {QUESTIONS}, edges AS (SELECT subject_id, predicate, object_id, min(edge_type) AS domain, max(confidence) AS confidence, count(*) AS seen FROM relations GROUP BY 1, 2, 3),
  t AS (SELECT DISTINCT query_id, domain AS wanted, unnest(list_filter(string_split(lower(text), ' '), lambda x: length(x) > 3 AND NOT list_contains({listed(NOISE)}, x))[1:6]) AS token FROM questions),
  p AS (SELECT token, id, maturity, CASE WHEN starts_with(lower(canonical), token) THEN 0 ELSE 1 END AS tier FROM (SELECT DISTINCT token FROM t) JOIN anchors ON contains(lower(canonical), token)),
  h AS (SELECT token, id FROM (SELECT *, count(*) FILTER (tier = 0) OVER (PARTITION BY token) AS n FROM p) WHERE tier = 0 OR n < 3 QUALIFY row_number() OVER (PARTITION BY token ORDER BY tier, maturity DESC, id) <= 8),
  direct AS (SELECT DISTINCT query_id, e.* FROM t JOIN h USING (token) JOIN edges e ON h.id = subject_id OR h.id = object_id WHERE wanted IS NULL OR contains(e.domain, wanted)),
  rest AS (SELECT query_id, e.* FROM questions q JOIN edges e USING (domain) WHERE query_id NOT IN (SELECT query_id FROM direct))
  SELECT query_id, subject_id, predicate, object_id, row_number() OVER (PARTITION BY query_id ORDER BY seen DESC, confidence DESC, subject_id, predicate, object_id) AS place FROM (SELECT * FROM direct UNION ALL SELECT * FROM rest) QUALIFY place <= 10""")
def gr35(spark, d):
    edges = relations(spark, d).groupBy("subject_id", "predicate", "object_id").agg(F.min("edge_type").alias("domain"), F.max("confidence").alias("confidence"), F.count("*").alias("seen"))
    return resolution.memory_search(questions(spark, d), anchors(spark, d), edges, NOISE).withColumn("place", F.col("place").cast("long"))
