"""Named queries over filters of names, texts and edges."""

from pyspark.sql import functions as F

from ..functions import filters
from ..operators import resolution
from ..sources.tables import anchors, relations, table
from .catalog import ANC, REL, query

TERMS = ["fossil bed", "ring nebula", "old botany", "algebra", "cognition", "finance", "truth", "disease", "free will", "plain word", "Risk", "drug"]


def listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def either(texts: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains({texts}, '{v}')" for v in values) + ")"


PREDICATES = ["is_a", "causes", "related_to", "requires", "can_cause", "supports"]
CHAINS = f"""chains AS (SELECT DISTINCT {listed(TERMS)}[1 + l_partkey % 12] AS s, {listed(PREDICATES)}[1 + l_suppkey % 6] AS p, {listed(TERMS)}[1 + (l_partkey // 12 + l_linenumber) % 12] AS o, CAST(l_quantity AS INTEGER) AS strength FROM lineitem)"""


def chains(spark, d):
    """Chains of stated terms, one for each that the lines of orders spell."""
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + i).cast("int"))
    t = table(spark, d, "lineitem")
    other = (F.floor(F.col("l_partkey") / 12) + F.col("l_linenumber")) % 12
    return t.select(pick(TERMS, F.col("l_partkey") % 12).alias("s"), pick(PREDICATES, F.col("l_suppkey") % 6).alias("p"), pick(TERMS, other).alias("o"), F.col("l_quantity").cast("int").alias("strength")).distinct()


@query("flt04_no_digits", f"WITH {ANC} SELECT id, canonical FROM anchors WHERE canonical NOT GLOB '*[0-9]*'")
def flt04(spark, d):
    return anchors(spark, d).where(~F.col("canonical").rlike("[0-9]")).select("id", "canonical")


@query("flt05_lengths_and_blanks", "WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ' ' || p_name WHEN 1 THEN p_name || ' ' ELSE p_name END AS name FROM part) SELECT p_partkey, name, trim(name) AS clean FROM n WHERE length(name) BETWEEN 9 AND 12 AND trim(name) <> name")
def flt05(spark, d):
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat(F.lit(" "), "p_name")).when(k == 1, F.concat("p_name", F.lit(" "))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", name.alias("name")).where("length(name) BETWEEN 9 AND 12 AND trim(name) <> name").withColumn("clean", F.trim("name"))


@query("flt07_boolean_sort_keys", "SELECT p_partkey, p_name FROM part ORDER BY p_brand IS NOT DISTINCT FROM 'Brand#11' DESC, CASE WHEN p_name = 'red ring' THEN 0 WHEN p_name LIKE 'red%' THEN 1 ELSE 2 END, p_retailprice DESC, p_partkey LIMIT 50")
def flt07(spark, d):
    rank = F.when(F.col("p_name") == "red ring", 0).when(F.col("p_name").startswith("red"), 1).otherwise(2)
    return table(spark, d, "part").orderBy(F.col("p_brand").eqNullSafe("Brand#11").desc(), rank, F.desc("p_retailprice"), "p_partkey").limit(50).select("p_partkey", "p_name")


ODD_NAME = "CASE p_partkey % 5 WHEN 0 THEN 'the ' || p_name WHEN 1 THEN p_name || ' of' WHEN 2 THEN 'a b c d e ' || p_name WHEN 3 THEN upper(p_name[:1]) || p_name[2:] ELSE p_name END"


def odd_names(spark, d):
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    odd = F.when(k == 0, F.concat(F.lit("the "), n)).when(k == 1, F.concat(n, F.lit(" of"))).when(k == 2, F.concat(F.lit("a b c d e "), n)).when(k == 3, F.concat(F.upper(F.substring(n, 1, 1)), F.expr("substring(p_name, 2)"))).otherwise(n)
    return table(spark, d, "part").select("p_partkey", odd.alias("name"))


@query("flt09_valid_concepts", f"""WITH n AS (SELECT p_partkey, {ODD_NAME} AS name FROM part), w AS (SELECT *, list_filter(string_split(lower(name), ' '), lambda x: x <> '') AS w FROM n)
  SELECT p_partkey, name FROM w WHERE length(name) BETWEEN 3 AND 80 AND len(w) BETWEEN 1 AND 6 AND w[1] NOT IN {tuple(filters.EDGE_STOP)} AND w[-1] NOT IN {tuple(filters.EDGE_STOP)}""")
def flt09(spark, d):
    return odd_names(spark, d).where(filters.valid_concept(F.col("name")))


@query("flt10_gap_noise", f"""WITH n AS (SELECT p_partkey, {ODD_NAME} AS name FROM part) SELECT p_partkey, name FROM n WHERE length(name) BETWEEN 4 AND 28 AND NOT regexp_matches(name, '[0-9]') AND trim(name) = name AND NOT regexp_matches(lower(name), '^(his |her |our |your |their |the |upon |between |likewise |numerou|- |\\w+ itself$|idea or |unavoidable )')
  AND NOT (len(string_split(name, ' ')) >= 2 AND regexp_matches(name, '(^| )[A-Z]')) AND NOT regexp_matches(name, '(^| )[^ ]( |$)')""")
def flt10(spark, d):
    return odd_names(spark, d).where(filters.clean_gap(F.col("name")))


def in_family(c: str) -> str:
    return either(f"lower({c})", [x for f in filters.FAMILIES for x in f])


@query("flt11_domain_noise", f"WITH {CHAINS} SELECT DISTINCT s, p, o FROM chains WHERE NOT (p = 'is_a' AND {in_family('o')} AND NOT {in_family('s')})")
def flt11(spark, d):
    return chains(spark, d).where(~filters.domain_noise(F.col("s"), F.col("p"), F.col("o"))).select("s", "p", "o").distinct()


INCOHERENT = "p = 'is_a' AND ((s = 'truth' AND lower(o) IN ('disease', 'physics', 'cancer', 'compound', 'drug')) OR (o = 'truth' AND lower(s) IN ('disease', 'cancer', 'compound', 'drug', 'tumor')))"


@query("flt12_incoherent_demoted", f"WITH {CHAINS} SELECT s, p, o, strength * CASE WHEN {INCOHERENT} THEN 0.05 :: DOUBLE ELSE 1.0 :: DOUBLE END AS score FROM chains")
def flt12(spark, d):
    bad = filters.incoherent(F.lit("truth"), F.col("s"), F.col("p"), F.col("o"))
    return chains(spark, d).select("s", "p", "o", (F.col("strength") * F.when(bad, 0.05).otherwise(1.0)).alias("score"))


@query("gr38_reranked_paths", f"""WITH {CHAINS}, x AS (SELECT s, p, o, strength * CASE WHEN {INCOHERENT} THEN 0.05 :: DOUBLE ELSE 1.0 :: DOUBLE END * CASE WHEN p IN ('causes', 'requires', 'supports') THEN 1.4 :: DOUBLE WHEN p IN ('related_to', 'is_a') THEN 0.7 :: DOUBLE ELSE 1.0 :: DOUBLE END
  * CASE WHEN p IN ('supports', 'requires') THEN 1.5 :: DOUBLE ELSE 1.0 :: DOUBLE END AS score, p = 'can_cause' AS careful FROM chains) SELECT * FROM x ORDER BY score DESC, s, p, o LIMIT 40""")
def gr38(spark, d):
    """The chains told of the term truth; the forty best, as a report."""
    s, p, o = (F.col(c) for c in "spo")
    found = chains(spark, d).select("s", "p", "o", filters.reranked(F.lit("truth"), s, p, o, F.col("strength")).alias("score"), filters.sensitive(p, o).alias("careful"))
    return found.orderBy(F.desc("score"), "s", "p", "o").limit(40)


STOP = ["the", "and", "for", "that", "this", "with", "you", "your", "are", "was", "did", "has", "have", "can", "could", "would", "remember", "recall", "know", "tell", "talk", "about", "when", "what", "where", "how", "why", "our", "project", "time", "work"]
TERMS_SQL = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z][a-z0-9_-]{{2,}}'), lambda x: NOT list_contains(" + listed(STOP) + ", x) AND length(x) > {}))"


@query("flt14_relevance_gate", f"""WITH p AS (SELECT conv_id, turn, text AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a, role FROM conversations), t AS (SELECT conv_id, turn, a, {TERMS_SQL.format('q', 3)} AS terms FROM p WHERE role = 'user' AND a IS NOT NULL)
  SELECT conv_id, turn, CASE WHEN len(terms) = 0 OR len(list_filter(terms, lambda x: contains(lower(a), x))) > 0 THEN a ELSE '' END AS memory FROM t""")
def flt14(spark, d):
    pairs = resolution.pairs_of_turns(table(spark, d, "conversations"))
    terms = filters.topical_terms(F.col("question"), STOP, 4)
    return pairs.select("conv_id", "turn", F.when(filters.in_focus(F.col("answer"), terms), F.col("answer")).otherwise("").alias("memory"))


@query("flt15_focus", f"WITH {REL}, {ANC}, c AS (SELECT DISTINCT a.canonical AS s, predicate AS p, object_id AS o FROM relations JOIN anchors a ON a.id = subject_id) SELECT * FROM c WHERE contains(lower(s || ' ' || p || ' ' || o), 'ring') OR contains(lower(s || ' ' || p || ' ' || o), 'causes')")
def flt15(spark, d):
    c = relations(spark, d).select("subject_id", F.col("predicate").alias("p"), F.col("object_id").alias("o")).distinct().join(anchors(spark, d).select(F.col("id").alias("subject_id"), F.col("canonical").alias("s")), "subject_id").select("s", "p", "o").distinct()
    return c.where(filters.in_focus(F.concat_ws(" ", "s", "p", "o"), filters.topical_terms(F.lit("what causes the ring"), [*STOP, "what"])))


@query("flt16_anchor_relevance", f"WITH {CHAINS} SELECT DISTINCT s, p, o FROM chains WHERE contains(lower(s || ' | ' || p || ' | ' || o), 'truth')")
def flt16(spark, d):
    return chains(spark, d).where(F.lower(F.concat_ws(" | ", "s", "p", "o")).contains("truth")).select("s", "p", "o").distinct()


SPEAKER, REFLECTS, NOISE = r"(?i)(^|[^\p{L}])(the|der|la)([^\p{L}]|$)", r"(?i)(^|[^\p{L}])(is not|was|und|que|of)([^\p{L}]|$)", r"(?i)import |sha256|https?://"


@query("flt18_voice", rf"""SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '\|.*\|') AND length(text) - length(replace(text, '|', '')) <= 2 AND NOT regexp_matches(text, '{NOISE}') AND length(text) > 0
  AND length(regexp_replace(text, '[^\p{{L}} ]', '', 'g')) >= 0.68 * length(text) AND regexp_matches(text, '{SPEAKER}') AND regexp_matches(text, '{REFLECTS}')""")
def flt18(spark, d):
    return table(spark, d, "documents").where(filters.voice(F.col("text"), SPEAKER, REFLECTS, NOISE)).select("doc_id")


OFF, SYSTEM = ["p7 ", " s13"], ["p1", "s2"]


@query("flt19_review_rules", f"""WITH r AS (SELECT l_orderkey AS id, list({{'s': 'p' || l_partkey, 'o': 's' || l_suppkey, 't': 'p' || l_partkey || ' causes s' || l_suppkey}} ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_returnflag = 'A') AS rels FROM lineitem GROUP BY 1),
  f AS (SELECT id, rels, list_filter(rels, lambda r: contains(r.t, 'p7 ') OR contains(r.t, ' s13')) AS off, list_filter(rels, lambda r: contains(r.s, 'p1') OR contains(r.s, 's2') OR contains(r.o, 'p1') OR contains(r.o, 's2')) AS good, list_filter(rels, lambda r: NOT (contains(r.s, 'p1') OR contains(r.s, 's2') OR contains(r.o, 'p1') OR contains(r.o, 's2'))) AS other FROM r)
  SELECT id, CASE WHEN rels IS NULL OR len(off) > 0 OR len(good) = 0 THEN 2 ELSE 1 END AS status, CASE WHEN rels IS NULL THEN 'empty relations array' WHEN len(off) > 0 THEN 'off-topic relations: ' || off[1].t WHEN len(good) = 0 THEN 'no system relations' WHEN len(other) > 0 THEN 'approved (ignored: ' || other[1].t || ')' ELSE 'approved' END AS note FROM f""")
def flt19(spark, d):
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "A", one))).alias("x"))  # an order has seven lines at most
    rels = F.transform("x", lambda x: F.struct(F.concat(F.lit("p"), x["l_partkey"]).alias("subject"), F.lit("causes").alias("predicate"), F.concat(F.lit("s"), x["l_suppkey"]).alias("object")))
    return r.select("id", filters.review_relations(F.to_json(F.struct(rels.alias("relations"))), OFF, SYSTEM).alias("v")).select("id", "v.status", "v.note")


@query("flt23_acceptance", """WITH x AS (SELECT p_partkey, p_name, (p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)) :: INT + (contains(p_name, 'ring') OR contains(p_name, 'red')) :: INT + (contains(p_name, 'small') OR contains('small', p_name) OR contains(p_name, 'red ring') OR contains('red ring', p_name)) :: INT + (p_size / 50 > 0.5) :: INT AS n FROM part)
  SELECT p_partkey, CASE WHEN n >= 3 THEN 'accepted' WHEN n = 2 THEN 'pending' ELSE 'rejected' END AS verdict FROM x""")
def flt23(spark, d):
    known = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("known", F.lit(True))
    p = table(spark, d, "part").join(known, "p_partkey", "left")
    return p.select("p_partkey", filters.acceptance(F.coalesce("known", F.lit(False)), F.col("p_name"), ["ring", "red"], ["small", "red ring"], F.col("p_size") / 50).alias("verdict"))


@query("flt25_titles_and_markers", """SELECT doc_id FROM documents WHERE NOT coalesce(source, '') ILIKE '%blog.%' AND NOT coalesce(source, '') ILIKE '%net%' AND NOT coalesce(source, '') ILIKE 'm.%' AND (text ILIKE '%license%' OR text ILIKE '% und %' OR text ILIKE '%reserved%') AND n_chars >= 80 AND n_chars < 6000""")
def flt25(spark, d):
    return table(spark, d, "documents").where(~F.lower(F.coalesce("source", F.lit(""))).rlike("blog\\.|net|^m\\.") & F.lower("text").rlike("license| und |reserved") & (F.col("n_chars") >= 80) & (F.col("n_chars") < 6000)).select("doc_id")


DOMAINS = ["finance", "computing", "economics", "clinical", "medicine and law", "art", "software", ""]


@query("flt26_best_sense", f"""WITH h AS (SELECT l_orderkey AS id, l_linenumber AS pos, l_partkey AS sense, lower({listed(DOMAINS)}[1 + l_partkey % 8]) AS d, lower({listed(DOMAINS)}[1 + l_orderkey % 8]) AS a FROM lineitem),
  g AS (SELECT *, CASE WHEN d IN ('economics', 'finance') THEN 1 WHEN d IN ('computing', 'software') THEN 2 WHEN d IN ('clinical') THEN 3 END AS gd, CASE WHEN a IN ('economics', 'finance') THEN 1 WHEN a IN ('computing', 'software') THEN 2 WHEN a IN ('clinical') THEN 3 END AS ga FROM h),
  r AS (SELECT *, CASE WHEN d = '' OR a = '' THEN 3 WHEN d = a THEN 0 WHEN gd = ga THEN 1 WHEN contains(d, a) OR contains(a, d) THEN 2 ELSE 3 END AS rank FROM g)
  SELECT id, sense, rank FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, pos, sense) = 1""")
def flt26(spark, d):
    """The best sense of each order's lines for the order's domain, the first of equals."""
    pick = lambda i: F.element_at(F.array(*[F.lit(v) for v in DOMAINS]), (1 + i % 8).cast("int"))
    h = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("sense"), filters.sense_rank(pick(F.col("l_partkey")), pick(F.col("l_orderkey"))).alias("rank"))
    return h.groupBy("id").agg(F.min(F.struct("rank", "pos", "sense")).alias("x")).select("id", "x.sense", "x.rank")


LOOKUP = ["red", "ring", "sma", "gadget", "dge", "zzz", "blue w"]


@query("flt03_prefix_lookup", f"""WITH {ANC}, t AS (SELECT unnest({listed(LOOKUP)}) AS token), p AS (SELECT token, id, canonical, maturity, 0 AS tier FROM t JOIN anchors ON starts_with(lower(canonical), token)), few AS (SELECT token FROM t LEFT JOIN p USING (token) GROUP BY 1 HAVING count(id) < 3),
  a AS (SELECT * FROM p UNION ALL SELECT token, id, canonical, maturity, 1 FROM t JOIN few USING (token) JOIN anchors ON contains(lower(canonical), token) AND NOT starts_with(lower(canonical), token))
  SELECT token, id, canonical, row_number() OVER (PARTITION BY token ORDER BY tier, maturity DESC, id) AS place FROM a QUALIFY place <= 8""")
def flt03(spark, d):
    """Anchors that start with a token; if there are under three, those that hold it too."""
    tokens = spark.createDataFrame([(x,) for x in LOOKUP], "token string")
    return resolution.lookup(tokens, anchors(spark, d)).select("token", "id", "canonical", F.col("place").cast("long").alias("place"))
