"""Named queries over wavefronts and paths."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import packets, paths, wavefront
from ..sources.storage import keep
from ..sources.tables import anchors, relations, table
from .catalog import ANC, NATIONS, REL, nation_edges, query
from .packet_queries import NAMED, named_edges

# --- wavefronts: a seed for each brand, its dearest part ---
FIELD = f"""{REL}, {ANC}, e AS (SELECT subject_id, CASE predicate WHEN 'inhibits' THEN 'related_to' ELSE predicate END AS predicate, object_id, min(CASE edge_type WHEN 'O' THEN 'causal' ELSE 'associative' END) AS edge_type, coalesce(min(CASE WHEN capsule_id % 3 = 0 THEN 'pubmed' END), '') AS domain_tags FROM relations GROUP BY 1, 2, 3),
  own AS (SELECT a.id, a.canonical, a.maturity, coalesce(n, 0) AS attractor, CASE WHEN a.id[1] = 's' THEN 'wikidata' ELSE 'extracted' END AS object_domain, CASE WHEN a.maturity < 950 THEN 'music' END AS sem_domain FROM anchors a LEFT JOIN (SELECT subject_id AS id, count(*) AS n FROM relations GROUP BY 1) USING (id)),
  queries AS (SELECT domain AS query_id, id, canonical AS text FROM anchors WHERE id[1] = 'p' QUALIFY row_number() OVER (PARTITION BY domain ORDER BY maturity DESC, id) = 1)"""


def field(spark, d):
    p = F.when(F.col("predicate") == "inhibits", "related_to").otherwise(F.col("predicate"))
    e = relations(spark, d).groupBy("subject_id", p.alias("predicate"), "object_id").agg(F.min(F.when(F.col("edge_type") == "O", "causal").otherwise("associative")).alias("edge_type"), F.coalesce(F.min(F.when(F.col("capsule_id") % 3 == 0, "pubmed")), F.lit("")).alias("domain_tags"))
    n = relations(spark, d).groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("attractor"))
    a = anchors(spark, d).join(n, "id", "left").select("id", "canonical", "maturity", F.coalesce("attractor", F.lit(0)).alias("attractor"), F.when(F.col("id").startswith("s"), "wikidata").otherwise("extracted").alias("object_domain"), F.when(F.col("maturity") < 950, "music").alias("sem_domain"))
    q = anchors(spark, d).where(F.col("id").startswith("p")).groupBy(F.col("domain").alias("query_id")).agg(F.min(F.struct(-F.col("maturity"), "id", "canonical")).alias("x")).select("query_id", "x.id", F.col("x.canonical").alias("text"))
    return keep(q), keep(e), keep(a)  # each level of a wavefront reads them


NB = """both_ways AS (SELECT subject_id AS node, object_id AS other, predicate, edge_type, domain_tags, 'out' AS direction FROM e UNION ALL SELECT object_id, subject_id, predicate, edge_type, domain_tags, 'in' FROM e),
  nb AS MATERIALIZED (SELECT b.*, o.canonical, o.maturity, o.attractor, o.object_domain, o.sem_domain, predicate IN ('related_to', 'co_occurs_with') AS generic, row_number() OVER (PARTITION BY node, direction ORDER BY maturity DESC, other, predicate) AS r, row_number() OVER (PARTITION BY node, direction, predicate IN ('related_to', 'co_occurs_with') ORDER BY maturity DESC, other, predicate) AS rs FROM both_ways b JOIN own o ON o.id = other WHERE length(canonical) < 40),
  near AS (SELECT query_id, nb.* FROM queries q JOIN nb ON node = q.id WHERE r <= 20 OR (NOT generic AND rs <= 20)),
  types AS (SELECT query_id, edge_type, count(*) AS n FROM near GROUP BY 1, 2), sums AS (SELECT query_id, count(*) AS types, min(row(-n, edge_type)) FILTER (edge_type <> 'associative') AS x FROM types GROUP BY 1),
  asked AS (SELECT q.*, greatest(0.10 :: DOUBLE - 0.005 :: DOUBLE * least(len(string_split(text, ' ')) + 0.5 :: DOUBLE * coalesce(types, 0), 10), 0.04 :: DOUBLE) AS theta, CASE WHEN x IS NULL THEN ['associative'] ELSE ['causal', 'functional', 'mechanistic'] END AS family FROM queries q LEFT JOIN sums USING (query_id))"""
CLEAN = "length(canonical) <= 35 AND len(string_split(canonical, ' ')) <= 4 AND NOT list_has_any(string_split(canonical, ' '), ['the', 'of', 'and', 'a', 'in', 'to', 'for', 'with'])"


def activation_sql(depth: int, tags: str, active: str) -> str:
    c = "least(ln(1 + greatest(maturity, 0)) / ln(1 + 1.023e11 :: DOUBLE), 1)"
    c = f"CASE WHEN attractor > 0 THEN least({c} * (1 + 0.3 :: DOUBLE * least(ln(1 + attractor) / ln(1000001 :: DOUBLE), 1)), 1) ELSE {c} END"
    d = f"CASE WHEN list_contains({active}, edge_type) THEN 1.0 :: DOUBLE ELSE 0.2 :: DOUBLE END * CASE object_domain WHEN 'wikidata' THEN 0.95 :: DOUBLE ELSE 0.30 :: DOUBLE END"
    d = f"CASE WHEN edge_type = 'associative' AND contains({tags}, 'pubmed') THEN least({d}, 0.15 :: DOUBLE) ELSE {d} END"
    foreign = "sem_domain = 'music' AND NOT list_has_any(family, ['creative', 'contextual'])"
    return f"(0.6 :: DOUBLE * CASE WHEN {foreign} THEN ({c}) * 0.05 :: DOUBLE ELSE {c} END + 0.4 :: DOUBLE * CASE WHEN {foreign} THEN least({d}, 0.05 :: DOUBLE) ELSE {d} END) * exp(-0.35 :: DOUBLE * {depth})"


def wave_sql(levels: int, active: str, k: str = "") -> str:
    """CTEs that end in chains{k}(query_id, s, p, o, strength, place). A query leaves the front after the level that brings it to 60 chains or 150 nodes."""
    out = [f"v0{k} AS (SELECT query_id, id AS node FROM asked)", f"f0{k} AS (SELECT * FROM v0{k})"]
    say = lambda x: f"CASE WHEN direction = 'out' THEN {x[0]} ELSE {x[1]} END"
    for i in range(1, levels + 1):
        out.append(f"""m{i}{k} AS MATERIALIZED (SELECT * FROM (SELECT f.query_id, f.node, nb.* EXCLUDE (node), a.theta, a.family, {activation_sql(i, 'domain_tags', active)} AS a FROM f{i - 1}{k} f JOIN nb ON nb.node = f.node JOIN asked a ON a.query_id = f.query_id WHERE (r <= 10 OR (NOT generic AND rs <= 20)) AND {CLEAN} AND NOT EXISTS (SELECT 1 FROM v{i - 1}{k} v WHERE v.query_id = f.query_id AND v.node = nb.other)) WHERE a >= theta)""")
        out.append(f"g{i}{k} AS MATERIALIZED (SELECT query_id, node FROM (SELECT query_id, other AS node, max(a) AS a FROM m{i}{k} GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY a DESC, node) <= 150)")
        out.append(f"v{i}{k} AS MATERIALIZED (SELECT * FROM v{i - 1}{k} UNION SELECT * FROM g{i}{k})")
        met = " UNION ALL ".join(f"SELECT query_id FROM m{j}{k}" for j in range(1, i + 1))
        out.append(f"e{i}{k} AS (SELECT query_id FROM ({met}) GROUP BY 1 HAVING count(*) >= 60 UNION SELECT query_id FROM v{i}{k} GROUP BY 1 HAVING count(*) >= 150), f{i}{k} AS MATERIALIZED (SELECT * FROM g{i}{k} WHERE query_id NOT IN (SELECT query_id FROM e{i}{k}))")
    waves = " UNION ALL ".join(f"SELECT query_id, {say(('w.canonical', 'm.canonical'))} AS s, predicate AS p, {say(('m.canonical', 'w.canonical'))} AS o, CAST(floor(a * 100) AS INTEGER) AS strength, 1 AS later FROM m{i}{k} m JOIN own w ON w.id = node" for i in range(1, levels + 1))
    seed = f"SELECT query_id, {say(('w.canonical', 'm.canonical'))} AS s, predicate AS p, {say(('m.canonical', 'w.canonical'))} AS o, greatest(CAST(floor(a * 100) AS INTEGER), 1) AS strength, 0 AS later FROM (SELECT n.*, theta, {activation_sql(1, chr(39) * 2, active)} AS a FROM near n JOIN asked USING (query_id) WHERE predicate NOT IN ('related_to', 'context_of') AND {CLEAN}) m JOIN own w ON w.id = node WHERE a >= theta * 0.5 :: DOUBLE"
    out.append(f"told{k} AS ({seed} UNION ALL {waves}), one{k} AS (SELECT query_id, s, p, o, min(row(later, -strength)) AS x FROM told{k} GROUP BY 1, 2, 3, 4)")
    out.append(f"chains{k} AS (SELECT query_id, s, p, o, -x[2] AS strength, row_number() OVER (PARTITION BY query_id ORDER BY x[1], x[2], s, p, o) AS place FROM one{k} QUALIFY place <= 15)")
    return ", ".join(out)


OWN = "list_distinct(list_concat(family, ['associative']))"
LEVELS = 5
WAVE = f"{FIELD}, {NB}, {wave_sql(LEVELS, OWN)}"


def chains(spark, d):
    q, e, a = field(spark, d)
    return q, wavefront.infer(q, e, a, levels=LEVELS)


@query("gr01_wavefront", f"WITH {WAVE} SELECT * FROM chains")
def gr01(spark, d):
    return chains(spark, d)[1].withColumn("place", F.col("place").cast("long"))


@query("gr03_calibration", f"WITH {FIELD}, {NB} SELECT query_id, theta, array_to_string(list_sort(family), ',') AS family FROM asked")
def gr03(spark, d):
    """The threshold and the active family of each seed (GR-03, GR-04)."""
    return wavefront.calibrated(*field(spark, d))[0].select("query_id", "theta", F.array_join(F.array_sort("family"), ",").alias("family"))


@query("gr05_two_pass_neighbors", f"WITH {FIELD}, {NB} SELECT query_id, direction, predicate, other FROM near")
def gr05(spark, d):
    return wavefront.calibrated(*field(spark, d))[1].select("query_id", "direction", "predicate", "other")


WEIGHT = "CASE p WHEN 'requires' THEN 1.0 :: DOUBLE WHEN 'causes' THEN 0.95 :: DOUBLE ELSE 0.55 :: DOUBLE END"


def score_sql(source: str) -> str:
    return f"SELECT query_id, 0.4 :: DOUBLE * least(count(*) / 15, 1) + 0.4 :: DOUBLE * avg(strength * {WEIGHT}) / 100 + 0.2 :: DOUBLE * least(count(DISTINCT p) / 10, 1) AS score, round(count(*) FILTER (p IN ('requires', 'causes')) / count(*), 2) AS quality, avg(strength) FILTER (strength > 1) AS mean FROM {source} GROUP BY 1"


@query("gr07_candidate_scores", f"WITH {WAVE}, g AS ({score_sql('chains')}) SELECT query_id, score, CASE WHEN score >= 0.54 THEN 'strong' WHEN score >= 0.34 THEN 'moderate' ELSE 'weak' END AS signal, quality, CASE WHEN mean IS NULL THEN 'memory_only' WHEN mean / 100 < 0.3 THEN 'weak_signal' ELSE 'ok' END AS tag FROM g", rounded="score")
def gr07(spark, d):
    return wavefront.candidate_scores(chains(spark, d)[1])


WIDE = "CASE WHEN list_contains(family, 'causal') THEN ['causal', 'functional', 'mechanistic', 'structural'] ELSE ['associative'] END"
ALL = "[" + ", ".join(f"'{x}'" for x in wavefront.FAMILIES) + "]"


@query("gr06_multipass", f"""WITH {FIELD}, {NB}, {wave_sql(LEVELS, OWN, 'a')}, {wave_sql(LEVELS, WIDE, 'b')}, {wave_sql(LEVELS, ALL, 'c')},
  named AS (SELECT 'A' AS pass_used, c.* FROM chainsa c UNION ALL SELECT 'B', c.* FROM chainsb c UNION ALL SELECT 'C', c.* FROM chainsc c), scored AS (SELECT query_id, pass_used, 0.4 :: DOUBLE * least(count(*) / 15, 1) + 0.4 :: DOUBLE * avg(strength * {WEIGHT}) / 100 + 0.2 :: DOUBLE * least(count(DISTINCT p) / 10, 1) AS score, avg(strength) FILTER (strength > 1) AS mean
    FROM named JOIN queries q USING (query_id) WHERE contains(lower(s || ' | ' || p || ' | ' || o), lower(text)) GROUP BY 1, 2)
  SELECT query_id, pass_used, score, CASE WHEN mean IS NULL THEN 'memory_only' WHEN mean / 100 < 0.3 THEN 'weak_signal' ELSE 'ok' END AS tag FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN score >= 0.5 AND pass_used <> 'C' THEN 0 ELSE 1 - score END, pass_used) = 1""", rounded="score")
def gr06(spark, d):
    return wavefront.multipass(*field(spark, d), levels=LEVELS)


CATEGORISED = f"""{WAVE}, c AS (SELECT query_id, CASE WHEN p = 'causes' THEN 'causes' WHEN p = 'requires' THEN 'requires' ELSE 'other' END AS category, s, p, o, place AS k FROM chains WHERE s <> o),
  cat AS (SELECT query_id, category, s, p, o, row_number() OVER (PARTITION BY query_id, category ORDER BY k, s, p, o) AS place FROM c QUALIFY place <= CASE WHEN category = 'other' THEN 15 ELSE 20 END)"""


@query("gr11_categories", f"WITH {CATEGORISED} SELECT * FROM cat")
def gr11(spark, d):
    return wavefront.categorised(chains(spark, d)[1]).withColumn("place", F.col("place").cast("long"))


@query("gr12_conclusions", f"""WITH {CATEGORISED}, a AS (SELECT query_id, lower(text) AS q, category, o, row_number() OVER (PARTITION BY query_id, category ORDER BY place) AS n FROM cat JOIN queries USING (query_id) WHERE category <> 'other' AND lower(s) = lower(text) AND lower(o) <> lower(text) QUALIFY n <= 4),
  l AS (SELECT query_id, CASE category WHEN 'causes' THEN 'PRODUCES' ELSE 'REQUIRES' END AS kind, q || CASE category WHEN 'causes' THEN ' enables or causes: ' ELSE ' depends on: ' END || string_agg(o, ', ' ORDER BY n) AS conclusion FROM a GROUP BY query_id, q, category)
  SELECT * FROM l UNION ALL SELECT query_id, 'FIELD', lower(text) || ' activates but no strong predicate chains resolved.' FROM queries WHERE query_id NOT IN (SELECT query_id FROM l)""")
def gr12(spark, d):
    q, c = chains(spark, d)
    return wavefront.conclusions(wavefront.categorised(c), q)


@query("ag33_capsules", f"WITH {WAVE} SELECT query_id, CASE WHEN bool_or(p IN ('causes', 'requires')) THEN 'mechanistic_response' WHEN count(*) < 5 THEN 'sparse_response' ELSE 'relational_response' END AS capsule FROM chains GROUP BY 1")
def ag33(spark, d):
    return wavefront.capsule(chains(spark, d)[1])


@query("srt04_wavefront_budget", f"WITH {WAVE} SELECT query_id, node FROM g1")
def srt04(spark, d):
    """The nodes of a level that go on: the best 150 of each query."""
    q, e, a = field(spark, d)
    asked, _ = wavefront.calibrated(q, e, a)
    near = wavefront.neighbors(e, a, q.select(F.col("id").alias("node"))).where((F.col("rank") <= 10) | ~F.col("generic")).join(asked.select("query_id", F.col("id").alias("node"), "theta", "family"), "node")
    active = F.array_union("family", F.array(F.lit("associative")))
    met = near.where(wavefront.clean_name(F.col("canonical")) & (F.col("other") != F.col("node"))).withColumn("a", wavefront.activation(active, F.col("family"), F.lit(1))).where("a >= theta")
    best = met.groupBy("query_id", F.col("other").alias("node")).agg(F.max("a").alias("a"))
    return best.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("a"), "node"))).where("_n <= 150").select("query_id", "node")


@query("set05_seed_wins", f"""WITH {REL}, s AS (SELECT subject_id AS k, object_id AS v, max(confidence) AS c, 0 AS src FROM relations WHERE predicate = 'causes' GROUP BY 1, 2), w AS (SELECT subject_id AS k, object_id AS v, max(confidence) AS c, 1 AS src FROM relations GROUP BY 1, 2),
  u AS (SELECT * FROM s UNION ALL SELECT * FROM w WHERE (k, v) NOT IN (SELECT (k, v) FROM s)) SELECT k, v, src FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY src, c DESC, v) <= 5""")
def set05(spark, d):
    """Seeds, then what else was found, five of each key; a seed wins over the same row of the rest."""
    r = relations(spark, d).groupBy(F.col("subject_id").alias("k"), F.col("object_id").alias("v")).agg(F.max("confidence").alias("c"), F.max(F.when(F.col("predicate") == "causes", F.col("confidence"))).alias("seed"))
    own = r.select("k", "v", F.when(F.col("seed").isNotNull(), 0).otherwise(1).alias("src"), F.coalesce("seed", "c").alias("c"))
    return own.withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy("src", F.desc("c"), "v"))).where("_n <= 5").select("k", "v", "src")


# --- paths of two edges ---
@query("wn04_best_by_first_hop", f"WITH {NAMED} SELECT src, p1, mid, p2, dst FROM (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY src, mid ORDER BY round(score, 9) DESC, dst, p1, p2) = 1) QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, mid) <= 25")
def wn04(spark, d):
    """Of each start, the best path through each first hop, then the best 25."""
    rows = packets.two_hops(named_edges(spark, d)).withColumn("score", F.round("score", 9))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("src", "mid").orderBy(F.desc("score"), "dst", "p1", "p2"))).where("_n = 1")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "mid"))).where("_n <= 25").select("src", "p1", "mid", "p2", "dst")


# --- accounts of causes: for each region, the edges out of its nations ---
ACTS = f"""{NATIONS}, e AS (SELECT r_name AS query_id, a.n_name AS s, CASE n % 4 WHEN 0 THEN 'causes' WHEN 1 THEN 'enables' WHEN 2 THEN 'is_a' ELSE 'requires' END AS p, b.n_name AS o, n / (n + 40.0 :: DOUBLE) AS w FROM nation_edges JOIN nation a ON a.n_nationkey = subject_id JOIN nation b ON b.n_nationkey = object_id JOIN region ON r_regionkey = a.n_regionkey WHERE subject_id <> object_id)"""
TOP = """u AS (SELECT query_id, s AS node, w AS a FROM e UNION ALL SELECT query_id, o, 0.8 :: DOUBLE * w FROM e UNION ALL SELECT query_id, query_id, 1.0 FROM e), m AS (SELECT query_id, node, max(a) AS a FROM u GROUP BY ALL),
  n AS (SELECT query_id, node, a / max(a) OVER (PARTITION BY query_id) AS a FROM m), top_nodes AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, node) AS place FROM n WHERE a >= 0.05 QUALIFY place <= 30),
  j AS (SELECT e.*, x.a AS a_s, y.a AS a_o, x.a * w * y.a AS score FROM e JOIN n x ON e.query_id = x.query_id AND e.s = x.node JOIN n y ON e.query_id = y.query_id AND e.o = y.node),
  top_edges AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s, p, o) AS place FROM j WHERE score >= 0.002 OR w >= 0.3 QUALIFY place <= 60),
  packets AS (SELECT query_id, round(0.7 * best + 0.3 * least(coalesce(n_edges, 0) / 20, 1.0), 3) AS whole FROM (SELECT query_id, count(*) AS n_nodes, avg(a) FILTER (place <= 5) AS best FROM top_nodes GROUP BY 1) LEFT JOIN (SELECT query_id, count(*) AS n_edges FROM top_edges GROUP BY 1) USING (query_id))"""


def acts(spark, d):
    n = table(spark, d, "nation")
    e = nation_edges(spark, d).where("subject_id <> object_id").join(F.broadcast(n.select(F.col("n_nationkey").alias("subject_id"), F.col("n_name").alias("s"), F.col("n_regionkey").alias("r_regionkey"))), "subject_id")
    e = e.join(F.broadcast(n.select(F.col("n_nationkey").alias("object_id"), F.col("n_name").alias("o"))), "object_id").join(F.broadcast(table(spark, d, "region")), "r_regionkey")
    p = F.when(F.col("n") % 4 == 0, "causes").when(F.col("n") % 4 == 1, "enables").when(F.col("n") % 4 == 2, "is_a").otherwise("requires")
    return keep(e.select(F.col("r_name").alias("query_id"), "s", p.alias("p"), "o", (F.col("n") / (F.col("n") + 40.0)).alias("w")))


CAUSE = "CASE p WHEN 'causes' THEN 1.0 :: DOUBLE WHEN 'enables' THEN 0.85 :: DOUBLE ELSE 0.75 :: DOUBLE END"


def beam_sql(a: str, b: str) -> str:
    """CTEs from seeds(query_id, node) to paths(query_id, nodes, ps, length, score) and account(...)."""
    out = ["b0 AS (SELECT query_id, node, [node] AS nodes, [] :: VARCHAR[] AS keys, [] :: VARCHAR[] AS ps, 1.0 :: DOUBLE AS product FROM seeds)"]
    for i in range(1, 5):
        out.append(f"l{i} AS (SELECT b.query_id, {b} AS node, list_append(nodes, {b}) AS nodes, list_append(keys, s || chr(1) || p || chr(1) || o) AS keys, list_append(ps, p) AS ps, product * (w * {CAUSE} * 0.8 :: DOUBLE) AS product FROM b{i - 1} b JOIN causal c ON c.query_id = b.query_id AND c.{a} = b.node WHERE NOT list_contains(nodes, {b}))")
        out.append(f"x{i} AS (SELECT *, {i} AS length, product * exp({-0.3 * i} :: DOUBLE) AS score FROM l{i}), b{i} AS (SELECT query_id, node, nodes, keys, ps, product FROM x{i} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, keys) <= 6)")
    out.append("paths AS (" + " UNION ALL ".join(f"SELECT query_id, nodes, keys, ps, length, score FROM x{i}" for i in range(1, 5)) + ")")
    out.append("top3 AS (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, keys) <= 3), told AS (SELECT query_id, avg(score) AS mean, len(list_intersect(list_distinct(flatten(list(ps))), ['causes', 'leads_to', 'enables', 'produces', 'requires'])) AS filled FROM top3 GROUP BY 1)")
    out.append("story AS (SELECT query_id, nodes AS narrative, count(*) OVER (PARTITION BY query_id) AS n_paths FROM paths QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length DESC, score DESC, keys) = 1)")
    out.append("account AS (SELECT query_id, n_paths, least(filled / 2.5 :: DOUBLE, 1) AS completeness, least(0.7 :: DOUBLE * mean + 0.3 :: DOUBLE * whole, 0.95 :: DOUBLE) AS confidence, narrative FROM told JOIN story USING (query_id) JOIN packets USING (query_id))")
    return ", ".join(out)


CAUSAL = "causal AS (SELECT * FROM top_edges WHERE p IN ('causes', 'enables', 'requires'))"
SEEDS = "seeds AS (SELECT query_id, node FROM top_nodes WHERE node <> query_id AND (query_id, node) IN (SELECT (query_id, {}) FROM causal) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY a DESC, node) = 1)"


@query("cg02_explanations", f"WITH {ACTS}, {TOP}, {CAUSAL}, {SEEDS.format('s')}, {beam_sql('s', 'o')} SELECT query_id, node AS seed, n_paths, completeness, confidence, array_to_string(narrative, ' → ') AS narrative FROM account JOIN seeds USING (query_id)", rounded="confidence")
def cg02(spark, d):
    """Forward causal search with a beam (GR-23)."""
    return paths.explain(acts(spark, d)).withColumn("narrative", F.array_join("narrative", " → "))


@query("cg03_traced_causes", f"""WITH {ACTS}, {TOP}, {CAUSAL}, {SEEDS.format('o')}, {beam_sql('o', 's')}, up AS (SELECT DISTINCT query_id, unnest(nodes)[1:] AS node, unnest(list_concat([0], range(1, len(nodes)))) AS i FROM paths),
  roots AS (SELECT query_id, node, coalesce(a, 0) AS a FROM (SELECT DISTINCT query_id, node FROM up WHERE i > 0) LEFT JOIN (SELECT query_id, node, a FROM top_nodes) USING (query_id, node) WHERE (query_id, node) NOT IN (SELECT (query_id, o) FROM causal)),
  listed AS (SELECT query_id, string_agg(node, ',' ORDER BY a DESC, node) AS roots FROM (SELECT * FROM roots QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY a DESC, node) <= 5) GROUP BY 1)
  SELECT query_id, node AS effect, n_paths, completeness, confidence, array_to_string(list_reverse(narrative), ' → ') AS chain, coalesce(roots, narrative[-1]) AS roots FROM account JOIN seeds USING (query_id) LEFT JOIN listed USING (query_id)""", rounded="confidence")
def cg03(spark, d):
    """Backward causal search with root causes (GR-22)."""
    return paths.trace_cause(acts(spark, d)).withColumn("chain", F.array_join("chain", " → ")).withColumn("roots", F.array_join("roots", ","))


@query("gr24_top_paths", f"""WITH {ACTS}, {TOP}, p0 AS (SELECT query_id, node, [node] AS nodes, [] :: VARCHAR[] AS ps, ln(a) AS score FROM top_nodes WHERE place <= 3), p1 AS (SELECT t.query_id, o AS node, list_append(nodes, o) AS nodes, list_append(ps, p) AS ps, p0.score + ln(w) - 0.2 :: DOUBLE AS score FROM p0 JOIN top_edges t ON t.query_id = p0.query_id AND s = node WHERE NOT list_contains(nodes, o)),
  p2 AS (SELECT t.query_id, o AS node, list_append(nodes, o) AS nodes, list_append(ps, p) AS ps, p1.score + ln(w) - 0.2 :: DOUBLE AS score FROM p1 JOIN top_edges t ON t.query_id = p1.query_id AND s = node WHERE NOT list_contains(nodes, o))
  SELECT query_id, array_to_string(nodes, ' ') AS nodes, score AS log_score, CASE WHEN list_has_any(ps, ['causes', 'enables', 'requires']) THEN 'causal' WHEN list_has_any(ps, ['is_a']) THEN 'definitional' ELSE 'associative' END AS kind, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p.nodes, ps) AS place FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) p QUALIFY place <= 10""", rounded="log_score")
def gr24(spark, d):
    e = acts(spark, d)
    nodes, top = packets.ranked(e)
    seeds = nodes.where("place <= 3").select("query_id", "node", "a")
    found = paths.top_paths(top, seeds, 0.2, ["causes", "enables", "requires"], ["is_a"], depth=2)
    return found.withColumn("nodes", F.array_join("nodes", " ")).withColumn("place", F.col("place").cast("long"))


USE = """greatest(0.30 :: DOUBLE * least(CASE p WHEN 'requires' THEN 0.8 :: DOUBLE ELSE 0.9 :: DOUBLE END, 1) + 0.20 :: DOUBLE * {0} * w + 0.20 :: DOUBLE * a_o * (1 - a_s) * 0.5 :: DOUBLE + 0.10 :: DOUBLE - 0.10 :: DOUBLE * (1 - w) - 0.05 :: DOUBLE * greatest(0, 0.5 :: DOUBLE - whole), 0)"""
FEASIBLE = "CASE p WHEN 'requires' THEN 0.7 :: DOUBLE ELSE 0.8 :: DOUBLE END"


@query("cg07_plans", f"""WITH {ACTS}, {TOP}, steps AS (SELECT * FROM top_edges WHERE p IN ('requires', 'enables')), act AS (SELECT query_id, o AS action, {USE.format(FEASIBLE)} AS utility, 1 AS depth FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY query_id, o ORDER BY place) = 1) JOIN packets USING (query_id)),
  best AS (SELECT * FROM act QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY utility DESC, action) <= 4), more AS (SELECT * FROM steps WHERE (query_id, o) NOT IN (SELECT (query_id, action) FROM act)),
  after AS (SELECT b.query_id, action || ' → ' || o AS action, utility * 0.85 :: DOUBLE * {FEASIBLE} * w AS utility, 2 AS depth FROM best b JOIN more m ON m.query_id = b.query_id AND m.s = b.action QUALIFY row_number() OVER (PARTITION BY b.query_id, b.action ORDER BY place) <= 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY utility DESC, action) AS n FROM (SELECT * FROM act UNION ALL SELECT * FROM after) QUALIFY n <= 8),
  z AS (SELECT query_id, string_agg(action, ',' ORDER BY n) AS actions, least(sum(0.85 :: DOUBLE ** depth * utility), 1) AS plan_score FROM r GROUP BY 1)
  SELECT query_id, actions, plan_score, 0.6 :: DOUBLE * whole + 0.4 :: DOUBLE * plan_score AS confidence FROM z JOIN packets USING (query_id)""", rounded="plan_score confidence")
def cg07(spark, d):
    return paths.plan_next(acts(spark, d)).drop("utilities").withColumn("actions", F.array_join("actions", ","))
