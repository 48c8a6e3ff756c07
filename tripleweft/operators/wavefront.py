"""Activation spreading from many seeds at once, level by level, and what is concluded from the chains it finds.

edges: subject_id, predicate, object_id (unique together), edge_type, domain_tags. anchors: id, canonical, maturity, attractor (0: none), object_domain, sem_domain (null: unknown). queries: query_id, id (the seed), text.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import TAXONOMIC, domain_noise
from ..functions.scores import ALPHA, BETA, LAMBDA, MATURITY_MAX, clean_name, threshold
from ..sources.storage import keep

# Quality of sources, edge types that go together, and bounds of a wavefront.
QUALITY = {
    "wikidata": 0.95, "gene_ontology": 0.90, "biomedical": 0.85, "mathematics": 0.80, "physics": 0.80, "computer_science": 0.78, "statistics": 0.75, "conceptnet": 0.75, "science": 0.70, "linguistics": 0.82,
    "medicine": 0.82, "extracted": 0.30, "inferred": 0.35, "inferred_cross_scored": 0.30, "inferred_2hop_scored": 0.28, "inferred_bridge": 0.25, "": 0.40,
}
QUALITY_ELSE, COOCCUR_CAP, CROSS_DOMAIN = 0.50, 0.15, 0.05
FAMILIES = {
    "causal": ["causal", "functional", "mechanistic"], "functional": ["functional", "causal", "structural", "mechanistic"], "structural": ["structural", "spatial", "property", "taxonomic"],
    "taxonomic": ["taxonomic", "structural", "semantic", "functional", "property"], "mechanistic": ["mechanistic", "causal", "functional"], "spatial": ["spatial", "structural"], "derivational": ["derivational", "semantic"],
    "semantic": ["semantic", "logical", "derivational", "taxonomic"], "logical": ["logical", "semantic"], "cognitive": ["cognitive", "causal"], "contextual": ["contextual", "associative"], "bridge": ["bridge", "contextual"],
    "property": ["property", "structural"], "creative": ["creative", "property"], "comparative": ["comparative", "causal"], "temporal": ["temporal", "causal"], "clinical": ["clinical", "mechanistic", "causal"], "associative": ["associative"],
}
MEANINGS = {
    "science": ["causal", "mechanistic", "structural", "taxonomic", "functional", "logical"], "medicine": ["clinical", "mechanistic", "causal", "functional"], "biology": ["taxonomic", "structural", "mechanistic", "causal", "functional"],
    "chemistry": ["mechanistic", "structural", "causal", "property"], "physics": ["causal", "mechanistic", "spatial", "structural"], "mathematics": ["logical", "derivational", "semantic"],
    "computer_science": ["logical", "structural", "functional", "causal"], "engineering": ["structural", "functional", "causal", "mechanistic"], "economics": ["causal", "functional", "contextual"], "sociology": ["cognitive", "causal", "contextual"],
    "psychology": ["cognitive", "causal", "functional"], "philosophy": ["logical", "cognitive", "semantic"], "linguistics": ["semantic", "derivational", "logical"], "history": ["temporal", "contextual", "causal"],
    "geography": ["spatial", "structural", "contextual"], "music": ["creative", "contextual"], "art": ["creative", "contextual"],
}
PER_NODE, MOST_VISITED, HUB = 20, 150, 100_000
FEW_NODES = 100_000  # so many names of nodes may be broadcast (some 10 MB)
GENERIC, UNTOLD = ["related_to", "co_occurs_with"], ["related_to", "context_of"]
# How much a predicate tells, and the bounds of a candidate's signal and tag.
TELLS = {"requires": 1.0, "enables": 1.0, "causes": 0.95, "is_a": 0.9, "produces": 0.85, "affects": 0.8, "binds_to": 0.75, "contains": 0.55, "contain": 0.35, "context_of": 0.45, "manner_of": 0.4, "associative": 0.3}
TELLS_ELSE, GOOD_ENOUGH, STRONG, MODERATE, WEAK_MEAN = 0.55, 0.5, 0.54, 0.34, 0.3
# Predicates of each category of a conclusion with how many it holds, and words about words.
CATEGORIES = {
    "taxonomy": (TAXONOMIC, 20), "causes": (["causes", "leads_to", "activates", "produces", "enables", "transforms", "can_cause", "indirectly_produces", "has_subevent", "affects", "used_for"], 20),
    "requires": (["contains", "depends_on", "requires", "consumes", "uses"], 20), "inhibits": (["inhibits", "regulates", "incompatible_with", "fails_on"], 15),
}
# Predicates that call for an account of how, or of what.
MECHANISTIC = ["causes", "enables", "produces", "requires", "regulates", "inhibits", "activates", "uses", "used_by", "used_for", "prevents", "triggers"]
DEFINITIONAL = ["is_a", "also_known_as", "defined_as", "subtype_of", "instance_of", "contains", "part_of", "composed_of", "component_of"]
OTHERS_HELD = 15
LEXICAL = [
    "german", "french", "latin", "english", "spanish", "dutch", "greek", "word", "noun", "verb", "adjective", "adverb", "preposition", "article",
    "phrase", "term", "expression", "syllable", "morpheme", "letter", "plural", "singular", "tense", "etymology",
]


def lookup(table: dict, key: Column, rest) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.array(*[F.lit(v) for v in x]) if isinstance(x, list) else F.lit(x) for pair in table.items() for x in pair]), key), rest)


def activation(active: Column, gate: Column, depth) -> Column:
    """A(n) of a row with maturity, attractor, object_domain, sem_domain, edge_type, domain_tags: (0.6 C + 0.4 D) e^(-0.35 depth)."""
    c = F.least(F.log1p(F.greatest(F.coalesce("maturity", F.lit(0.0)), F.lit(0.0))) / F.log1p(F.lit(MATURITY_MAX)), F.lit(1.0))
    c = F.when(F.col("attractor") > 0, F.least(c * (1 + 0.3 * F.least(F.log1p("attractor") / F.log1p(F.lit(1e6)), F.lit(1.0))), F.lit(1.0))).otherwise(c)
    kind = F.coalesce("edge_type", F.lit("associative"))
    d = F.when(F.array_contains(active, kind), 1.0).otherwise(0.2) * lookup(QUALITY, F.coalesce("object_domain", F.lit("")), F.lit(QUALITY_ELSE))
    d = F.when((kind == "associative") & F.coalesce("domain_tags", F.lit("")).contains("pubmed"), F.least(d, F.lit(COOCCUR_CAP))).otherwise(d)
    means = F.try_element_at(F.create_map(*[x for k, v in MEANINGS.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))]), F.lower("sem_domain"))
    foreign = means.isNotNull() & ~F.arrays_overlap(means, gate)
    c, d = F.when(foreign, c * CROSS_DOMAIN).otherwise(c), F.when(foreign, F.least(d, F.lit(CROSS_DOMAIN))).otherwise(d)
    return (ALPHA * c + BETA * d) * F.exp(-LAMBDA * depth)


def _touching(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """node, direction, other, predicate, edge_type, domain_tags of the edges at nodes(node) (None: at all), both ways; where these are few, other edges are dropped where they lie."""
    side = lambda a, b, way: edges.select(F.col(a).alias("node"), F.col(b).alias("other"), "predicate", "edge_type", "domain_tags", F.lit(way).alias("direction"))
    both = side("subject_id", "object_id", "out").union(side("object_id", "subject_id", "in"))
    if nodes is None:
        return both
    at = nodes.select("node").distinct()
    few = at.limit(FEW_NODES + 1).count() <= FEW_NODES
    return keep(both.join(F.broadcast(at) if few else at, "node", "left_semi"))


def neighbors(edges: DataFrame, anchors: DataFrame, nodes: DataFrame | None = None, most: int = PER_NODE, touching: DataFrame | None = None) -> DataFrame:
    """node, direction, predicate, other, rank and the other's columns, written once: for each node (or each of nodes(node)) and each direction, the `most` neighbours of greatest maturity, and the `most` with a telling predicate. touching: the edges at these nodes, if they are known.

    rank is the place by maturity, null beyond `most`; a neighbour that is not generic is always among the `most` telling ones if its rank is not null. The two lists are cut by row_number in plans of their
    own, so that Spark cuts them before the shuffle as well, and a hub sends `most` rows from each task.
    """
    both = touching if touching is not None else _touching(edges, nodes)
    rows = keep(both.join(anchors.where(F.length("canonical") < 40).withColumnRenamed("id", "other"), "other").withColumn("generic", F.col("predicate").isin(GENERIC)))
    w = Window.partitionBy("node", "direction").orderBy(F.desc("maturity"), "other", "predicate")
    cut = lambda df, n: df.withColumn(n, F.row_number().over(w)).where(F.col(n) <= most)
    first = cut(rows, "rank")
    telling = cut(rows.where(~F.col("generic")), "_s").drop("_s")
    key = ["node", "direction", "other", "predicate"]
    rest = telling.join(first.select(*key), key, "left_anti").withColumn("rank", F.lit(None).cast("int"))
    return keep(first.unionByName(rest))


def calibrated(queries: DataFrame, edges: DataFrame, anchors: DataFrame, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(queries with theta, family; the seeds' neighbours): the threshold by words and edge types, and the family of the commonest telling edge type about the seed (ties: the least name). near: the lists of `neighbors`, if there are any yet."""
    seeds = queries.select("query_id", F.col("id").alias("node"))
    near = keep(seeds.join(near if near is not None else neighbors(edges, anchors, seeds), "node").drop("rank", "generic"))
    types = near.where("edge_type IS NOT NULL").groupBy("query_id", "edge_type").agg(F.count("*").alias("n"))
    sums = types.groupBy("query_id").agg(F.count("*").alias("types"), F.min(F.when(F.col("edge_type") != "associative", F.struct(-F.col("n"), "edge_type")))["edge_type"].alias("primary"))
    family = lookup(FAMILIES, F.coalesce("primary", F.lit("associative")), F.array(F.lit("associative")))
    words = F.size(F.split(F.trim(F.replace(F.col("text"), F.lit("_"), F.lit(" "))), "\\s+"))
    out = queries.join(sums, "query_id", "left").withColumn("theta", threshold(words, F.coalesce("types", F.lit(0)))).withColumn("family", family)
    return out.drop("types"), near


def _chain(direction: str = "direction"):
    way = F.col(direction) == "out"
    return [F.when(way, F.col("from_name")).otherwise(F.col("canonical")).alias("s"), F.col("predicate").alias("p"), F.when(way, F.col("canonical")).otherwise(F.col("from_name")).alias("o")]


def waves(asked: DataFrame, near: DataFrame | None, edges: DataFrame, anchors: DataFrame, levels: int, most: int) -> DataFrame:
    """query_id, s, p, o, strength of every chain that the wavefront of each of asked(query_id, id, theta, active, family) meets. near: the lists of `neighbors`, if there are any yet.

    All queries go level by level in one plan. A query stops after a level that brings its chains to 4 * most or its visited nodes to MOST_VISITED, so deep levels are of the queries that still look for something.
    Neighbours and degrees are looked up for the nodes of a level only, so a level reads the edges once and shuffles those at its nodes.
    """
    clean = clean_name(F.col("canonical"))
    state = asked.select("query_id", "theta", "active", "family")
    names = anchors.select(F.col("id").alias("node"), F.col("canonical").alias("from_name"))
    front = asked.select("query_id", F.col("id").alias("node"))
    visited, spent, found = front, None, None
    for depth in range(1, levels + 1):
        touching = _touching(edges, front)
        goes_on = front
        if depth > 1:
            goes_on = front.join(touching.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("node"), "node", "left_anti")
        lists = near if near is not None else neighbors(edges, anchors, front, touching=touching)
        lists = lists.where((F.col("rank") <= PER_NODE // 2) | ~F.col("generic")).where(clean)
        met = goes_on.join(lists, "node").join(visited.withColumnRenamed("node", "other"), ["query_id", "other"], "left_anti").join(state, "query_id")
        met = keep(met.withColumn("a", activation(F.col("active"), F.col("family"), F.lit(depth))).where("a >= theta").join(names, "node"))
        own = met.select("query_id", *_chain(), F.floor(F.col("a") * 100).cast("int").alias("strength"))
        found = own if found is None else found.unionByName(own)
        best = met.groupBy("query_id", F.col("other").alias("node")).agg(F.max("a").alias("a"))
        best = keep(best.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("a"), "node"))).where(F.col("_n") <= MOST_VISITED).select("query_id", "node"))
        if depth == levels or best.isEmpty():
            break
        visited = visited.union(best)
        now = met.groupBy("query_id").agg(F.count("*").alias("chains"), F.lit(0).alias("nodes")).union(best.groupBy("query_id").agg(F.lit(0), F.count("*")))
        spent = keep((now if spent is None else now.union(spent)).groupBy("query_id").agg(F.sum("chains").alias("chains"), F.sum("nodes").alias("nodes")))
        front = keep(best.join(spent.where((F.col("chains") < 4 * most) & (F.col("nodes") + 1 < MOST_VISITED)), "query_id", "left_semi"))
        if front.isEmpty():
            break
    return found


def chosen(asked: DataFrame, seeds: DataFrame, found: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """query_id, s, p, o, strength, place: of each query the `most` best chains, the seed's own telling edges first, then what the wavefront found."""
    names = anchors.select(F.col("id").alias("node"), F.col("canonical").alias("from_name"))
    seed = seeds.where(~F.col("predicate").isin(UNTOLD) & clean_name(F.col("canonical"))).join(asked.select("query_id", "theta", "active", "family"), "query_id").withColumn("domain_tags", F.lit(""))
    seed = seed.withColumn("a", activation(F.col("active"), F.col("family"), F.lit(1))).where("a >= theta * 0.5").join(names, "node")
    seed = seed.select("query_id", *_chain(), F.greatest(F.floor(F.col("a") * 100).cast("int"), F.lit(1)).alias("strength"))
    both = seed.withColumn("later", F.lit(0)).unionByName(found.withColumn("later", F.lit(1))).groupBy("query_id", "s", "p", "o").agg(F.min(F.struct("later", -F.col("strength"))).alias("x"))
    both = both.select("query_id", "s", "p", "o", "x.later", (-F.col("x.col2")).alias("strength"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("later", F.desc("strength"), "s", "p", "o"))
    return both.withColumn("place", place).where(F.col("place") <= most).drop("later")


def infer(queries: DataFrame, edges: DataFrame, anchors: DataFrame, levels: int = 5, most: int = 15) -> DataFrame:
    """query_id, s, p, o (names), strength, place of the `most` best chains of each query: the seed's own telling edges first, then what the wavefront met.

    A wave goes from each node to its neighbours that are clean, not met before and activated beyond the query's threshold; of each level the best MOST_VISITED nodes of a query go on, hubs don't, and queries that have met enough stop.
    """
    asked, seeds = calibrated(queries, edges, anchors)
    asked = keep(asked.withColumn("active", F.array_union("family", F.array(F.lit("associative")))))
    return chosen(asked, seeds, waves(asked, None, edges, anchors, levels, most), anchors, most)


def candidate_scores(chains: DataFrame) -> DataFrame:
    """query_id, score, signal, quality, tag of each query's chains: 0.4 of their number (of 15), 0.4 of the mean strength weighed by predicate, 0.2 of the predicates (of 10)."""
    weight = lookup(TELLS, F.col("p"), F.lit(TELLS_ELSE))
    one = F.lit(1.0)
    score = 0.4 * F.least(F.count("*") / 15, one) + 0.4 * F.avg(F.col("strength") * weight) / 100 + 0.2 * F.least(F.count_distinct("p") / 10, one)
    strong = F.when(F.col("strength") > 1, F.col("strength"))
    g = chains.groupBy("query_id").agg(score.alias("score"), F.round(F.avg(F.col("p").isin(*TELLS).cast("int")), 2).alias("quality"), F.avg(strong).alias("mean"))
    tag = F.when(F.col("mean").isNull(), "memory_only").when(F.col("mean") / 100 < WEAK_MEAN, "weak_signal").otherwise("ok")
    return g.select("query_id", "score", F.when(F.col("score") >= STRONG, "strong").when(F.col("score") >= MODERATE, "moderate").otherwise("weak").alias("signal"), "quality", tag.alias("tag"))


def multipass(queries: DataFrame, edges: DataFrame, anchors: DataFrame, levels: int = 5, most: int = 15) -> DataFrame:
    """query_id, pass_used, score, tag: of three passes (own domain; with its neighbours; all edge types) over chains that name the query, the first with a score of 0.5 or more, else the best (ties: the earlier). Queries without a chain are left out.

    The three passes of all queries are one wavefront: each pass is a query of its own.
    """
    asked, seeds = calibrated(queries, edges, anchors)
    primary = F.coalesce("primary", F.lit("associative"))
    wide = {k: sorted({*v, *(x for e in v for x in FAMILIES.get(e, []))}) for k, v in FAMILIES.items()}
    active = {"A": F.array_union("family", F.array(F.lit("associative"))), "B": lookup(wide, primary, F.array(F.lit("associative"))), "C": F.array(*[F.lit(x) for x in FAMILIES])}
    passes = F.explode(F.array(*[F.struct(F.lit(k).alias("pass_used"), v.alias("active")) for k, v in active.items()]))
    each = lambda df: df.withColumn("query_id", F.struct("query_id", "_pass.pass_used"))
    asked = keep(each(asked.withColumn("_pass", passes)).withColumn("active", F.col("_pass.active")).drop("_pass"))
    seeds = seeds.join(asked.select(F.col("query_id").alias("_p"), F.col("query_id.query_id").alias("query_id")), "query_id").drop("query_id").withColumnRenamed("_p", "query_id")
    c = chosen(asked, seeds, waves(asked, None, edges, anchors, levels, most), anchors, most).join(asked.select("query_id", F.lower("text").alias("_q")), "query_id")
    scored = candidate_scores(c.where(F.lower(F.concat_ws(" | ", "s", "p", "o")).contains(F.col("_q")))).select("query_id.*", "score", "tag")
    enough = F.when((F.col("score") >= GOOD_ENOUGH) & (F.col("pass_used") != "C"), F.struct(F.lit(0.0).alias("k"), "pass_used")).otherwise(F.struct((1 - F.col("score")).alias("k"), "pass_used"))
    return scored.groupBy("query_id").agg(F.min_by(F.struct("pass_used", "score", "tag"), enough).alias("x")).select("query_id", "x.*")


def categorised(chains: DataFrame) -> DataFrame:
    """query_id, category, s, p, o, place of chains(query_id, s, p, o, place), without loops, noise across families and words about words; each category holds its first 20 (15) only."""
    p = F.col("p")
    kind = F.when(p.isin(CATEGORIES["taxonomy"][0]), "taxonomy")
    held = F.when(F.col("category").isin("inhibits", "other"), OTHERS_HELD).otherwise(20)
    for name in ("causes", "requires", "inhibits"):
        kind = kind.when(p.isin(CATEGORIES[name][0]), name)
    rows = chains.where((F.col("s") != F.col("o")) & ~domain_noise(F.col("s"), p, F.col("o")) & ~(p.isin(TAXONOMIC) & F.lower("o").isin(LEXICAL))).withColumn("category", kind.otherwise("other"))
    first = rows.groupBy("query_id", "category", "s", "p", "o").agg(F.min("place").alias("_first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "category").orderBy("_first", "s", "p", "o"))).where(F.col("place") <= held).drop("_first")


def conclusions(categories: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, kind, conclusion: what each query is, requires, produces and constrains, by its first 5, 4, 4 and 3 objects; what it encompasses if it is classified as nothing; FIELD if nothing is concluded."""
    q = F.lower("text")
    rows = categories.join(queries.select("query_id", q.alias("q")), "query_id")
    ahead = (F.lower("s") == F.col("q")) & (F.lower("o") != F.col("q"))
    behind = (F.col("category") == "taxonomy") & (F.lower("o") == F.col("q"))
    rows = rows.withColumn("way", F.when(ahead, "ahead").when(behind, "behind")).where("way IS NOT NULL AND category <> 'other'")
    most = F.when(F.col("category") == "taxonomy", 5).when(F.col("category") == "inhibits", 3).otherwise(4)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "category", "way").orderBy("place"))).where(F.col("_n") <= most)
    told = F.when(F.col("way") == "ahead", F.col("o")).otherwise(F.col("s"))
    listed = rows.groupBy("query_id", "q", "category", "way").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", told.alias("t")))), lambda x: x["t"]), ", ").alias("list"))
    known = listed.where("category = 'taxonomy' AND way = 'ahead'").select("query_id")
    listed = listed.where("way = 'ahead'").unionByName(listed.where("way = 'behind'").join(known, "query_id", "left_anti"))
    say = {"taxonomy": ("IDENTITY", "%s is classified as: %s"), "requires": ("REQUIRES", "%s depends on: %s"), "causes": ("PRODUCES", "%s enables or causes: %s"), "inhibits": ("CONSTRAINS", "%s inhibits or regulates: %s")}
    behind_ = F.col("way") == "behind"
    kind, text = F.when(behind_, "CATEGORY"), F.when(behind_, F.format_string("%s encompasses: %s", "q", "list"))
    for c, (k, form) in say.items():
        kind, text = kind.when(F.col("category") == c, k), text.when(F.col("category") == c, F.format_string(form, "q", "list"))
    out = listed.select("query_id", kind.alias("kind"), text.alias("conclusion"))
    rest = queries.join(out.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit("FIELD").alias("kind"), F.concat(q, F.lit(" activates but no strong predicate chains resolved.")).alias("conclusion"))
    return out.unionByName(rest)


def capsule(chains: DataFrame, mechanistic: list[str] = MECHANISTIC, definitional: list[str] = DEFINITIONAL) -> DataFrame:
    """query_id, capsule: how to answer, by the predicates of its chains; under five chains, sparsely."""
    has = lambda own: F.bool_or(F.col("p").isin(own))
    g = chains.groupBy("query_id").agg(has(mechanistic).alias("m"), has(definitional).alias("d"), F.count("*").alias("n"))
    return g.select("query_id", F.when(F.col("m"), "mechanistic_response").when(F.col("d"), "definitional_response").when(F.col("n") < 5, "sparse_response").otherwise("relational_response").alias("capsule"))
