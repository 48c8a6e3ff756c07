"""Packets: the nodes and edges that count for each of many queries at once, and what is read off them.

edges: query_id, s, p, o, w (0 to 1). Queries of few edges are shuffled once; of others, ranks are cut at a fixed k, which Spark applies before the shuffle too, so a query with very many edges isn't gathered.
Where edges are made of rows that may repeat them, `merged` deals these rows by query, and edges, nodes and ranks are made of that one shuffle.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import noisy_or
from ..sources.storage import keep

# Bounds of a packet, weights of the confidence, slots of a definition with the weight of each predicate.
NODE_FLOOR, TOP_NODES, EDGE_FLOOR, SURE, TOP_EDGES, DECAY, TRUST = 0.05, 30, 0.002, 0.3, 60, 0.8, 0.7
MANY = 10_000  # so many edges of a query may meet in one task
PER_TASK = 100_000  # edges of small queries that a task ranks, whatever the size of the table
EVIDENCE, COVERAGE, COHERENCE, TRUST_MEAN, CONTRADICTION, EXTRAPOLATION, MISSING = 0.25, 0.20, 0.20, 0.15, 0.10, 0.05, 0.05
SLOTS = {
    "genus": {"is_a": 1.0, "type_of": 0.9, "subtype_of": 0.85, "instance_of": 0.8, "classified_as": 0.75},
    "function": {"used_for": 1.0, "enables": 0.9, "produces": 0.85, "has_function": 0.9, "performs": 0.85},
    "properties": {"has_property": 1.0, "characterized_by": 0.9, "defined_as": 0.95, "also_known_as": 0.7, "composed_of": 0.8, "contains": 0.75},
    "relations": {"part_of": 0.9, "related_to": 0.6, "associated_with": 0.55, "contrasts_with": 0.8, "similar_to": 0.7, "requires": 0.85, "depends_on": 0.8},
}


def _best(df: DataFrame, k: int, group: list, *order) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def _small(edges: DataFrame, tasks: int | None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of queries of at most MANY edges: shuffled once, by query (tasks None: they lie so already); windows and groups of a query's nodes and edges need no other shuffle."""
    end = lambda side, node, a: F.struct(F.lit(side).alias("side"), F.col(node).alias("node"), a.alias("a"))
    ends = F.inline(F.array(end(0, "s", F.col("w")), end(1, "o", DECAY * F.col("w")), end(2, "query_id", F.lit(1.0))))
    rows = edges.select("query_id", "s", "p", "o", "w")
    rows = (rows.repartition(tasks, "query_id") if tasks else rows).select("query_id", "s", "p", "o", "w", ends)
    whole = Window.partitionBy("query_id")
    nodes = rows.groupBy("query_id", "node").agg(F.max("a").alias("a")).withColumn("a", F.col("a") / F.max("a").over(whole))
    act = F.max("a").over(Window.partitionBy("query_id", "node")) / F.max("a").over(whole)
    named = F.col("query_id").isNotNull() & F.col("s").isNotNull() & F.col("o").isNotNull()  # no filter, which Spark would move before the shuffle of `merged`, so that nodes and edges couldn't share it
    of = lambda side: F.max(F.when((F.col("side") == side) & named, F.col("act")))
    top = rows.withColumn("act", act).where("side < 2").groupBy("query_id", "s", "p", "o", "w").agg(of(0).alias("a_s"), of(1).alias("a_o"))
    top = top.withColumn("score", F.col("a_s") * F.col("w") * F.col("a_o")).where((F.col("score") >= EDGE_FLOOR) | (F.col("score").isNotNull() & (F.col("w") >= SURE)))
    top = _best(top.select("query_id", "s", "o", "p", "w", "a_s", "a_o", "score"), TOP_EDGES, ["query_id"], F.desc("score"), "s", "p", "o")
    return _best(nodes.where(F.col("a") >= NODE_FLOOR), TOP_NODES, ["query_id"], F.desc("a"), "node"), top


def _large(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of queries of more than MANY edges, of which none is gathered.

    An edge's score lies between those that its own weight alone and the query's greatest activation would give its ends, so an edge whose upper bound is below the TOP_EDGES-th greatest lower bound isn't joined with its ends.
    """
    edges = keep(edges)
    own = edges.groupBy("query_id").agg(F.max("w").alias("peak"))
    own = keep(own.withColumn("most", F.greatest("peak", F.lit(1.0))))  # at most a row for each MANY edges
    known = edges.where("w >= 0").join(F.broadcast(own), "query_id")
    low = known.withColumn("low", F.col("w") / F.col("most") * F.col("w") * (DECAY * F.col("w") / F.col("most"))).where((F.col("low") >= EDGE_FLOOR) | (F.col("w") >= SURE))
    least = _best(low.select("query_id", "low"), TOP_EDGES, ["query_id"], F.desc("low")).groupBy("query_id").agg(F.min("low").alias("least"), F.count("*").alias("_k")).where(F.col("_k") == TOP_EDGES)
    bound = keep(own.join(least.select("query_id", "least"), "query_id", "left"))
    end = lambda c: F.when(F.col(c) == F.col("query_id"), F.greatest("peak", F.lit(1.0))).otherwise(F.col("peak")) / F.col("most")
    high = end("s") * F.col("w") * end("o")
    rows = edges.join(F.broadcast(bound), "query_id").where(F.col("least").isNull() | F.col("w").isNull() | (F.col("w") < 0) | (high >= F.col("least"))).select(*edges.columns)
    seen = edges.select("query_id", F.explode(F.array(F.struct(F.col("s").alias("node"), F.col("w").alias("a")), F.struct(F.col("o").alias("node"), (DECAY * F.col("w")).alias("a")))).alias("x")).select("query_id", "x.node", "x.a")
    act = seen.unionByName(own.select("query_id", F.col("query_id").alias("node"), F.lit(1.0).alias("a"))).groupBy("query_id", "node").agg(F.max("a").alias("a"))
    act = keep(act.join(F.broadcast(own.select(F.col("query_id").alias("_q"), "most")), F.col("query_id").eqNullSafe(F.col("_q"))).select("query_id", "node", (F.col("a") / F.col("most")).alias("a")))
    nodes = keep(_best(act.where(F.col("a") >= NODE_FLOOR), TOP_NODES, ["query_id"], F.desc("a"), "node"))
    rows = rows.join(act.select("query_id", F.col("node").alias("s"), F.col("a").alias("a_s")), ["query_id", "s"])
    rows = rows.join(act.select("query_id", F.col("node").alias("o"), F.col("a").alias("a_o")), ["query_id", "o"])
    rows = rows.withColumn("score", F.col("a_s") * F.col("w") * F.col("a_o")).where((F.col("score") >= EDGE_FLOOR) | (F.col("w") >= SURE))
    return nodes, keep(_best(rows.select("query_id", "s", "o", "p", "w", "a_s", "a_o", "score"), TOP_EDGES, ["query_id"], F.desc("score"), "s", "p", "o"))


def ranked(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(top_nodes, top_edges) of edges, for functions that need both: queries are counted once, small ones are shuffled whole, large ones go by joins."""
    sizes = edges.groupBy("query_id").agg(F.count("*").alias("_n"))
    least, most, total = sizes.agg(F.min("_n"), F.max("_n"), F.sum("_n")).first()
    tasks = (total or 0) // PER_TASK + 1
    if most is None or most <= MANY:
        return _small(edges, tasks)
    if least > MANY:
        return _large(edges)
    large = keep(sizes.where(F.col("_n") > MANY).select(F.col("query_id").alias("_q")))
    same = F.col("query_id").eqNullSafe(F.col("_q"))
    of = [_small(edges.join(F.broadcast(large), same, "left_anti"), tasks), _large(edges.join(F.broadcast(large), same, "left_semi"))]
    return tuple(a.unionByName(b) for a, b in zip(*of))


def merged(rows: DataFrame) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """(edges, what `ranked` says of them) of rows(query_id, s, p, o, w): rows of one edge are one, with their greatest weight.

    Where no query has more than MANY rows, these are dealt by query before edges are made of them; all that is made of the edges groups by more than the query and needs each row, so Spark shuffles the rows once for all uses in a plan.
    """
    most, total = rows.groupBy("query_id").agg(F.count("*").alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    few = (most or 0) <= MANY
    rows = rows.repartition((total or 0) // PER_TASK + 1, "query_id") if few else rows
    edges = rows.groupBy("query_id", "s", "p", "o").agg(F.max("w").alias("w"))
    return edges, _small(edges, None) if few else ranked(edges)


def top_nodes(edges: DataFrame) -> DataFrame:
    """query_id, node, a, place of each query's best nodes: subjects take their greatest weight, objects 0.8 of it, the query itself 1; divided by the query's greatest."""
    return ranked(edges)[0]


def top_edges(edges: DataFrame) -> DataFrame:
    """Edges with a_s, a_o, score (a_s w a_o) and place, the best first."""
    return ranked(edges)[1]


def packets(edges: DataFrame, parts: tuple | None = None) -> DataFrame:
    """query_id, n_nodes, n_edges, confidence: 0.7 of the five best nodes' mean and 0.3 of the edges' share of twenty. parts: what `ranked` says of the edges, if that is known."""
    best, top = parts or ranked(edges)
    # counted together and not joined: a join drops null queries on one side, and then the two sides don't share a shuffle
    rows = best.select("query_id", F.lit(1).alias("_node"), F.lit(0).alias("_edge"), F.when(F.col("place") <= 5, F.col("a")).alias("a")).unionByName(top.select("query_id", F.lit(0).alias("_node"), F.lit(1).alias("_edge"), F.lit(None).cast("double").alias("a")))
    sums = rows.groupBy("query_id").agg(F.sum("_node").alias("n_nodes"), F.sum("_edge").alias("n_edges"), F.avg("a").alias("best")).where("n_nodes > 0")
    return sums.select("query_id", "n_nodes", "n_edges", F.round(0.7 * F.col("best") + 0.3 * F.least(F.col("n_edges") / 20, F.lit(1.0)), 3).alias("confidence"))


def definitions(edges: DataFrame, parts: tuple | None = None) -> DataFrame:
    """query_id, genus, functions (three at most), completeness, confidence: the best edge of each slot, its subject's activation times the predicate's weight times its own."""
    parts = parts or ranked(edges)
    table = F.create_map(*[F.lit(x) for slot, own in SLOTS.items() for p, weight in own.items() for x in (p, f"{slot} {weight}")])
    rows = parts[1].withColumn("slot", F.try_element_at(table, F.col("p"))).where("slot IS NOT NULL")
    rows = rows.select("query_id", F.split("slot", " ")[0].alias("slot"), "o", (F.col("a_s") * F.split("slot", " ")[1].cast("double") * F.col("w")).alias("hit"))
    rows = _best(rows, 3, ["query_id", "slot"], F.desc("hit"), "o")
    first = F.col("place") == 1
    found = rows.groupBy("query_id").agg(
        F.max(F.when(first & (F.col("slot") == "genus"), F.col("o"))).alias("genus"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("slot") == "function", F.struct("place", "o")))), lambda x: x["o"]), ",").alias("functions"),
        (F.count_if(first) / len(SLOTS)).alias("completeness"), F.avg(F.when(first & (F.col("hit") > 0), F.col("hit"))).alias("mean"))
    rest = 0.5 * F.col("p.confidence")
    return packets(edges, parts).alias("p").join(found.alias("f"), "query_id", "left").select(
        "query_id", "genus", F.coalesce("functions", F.lit("")).alias("functions"), F.coalesce("completeness", F.lit(0.0)).alias("completeness"), F.round(F.when(F.col("mean").isNull(), rest).otherwise(F.least("mean", F.lit(1.0))), 9).alias("confidence"))


def confidence(edges: DataFrame, contradicting: list[str], parts: tuple | None = None) -> DataFrame:
    """query_id, confidence: a sigmoid of weighted evidence (noisy or over the best twenty edges), coverage, coherence, trust, contradiction and gaps; no paths are followed, so extrapolation is 0."""
    nodes, e = parts or ranked(edges)
    near = nodes.where("place <= 15").select("query_id", "node")
    e = e.join(near.select("query_id", F.col("node").alias("s"), F.lit(1).alias("_s")), ["query_id", "s"], "left").join(near.select("query_id", F.col("node").alias("o"), F.lit(1).alias("_o")), ["query_id", "o"], "left")
    pair = F.when((F.col("place") <= 30) & F.col("_s").isNotNull() & F.col("_o").isNotNull(), F.col("a_s") * F.col("a_o"))
    sums = e.groupBy("query_id").agg(
        noisy_or(F.when(F.col("place") <= 20, TRUST * F.col("w"))).alias("evidence"), (F.sum(pair * F.col("w")) / F.nullif(F.sum(pair), F.lit(0.0))).alias("coherence"),
        F.avg(F.when(F.col("place") <= 10, F.col("w"))).alias("trust"), F.max(F.when(F.col("p").isin(contradicting), F.col("w"))).alias("against"))
    all_ = nodes.groupBy("query_id").agg(F.least(F.count("*") / 10, F.lit(1.0)).alias("coverage")).join(sums, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    logit = EVIDENCE * zero("evidence") + COVERAGE * F.col("coverage") + COHERENCE * F.least(F.coalesce("coherence", F.lit(0.5)), F.lit(1.0)) + TRUST_MEAN * zero("trust") - CONTRADICTION * zero("against") - MISSING * 0.5 * (1 - F.col("coverage"))
    return all_.select("query_id", F.round(1 / (1 + F.exp(-(4 * logit - 2))), 3).alias("confidence"))


# How much a hop along a predicate is trusted (others: 0.65), and which are causal or taxonomic in a conclusion.
HOP = {"is_a": 1.0, "part_of": 1.0, "derived_from": 0.95, "facet_of": 0.95, "causes": 0.9, "enables": 0.9, "produces": 0.9, "leads_to": 0.85, "contains": 0.85, "requires": 0.85, "depends_on": 0.85, "used_for": 0.8, "uses": 0.8, "has_subevent": 0.75, "activates": 0.8, "can_cause": 0.55}


def specificity(name: Column) -> Column:
    n = F.size(F.split(F.trim(name), "\\s+"))
    return F.when(n >= 3, 0.9).when(n == 2, 0.7).when(F.length(name) <= 4, 0.3).otherwise(0.42)


def hop_score(predicate: Column, to: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in HOP.items() for x in pair])
    return F.coalesce(F.try_element_at(known, predicate), F.lit(0.65)) * specificity(to)


def two_hops(edges: DataFrame) -> DataFrame:
    """src, p1, mid, p2, dst, score of the paths of two different edges(s, p, o) that don't return; joined by the middle node."""
    a, b = edges.select(F.col("s").alias("src"), F.col("p").alias("p1"), F.col("o").alias("mid")), edges.select(F.col("s").alias("mid"), F.col("p").alias("p2"), F.col("o").alias("dst"))
    rows = a.join(b, "mid").where("src <> mid AND src <> dst AND mid <> dst")
    return rows.select("src", "p1", "mid", "p2", "dst", (hop_score(F.col("p1"), F.col("mid")) * hop_score(F.col("p2"), F.col("dst"))).alias("score"))


def name_verdicts(names: DataFrame, high: int = 50, most_words: int = 5) -> DataFrame:
    """id, cls, target of names(id, name, n) that look malformed: MERGE into the cleaned name, DELETE a fragment, REVIEW what has many relations. Any one character and a space at the start count as an artefact."""
    # Words that start a fragment, endings that are well formed.
    starters = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "among", "only", "your", "its", "their", "this", "that", "these", "those"]
    name = F.col("name")
    odd = name.rlike("^. ") | (name != F.trim(name)) | (name.endswith("'") & ~F.lower(name).rlike("'s$|'t$|'s |'ll|'re|'ve"))
    target = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), "^[_-]\\s+", ""), "'+$", "")))
    w = F.split(F.col("target"), "\\s+")
    fragment = (F.size(w) > most_words) | F.col("target").rlike("[;:!?@#$%^&*+=\\[\\]{}<>\\\\|/]") | w[0].isin(starters)
    verdict = F.when(F.col("target") == "", "DELETE").when(F.coalesce("n", F.lit(0)) >= high, "REVIEW").when(fragment, "DELETE").otherwise("MERGE")
    return names.where(odd).withColumn("target", target).select("id", verdict.alias("cls"), "target")


def spatial_relations(boxes: DataFrame, near: float = 200.0) -> DataFrame:
    """image, a, b, predicate, confidence of boxes(image, id, x, y) whose centres are at most `near` apart. Joined by cells as wide as that, not by image, so a crowded image spreads."""
    b = boxes.withColumns({"cx": F.floor(F.col("x") / near), "cy": F.floor(F.col("y") / near)})
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = b.withColumn("_d", shift).select("image", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("cx") + F.col("_d.i")).alias("cx"), (F.col("cy") + F.col("_d.j")).alias("cy"))
    dx, dy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    rows = left.join(b, ["image", "cx", "cy"]).where(F.col("a") != F.col("id")).withColumns({"dx": dx, "dy": dy}).withColumn("far", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).where(F.col("far") <= near)
    word = F.when(F.abs("dy") > F.abs("dx"), F.when(F.col("dy") > 0, "above").otherwise("below")).when(F.col("dx") < 0, "left of").otherwise("right of")
    return rows.select("image", "a", F.col("id").alias("b"), word.alias("predicate"), F.greatest(F.lit(0.5), 1 - F.col("far") / near).alias("confidence"))
