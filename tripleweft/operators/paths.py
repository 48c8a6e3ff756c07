"""Paths along edges, from many starts at once. Loops go by levels; each level is written to the shared folder, so plans stay short."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import keep
from .packets import packets, ranked

# Weight of causal predicates, trust, decay by length, bounds of the search.
CAUSAL = {
    "causes": 1.00, "leads_to": 0.95, "enables": 0.85, "produces": 0.85, "requires": 0.75, "depends_on": 0.70, "stabilises": 0.65, "prevents": 0.60, "destabilises": 0.60, "triggers": 0.90, "results_in": 0.90,
    "contributes_to": 0.70, "regulates": 0.75, "impairs": 0.65, "affects": 0.55,
}
PRIMARY = ["causes", "leads_to", "enables", "produces", "requires"]
TRUST, DECAY, DEPTH, BEAM = 0.80, 0.30, 4, 6
FEW_NODES = 500_000  # so many hashes of nodes may be broadcast (some 30 MB)
FIRST_LOOKED = 100  # so many nodes of a seed's last level are looked at first, ten times as many whenever they lead to nothing new
# Goal and feasibility of predicates that name a step, those that name a risk, weights of a step's use.
STEPS = {
    "requires": (0.8, 0.7), "enables": (0.9, 0.8), "depends_on": (0.7, 0.6), "produces": (0.85, 0.75), "blocks": (0.3, 0.2), "leads_to": (0.8, 0.7), "prevents": (0.4, 0.3), "next_step": (1.0, 0.9),
    "build_order": (1.0, 0.85), "precedes": (0.85, 0.75), "follows": (0.80, 0.70),
}
RISKS = ["contradicts", "blocks", "prevents", "conflicts_with"]
GOAL, FEASIBLE, GAIN, SAFE, COST, RISK, UNSURE, LATER = 0.30, 0.20, 0.20, 0.10, 0.10, 0.05, 0.05, 0.85


def _mapped(table: dict, key: Column, rest) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(rest))


def _leading(steps: DataFrame, nodes: DataFrame, column: str = "node") -> DataFrame:
    """steps whose `column` is one of nodes(node). Where these are few, other steps are dropped where they lie, by hashes; some that are not of the nodes may stay, so a join by name must follow."""
    at = nodes.select(F.xxhash64("node").alias("_h")).distinct()
    if at.limit(FEW_NODES + 1).count() > FEW_NODES:
        return steps
    return steps.withColumn("_h", F.xxhash64(column)).join(F.broadcast(at), "_h", "left_semi").drop("_h")


def _in_order(front: DataFrame) -> DataFrame:
    """front, kept, with _rank: a number that grows with the path. Paths of a level have one length, so the least path to a node comes through the least path to the node before it, and steps need not carry paths."""
    return keep(front.orderBy("path").withColumn("_rank", F.monotonically_increasing_id()))


def _levels(edges: DataFrame, seeds: DataFrame, depth: int, ends: DataFrame | None = None) -> list[DataFrame]:
    """The levels of `reach`, kept: seed, node, path, _rank of the nodes met first after 0, 1, ... steps, up to the last that has any."""
    steps = edges.select(F.col("src").alias("node"), "dst")  # an edge that comes twice changes no least path
    levels = [_in_order(seeds.select("seed", F.col("seed").alias("node"), F.array("seed").alias("path")).distinct())]
    for k in range(1, depth + 1):
        own = _leading(steps, levels[-1])
        if ends is not None and k == depth:
            own = _leading(own, ends, "dst")
        met = levels[-1].select("seed", "node", "_rank").join(own, "node").groupBy("seed", F.col("dst").alias("node")).agg(F.min("_rank").alias("_rank"))
        if ends is not None and k == depth:
            met = met.join(ends, "node", "left_semi")
        seen = reduce(DataFrame.unionByName, [x.select("seed", "node") for x in levels])
        new = met.join(seen, ["seed", "node"], "left_anti")
        front = _in_order(new.join(levels[-1].select("_rank", "path"), "_rank").select("seed", "node", F.concat("path", F.array("node")).alias("path")))
        if front.isEmpty():
            break
        levels.append(front)
    return levels


def reach(edges: DataFrame, seeds: DataFrame, depth: int, ends: DataFrame | None = None) -> DataFrame:
    """seed, node, path (of nodes) of all that each of seeds(seed) reaches along edges(src, dst) in up to `depth` steps, breadth first: each node once, by the least of its shortest paths. With ends(node), only these nodes; then the last level looks at steps to them alone."""
    found = reduce(DataFrame.unionByName, _levels(edges, seeds, depth, ends)).select("seed", "node", "path")
    return found if ends is None else found.join(ends, "node", "left_semi").select("seed", "node", "path")


def multihop(edges: DataFrame, seeds: DataFrame, max_hops: int = 3, max_nodes: int = 60, per_node: int = 8, least_seen: int = 2, most: int = 25) -> DataFrame:
    """seed, path (array of node, predicate, node, ...), hops, place: of each of seeds(seed) the `most` longest paths of a search by breadth along edges(src, p, dst, seen), for all seeds in one plan.

    From a node only the per_node edges seen most go on (least_seen at least; ties by dst, then p), and each node is entered once a seed, by the first edge of the first node in the queue. A node is not looked
    at once max_nodes nodes are known to its seed; it then ends its path, as a node without edges does and one at max_hops. Nodes whose neighbours were all entered by others end no path.
    A seed's queue holds under max_nodes + per_node nodes, so its windows are small; a hub's edges are cut to per_node before they are shuffled. What a level meets is dealt by seed once; nodes know the place of the
    one before them, and paths are made at the end for those that are told.
    """
    first = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("seen"), "dst", "p"))
    steps = edges.where((F.col("seen") >= least_seen) & (F.col("src") != F.col("dst"))).withColumn("_r", first).where(F.col("_r") <= per_node)
    steps = keep(steps.select(F.col("src").alias("node"), "_r", "p", "dst"))
    ends = steps.select("node", F.lit(True).alias("_has")).distinct()
    own = Window.partitionBy("seed")
    # _known: how many nodes a seed knows before it looks at a level
    fronts = [keep(seeds.select("seed", F.col("seed").alias("node"), F.lit(1).alias("_pos"), F.lit(1).alias("_known")).distinct())]
    done = []
    for hops in range(max_hops):
        looking = fronts[-1].where(F.col("_known") < max_nodes)  # seeds that know enough look at no more nodes
        met = looking.select("seed", "node", "_pos", "_known").join(steps, "node").select("seed", F.col("dst").alias("node"), F.struct("_pos", "_r", "p").alias("x"), "_known")
        seen = reduce(DataFrame.unionByName, [x.select("seed", "node") for x in (*fronts[:-1], looking)])
        rows = met.unionByName(seen.withColumns({"x": F.lit(None).cast(met.schema["x"].dataType), "_known": F.lit(None).cast("int")})).repartition("seed")
        new = rows.groupBy("seed", "node").agg(F.min("x").alias("x"), F.max("_known").alias("_known"), F.max(F.col("x").isNull()).alias("_seen")).where(~F.col("_seen")).select("seed", "node", "x.*", "_known")
        # a node is looked at as long as those before it in the queue haven't led to enough; so those looked at come first, and places don't change with what is left out
        before = F.count("*").over(own.orderBy("_pos").rangeBetween(Window.unboundedPreceding, -1))
        new = new.withColumn("_place", F.row_number().over(own.orderBy("_pos", "_r"))).withColumn("_looked", F.col("_known") + before < max_nodes)
        entered = keep(new.withColumn("_next", (F.col("_known") + F.sum(F.col("_looked").cast("int")).over(own)).cast("int")))
        if hops:
            done.append(fronts[-1].where((F.col("_known") >= max_nodes) & (F.col("_pos") <= most)).withColumn("hops", F.lit(hops)))
            last = entered.where(F.col("_place") == max_nodes - F.col("_known")).select("seed", F.col("_pos").alias("_last"))
            queue = looking.join(last, "seed", "left").join(ends, "node", "left")
            done.append(queue.where((F.col("_pos") > F.col("_last")) | F.col("_has").isNull()).select(*fronts[-1].columns).withColumn("hops", F.lit(hops)))
        fronts.append(entered.where("_looked").select("seed", "node", F.col("_place").alias("_pos"), F.col("_next").alias("_known"), F.col("_pos").alias("_from"), "p"))
        if fronts[-1].isEmpty():
            break
    done.append(fronts[-1].where(F.col("_pos") <= most).withColumn("hops", F.lit(len(fronts) - 1)))
    place = F.row_number().over(own.orderBy(F.desc("hops"), "_pos"))
    told = keep(reduce(DataFrame.unionByName, done).withColumn("place", place).where(F.col("place") <= most).select("seed", "hops", "place", "_from", "p", "node"))
    out, step = None, lambda n: F.array("p", F.col(n).cast("string"))
    for h in range(len(fronts) - 1, 0, -1):
        rows = told.where(F.col("hops") == h).select("seed", "hops", "place", "_from", step("node").alias("path"))
        out = rows if out is None else out.unionByName(rows)
        if h > 1:
            back = fronts[h - 1].where(F.col("_known") < max_nodes).select("seed", F.col("_pos").alias("_from"), F.col("_from").alias("_f"), step("node").alias("_step"))
            out = out.join(back, ["seed", "_from"]).select("seed", "hops", "place", F.col("_f").alias("_from"), F.concat("_step", "path").alias("path"))
    return out.select("seed", F.concat(F.array(F.col("seed").cast("string")), "path").alias("path"), "hops", "place")


def longest(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, path: of the nodes that each seed reaches, edges taken both ways, the path to the farthest (ties: the least path).

    The last level, which may hold most nodes of all seeds, is not made: a seed's paths are followed in their order until one leads to a node that the seed hasn't met, which gives the least path of that level.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    levels = _levels(both, seeds, depth - 1)
    seen = reduce(DataFrame.unionByName, levels)
    told = [seen.groupBy("seed").agg(F.min(F.struct(-F.size("path"), "path"))["path"].alias("path"))]
    if len(levels) == depth:
        steps, size = both.select(F.col("src").alias("node"), "dst"), FIRST_LOOKED
        rest = keep(levels[-1].withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy("_rank"))))
        start = 0
        while not rest.isEmpty():
            now = rest.where((F.col("_n") > start) & (F.col("_n") <= start + size))
            met = now.select("seed", "node", "_rank").join(_leading(steps, now), "node").groupBy("seed", F.col("dst").alias("node")).agg(F.min("_rank").alias("_rank"))
            least = met.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").groupBy("seed").agg(F.min(F.struct("_rank", "node")).alias("x")).select("seed", "x.*")
            told.append(keep(least.join(now.select("_rank", "path"), "_rank").select("seed", F.concat("path", F.array("node")).alias("path"))))
            start, size = start + size, 10 * size
            rest = rest.where(F.col("_n") > start).join(told[-1].select("seed"), "seed", "left_anti")
    return reduce(DataFrame.unionByName, told).groupBy("seed").agg(F.min(F.struct(-F.size("path"), "path"))["path"].alias("path"))


def between(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """src, dst, path: the shortest path (ties: the least) of each of pairs(src, dst) that has one of up to `depth` steps."""
    found = reach(edges, pairs.select(F.col("src").alias("seed")).distinct(), depth, pairs.select(F.col("dst").alias("node")).distinct())
    return pairs.join(found.select(F.col("seed").alias("src"), F.col("node").alias("dst"), "path"), ["src", "dst"])


def inferred(edges: DataFrame, seeds: DataFrame, depth: int = 5, most: int = 12) -> DataFrame:
    """seed, chain, place: chains of edges(s, p, o) from each seed, those against the edge with ← at the predicate, breadth first; the shortest `most` of nodes not met before."""
    labelled = edges.select(F.col("s").alias("src"), "p", F.col("o").alias("dst")).union(edges.select("o", F.concat(F.lit("←"), "p"), "s"))
    first = labelled.groupBy("src", "dst").agg(F.min("p").alias("p"))
    paths = reach(first, seeds, depth).where(F.size("path") > 1)
    steps = paths.select("seed", "node", "path", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "src")).withColumn("dst", F.element_at("path", F.col("i") + 2)).join(first, ["src", "dst"])
    said = steps.groupBy("seed", "node", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.format_string(" —[%s]→ %s", "p", "dst").alias("t")))), lambda x: x["t"]), "").alias("t"))
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.size("path"), "path"))
    return said.withColumn("place", place).where(F.col("place") <= most).select("seed", F.concat("seed", "t").alias("chain"), "place")


def beam(edges: DataFrame, seeds: DataFrame, backward: bool = False, depth: int = DEPTH, width: int = BEAM) -> DataFrame:
    """query_id, path (structs s, p, o from the seed on), length, score of the paths that a beam finds from seeds(query_id, node) along edges(query_id, s, p, o, w) of one query: at each level the best `width` go on.

    score: the product of w, the predicate's causal weight and 0.8, times e^(-0.3 length). Paths don't return to a node.
    """
    a, b = ("o", "s") if backward else ("s", "o")
    steps = keep(edges.select("query_id", F.col(a).alias("node"), F.col(b).alias("_next"), F.struct("s", "p", "o").alias("_e"), (F.col("w") * _mapped(CAUSAL, F.col("p"), 0.5) * TRUST).alias("_w")))
    front = seeds.select("query_id", "node", F.array("node").alias("nodes"), F.array().cast("array<struct<s:string,p:string,o:string>>").alias("path"), F.lit(1.0).alias("product"))
    levels = []
    for length in range(1, depth + 1):
        found = front.join(steps, ["query_id", "node"]).where(~F.array_contains("nodes", F.col("_next")))
        found = found.select("query_id", F.col("_next").alias("node"), F.concat("nodes", F.array("_next")).alias("nodes"), F.concat("path", F.array("_e")).alias("path"), (F.col("product") * F.col("_w")).alias("product"))
        levels.append(keep(found.withColumn("score", F.col("product") * F.exp(F.lit(-DECAY * length))).withColumn("length", F.lit(length))))
        front = levels[-1].withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path"))).where(F.col("_n") <= width).drop("_n")
    return reduce(DataFrame.unionByName, levels).select("query_id", "path", "nodes", "length", "score")


def _account(paths: DataFrame, whole: DataFrame) -> DataFrame:
    """query_id, n_paths, completeness, confidence, narrative (nodes) of each query's paths: the longest, of these the best; packets(query_id, confidence) are whole."""
    ranked = paths.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path")))
    top = ranked.where(F.col("_n") <= 3).select("query_id", "score", F.transform("path", lambda x: x["p"]).alias("ps"))
    told = top.groupBy("query_id").agg(F.avg("score").alias("mean"), F.size(F.array_intersect(F.array_distinct(F.flatten(F.collect_list("ps"))), F.array(*[F.lit(p) for p in PRIMARY]))).alias("filled"))
    story = paths.groupBy("query_id").agg(F.count("*").alias("n_paths"), F.min_by("nodes", F.struct(-F.col("length"), -F.col("score"), "path")).alias("narrative"))
    out = told.join(story, "query_id").join(whole.select("query_id", F.col("confidence").alias("_c")), "query_id")
    return out.select("query_id", "n_paths", F.least(F.col("filled") / 2.5, F.lit(1.0)).alias("completeness"), F.least(0.7 * F.col("mean") + 0.3 * F.col("_c"), F.lit(0.95)).alias("confidence"), "narrative")


def _most_active(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """query_id, node: of each query's ends(query_id, node), the most activated top node that isn't the query itself (ties: the least)."""
    own = nodes.join(ends.distinct(), ["query_id", "node"]).where("node <> query_id")
    return own.groupBy("query_id").agg(F.min(F.struct(-F.col("a"), "node"))["node"].alias("node"))


def explain(edges: DataFrame) -> DataFrame:
    """query_id, seed, n_paths, completeness, confidence, narrative: causal paths from each query's most activated cause. edges: query_id, s, p, o, w. Queries without a causal edge are left out."""
    parts = tuple(keep(x) for x in ranked(edges))
    causal = keep(parts[1].where(F.col("p").isin(*CAUSAL)))
    seeds = _most_active(parts[0], causal.select("query_id", F.col("s").alias("node")))
    return _account(beam(causal, seeds), packets(edges, parts)).join(seeds.withColumnRenamed("node", "seed"), "query_id")


def trace_cause(edges: DataFrame, most: int = 5) -> DataFrame:
    """query_id, effect, n_paths, completeness, confidence, chain (from the root to the effect), roots: causal paths back from each query's most activated effect; roots are causes that nothing causes (else the chain's start), most activated first."""
    nodes, top = tuple(keep(x) for x in ranked(edges))
    causal = keep(top.where(F.col("p").isin(*CAUSAL)))
    effects = keep(_most_active(nodes, causal.select("query_id", F.col("o").alias("node"))))
    paths = keep(beam(causal, effects, backward=True))
    up = paths.select("query_id", F.explode("path").alias("e")).select("query_id", F.col("e.s").alias("node")).distinct()
    roots = up.join(causal.select("query_id", F.col("o").alias("node")).distinct(), ["query_id", "node"], "left_anti").join(nodes.select("query_id", "node", "a"), ["query_id", "node"], "left")
    listed = roots.groupBy("query_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("a", F.lit(0.0))).alias("a"), "node"))), lambda x: x["node"]), 1, most).alias("roots"))  # a packet has 60 edges
    out = _account(paths, packets(edges, (nodes, top))).join(effects.withColumnRenamed("node", "effect"), "query_id").join(listed, "query_id", "left")
    chain = F.reverse("narrative")
    return out.select("query_id", "effect", "n_paths", "completeness", "confidence", chain.alias("chain"), F.coalesce("roots", F.slice(chain, 1, 1)).alias("roots"))


def top_paths(edges: DataFrame, seeds: DataFrame, decay: float, causal: list[str], definitional: list[str], depth: int = 4, most: int = 10) -> DataFrame:
    """query_id, nodes, log_score, kind, place: the best paths of up to `depth` edges from seeds(query_id, node, a): log a, plus log w less `decay` for each edge; causal, definitional or associative by their predicates. All paths are ranked; nothing stops early."""
    steps = edges.select("query_id", F.col("s").alias("node"), F.col("o").alias("_next"), "p", F.log(F.greatest("w", F.lit(1e-9))).alias("_w"))
    front, levels = seeds.select("query_id", "node", F.array("node").alias("nodes"), F.array().cast("array<string>").alias("ps"), F.log(F.greatest("a", F.lit(1e-9))).alias("log_score")), []
    for _ in range(depth):
        front = keep(front.join(steps, ["query_id", "node"]).where(~F.array_contains("nodes", F.col("_next"))).select(
            "query_id", F.col("_next").alias("node"), F.concat("nodes", F.array("_next")).alias("nodes"), F.concat("ps", F.array("p")).alias("ps"), (F.col("log_score") + F.col("_w") - decay).alias("log_score")))
        levels.append(front)
    has = lambda own: F.arrays_overlap("ps", F.array(*[F.lit(p) for p in own]))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("log_score"), "nodes", "ps"))
    kind = F.when(has(causal), "causal").when(has(definitional), "definitional").otherwise("associative")
    return reduce(DataFrame.unionByName, levels).withColumn("place", place).where(F.col("place") <= most).select("query_id", "nodes", "log_score", kind.alias("kind"), "place")


def plan_next(edges: DataFrame, most: int = 8) -> DataFrame:
    """query_id, actions (best first), utilities, plan_score, confidence: what to do next in each query: the objects of edges that name a step, each by its best edge, and after the best four two steps more of each.

    edges: query_id, s, p, o, w. Queries without such an edge are left out.
    """
    nodes, e = tuple(keep(x) for x in ranked(edges))
    whole = packets(edges, (nodes, e)).select("query_id", F.col("confidence").alias("_c"))
    first = e.where(F.col("p").isin(*STEPS)).withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "o").orderBy("place"))).where("_n = 1").join(whole, "query_id")
    goal, feasible = _mapped({k: v[0] for k, v in STEPS.items()}, F.col("p"), 0.5), _mapped({k: v[1] for k, v in STEPS.items()}, F.col("p"), 0.5)
    asked, done = F.array_distinct(F.split(F.lower("query_id"), "\\s+")), F.array_distinct(F.split(F.lower("o"), "\\s+"))
    overlap = F.size(F.array_intersect(asked, done)) / F.greatest(F.size(asked), F.lit(1))
    risk = F.when(F.col("p").isin(RISKS), 1.0).otherwise(0.0)
    use = (GOAL * F.least(goal * (1 + 0.2 * overlap), F.lit(1.0)) + FEASIBLE * feasible * F.col("w") + GAIN * F.col("a_o") * (1 - F.col("a_s")) * 0.5 + SAFE * (1 - 0.5 * risk)
           - COST * (1 - F.col("w")) - RISK * risk - UNSURE * F.greatest(F.lit(0.0), 0.5 - F.col("_c")))
    actions = keep(first.select("query_id", F.col("o").alias("action"), F.greatest(use, F.lit(0.0)).alias("utility"), F.lit(1).alias("depth")))
    best = actions.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("utility"), "action"))).where("_n <= 4")
    more = e.where(F.col("p").isin(*STEPS)).join(actions.select("query_id", F.col("action").alias("o")), ["query_id", "o"], "left_anti").select("query_id", F.col("s").alias("action"), "o", "w", "p", "place")
    after = best.join(more, ["query_id", "action"]).withColumn("_m", F.row_number().over(Window.partitionBy("query_id", "action").orderBy("place"))).where("_m <= 2")
    after = after.select("query_id", F.concat_ws(" → ", "action", "o").alias("action"), (F.col("utility") * LATER * feasible * F.col("w")).alias("utility"), F.lit(2).alias("depth"))
    best = actions.unionByName(after).withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("utility"), "action"))).where(F.col("_n") <= most)
    listed = F.array_sort(F.collect_list(F.struct("_n", "action", "utility")))
    out = best.groupBy("query_id").agg(listed.alias("x"), F.sum(F.pow(F.lit(LATER), F.col("depth")) * F.col("utility")).alias("plan")).join(whole, "query_id")
    plan = F.least("plan", F.lit(1.0))
    return out.select("query_id", F.transform("x", lambda x: x["action"]).alias("actions"), F.transform("x", lambda x: x["utility"]).alias("utilities"), plan.alias("plan_score"), (0.6 * F.col("_c") + 0.4 * plan).alias("confidence"))
