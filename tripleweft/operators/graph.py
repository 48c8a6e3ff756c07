"""Graph operators over edges (subject_id, predicate, object_id, ...)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import keep
from .hot import join_degrees
from .patterns import unify  # noqa: F401 (part of what can be asked of a graph)


def aggregate_edges(raw: DataFrame) -> DataFrame:
    """Raw edges by subject, predicate, object, domain_tags and edge_type (trimmed, null as ''): sums of counts (null as 1), maxima of the rest."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c)
    rows = raw.where("subject_id IS NOT NULL AND predicate IS NOT NULL AND object_id IS NOT NULL")
    return rows.groupBy("subject_id", "predicate", "object_id", text("domain_tags"), text("edge_type")).agg(
        F.sum(F.coalesce("seen_count", F.lit(1))).alias("seen_count"), F.sum(F.coalesce("evidence_count", F.lit(1))).alias("evidence_count"),
        F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"), F.max("edge_weight").alias("edge_weight"), F.max("polarity").alias("polarity"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, incoming, outgoing of nodes that have both."""
    out = edges.groupBy(F.col("subject_id").alias("node")).agg(F.count("*").alias("outgoing"))
    return edges.groupBy(F.col("object_id").alias("node")).agg(F.count("*").alias("incoming")).join(out, "node")


def top_neighbors(edges: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """For each node, the k neighbours of greatest maturity, edges taken both ways."""
    both = edges.select(F.col("subject_id").alias("node"), F.col("object_id").alias("id")).union(edges.select("object_id", "subject_id")).distinct()
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("maturity"), "id"))
    return both.join(anchors.select("id", "maturity"), "id").withColumn("place", rank).where(F.col("place") <= k)


def levels(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node, depth of all that is reached from seeds(node) along edges(src, dst), breadth first; each node once. Each level is written to the shared folder, and an empty one ends the search."""
    edges = keep(edges.select("src", "dst").distinct())
    seen = front = keep(seeds.select("node", F.lit(0).alias("depth")).distinct())
    for d in range(1, depth + 1):
        found = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = keep(found.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth")))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def propagated(bridges: DataFrame, start: DataFrame, damping: float = 0.5, tolerance: float = 1e-10, rounds: int = 200, stride: int = 3) -> DataFrame:
    """node, weight where weights no longer change: each node keeps 1 - damping of its weight in start(node, weight), and passes `damping` of what it has to its neighbours over bridges(a, b, resonance), by resonance; a node without bridges keeps it.

    The sum of weights is that of start (nodes that only bridges name start with 0; bridges without resonance, and from a node to itself, don't count; repeated ones add up). Every `stride` steps the weights are written
    to the shared folder and compared with those before; it ends when no sum of changes exceeds tolerance times the whole, which takes some log(tolerance) / log(damping) steps whatever the graph.
    What reaches a hub is added up in each task first; what a hub sends out is joined where its bridges lie.
    """
    both = bridges.where("resonance > 0 AND a <> b").select(F.col("a").alias("node"), F.col("b").alias("to"), "resonance")
    both = both.union(both.select(F.col("to").alias("node"), F.col("node").alias("to"), "resonance")).groupBy("node", "to").agg(F.sum("resonance").alias("r"))
    both = keep(both)
    out = keep(both.groupBy("node").agg(F.sum("r").alias("_all"), F.count("*").alias("_n")))
    both = keep(join_degrees(both, out, "node", "_n").select("node", "to", (F.col("r") / F.col("_all")).alias("share")))
    base = start.where("node IS NOT NULL").groupBy("node").agg(F.sum("weight").alias("base")).join(out.select("node", "_n"), "node", "full").select("node", F.coalesce("base", F.lit(0.0)).alias("base"), F.coalesce("_n", F.lit(0)).alias("_n"))
    base = keep(base)
    now, whole = base.withColumn("weight", F.col("base")), base.agg(F.sum(F.abs("base"))).first()[0]
    if not whole:
        return base.select("node", F.col("base").alias("weight"))

    def step(now):
        sent = join_degrees(both, now.where("_n > 0").select("node", "weight", "_n"), "node", "_n").groupBy(F.col("to").alias("node")).agg(F.sum(F.col("weight") * F.col("share")).alias("_got"))
        kept = F.when(F.col("_n") == 0, F.col("weight")).otherwise(0.0)
        return now.join(sent, "node", "left").select("node", "base", "_n", ((1 - damping) * F.col("base") + damping * (kept + F.coalesce("_got", F.lit(0.0)))).alias("weight"))

    for _ in range(0, rounds, stride):
        before = now
        for _ in range(stride - 1):
            before = step(before)
        now = step(before)
        now = keep(now.join(before.select("node", F.col("weight").alias("_before")), "node"))
        moved = now.agg(F.sum(F.abs(F.col("weight") - F.col("_before")))).first()[0]
        now = now.drop("_before")
        if moved <= tolerance * whole:
            break
    return now.select("node", "weight")


def merge_nodes(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """edges with both ends redirected by merges(old, new), then aggregated again."""
    for c in ("subject_id", "object_id"):
        edges = edges.join(merges.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
    return aggregate_edges(edges)


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """src, dst, depth (the least, from 1) of all pairs that at most `depth` edges(src, dst) join. Each level is written to the shared folder."""
    first = keep(edges.select("src", "dst").distinct())
    seen = front = first.withColumn("depth", F.lit(1))
    steps = first.select(F.col("src").alias("dst"), F.col("dst").alias("_next"))
    for d in range(2, depth + 1):
        found = front.join(steps, "dst").select("src", F.col("_next").alias("dst")).distinct()
        front = keep(found.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit(d).alias("depth")))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def mined_rules(edges: DataFrame) -> DataFrame:
    """rule, p, s, o of what edges(s, p, o) imply: the same relation over two edges (transitive), turned round (symmetric), and of each subject to itself (reflexive). Loops imply nothing but the last."""
    own = edges.where("s <> o").distinct()
    ahead = own.select("p", "s", F.col("o").alias("mid")).join(own.select("p", F.col("s").alias("mid"), "o"), ["p", "mid"]).where("s <> o").select(F.lit("transitive").alias("rule"), "p", "s", "o").distinct()
    back = own.select(F.lit("symmetric").alias("rule"), "p", F.col("o").alias("s"), F.col("s").alias("o"))
    return ahead.unionByName(back).unionByName(edges.select(F.lit("reflexive").alias("rule"), "p", "s", F.col("s").alias("o")).distinct())


def in_order(text: Column, terms: list[str]) -> Column:
    """The text holds all terms, each after the end of the one before; a null text holds none. One pass: the first place of each is the best one."""
    at = F.lit(1)
    found = F.lit(True)
    for t in terms:
        place = F.call_function("locate", F.lit(t), text, at)
        found, at = found & (place > 0), place + len(t)
    return found


def _packed(rows: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """rows in packs of about `block`, a row each, kept in files of some four packs."""
    n = max(1, -(-rows.count() // block))
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("_block"), F.struct(F.col(key).alias("k"), F.col(vector).alias("v")).alias("_x")).repartition(max(1, min(20_000, n // 4)), "_block")
    return keep(dealt.groupBy("_block").agg(F.collect_list("_x").alias("pack")).drop("_block"))


def cosine_neighbors(queries: DataFrame, rows: DataFrame, key: str, vector: str, least: float, block: int = 2000) -> DataFrame:
    """a, b, cosine of queries and rows (key, vector) that are at least `least` alike, a row not with itself. Both are put in packs of about `block`, a row each; each pair of packs is one product of matrices, so a vector goes to Python once for a pack of queries."""
    import numpy as np
    import pyarrow as pa

    def matrix(pack):
        keys, lists = pack.field("k"), pack.field("v")
        if lists.null_count or len(set(lists.value_lengths().to_pylist())) > 1:
            raise ValueError("vectors must be of one length, none null")
        v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)
        return keys.to_numpy(zero_copy_only=False), v, np.sqrt((v * v).sum(1))

    def each(batches):
        for x in batches:
            mine, others = (x.column(c) for c in ("pack", "other"))
            for at in range(len(x)):
                (a, u, m), (b, v, n) = matrix(mine[at].values), matrix(others[at].values)
                c = (u @ v.T) / (m[:, None] * n[None, :] + 1e-9)
                i, j = np.nonzero(c >= least)
                i, j = i[a[i] != b[j]], j[a[i] != b[j]]
                yield pa.RecordBatch.from_arrays([pa.array(a[i], mine.type.value_type.field("k").type), pa.array(b[j], mine.type.value_type.field("k").type), pa.array(c[i, j])], names=["a", "b", "cosine"])

    kinds = dict(rows.dtypes)
    packs = _packed(queries, key, vector, block)
    met = _packed(rows, key, vector, block).withColumnRenamed("pack", "other").crossJoin(packs)
    return met.mapInArrow(each, f"a {kinds[key]}, b {kinds[key]}, cosine double")


def narrowed(rows: DataFrame, **wanted) -> DataFrame:
    """rows where each named column has the value given, lies in a (least, most) of which either may be None, or is in a list; None asks nothing."""
    for column, value in wanted.items():
        if isinstance(value, tuple):
            for bound, test in zip(value, (F.col(column) >= value[0], F.col(column) <= value[1])):
                rows = rows if bound is None else rows.where(test)
        elif isinstance(value, list):
            rows = rows.where(F.col(column).isin(value))
        elif value is not None:
            rows = rows.where(F.col(column) == value)
    return rows
