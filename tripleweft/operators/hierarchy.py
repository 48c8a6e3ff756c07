"""Trees of unknown depth, rolled up."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import keep


def ancestors(tree: DataFrame) -> DataFrame:
    """node, ancestor, distance of every node of tree(node, parent) and all that lies above it, itself at distance 0; parents that are no nodes count too. Repeated rows count once; rows without a node are left out.

    The reach doubles each round, so a tree of depth n takes log2(n) rounds. A node whose ancestors run in a circle is an error, since it has no end.
    """
    steps = keep(tree.where("node IS NOT NULL").select("node", "parent").distinct())
    if not steps.groupBy("node").agg(F.count("parent").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a node has several parents")
    nodes = steps.select("node").union(steps.where("parent IS NOT NULL").select("parent")).distinct()
    most, known = nodes.count(), 0
    out = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    jump = steps.where("parent IS NOT NULL").select("node", F.col("parent").alias("up"))  # 2^round above
    length = 1
    while True:
        jump = keep(jump)
        if jump.isEmpty():
            return out
        if length > most:
            raise ValueError("some nodes are their own ancestors")
        # what lies within `length` above the node that is `length` above
        higher = jump.join(out.select(F.col("node").alias("up"), "ancestor", "distance"), "up").select("node", "ancestor", (F.col("distance") + length).alias("distance"))
        out = keep(out.unionByName(higher))
        jump = jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("_next")), "up").select("node", F.col("_next").alias("up"))
        length *= 2


def rolled_up(counts: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, ancestor, distance, n: what each node of counts(node, n) passes to each of its ancestors; node, own, total, below: each node's own count, that of its whole subtree, and how many of its subtree's nodes have one).

    Counts are added up by node before they meet the tree, so a frequent node is one row, and what reaches an ancestor is added up in each task first.
    """
    own = counts.groupBy("node").agg(F.sum("n").alias("n"))
    passed = keep(ancestors(tree).join(own, "node"))
    total = passed.groupBy(F.col("ancestor").alias("node")).agg(F.sum(F.when(F.col("distance") == 0, F.col("n"))).alias("own"), F.sum("n").alias("total"), F.count("*").alias("below"))
    return passed.select("node", "ancestor", "distance", "n"), total.select("node", F.coalesce("own", F.lit(0)).alias("own"), "total", "below")
