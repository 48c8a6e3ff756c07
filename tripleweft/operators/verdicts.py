"""What is concluded from packets: contradictions, gaps, comparisons and the quality of a response. Scores aren't rounded, but for those of gaps.

edges: query_id, s, p, o, w (0 to 1), as for packets.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import noisy_or
from .packets import TRUST, packets, ranked

# Predicates that speak against or for a claim, and the scores beyond which they settle it.
AGAINST = ["contradicts", "negates", "incompatible_with", "refutes", "conflicts_with", "disproven_by", "opposes", "falsifies"]
SUPPORTING = ["supports", "confirms", "validates", "is_consistent_with", "is_a", "causes", "enables", "requires", "leads_to", "defined_as", "has_property", "produced_by"]
CONTRADICTED, SUPPORTED, EVIDENCE_POWER = 0.35, 0.55, 0.3
# Weights of the predicates that name a need, the least score of a gap and how many are told.
NEEDS = {"requires": 1.0, "depends_on": 0.9, "needs": 0.85, "precondition_of": 0.85, "missing": 1.0, "lacks": 0.9, "blocks": 0.7, "prerequisite_of": 0.88, "constrained_by": 0.75}
NEED_TRUST, LEAST_GAP, MOST_GAPS = 0.8, 0.2, 8
# Weights of a response's quality, and the least that is good enough.
INTENT, COMPLETE, SURE, CONTINUITY, UNSUPPORTED, RISK, READY = 0.25, 0.25, 0.20, 0.15, 0.10, 0.05, 0.40


def contradictions(edges: DataFrame, against: list[str] = AGAINST, supporting: list[str] = SUPPORTING, evidence: int = 5, parts: tuple | None = None) -> DataFrame:
    """query_id, status, against, support, confidence, evidence: the greatest proof against, noisy or of the proofs for, and the texts of the best of those.

    A query without such edges is insufficient_memory with scores of 0 and a confidence of 0.2.
    """
    proof = TRUST * F.col("w") * F.pow("score", F.lit(EVIDENCE_POWER))
    speaks = F.col("p").isin(supporting) & ~F.col("p").isin(against)
    rows = (parts or ranked(edges))[1].withColumns({"proof": proof, "speaks": speaks, "says": F.format_string("%s %s %s (strength=%.2f)", "s", "p", "o", "w")}).where(speaks | F.col("p").isin(against))
    texts = F.array_sort(F.collect_list(F.when(F.col("speaks"), F.struct((-F.col("proof")).alias("rank"), "place", "says"))))  # a packet has 60 edges at most
    sums = rows.groupBy("query_id").agg(
        F.max(F.when(~F.col("speaks"), F.col("proof"))).alias("against"), noisy_or(F.when(F.col("speaks"), F.col("proof"))).alias("support"),
        F.count("*").alias("n"), F.transform(F.slice(texts, 1, evidence), lambda x: x["says"]).alias("evidence"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    found = edges.select("query_id").distinct().join(sums, "query_id", "left").withColumns({"against": zero("against"), "support": zero("support"), "n": F.coalesce("n", F.lit(0))})
    status = F.when(F.col("against") > CONTRADICTED, "contradicted").when(F.col("support") > SUPPORTED, "supported").otherwise("insufficient_memory")
    sure = F.least(F.abs(F.col("support") - F.col("against")) * F.least(F.col("n") / 10, F.lit(1.0)) + 0.2, F.lit(1.0))
    return found.select("query_id", status.alias("status"), "against", "support", sure.alias("confidence"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


def gaps(edges: DataFrame, parts: tuple | None = None) -> DataFrame:
    """query_id, item, required_by, p, gap, place, n_required, mean_gap: one row for each needed item, by its best edge; place is set for those that are gaps, null for the rest."""
    weights = F.create_map(*[F.lit(x) for pair in NEEDS.items() for x in pair])
    one = Window.partitionBy("query_id", "o")
    whole = Window.partitionBy("query_id")
    nodes, top = parts or ranked(edges)
    needs = top.where(F.col("p").isin(*NEEDS)).withColumns({"fans": F.count("*").over(one), "first": F.row_number().over(one.orderBy("place"))}).where("first = 1")
    held = nodes.select("query_id", F.col("node").alias("o"), F.col("a").alias("held"))
    score = F.col("w") * F.try_element_at(weights, F.col("p")) * NEED_TRUST * (F.col("fans") / F.max("fans").over(whole)) * (1 - F.coalesce("held", F.lit(0.0)))
    rows = needs.join(held, ["query_id", "o"], "left").withColumn("gap", F.round(score, 4))
    rank = F.row_number().over(whole.orderBy(F.desc("gap"), F.col("place").asc()))
    told = F.when((F.col("gap") >= LEAST_GAP) & (F.col("rank") <= MOST_GAPS), F.col("rank"))
    return rows.withColumn("rank", rank).select("query_id", F.col("o").alias("item"), F.col("s").alias("required_by"), "p", "gap", told.alias("place"), F.count("*").over(whole).alias("n_required"), F.avg("gap").over(whole).alias("mean_gap"))


def coverage(edges: DataFrame, parts: tuple | None = None) -> DataFrame:
    """query_id, missing, coverage, confidence: the gaps, worst first, and the share of needed items that aren't among them; all of it where nothing is needed.

    Gaps have four places and a packet's confidence three, so sums are kept as whole numbers and divided once.
    """
    parts = parts or ranked(edges)
    sums = gaps(edges, parts).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "item")))), lambda x: x["item"]).alias("missing"),
        (F.count("*") - F.count("place")).alias("held"), F.count("*").alias("n"), F.sum(F.round(F.col("gap") * 10000).cast("long")).alias("total"))
    own, n = F.round(F.col("p.confidence") * 1000).cast("long"), F.col("n")
    sure = F.when(n.isNull(), own * 4 / 10000).otherwise(F.least((own * 10 * n + F.col("total") + 3000 * n) / (20000 * n), F.lit(0.95)))
    return packets(edges, parts).alias("p").join(sums, "query_id", "left").select("query_id", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), F.coalesce(F.col("held") / n, F.lit(1.0)).alias("coverage"), sure.alias("confidence"))


def compare(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """a, b, n_shared, only_a, only_b, similarity, verdict of pairs(a, b), from features(id, p, o, w) that are unique by id, p, o: the sum of the lesser weights over that of the greater.

    A pair without features has a similarity of 0.
    """
    sides = pairs.select("a", "b", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("id")), F.struct(F.lit(1).alias("side"), F.col("b").alias("id")))).alias("x")).select("a", "b", "x.side", "x.id")
    of = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("w"))), F.lit(0.0))
    keys = sides.join(features, "id").groupBy("a", "b", "p", "o").agg(of(0).alias("x"), of(1).alias("y"))
    x, y = F.col("x") > 0, F.col("y") > 0
    sums = keys.groupBy("a", "b").agg(F.count_if(x & y).alias("n_shared"), F.count_if(x & ~y).alias("only_a"), F.count_if(y & ~x).alias("only_b"), (F.sum(F.least("x", "y")) / F.nullif(F.sum(F.greatest("x", "y")), F.lit(0.0))).alias("similarity"))
    filled = pairs.join(sums, ["a", "b"], "left").fillna(0, ["n_shared", "only_a", "only_b", "similarity"])
    s = F.round("similarity", 3)
    return filled.withColumn("verdict", F.when(s >= 0.65, "similar").when(s >= 0.35, "related").when(s >= 0.15, "different").otherwise("distinct"))


def blended(operator: Column, assessed: Column) -> Column:
    """0.7 of the operator's own confidence and 0.3 of that assessed; the latter alone where the operator has none."""
    return F.when(operator > 0, 0.7 * operator + 0.3 * assessed).otherwise(assessed)


def quality(knows_act: Column, complete: Column, sure: Column, continues: Column, uncertainties: Column, public: Column) -> Column:
    """Quality of a response, 0 to 1: whether it is a known speech act, completeness, confidence, whether it goes on from the last act, less what is unsupported or not public."""
    raw = INTENT * F.when(knows_act, 1.0).otherwise(0.2) + COMPLETE * complete + SURE * sure + CONTINUITY * F.when(continues, 0.7).otherwise(0.5)
    raw = raw - UNSUPPORTED * F.least(uncertainties * 0.2, F.lit(1.0)) - RISK * F.when(public, 0.0).otherwise(0.2)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
