"""Items seen in frames, relations between them, and concepts named together."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(seen: DataFrame) -> DataFrame:
    """stream, frame, item, change (appeared, disappeared) from seen(stream, frame, item), unique rows with whole-numbered frames.

    What is there in a stream's last frame doesn't disappear. Windows are by stream and item, so that a long stream spreads.
    """
    last = seen.groupBy("stream").agg(F.max("frame").alias("last"))
    w = Window.partitionBy("stream", "item").orderBy("frame")
    runs = seen.withColumns({"before": F.lag("frame").over(w), "after": F.lead("frame").over(w)}).join(last, "stream")
    frame = F.col("frame")
    begins = F.when(F.col("before").isNull() | (F.col("before") < frame - 1), F.struct(frame.alias("frame"), F.lit("appeared").alias("change")))
    ends = F.when((F.col("after").isNull() | (F.col("after") > frame + 1)) & (frame < F.col("last")), F.struct((frame + 1).alias("frame"), F.lit("disappeared").alias("change")))
    return runs.select("stream", "item", F.explode(F.array_compact(F.array(begins, ends))).alias("x")).select("stream", "x.frame", "item", "x.change")


def label(item: Column) -> Column:
    """The item's name without what follows its last underscore."""
    return F.regexp_replace(item, "_[^_]*$", "")


def event_type(item: Column, change: Column, animate: list[str], vehicles: list[str]) -> Column:
    """The typed event of an appearance or a disappearance."""
    came, name = change == "appeared", label(item)
    say = lambda yes, no: F.concat(name, F.when(came, yes).otherwise(no))
    return F.when(name.isin(animate), say("_entered", "_left")).when(name.isin(vehicles), say("_appeared", "_departed")).otherwise(F.concat(F.when(came, "object_detected:").otherwise("object_removed:"), name))


def projected(relations: DataFrame, predicates: dict[str, str], source: str) -> DataFrame:
    """s, p, o, source, usage_count, confidence (the greatest) of relations(subject, predicate, object, confidence) between instances, told of their labels; predicates outside the map stay."""
    known = F.create_map(*[F.lit(x) for pair in predicates.items() for x in pair])
    p = F.coalesce(F.try_element_at(known, F.col("predicate")), F.col("predicate"))
    return relations.groupBy(label(F.col("subject")).alias("s"), p.alias("p"), label(F.col("object")).alias("o")).agg(F.count("*").alias("usage_count"), F.max("confidence").alias("confidence")).withColumn("source", F.lit(source))


def cooccurrences(concepts: DataFrame, least: float = 0.5, k: int = 8, domain: str = "general") -> DataFrame:
    """s, o, domain, seen_count: pairs of a document's k best concepts(doc, position, name, level, score), the better one first (ties: by position, then name); k bounds what is gathered of a document.

    The domain is the best of them that has level 0, in lower case with underscores. Concepts without a name, or with less than the least score, don't count.
    """
    best = Window.partitionBy("doc").orderBy(F.desc("score"), "position", "name")
    top = concepts.where((F.col("score") >= least) & (F.coalesce("name", F.lit("")) != "")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    held = top.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("place", "name", "level"))).alias("c"))
    heads = F.filter("c", lambda x: x["level"] == 0)
    name = F.when(F.size(heads) > 0, F.replace(F.lower(F.try_element_at(heads, F.lit(1))["name"]), F.lit(" "), F.lit("_"))).otherwise(domain)
    pairs = F.flatten(F.transform("c", lambda x: F.transform(F.filter("c", lambda y: y["place"] > x["place"]), lambda y: F.struct(x["name"].alias("s"), y["name"].alias("o")))))
    return held.select(name.alias("domain"), F.explode(pairs).alias("x")).groupBy("x.s", "x.o", "domain").agg(F.count("*").alias("seen_count"))


def training_samples(rows: DataFrame, known: DataFrame, least: float = 0.75) -> DataFrame:
    """id, quality of rows(id, confidence, agrees, outcome) not known(id) yet: a confidence of at least `least`, 0.05 more if the engine agrees and 0.10 if validated, 1 at most."""
    quality = F.col("confidence") + F.when(F.col("agrees"), 0.05).otherwise(0.0) + F.when(F.col("outcome") == "validated", 0.10).otherwise(0.0)
    return rows.where(F.col("confidence") >= least).join(known, "id", "left_anti").select("id", F.least(quality, F.lit(1.0)).alias("quality"))
