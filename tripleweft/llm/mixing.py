"""Mixing sources to target weights by capped water-filling."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, packed, with_offsets, words

KEY = ["source", "_h", "doc_id", "size"]


def _id():
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def targets(sizes: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """sizes(source, source_size) with target: the size of all, shared by weight, at most max_epochs of each source.

    Sources stand by code point, null last, and take the weights in turn. A source whose share exceeds its limit is held at it,
    and what is left is shared again by weight, until no share exceeds its limit. Only two sums a round reach the driver.
    """
    placed = with_offsets(sizes, [F.col("source").asc_nulls_last()], {"_n": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    placed = placed.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * max_epochs).alias("_cap"))
    left, over = placed.agg(F.sum("source_size"), F.sum("_w")).first()
    total, held = left or 0, None
    share = float(left) / over if over else 0.0
    while over:
        full = F.col("_cap").cast("double") < F.lit(share) * F.col("_w")
        used, rest, n = placed.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w"))), F.count_if(full)).first()
        if n == held or not rest:
            break
        held, share = n, float(total - (used or 0)) / rest
    return placed.select("source", "source_size", F.least(F.col("_cap").cast("double"), F.lit(share) * F.col("_w")).alias("target"))


def plan(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents' sizes with their keys, each source's plan).

    The plan has the whole repetitions of every document of a source, and the key up to which documents, in a seeded order,
    are taken once more; the document at the key is taken in part, so a source's words miss its target by less than one.
    """
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    sized = sized.withColumn("_h", F.substring(F.md5(F.concat(F.lit(f"{seed}:"), _id())), 1, 16))
    sized = keep(sized)
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sums, weights, max_epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", (F.floor("target") - F.col("whole") * F.col("source_size")).cast("long"))
    goal = with_offsets(goal, [F.col("source").asc_nulls_last()], {"_start": F.col("source_size")})
    rows = sized.groupBy(*KEY).agg(F.count("*").alias("_m"))
    order = [F.col("source").asc_nulls_last(), F.col("_h"), _id(), F.col("size")]
    rows = with_offsets(rows, order, {"_before": F.col("size") * F.col("_m")})
    few = F.broadcast(goal) if goal.count() <= 100_000 else goal  # a source may hold a third of all rows; broadcast plans leave its rows where they are
    at = rows.alias("r").join(few.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
    before = F.col("_before") - F.col("_start")
    at = at.where((before < F.col("rest")) & (F.col("rest") <= before + F.col("size") * F.col("_m")))
    at = at.select(F.col("r.source").alias("_s"), F.struct("_h", _id(), "size").alias("_cut"), F.floor((F.col("rest") - before) / F.col("_m")).cast("long").alias("_part"))
    goal = goal.join(at, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "whole", "_cut", "_part")
    return sized, keep(goal)


def _taken(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """rows(source, _h, doc_id, size, ...) with whole, extra: words taken beyond the whole repetitions."""
    own = F.struct("_h", _id(), "size")
    goal = goal.withColumnRenamed("source", "_s")
    if goal.count() <= 100_000:  # else the join shuffles
        goal = F.broadcast(goal)
    out = rows.join(goal, F.col("source").eqNullSafe(F.col("_s")))
    return out.withColumn("extra", F.when(F.col("_cut").isNull() | (own > F.col("_cut")), F.lit(0)).when(own < F.col("_cut"), F.col("size")).otherwise(F.col("_part")).cast("long"))


def mix(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs (doc_id, source, text).

    Null or blank texts have size 0 and are taken 0 times; null sources are one source, the last; a source of no words has
    target 0. Repeated rows share one part. Very long texts count whole. An empty table gives an empty result. Other columns are not read.
    """
    sized, goal = plan(docs, weights, max_epochs, seed)
    out = _taken(sized, goal)
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def mixed(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """The rows of docs as often as the mix takes them; the last repetition of one document a source may be its first words only."""
    _, goal = plan(docs, weights, max_epochs, seed)
    text = F.col("_row.text")
    rows = packed(docs, "doc_id", "source").withColumn("size", F.size(words(text)).cast("long"))
    rows = rows.withColumn("_h", F.substring(F.md5(F.concat(F.lit(f"{seed}:"), _id())), 1, 16))
    out = _taken(rows, goal)
    # the words from the start, with the white space between them
    pieces = F.split(text, "(?<=[ \\t-\\r])(?=[^ \\t-\\r])")
    leading = text.rlike("^[ \\t-\\r]").cast("int")
    part = F.array_join(F.slice(pieces, F.lit(1), F.col("extra").cast("int") + leading), "")
    times = F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)
    out = out.withColumn("_t", F.explode(F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.array().cast("array<int>"))))
    cut = (F.col("_t") > F.col("whole")) & (F.col("extra") < F.col("size"))
    changed = {"text": F.when(cut, part).otherwise(text)}
    if "n_chars" in docs.columns:
        own = F.col("_row.n_chars")
        changed["n_chars"] = F.when(cut, F.length(part).cast(dict(docs.dtypes)["n_chars"])).otherwise(own)
    return out.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


ORACLE = """
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (SELECT source, source_size, source_size * 3 AS cap, [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS w FROM src),
ordered AS (SELECT *, CAST(cap AS DOUBLE) / w AS r, sum(cap) OVER s AS caps, sum(w) OVER s AS ws, sum(w) OVER () AS all_w, sum(source_size) OVER () AS total
  FROM placed WINDOW s AS (ORDER BY CAST(cap AS DOUBLE) / w, w, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT CAST(total - (caps - cap) AS DOUBLE) / (all_w - (ws - w)) AS share, r FROM ordered),
level AS (SELECT share FROM levels WHERE share <= r ORDER BY r LIMIT 1),
goal AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), share * w) AS target,
  CASE WHEN source_size > 0 THEN CAST(floor(least(CAST(cap AS DOUBLE), share * w) / source_size) AS BIGINT) ELSE 0 END AS whole FROM placed, level),
rest AS (SELECT *, CAST(floor(target) AS BIGINT) - whole * source_size AS rest FROM goal),
queue AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY substr(md5('7:' || CAST(doc_id AS VARCHAR)), 1, 16), doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM sized)
SELECT q.doc_id, q.size, g.source_size, g.target, CAST(g.whole * q.size + greatest(0, least(q.size, g.rest - q.before)) AS BIGINT) AS taken
FROM queue q JOIN rest g ON q.source IS NOT DISTINCT FROM g.source
"""
