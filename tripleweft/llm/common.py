"""What several operators share: shared storage, running offsets, components."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import clear, keep, shared_dir, shared_path  # noqa: F401 (the operators take them from here)

#: A word is a run of code points outside \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], count: str) -> DataFrame:
    """The inner join of big and small, whose keys are unique; `count` in small says how many rows of big have the key.

    Keys of more than 20,000 rows and of more than 1/50,000 of all rows (so 50,000 keys at most) are broadcast, and their rows stay where they are; only the others are shuffled, so that no key fills a task. small should be cheap to read again.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    hot = small.where(F.col(count) > max(20_000, total // 50_000))
    if hot.isEmpty():
        return big.join(small, keys)
    there = big.join(F.broadcast(hot), keys)
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small, keys)
    return there.unionByName(rest)


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and whole rows as `_row`, so that no other column's name can clash."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text):
    """array<string> of a text's words; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def with_offsets(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """Adds for each name in sums the sum of its expression over all rows before, in the order given.

    Rows are dealt by range, each range sums its own, and the ranges' totals (a row for each) are summed in turn,
    so no task sees all rows. Rows that tie in every key get any order. Nulls in an expression count 0.
    """
    n = max(1, min(partitions(df.sparkSession), df.count() // 20_000))
    dealt = df.withColumns({f"_{k}": F.coalesce(v, F.lit(0)).cast("long") for k, v in sums.items()})
    dealt = keep(dealt.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_t{k}") for k in sums])
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_b{k}") for k in sums])
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # totals has one row for each of the n ranges
    out = dealt.withColumns({f"_o{k}": F.coalesce(F.sum(f"_{k}").over(own), F.lit(0)) for k in sums}).join(F.broadcast(totals), "_range")
    return out.select(*df.columns, *[(F.col(f"_o{k}") + F.col(f"_b{k}")).alias(k) for k in sums])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges(u, v): the smallest node that can be reached.

    Alternates large and small stars; each node's neighbours are only ever reduced to their minimum, so a hub costs a
    sum of its edges, not a list. Every round is cut off from its lineage in the shared folder.
    """
    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    last, state = None, mark(now)
    while state != last:
        pairs = both(now)
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = pairs.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = keep(small.where("u <> v").distinct())
        last, state = state, mark(now)
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)


def arrow_map(df: DataFrame, each, schema: str) -> DataFrame:
    """mapInArrow where each(batches of column lists) yields dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    to = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for columns in each({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) and x.type == f.type else pa.array(x, f.type) for f in to], schema=to)

    return df.mapInArrow(run, schema)
