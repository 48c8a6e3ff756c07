"""Write rules: what an upsert leaves, as plans over the old rows and the new."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old, and the new rows (one for each key) whose key it lacks."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def insert_or_replace(old: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """new rows, the last of each key by order, and the old rows of other keys."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    return old.join(last.select(*key), key, "left_anti").unionByName(last)


def upsert(old: DataFrame, new: DataFrame, key: list[str], merge: dict[str, Column]) -> DataFrame:
    """One row for each key of both, columns merged by the aggregates given."""
    return old.unionByName(new).groupBy(*key).agg(*[c.alias(k) for k, c in merge.items()])


def delete(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(keys.select(*key).distinct(), key, "left_anti")


def update(rows: DataFrame, stats: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """rows with the columns of stats where its key has a value for them."""
    joined = rows.join(stats.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns]), key, "left")
    return reduce(lambda d, c: d.withColumn(c, F.coalesce(f"_new_{c}", c)).drop(f"_new_{c}"), columns, joined)


def first_rule(rules: list[tuple[Column, Column]], rest: Column) -> Column:
    """The value of the first rule whose condition holds; rest if none does."""
    return reduce(lambda c, r: c.when(r[0], r[1]), rules, F).otherwise(rest)


def purged(tree: DataFrame) -> DataFrame:
    """The nodes of tree(id, parent, expired) that stay when expired leaves go, again and again: those that haven't expired, and whatever lies above them."""
    from .storage import keep

    stays = front = keep(tree.where("NOT expired").select("id"))
    up = keep(tree.where("parent IS NOT NULL").select("id", "parent"))
    while True:
        front = keep(front.join(up, "id").select(F.col("parent").alias("id")).distinct().join(stays, "id", "left_anti"))
        if front.isEmpty():
            return stays.join(tree.select("id"), "id", "left_semi")
        stays = keep(stays.union(front))


def strengths(old: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """new rows with `strength`: which time their key comes, those of old counted before; the rank within new is by order."""
    before = old.groupBy(*key).agg(F.count("*").alias("_b"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return new.withColumn("_r", rank).join(before, key, "left").withColumn("strength", F.col("_r") + F.coalesce("_b", F.lit(0))).drop("_r", "_b")


def exported(samples: DataFrame, path: str, batch: str) -> DataFrame:
    """Writes samples(id, instruction, output, exported) not exported before as JSON lines (instruction, input, output) and gives all samples back, marked; rows of this batch carry its name."""
    fresh = samples.where("NOT exported")
    write_jsonl(fresh.select("instruction", F.lit("").alias("input"), "output"), path)
    return samples.select("id", F.lit(True).alias("exported"), F.when(~F.col("exported"), batch).alias("batch"))


def write_jsonl(rows: DataFrame, path: str, *by: str) -> None:
    """Appends JSON lines, a folder for each value of the columns in by."""
    rows.write.mode("append").partitionBy(*by).json(path) if by else rows.write.mode("append").json(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", "\t").option("header", True).csv(path)


def write_report(counts: DataFrame, path: str) -> None:
    """Writes counts(section, name, n) as lines of text: a heading for each section with its sum, then its names, the most frequent first. Sections are dealt by range, so the files in order of name are the report in order."""
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "name"))
    lines = counts.select("section", place.alias("place"), F.format_string("  %s: %d", "name", "n").alias("line"))
    heads = counts.groupBy("section").agg(F.sum("n").alias("n")).select("section", F.lit(0).alias("place"), F.format_string("== %s (%d)", "section", "n").alias("line"))
    rows = lines.unionByName(heads).repartitionByRange("section").sortWithinPartitions("section", "place")
    rows.select("line").write.text(path)


def read_report(spark, path: str) -> DataFrame:
    """number, value: the lines of a report's files in order of name, numbered from 1."""
    rows = spark.read.text(path).select("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_i"), "value")
    by_file = Window.partitionBy("file_name").orderBy("_i")
    rows = rows.withColumn("_n", F.row_number().over(by_file))
    sizes = rows.groupBy("file_name").agg(F.count("*").alias("_c"))
    before = Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = sizes.select("file_name", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    return rows.join(F.broadcast(starts), "file_name").select((F.col("_n") + F.col("_s")).alias("number"), "value")
