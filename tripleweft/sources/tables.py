"""Tables and text sources."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw edges of a knowledge graph: parts and suppliers, one edge for each line of an order."""
    predicate = F.when(F.col("l_returnflag") == "A", "causes").when(F.col("l_returnflag") == "N", "requires").otherwise("inhibits")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), "l_partkey").alias("subject_id"), predicate.alias("predicate"), F.concat(F.lit("s"), "l_suppkey").alias("object_id"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(None)).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit(" "), "l_linestatus")).otherwise(F.col("l_linestatus")).alias("domain_tags"),
        F.col("l_linestatus").alias("edge_type"), F.when(F.col("l_linenumber") > 5, F.lit(None)).otherwise(F.col("l_linenumber").cast("long")).alias("seen_count"),
        F.lit(None).cast("long").alias("evidence_count"), (F.col("l_discount") * 10).alias("confidence"), F.col("l_tax").alias("edge_weight"),
        F.when(F.col("l_tax") > 0.04, "+").otherwise("-").alias("polarity"), F.col("l_orderkey").alias("capsule_id"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes: id, canonical, maturity, domain."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("canonical"), F.col("p_retailprice").alias("maturity"), F.col("p_brand").alias("domain"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("canonical"), F.col("s_acctbal").alias("maturity"), F.col("s_nationkey").cast("string").alias("domain"))
    return parts.unionByName(suppliers)


def triples(spark: SparkSession, path: str) -> DataFrame:
    """subject, predicate, object of lines `s p o` or `s p o | anything`; shorter lines are left out."""
    parts = F.split(F.trim(F.split("value", "\\|")[0]), "\\s+")
    return spark.read.text(path).select(parts.alias("w")).where(F.size("w") >= 3).select(F.col("w")[0].alias("subject"), F.col("w")[1].alias("predicate"), F.array_join(F.slice("w", F.lit(3), F.size("w") - 2), " ").alias("object"))


def braid(spark: SparkSession, path: str) -> DataFrame:
    """src, rel, dst, weight of lines `src | rel | dst | weight`."""
    parts = F.transform(F.split("value", "\\|"), lambda x: F.trim(x))
    return spark.read.text(path).where(~F.col("value").startswith("@")).select(parts.alias("w")).where(F.size("w") == 4).select(*[F.get("w", i).alias(k) for i, k in enumerate(("src", "rel", "dst"))], F.get("w", F.lit(3)).try_cast("double").alias("weight"))


def bridges(spark: SparkSession, path: str) -> DataFrame:
    """a, b, resonance, ok of lines `A ↔ B [resonance: x]`; lines of another form have ok = false."""
    form = "^(.*?)\\s*↔\\s*(.*?)\\s*\\[resonance:\\s*([0-9.]+)\\]\\s*$"
    return spark.read.text(path).select(*[F.regexp_extract("value", form, i + 1).alias(k) for i, k in enumerate(("a", "b", "resonance"))], F.col("value").rlike(form).alias("ok"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of (gzipped) JSON lines; what can't be read keeps its text in _bad, blank lines are skipped."""
    return spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def games(spark: SparkSession, path: str) -> DataFrame:
    """white, black, result, moves of each game in PGN files; comments, annotations and variations of any depth go. Files are split at their [Event tags, so a large file is many rows."""
    text = spark.read.option("lineSep", "[Event ").text(path).select(F.col("value").alias("game")).where(F.col("game").contains("]"))
    tag = lambda k: F.regexp_extract("game", f'\\[{k} "([^"]*)"\\]', 1).alias(k.lower())
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("game", "^[^\\]]*\\]", ""), "(?m)^\\[.*\\]\\s*$", ""), "\\{[^}]*\\}", " ")
    tokens = F.filter(F.split(F.regexp_replace(body, "([()])", " $1 "), "\\s+"), lambda x: x != "")
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))
    step = lambda s, x: F.struct((s["depth"] + F.when(x == "(", 1).when(x == ")", -1).otherwise(0)).alias("depth"), F.when((s["depth"] == 0) & ~x.isin("(", ")"), F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"))
    moves = F.regexp_replace(F.array_join(F.aggregate(tokens, start, step, lambda s: s["kept"]), " "), "\\d+\\.+|\\$\\d+|(^| )(1-0|0-1|1/2-1/2|\\*)(?= |$)", " ")
    return text.select(tag("White"), tag("Black"), tag("Result"), F.filter(F.split(moves, "\\s+"), lambda x: x != "").alias("moves"))


def chats(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """title, role, text, at, place of the messages of chat exports: JSON of title, create_time and a mapping of nodes, whose text parts are joined; by time, then node. With whole_files a file is one array of conversations."""
    message = "struct<message: struct<author: struct<role: string>, create_time: double, content: struct<parts: array<string>>>>"
    c = spark.read.schema(f"title string, create_time double, mapping map<string, {message}>").option("multiLine", whole_files).json(path)
    m = c.select("title", "create_time", F.explode("mapping").alias("node", "x"))
    text = F.trim(F.array_join("x.message.content.parts", " "))
    rows = m.select("title", F.coalesce("x.message.author.role", F.lit("unknown")).alias("role"), text.alias("text"), F.coalesce("x.message.create_time", "create_time").alias("at"), "node").where("text <> ''")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("title").orderBy("at", "node"))).drop("node")


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def trace(spark: SparkSession, path: str, schema: str, key: str, value: str) -> DataFrame:
    """The row of the newest day in a folder of JSON lines by day that has the value; only folders of days are listed, and files are pruned by them."""
    rows = spark.read.schema(f"{schema}, day string").json(path).where(F.col(key) == value)
    return rows.orderBy(F.desc("day")).limit(1)


def not_done(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """The files(path) whose name is not in ledger(name)."""
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(ledger, "name", "left_anti").select("name")


def chunk(rows: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """The rows whose key lies in (after, after + size]: a filter on the column, so row groups outside are not read."""
    return rows.where((F.col(key) > after) & (F.col(key) <= after + size))


def code_blocks(page, tags: str = "pre|code"):
    """array<string>: the text of a page's elements of these tags, markup and prompts removed, character references decoded."""
    blocks = F.regexp_extract_all(page, F.lit(f"(?is)<(?:{tags})(?: [^>]*)?>(.*?)</(?:{tags})>"), F.lit(1))
    plain = lambda x: F.replace(F.replace(F.replace(F.regexp_replace(x, "<[^>]+>", ""), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.filter(F.transform(blocks, lambda x: F.trim(F.regexp_replace(plain(x), "(?m)^(>>>|\\.\\.\\.) ?", ""))), lambda x: (x != "") & (F.length(x) < 3000))


def first_by_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key, the first in the order given."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def columns_of(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """column_name of a table, from its schema; no row is read."""
    return spark.createDataFrame([(c,) for c in rows.columns], "column_name string")
