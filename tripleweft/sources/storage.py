"""The folder that driver and executors share, where loops cut their lineage."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a new local one in local mode (tests); on a cluster that is an error, since executors would not share it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tripleweft.tmp", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tripleweft-")
        spark.conf.set("tripleweft.tmp", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, which `clear` deletes."""
    _KEPT.append(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _KEPT[-1]


def keep(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, columns can be pruned, and a lost executor costs no earlier round."""
    path = shared_path(df.sparkSession, "kept")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what this driver's operators have left in the shared folder; call it once their results have been read."""
    jvm = spark.sparkContext._jvm
    while _KEPT:
        path = jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
