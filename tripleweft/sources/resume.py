"""Aggregation by ranges of a key that goes on where a killed run stopped."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import chunk


def _fs(spark, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def ranges_done(spark, folder: str) -> list[str]:
    """The ranges in folder whose state is whole: Spark's committer marks a folder once all of its files are in place, so the mark is the ledger's entry and can't be there without the state."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path):
        return []
    jvm = spark.sparkContext._jvm
    names = [x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()]
    return sorted(n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def aggregate_ranges(rows: DataFrame, key: str, size: int, folder: str, partial: Callable[[DataFrame], DataFrame], most: int | None = None) -> int:
    """Writes partial(rows of a range) for each range of `size` values of key (a whole number) to a folder of its own, but for ranges that are done; returns how many were written. With most, it stops after so many.

    Rows without a key belong to no range and make one of their own. A range that a killed run left half written is written anew. Ranges are cut from the least key on, so rows that come with greater keys
    later are new ranges, and the last range, which they may fill up, is told apart by its end. partial must give rows that can be merged: sums, counts, extremes.
    """
    spark = rows.sparkSession
    low, high, blank = rows.agg(F.min(key), F.max(key), F.count_if(F.col(key).isNull())).first()
    wanted = [] if low is None else [(a, min(a + size - 1, high)) for a in range(low // size * size, high + 1, size)]
    names = [(f"range={a}_{b}", lambda a=a, b=b: chunk(rows, key, a - 1, b - a + 1)) for a, b in wanted]
    names += [("range=null", lambda: rows.where(F.col(key).isNull()))] if blank else []
    done, written = set(ranges_done(spark, folder)), 0
    fs, _ = _fs(spark, folder)
    for name, part in names:
        if name in done:
            continue
        if most is not None and written == most:
            break
        partial(part()).write.mode("overwrite").parquet(f"{folder}/{name}")
        written += 1
        for old in done:
            if name.split("_")[0] == old.split("_")[0]:  # the same range with an earlier end
                fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{old}"), True)
    return written


def merged_ranges(spark, folder: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """merge(the states of all ranges that are done)."""
    return merge(spark.read.parquet(*[f"{folder}/{n}" for n in ranges_done(spark, folder)]))
