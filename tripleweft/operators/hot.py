"""Joins whose keys may hold a large share of all rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_degrees(rows: DataFrame, keyed: DataFrame, key: str, count: str, most: int = 20_000) -> DataFrame:
    """rows joined with keyed, whose keys are unique; `count` in keyed says how many of the rows have the key.

    Keys of more than `most` rows and of more than 1/50,000 of all (so 50,000 keys at most) are broadcast, and their rows stay where they lie; the others are shuffled.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = keyed.where(F.col(count) > max(most, total // 50_000))
    if hot.isEmpty():
        return rows.join(keyed, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
