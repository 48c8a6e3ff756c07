"""Temporal operators, as batch plans and as Structured Streaming plans."""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sequences(events: DataFrame, n: int = 3) -> DataFrame:
    """Counts of n event types in a row, for each user in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select(*[(F.lead("event_type", i).over(w) if i else F.col("event_type")).alias(f"event_{i + 1}") for i in range(n)])
    return rows.dropna().groupBy(*rows.columns).agg(F.count("*").alias("frequency"))


def predictions(counts: DataFrame, k: int = 3) -> DataFrame:
    """The k likeliest next events after each pair, each with its share of their frequencies."""
    pair = Window.partitionBy("event_1", "event_2")
    top = counts.withColumn("place", F.row_number().over(pair.orderBy(F.desc("frequency"), "event_3"))).where(F.col("place") <= k)
    return top.withColumn("confidence", F.col("frequency") / F.sum("frequency").over(pair))


def _fires(times: list, last, gap: int):
    out = []
    for t in times:
        fire = last is None or t - last >= gap
        last = t if fire else last
        out.append(fire)
    return out, last


def suppress(events: DataFrame, gap: int) -> DataFrame:
    """event_id, user_id, event_type, second, fired: of each user's events of a type, one fires only gap seconds or more after the last that fired.

    After a silence of gap or more an event always fires, so each run between such silences is suppressed on its own, and a busy user spreads over many tasks.
    """

    def each(batches):
        key, last = None, None
        for b in batches:
            fired = []
            for user, kind, run, second in zip(b["user_id"].tolist(), b["event_type"].tolist(), b["run"].tolist(), b["second"].tolist()):
                if (user, kind, run) != key:
                    key, last = (user, kind, run), None
                fire = last is None or second - last >= gap
                last = second if fire else last
                fired.append(fire)
            yield b.drop(columns="run").assign(fired=fired)

    rows = events.select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"))
    w = Window.partitionBy("user_id", "event_type").orderBy("second", "event_id")
    silent = F.coalesce(F.col("second") - F.lag("second").over(w) >= gap, F.lit(True))
    runs = rows.withColumn("_s", silent).withColumn("run", F.max(F.when(F.col("_s"), F.struct("second", "event_id"))).over(w)["event_id"]).drop("_s")
    dealt = runs.repartition("user_id", "event_type", "run").sortWithinPartitions("user_id", "event_type", "run", "second", "event_id")
    return dealt.mapInPandas(each, "event_id long, user_id long, event_type string, second long, fired boolean")


def suppress_stream(events: DataFrame, gap: int) -> DataFrame:
    """The same over a stream whose events come in order; the state is the second of the last that fired."""

    def each(key, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        for x in frames:
            x = x.sort_values(["second", "event_id"])
            x["fired"], last = _fires(x["second"].tolist(), last, gap)
            yield x
        if last is not None:
            state.update((int(last),))

    rows = events.select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"))
    return rows.groupBy("user_id", "event_type").applyInPandasWithState(each, "event_id long, user_id long, event_type string, second long, fired boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """Counts and sums by event type in tumbling windows; with late, rows behind the watermark are left out (streams)."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def trailing(events: DataFrame, failed, hours: int = 24) -> DataFrame:
    """user_id, hour (epoch second it begins at), n, failed, rate: of each hour with events, the failures of the `hours` up to it. Hours are counted first, so a busy user is a row for each hour."""
    hour = F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    h = events.groupBy("user_id", hour.alias("hour")).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"))
    w = Window.partitionBy("user_id").orderBy("hour").rangeBetween(-3600 * (hours - 1), 0)
    h = h.withColumns({c: F.sum(c).over(w) for c in ("n", "failed")})
    return h.withColumn("rate", F.col("failed") / F.col("n"))


def anomalies(counts: DataFrame, least: int = 3) -> DataFrame:
    """Pairs of neighbours in sequences that come under `least` times, with score 1 - frequency / least."""
    pairs = counts.select("event_1", "event_2", "frequency").union(counts.select("event_2", "event_3", "frequency"))
    pairs = pairs.groupBy("event_1", "event_2").agg(F.sum("frequency").alias("frequency"))
    return pairs.where(F.col("frequency") < least).withColumn("score", 1 - F.col("frequency") / least)


def promoted(pending: DataFrame, counts: DataFrame, least: int = 3) -> DataFrame:
    """event_1, event_2, frequency of pending(event_1, event_2) that sequences hold `least` times or more, at either place."""
    pairs = counts.select("event_1", "event_2", "frequency").union(counts.select("event_2", "event_3", "frequency")).groupBy("event_1", "event_2").agg(F.sum("frequency").alias("frequency"))
    return pending.distinct().join(pairs, ["event_1", "event_2"]).where(F.col("frequency") >= least)


def alive(state: DataFrame, last: str, ttl: str, now: DataFrame) -> DataFrame:
    """The rows of state that have not expired `ttl` after their time in `last`, as of now(now), one row."""
    return state.crossJoin(F.broadcast(now)).where(F.col(last) + F.expr(f"INTERVAL {ttl}") > F.col("now")).drop("now")


def alive_stream(events: DataFrame, ttl: str) -> DataFrame:
    """The same over a stream: counts by user and type whose state the watermark drops `ttl` after its last event."""
    return events.withWatermark("ts", ttl).groupBy("user_id", "event_type", F.session_window("ts", ttl)).agg(F.count("*").alias("n")).select("user_id", "event_type", F.col("session_window.start").alias("start"), "n")


def drain(spark, folder: str, schema: str, out: str, checkpoint: str) -> None:
    """Appends to out what (gzipped) files of JSON lines in folder hold that no earlier call has read; the checkpoint is the ledger of files."""
    rows = spark.readStream.schema(schema).json(folder)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
