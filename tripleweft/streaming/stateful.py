"""Streams with state of their own: tracks, links between events, lives that expire, passes every few batches. Each has a batch plan that says the same of rows that have come in full."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.sessions import LEADS, LEAST_SURE, MATCH_DISTANCE, MOST_MISSING, WINDOW, base_type, follow

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _own_state(rows: DataFrame) -> None:
    """State variables and timers need the RocksDB state store, which the session is told to use."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _ms(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


class _Tracks(StatefulProcessor):
    """Detections wait in state until the watermark has passed their frame; then frames are followed in order, whatever order they came in."""

    def __init__(self, reach: float, patience: int):
        self.reach, self.patience = reach, patience

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "frame long, id long, x double, y double, due long")
        self.live = handle.getListState("live", "name long, x double, y double, frame long")

    def handleInputRows(self, key, rows, timerValues):
        for x in rows:
            self.waiting.appendList(list(x[["frame", "id", "x", "y", "due"]].itertuples(index=False, name=None)))
            for due in set(x["due"].tolist()):
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready, rest = [r for r in rows if r[4] <= now], [r for r in rows if r[4] > now]
        if not ready:
            return
        live, out = [list(t) for t in self.live.get()], []
        for frame in sorted({r[0] for r in ready}):
            live, found = follow(live, [r[1:4] for r in ready if r[0] == frame], frame, self.reach, self.patience)
            out += [(key[0], frame, i, name) for i, name in found]
        self.live.put([tuple(t) for t in live]) if live else self.live.clear()
        self.waiting.put(rest) if rest else self.waiting.clear()
        yield pd.DataFrame(out, columns=["stream", "frame", "id", "track"])


def track_stream(detections: DataFrame, late: str, reach: float = MATCH_DISTANCE, patience: int = MOST_MISSING) -> DataFrame:
    """stream, frame, id, track: `sessions.track` over a stream of detections(stream, frame, id, label, x, y, ts).

    ts grows with the frame. A frame is followed once the watermark, `late` behind the latest ts, has passed it: rows may come in any order and any batches until then, and are dropped after.
    State is a list of live tracks and one of waiting detections for each stream and label; both are bounded by what a watermark's delay holds, and are found again from the checkpoint.
    """
    _own_state(detections)
    kind = dict(detections.dtypes)["stream"]
    rows = detections.withWatermark("ts", late).select("stream", "label", F.col("frame").cast("long"), F.col("id").cast("long"), F.col("x").cast("double"), F.col("y").cast("double"), _ms("ts").alias("due"), "ts")
    return rows.groupBy("stream", "label").transformWithStateInPandas(_Tracks(reach, patience), f"stream {kind}, frame long, id long, track long", "append", "eventTime")


def causal_links_stream(events: DataFrame, late: str, tick: str = "1 second", window: int = WINDOW) -> DataFrame:
    """stream, first_id, second_id, shared, confidence: `sessions.causal_links` over a stream of events(stream, id, frame, type, sub, obj, ts); a frame lasts `tick`.

    Two views of the stream, each with a watermark `late` behind, are joined by the common instance and an interval of time, so an event leaves the state once no event that may still come lies within `window` frames of it.
    A pair with two common instances is told once, by the lesser one.
    """
    instances = F.array_distinct(F.array_compact(F.array("sub", "obj")))
    each = events.select("stream", "id", "frame", "ts", base_type(F.col("type")).alias("kind"), instances.alias("all"), F.explode(instances).alias("instance"))
    leads = F.create_map(*[x for k, v in LEADS.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    a = each.where(F.col("kind").isin(*LEADS)).select("stream", "instance", F.col("id").alias("first_id"), F.col("frame").alias("f1"), F.col("ts").alias("t1"), F.col("all").alias("all1"), F.try_element_at(leads, F.col("kind")).alias("_to")).withWatermark("t1", late)
    b = each.select(F.col("stream").alias("_stream"), F.col("instance").alias("_instance"), F.col("id").alias("second_id"), F.col("frame").alias("f2"), F.col("ts").alias("t2"), F.col("all").alias("all2"), "kind").withWatermark("t2", late)
    near = F.expr(f"t2 >= t1 AND t2 <= t1 + {window} * INTERVAL {tick}")
    gap = F.col("f2") - F.col("f1")
    pairs = a.join(b, (F.col("stream") == F.col("_stream")) & (F.col("instance") == F.col("_instance")) & near)
    pairs = pairs.where((gap >= 0) & (gap <= window) & ((gap > 0) | (F.col("first_id") < F.col("second_id"))) & F.array_contains("_to", F.col("kind")) & (F.col("instance") == F.array_min(F.array_intersect("all1", "all2"))))
    return pairs.select("stream", "first_id", "second_id", F.col("instance").alias("shared"), F.greatest(F.lit(LEAST_SURE), 1 - gap / window * 0.7).alias("confidence"))


def lives(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """user_id, event_type, started, expired, n: the lives of each user's state of a type. A life ends ttl_seconds after its last event; an event at or after that time begins a new one."""
    w = Window.partitionBy("user_id", "event_type").orderBy("_t")
    rows = events.select("user_id", "event_type", _ms("ts").alias("_t"))
    new = F.coalesce(F.col("_t") - F.lag("_t").over(w) >= 1000 * ttl_seconds, F.lit(True))
    rows = rows.withColumn("_new", new).withColumn("_life", F.max(F.when(F.col("_new"), F.col("_t"))).over(w))
    return rows.groupBy("user_id", "event_type", F.col("_life").alias("started")).agg((F.max("_t") + 1000 * ttl_seconds).alias("expired"), F.count("*").alias("n")).select("user_id", "event_type", "started", "expired", "n")


class _Lives(StatefulProcessor):
    """One life for each key, with a timer at its end; an event puts the end off, or, once it is over, begins another."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle, self.now = handle, handle.getValueState("life", "started long, last long, n long")

    def handleInputRows(self, key, rows, timerValues):
        found = self.now.get() if self.now.exists() else None
        old = found and found[1] + self.ttl
        life, over = found and list(found), []
        for t in sorted(t for x in rows for t in x["t"].tolist()):
            if life and t >= life[1] + self.ttl:
                over.append((*key, life[0], life[1] + self.ttl, life[2]))
                life = None
            life = [min(life[0], t), max(life[1], t), life[2] + 1] if life else [t, t, 1]
        if life[1] + self.ttl != old:
            if old:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(life[1] + self.ttl)
        self.now.update(tuple(life))
        if over:
            yield pd.DataFrame(over, columns=["user_id", "event_type", "started", "expired", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.now.exists():
            started, last, n = self.now.get()
            if last + self.ttl <= expiredTimerInfo.getExpiryTimeInMs():
                self.now.clear()
                yield pd.DataFrame([(*key, started, last + self.ttl, n)], columns=["user_id", "event_type", "started", "expired", "n"])


def lives_stream(events: DataFrame, ttl_seconds: int, late: str) -> DataFrame:
    """The same over a stream, each life as soon as it is known to be over: by the watermark, `late` behind the latest ts, or by the event that begins the next. Events further behind are dropped."""
    _own_state(events)
    kinds = dict(events.dtypes)
    rows = events.withWatermark("ts", late).select("user_id", "event_type", _ms("ts").alias("t"), "ts")
    return rows.groupBy("user_id", "event_type").transformWithStateInPandas(_Lives(1000 * ttl_seconds), f"user_id {kinds['user_id']}, event_type {kinds['event_type']}, started long, expired long, n long", "append", "eventTime")


def _read(spark: SparkSession, folder: str, part: str, before: int) -> DataFrame | None:
    """What lies in the folders part=0 .. part=before-1, or None."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    found = [n for n in names if n.startswith(f"{part}=") and int(n.split("=")[1]) < before]
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/{n}" for n in found]) if found else None


def decided(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The rows that `judged_stream` has taken in, with verdict (null: pending) and score of the pass that decided each."""
    everything = 1 << 62
    rows, verdicts = _read(spark, f"{folder}/taken", "batch", everything), _read(spark, f"{folder}/passes", "pass", everything)
    verdicts = verdicts.select(key, "verdict", "score") if verdicts is not None else rows.where("false").select(key, F.lit("").alias("verdict"), F.lit(0.0).alias("score"))
    return rows.drop("batch").join(verdicts, key, "left")


def judged_stream(rows: DataFrame, key: str, score: Callable[[DataFrame], DataFrame], folder: str, every: int = 50, confirm: float = 0.35, reject: float = 0.1):
    """Starts a query that takes rows in, batch by batch, and every `every` batches judges all that no earlier pass has decided: score(rows) adds the column score; from `confirm` on a row is confirmed, under `reject`
    rejected, and else it stays pending for the next pass.

    Each batch and each pass has a folder of its own, named by the batch's number and overwritten when that batch is run again, and a pass looks only at batches and passes up to its own: so a batch that is replayed
    after a failure changes nothing. Returns the query, which ends when all that is there has been read.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/taken/batch={number}")
        if (number + 1) % every == 0:
            open_ = _read(spark, f"{folder}/taken", "batch", number + 1).drop("batch")
            before = _read(spark, f"{folder}/passes", "pass", number)
            if before is not None:
                open_ = open_.join(before.select(key), key, "left_anti")
            verdict = F.when(F.col("score") >= confirm, "confirmed").when(F.col("score") < reject, "rejected")
            score(open_).select(key, verdict.alias("verdict"), "score").where("verdict IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/passes/pass={number}")

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
