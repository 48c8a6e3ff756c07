"""Rows in order: tracks, temperatures, lineages, causal links, ladders."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import keep

# How far a track reaches and how long it waits; heat of a repetition and cooling.
MATCH_DISTANCE, MOST_MISSING = 80.0, 5
BASE, HEAT, COOL, HOTTEST = 0.60, 0.25, 0.15, 1.0
# Which event may lead to which, how semantic types map to these, and the reach in frames.
LEADS = {
    "object_entered": ["interaction_start", "placement", "relation_formed", "proximity_start"], "interaction_start": ["interaction_end", "placement", "relation_formed"], "interaction_end": ["placement", "removal", "object_left"],
    "placement": ["removal", "relation_ended", "object_left"], "removal": ["object_left", "relation_ended"], "relation_formed": ["relation_ended", "placement", "interaction_end"],
    "proximity_start": ["interaction_start", "placement", "proximity_end"], "proximity_end": ["relation_ended", "object_left"],
}
BASE_TYPES = {"_entered": "object_entered", "_appeared": "object_entered", "object_detected:": "object_entered", "_left": "object_left", "_departed": "object_left", "object_removed:": "object_left", "_interacts_with_": "interaction_start"}
WINDOW, LEAST_SURE = 10, 0.3
# The states of a unit from draft to benchmarked, what a verdict promotes to, verdicts that fail, and states only a person changes.
LADDER = ["candidate", "verified_static", "verified_runtime", "regression_tested", "benchmarked", "trusted"]
PROMOTES, FAILS, FINAL = {"passed_minimal": "verified_runtime", "passed_verified": "regression_tested", "passed_benchmarked": "benchmarked"}, ["failed_parse", "failed_static", "failed_runtime"], ["deprecated", "quarantined"]


def follow(live: list, free: list, now: int, reach: float, patience: int) -> tuple[list, list]:
    """(live tracks [name, x, y, last frame] after a frame; (id, name) of each of its detections). free: the frame's detections (id, x, y) by id; the oldest live track takes the nearest first."""
    live, left, out = [t for t in live if now - t[3] <= patience + 1], list(free), []
    for t in live:
        if not left:
            break
        far = [np.hypot(x - t[1], y - t[2]) for _, x, y in left]
        k = int(np.argmin(far))
        if far[k] <= reach:
            i, t[1], t[2] = left.pop(k)
            t[3] = now
            out.append((i, t[0]))
    return live + [[i, x, y, now] for i, x, y in left], out + [(i, i) for i, _, _ in left]


def track(detections: DataFrame, reach: float = MATCH_DISTANCE, patience: int = MOST_MISSING) -> DataFrame:
    """stream, frame, id, track of detections(stream, frame, id, label, x, y): each live track, oldest first, takes the nearest free detection of its label within reach (ties: the least id); a track ends after more than `patience` frames without one. A track's name is its first detection's id.

    Labels don't meet, and a silence of more than `patience` + 1 frames ends all tracks of a label, so each run between such silences is followed on its own.
    """
    w = Window.partitionBy("stream", "label").orderBy("frame", "id")
    rows = detections.select("stream", "frame", "id", "label", "x", "y")
    rows = rows.withColumn("_new", F.coalesce(F.col("frame") - F.lag("frame").over(w) > patience + 1, F.lit(True))).withColumn("run", F.max(F.when(F.col("_new"), F.struct("frame", "id"))).over(w)["id"]).drop("_new")
    kinds = dict(detections.dtypes)

    def each(batches):
        key, live, now, free, out = None, [], None, [], []

        def match():
            nonlocal live
            live, found = follow(live, free, now, reach, patience)
            out.extend((key[0], now, i, name) for i, name in found)

        for b in batches:
            for stream, label, run, frame, i, x, y in zip(*[b[c].tolist() for c in ("stream", "label", "run", "frame", "id", "x", "y")]):
                if free and ((stream, label, run) != key or frame != now):
                    match()
                    free = []
                if (stream, label, run) != key:
                    key, live = (stream, label, run), []
                now = frame
                free.append((i, x, y))
            yield pd.DataFrame(out, columns=["stream", "frame", "id", "track"])
            out = []
        if free:
            match()
            yield pd.DataFrame(out, columns=["stream", "frame", "id", "track"])

    dealt = rows.select("stream", "label", "run", "frame", "id", "x", "y").repartition("stream", "label", "run").sortWithinPartitions("stream", "label", "run", "frame", "id")
    return dealt.mapInPandas(each, f"stream {kinds['stream']}, frame {kinds['frame']}, id {kinds['id']}, track {kinds['id']}")


def temperatures(turns: DataFrame, base: float = BASE) -> DataFrame:
    """session, turn, heat of turns(session, turn, said): 0.25 more after each repetition of what was said before (1 at most), 0.15 less after any other turn (base at least). Null repeats nothing.

    Three turns in a row that don't repeat bring any heat back to base, so each run between such places is followed on its own.
    """
    w = Window.partitionBy("session").orderBy("turn")
    rows = turns.withColumn("_r", F.coalesce(F.col("said") == F.lag("said").over(w), F.lit(False)))
    cold = ~(F.lag("_r", 1, False).over(w) | F.lag("_r", 2, False).over(w) | F.lag("_r", 3, False).over(w))
    rows = rows.withColumn("_c", cold).withColumn("run", F.max(F.when(F.col("_c"), F.col("turn"))).over(w))
    kinds = dict(turns.dtypes)

    def each(batches):
        key, heat = None, base
        for b in batches:
            out = []
            for session, run, repeats in zip(b["session"].tolist(), b["run"].tolist(), b["_r"].tolist()):
                if (session, run) != key:
                    key, heat = (session, run), base
                heat = min(HOTTEST, heat + HEAT) if repeats else max(base, heat - COOL)
                out.append(heat)
            yield pd.DataFrame({"session": b["session"], "turn": b["turn"], "heat": out})

    dealt = rows.select("session", "turn", "_r", "run").repartition("session", "run").sortWithinPartitions("session", "run", "turn")
    return dealt.mapInPandas(each, f"session {kinds['session']}, turn {kinds['turn']}, heat double")


def lineage(steps: DataFrame) -> DataFrame:
    """node, origin, looped of steps(node, parent), one row for each node, null parents at origins: the farthest ancestor, by doubling the reach each round. Nodes whose ancestors run in a circle are looped, with a null origin."""
    known = steps.select("node")
    up = keep(steps.join(known.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", F.col("parent").alias("up")).unionByName(
        steps.join(known.select(F.col("node").alias("parent")), "parent", "left_anti").select("node", F.coalesce("parent", "node").alias("up"))))
    roots = keep(up.select(F.col("up").alias("node")).distinct().join(steps.where("parent IS NOT NULL").select("node"), "node", "left_anti"))
    rounds = max(1, int(up.count()).bit_length())
    for _ in range(rounds):
        open_ = up.join(roots, F.col("up") == roots["node"], "left_anti")
        if open_.isEmpty():
            break
        up = keep(up.alias("a").join(up.select(F.col("node").alias("_m"), F.col("up").alias("_u")), F.col("up") == F.col("_m"), "left").select("node", F.coalesce("_u", "up").alias("up")))
    done = up.join(roots.select(F.col("node").alias("up"), F.lit(True).alias("_root")), "up", "left")
    return done.select("node", F.when(F.col("_root"), F.col("up")).alias("origin"), F.col("_root").isNull().alias("looped"))


def base_type(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind.contains(k), F.lit(v)) for k, v in BASE_TYPES.items()], kind)


def causal_links(events: DataFrame, window: int = WINDOW) -> DataFrame:
    """first_id, second_id, shared, confidence of events(stream, id, frame, type, sub, obj) that share an instance, lie within `window` frames of each other, and of which one may lead to the other; the earlier first (ties: by id). shared: the least of common instances.

    Joined by instance and by cells as wide as the window, so a common instance spreads over its frames.
    """
    each = events.select("stream", "id", "frame", base_type(F.col("type")).alias("kind"), F.explode(F.array_distinct(F.array_compact(F.array("sub", "obj")))).alias("instance")).withColumn("cell", F.floor(F.col("frame") / window))
    leads = F.create_map(*[x for k, v in LEADS.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    a = each.where(F.col("kind").isin(*LEADS)).select("stream", "instance", F.col("id").alias("first_id"), F.col("frame").alias("f1"), F.try_element_at(leads, F.col("kind")).alias("_to"), F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"))
    b = each.select("stream", "instance", F.col("id").alias("second_id"), F.col("frame").alias("f2"), "kind", "cell")
    gap = F.col("f2") - F.col("f1")
    pairs = a.join(b, ["stream", "instance", "cell"]).where((gap >= 0) & (gap <= window) & ((gap > 0) | (F.col("first_id") < F.col("second_id"))) & F.array_contains("_to", F.col("kind")))
    sure = F.greatest(F.lit(LEAST_SURE), 1 - F.min(gap) / window * 0.7)
    return pairs.groupBy("stream", "first_id", "second_id").agg(F.min("instance").alias("shared"), sure.alias("confidence"))


def promoted(state: Column, verdict: Column) -> Column:
    """The new state of a unit by its latest verdict; null: no change. A failure fails any state but the final ones; a promotion never goes down the ladder."""
    rank = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, s in enumerate(LADDER) for x in (s, i)]), c), F.lit(-1))
    target = F.try_element_at(F.create_map(*[F.lit(x) for pair in PROMOTES.items() for x in pair]), verdict)
    return F.when(F.coalesce(state.isin(FINAL), F.lit(False)) | verdict.isNull(), None).when(verdict.isin(FAILS), F.when(~state.eqNullSafe(F.lit("failed")), "failed")).when(rank(state) < rank(target), target)


def echoes(rows: DataFrame, common: list[str], least: int = 4, back: int = 3, penalty: float = 0.65) -> DataFrame:
    """session, turn, factor of rows(session, turn, text): `penalty` if a text shares `least` words, common ones aside, with one of the `back` before it; 1 if not."""
    w = Window.partitionBy("session").orderBy("turn").rowsBetween(-back, -1)
    own = rows.withColumn("_w", F.array_distinct(F.filter(F.split(F.lower("text"), "\\s+"), lambda x: (x != "") & ~x.isin(common))))
    own = own.withColumn("_before", F.collect_list("_w").over(w))
    echo = F.exists("_before", lambda b: F.size(F.array_intersect(b, F.col("_w"))) >= least)
    return own.select("session", "turn", F.when(echo, penalty).otherwise(1.0).alias("factor"))
