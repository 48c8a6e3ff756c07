"""Stateful operators against plain Python, streams against their batch twins, and sources over small files."""

import json
import math

import numpy as np

from tripleweft.operators import graph, sessions
from tripleweft.sources import sinks, storage, tables
from tripleweft.streaming import events as temporal


def brute_tracks(rows, reach=80.0, patience=5):
    """stream, frame, id, track, frame by frame over one list of tracks a stream."""
    out = []
    for stream in {r[0] for r in rows}:
        tracks = []
        for frame in sorted({r[1] for r in rows if r[0] == stream}):
            tracks = [t for t in tracks if frame - t[4] <= patience + 1]
            free = sorted(r for r in rows if r[0] == stream and r[1] == frame)
            for t in tracks:
                near = [(math.hypot(r[4] - t[2], r[5] - t[3]), r) for r in free if r[3] == t[1]]
                if near and min(near)[0] <= reach:
                    r = min(near)[1]
                    free.remove(r)
                    t[2:] = [r[4], r[5], frame]
                    out.append((stream, frame, r[2], t[0]))
            for r in free:
                tracks.append([r[2], r[3], r[4], r[5], frame])
                out.append((stream, frame, r[2], r[2]))
    return sorted(out)


def test_tracks(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), int(f), k, str(rng.choice(["cat", "cup"])), float(rng.integers(0, 300)), float(rng.integers(0, 300))) for k, (s, f) in enumerate(rng.integers((0, 0), (2, 60), (160, 2)))]
    got = sessions.track(spark.createDataFrame(rows, "stream int, frame int, id long, label string, x double, y double"))
    assert sorted(tuple(r) for r in got.collect()) == brute_tracks(rows)
    assert sessions.track(spark.createDataFrame([], "stream int, frame int, id long, label string, x double, y double")).count() == 0


def test_suppression_over_a_stream(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(k, int(u), "ab"[t], 1_700_000_000 + 40 * k) for k, (u, t) in enumerate(rng.integers((0, 0), (3, 2), (90, 2)).tolist())]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s long").selectExpr("event_id", "user_id", "event_type", "timestamp_seconds(s) AS ts")
    want = sorted(tuple(r) for r in temporal.suppress(events, 300).collect())
    last, plain = {}, []
    for k, u, t, s in rows:
        fired = s - last.get((u, t), -300) >= 300
        last[(u, t)] = s if fired else last.get((u, t))
        plain.append((k, u, t, s, fired))
    assert want == sorted(plain)
    for i in range(3):  # three files, in order
        events.where(f"event_id DIV 30 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    temporal.suppress_stream(stream, 300).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(100)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_files_are_drained_once(spark, tmp_path):
    folders = [str(tmp_path / x) for x in ("in", "out", "check")]
    spark.range(5).write.option("compression", "gzip").mode("append").json(folders[0])
    temporal.drain(spark, folders[0], "id long", folders[1], folders[2])
    spark.range(5, 8).write.option("compression", "gzip").mode("append").json(folders[0])
    for _ in range(2):
        temporal.drain(spark, folders[0], "id long", folders[1], folders[2])
    assert sorted(r.id for r in spark.read.parquet(folders[1]).collect()) == list(range(8))


def test_whole_chat_files(spark, tmp_path):
    node = lambda role, at, *parts: {"message": {"author": {"role": role}, "create_time": at, "content": {"parts": list(parts)}}}
    chats = [{"title": "t", "create_time": 1.0, "mapping": {"b": node("user", 2.0, "late", "words"), "a": node("assistant", 1.5, "early"), "c": {"message": None}, "d": node("user", 3.0, " ")}}]
    (tmp_path / "c.json").write_text(json.dumps(chats, indent=1))
    assert [(r.place, r.role, r.text) for r in tables.chats(spark, str(tmp_path / "c.json")).orderBy("place").collect()] == [(1, "assistant", "early"), (2, "user", "late words")]


def test_games_with_deep_variations(spark, tmp_path):
    deep = "(" * 9 + "c4" + ")" * 9
    (tmp_path / "g.pgn").write_text(f'[Event "a"]\n[White "w"]\n[Black "b"]\n[Result "1-0"]\n\n1. e4 {{x (y)}} {deep} e5 2. Nf3 1-0\n\n[Event "c"]\n[White "v"]\n[Result "*"]\n\n*\n')
    got = {r.white: (r.black, r.result, r.moves) for r in tables.games(spark, str(tmp_path / "g.pgn")).collect()}
    assert got == {"w": ("b", "1-0", ["e4", "e5", "Nf3"]), "v": ("", "*", [])}


def test_lineage_with_a_circle(spark):
    steps = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x"), ("q", "gone")], "node string, parent string")
    got = {r.node: (r.origin, r.looped) for r in sessions.lineage(steps).collect()}
    assert got == {"a": ("a", False), "b": ("a", False), "c": ("a", False), "x": (None, True), "y": (None, True), "z": (None, True), "q": ("gone", False)}


def test_purge_keeps_what_lies_above(spark):
    tree = spark.createDataFrame([(1, None, True), (2, 1, True), (3, 2, False), (4, 1, True), (5, 4, True)], "id int, parent int, expired boolean")
    assert sorted(r.id for r in sinks.purged(tree).collect()) == [1, 2, 3]


def test_terms_in_order(spark):
    rows = spark.createDataFrame([("the one with words from it",), ("from the with",), ("the with",), ("thewithfrom",), ("",), (None,)], "t string")
    assert [r.ok for r in rows.select(graph.in_order(rows.t, ["the", "with", "from"]).alias("ok")).collect()] == [True, False, False, True, False, False]


def test_truth_floor_lets_bridges_pass(spark):
    e = spark.createDataFrame([("a", "is", "b", "asserted", 0.9, False), ("c", "is", "d", "guess", 0.8, True), ("e", "is", "f", "guess", 0.7, False)], "subject_id string, predicate string, object_id string, local_truth string, local_confidence double, is_bridge boolean")
    assert [(r.X, r.hit_bridge) for r in graph.unify([("?X", "is", "*")], e, truth_floor=["asserted"]).collect()] == [("a", False), ("c", True)]


def test_kept_folders_are_cleared(spark):
    kept = storage.keep(spark.range(3))
    path = kept.inputFiles()[0].rsplit("/", 1)[0]
    storage.clear(spark)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
