"""Repeated passages by longest-previous-factor arrays over shards of anchored segments."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, join_counted, keep

GRAM = 32
PIECE = 1 << 19
MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed hashes of all GRAM-byte strings, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    width, base = 1, MIX
    while width < GRAM:
        h = h[:-width] * base + h[width:]
        width, base = width * 2, base * base
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def segments(raw: bytes, length: int):
    """(anchor hash, start, windows) of each run of windows of `length` bytes with one anchor: the place of their least gram hash, the first of equals.

    Equal windows have equal anchors, so all copies of a window lie in segments of one anchor hash.
    """
    with np.errstate(over="ignore"):
        for at in range(0, len(raw) - length + 1, PIECE):
            part = np.frombuffer(raw[at : at + PIECE + length - 1], np.uint8)
            h = gram_hashes(part)
            width, n = length - GRAM + 1, len(part) - length + 1
            low = np.uint64((1 << 20) - 1)
            key = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
            key[: len(h)] = h & ~low | np.arange(len(h), dtype=np.uint64)
            blocks = key.reshape(-1, width)
            ahead = np.minimum.accumulate(blocks, 1).ravel()
            behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
            place = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
            starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            yield h[place[starts]].view(np.int64), starts + at, np.diff(np.append(starts, n))


def window_ranks(text: bytes, length: int) -> np.ndarray:
    """The rank of the `length` bytes at each place of text among all such strings, by prefix doubling."""
    data = np.frombuffer(text + bytes(length), np.uint8)
    rank = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        rank = rank << np.uint64(8) | data[k : len(data) - 7 + k]
    rank, width = np.unique(rank, return_inverse=True)[1].astype(np.uint64), 8
    while width < length:
        step = min(width, length - width)
        both = rank[:-step] * np.uint64(len(data)) + rank[step:]
        rank, width = np.unique(both, return_inverse=True)[1].astype(np.uint64), width + step
    return rank[: len(text)].astype(np.int64)


def factors(text: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes at starts (ascending): has it an earlier match of `length` bytes, and an earlier or later one.

    Suffixes stand in suffix order, cut at `length` bytes, equals by place. A longest previous factor is the longer match with the previous and the next smaller place in that order. For
    factors of `length` or more only the run of equals counts: there the suffix before is the previous smaller place, and a next smaller one does not exist.
    """
    rank = window_ranks(text, length)[starts]
    order = np.argsort(rank, kind="stable")
    same = rank[order][1:] == rank[order][:-1]
    earlier, later = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    earlier[order[1:][same]] = True
    later[order[:-1][same]] = True
    return earlier, earlier | later


def runs(places: np.ndarray) -> list[dict]:
    """Ascending places as runs lo to hi (exclusive)."""
    ends = np.flatnonzero(np.diff(places) != 1)
    lo, hi = places[np.concatenate(([0], ends + 1))] if len(places) else places, places[np.concatenate((ends, [len(places) - 1]))] + 1 if len(places) else places
    return [{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist())]


def crowded(pieces: DataFrame, length: int, keep_first: bool, width: int = 20) -> DataFrame:
    """anchor, seg, at (runs lo to hi) of what comes twice in pieces(anchor, seg, doc_id, _sig, start, n, part) of crowded anchors, without gathering an anchor.

    Ranges of up to `width` windows, cut by their offset to the anchor, are compared by hashes (128 bits) of what all their windows share (core) and of all they cover (union). Equal unions settle a range; where unions differ about one core, the windows
    of one range for each union are compared by their hashes.
    """
    import xxhash

    kinds = dict(pieces.dtypes)
    names = f"anchor long, seg long, doc_id {kinds['doc_id']}, _sig long, start long"

    def split(batches):
        for b in batches:
            out = {k: [] for k in ("row", "lo", "hi", "core", "union")}
            for row, (anchor, n, part) in enumerate(zip(b["anchor"].to_pylist(), b["n"].to_pylist(), b["part"])):
                raw = part.as_py()
                with np.errstate(over="ignore"):
                    place = int(np.flatnonzero(gram_hashes(np.frombuffer(raw, np.uint8)).view(np.int64) == anchor)[0])
                for cell in range(max(0, place - n + 1) // width, place // width + 1):  # by the anchor's offset in the window
                    near, far = cell * width, min(cell * width + width - 1, length - GRAM)
                    lo, hi = max(0, place - far), min(n, place - near + 1)
                    for k, v in zip(out, (row, lo, hi, xxhash.xxh3_128_digest(raw[place - near : place - far + length]), xxhash.xxh3_128_digest(raw[lo : hi - 1 + length]))):
                        out[k].append(v)
            row = out.pop("row")
            yield {k: b[k].take(row) for k in ("anchor", "seg", "doc_id", "_sig", "start")} | out

    def windows(batches):
        for b in batches:
            out = {k: [] for k in ("row", "at", "hash")}
            for row, (lo, hi, part) in enumerate(zip(b["lo"].to_pylist(), b["hi"].to_pylist(), b["part"])):
                raw = part.as_py()
                for at in range(lo, hi):
                    for k, v in zip(out, (row, at, xxhash.xxh3_128_digest(raw[at : at + length]))):
                        out[k].append(v)
            row = out.pop("row")
            yield {k: b[k].take(row) for k in ("anchor", "seg", "doc_id", "_sig", "start")} | out

    ranges = keep(arrow_map(pieces.select("anchor", "seg", "doc_id", "_sig", "start", "n", "part"), split, f"{names}, lo int, hi int, core binary, union binary"))
    ranges = ranges.withColumn("order", F.struct("doc_id", "_sig", "start", "lo"))
    unions = keep(ranges.groupBy("anchor", "core", "union").agg(F.count("*").alias("copies"), F.min("order").alias("least"), F.min_by(F.struct("seg", "lo", "hi"), "order").alias("own")))
    settled = join_counted(ranges, unions.where("copies > 1").select("anchor", "core", "union", "least", "copies"), ["anchor", "core", "union"], "copies")
    settled = settled.where((F.col("order") > F.col("least")) if keep_first else F.lit(True)).select("anchor", "seg", "lo", "hi")
    split_cores = keep(unions.groupBy("anchor", "core").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    open_ = join_counted(unions.drop("copies", "least"), split_cores, ["anchor", "core"], "kinds").select("anchor", "own.*").join(pieces, ["anchor", "seg"])
    each = arrow_map(open_.select("anchor", "seg", "doc_id", "_sig", "start", "lo", "hi", "part"), windows, f"{names}, at int, hash binary").withColumn("order", F.struct("doc_id", "_sig", "start", "at"))
    each = keep(each)
    twice = keep(each.groupBy("anchor", "hash").agg(F.count("*").alias("c"), F.min("order").alias("first")).where("c > 1"))
    found = join_counted(each, twice, ["anchor", "hash"], "c").where((F.col("order") > F.col("first")) if keep_first else F.lit(True))
    found = settled.union(found.select("anchor", "seg", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi")))
    found = found.groupBy("anchor", "seg").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("at"))  # a segment has under `length` windows
    return found.withColumn("at", joined_runs("at"))


def joined_runs(column: str):
    """A sorted array of struct<lo:int,hi:int> with those that touch or overlap made one."""
    none = F.array().cast("array<struct<lo:int,hi:int>>")

    def add(done, x):
        last = F.element_at(done, -1)
        longer = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))
        return F.when((F.size(done) > 0) & (x["lo"] <= F.try_element_at(done, F.lit(-1))["hi"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(column, none, add)


def spans(docs: DataFrame, length: int = 400, keep_first: bool = False, shard_bytes: int = 1_500_000, hot: int = 64) -> DataFrame:
    """doc_id, _sig, spans (sorted array of from, to in bytes): what to remove of each text that loses something.

    Segments that come twice are found by counting hashes of their bytes (64 bits beside the anchor's 64). Segments that share their anchor only are gathered by anchor in shards of about shard_bytes, whose suffixes are sorted. An anchor with
    more than `hot` different segments is not gathered: see crowded.
    """
    import xxhash

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text").withColumn("_sig", F.xxhash64("text")).where(F.octet_length("text") >= length)

    def cut(batches):
        for b in batches:
            names, sigs = b["doc_id"].to_pylist(), b["_sig"].to_pylist()
            out, held = {k: [] for k in ("doc_id", "_sig", "anchor", "seg", "start", "n")}, 0
            for name, sig, text in zip(names, sigs, b["text"]):
                raw = text.as_py().encode()
                for anchor, start, n in segments(raw, length):
                    out["anchor"].append(anchor)
                    out["start"].append(start)
                    out["n"].append(n)
                    out["seg"] += [xxhash.xxh3_64_intdigest(raw[s : s + k + length - 1]) for s, k in zip(start.tolist(), n.tolist())]
                    out["doc_id"] += [name] * len(n)
                    out["_sig"] += [sig] * len(n)
                held += len(raw)
                if held > 8_000_000:
                    yield _block(out)
                    out, held = {k: [] for k in out}, 0
            yield _block(out)

    def _block(out):
        return out | {"seg": np.array(out["seg"], np.uint64).view(np.int64)} | {k: np.concatenate(out[k]) if out[k] else [] for k in ("anchor", "start", "n")}

    cuts = keep(arrow_map(rows, cut, f"doc_id {kind}, _sig long, anchor long, seg long, start long, n int"))
    again = keep(cuts.groupBy("anchor").agg(F.count("*").alias("_c")).where("_c > 1"))
    cuts = keep(join_counted(cuts, again, ["anchor"], "_c").drop("_c"))  # the rest comes once
    each = cuts.groupBy("anchor", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "_sig", "start", "n")).alias("first"))
    each = keep(each)
    wide = keep(each.groupBy("anchor").agg(F.count("*").alias("segs")).where("segs > 1"))
    edges = keep(join_counted(each, wide, ["anchor"], "segs").select("anchor", "seg", "segs", "first.*"))
    size = edges.agg(F.sum(F.col("n") + length - 1)).first()[0]
    shards = max(1, -(-(size or 0) // shard_bytes))
    wanted = edges.groupBy(F.struct("doc_id", "_sig").alias("_id")).agg(F.collect_list(F.struct("anchor", "seg", "start", "n", (F.col("segs") > hot).alias("hot"))).alias("wanted"))
    found = rows.withColumn("_id", F.struct("doc_id", "_sig")).join(wanted, "_id").dropDuplicates(["_id"])

    def fetch(batches):
        for b in batches:
            for name, sig, text, want in zip(b["doc_id"].to_pylist(), b["_sig"].to_pylist(), b["text"], b["wanted"]):
                raw, want = text.as_py().encode(), want.as_py()
                yield {k: [w[k] for w in want] for k in ("anchor", "seg", "start", "n", "hot")} | {"doc_id": [name] * len(want), "_sig": [sig] * len(want), "part": [raw[w["start"] : w["start"] + w["n"] + length - 1] for w in want]}

    pieces = keep(arrow_map(found.select("doc_id", "_sig", "text", "wanted"), fetch, f"anchor long, seg long, doc_id {kind}, _sig long, start long, n int, hot boolean, part binary"))

    ranges = "at array<struct<lo:int,hi:int>>"

    def shard(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["doc_id", "_sig", "start"])
        n, sizes = x["n"].to_numpy(np.int64), x["part"].str.len().to_numpy(np.int64)
        base = np.cumsum(sizes) - sizes
        starts = np.concatenate([np.arange(b, b + k) for b, k in zip(base, n)])
        flags = factors(b"".join(x["part"]), starts, length)[0 if keep_first else 1]
        cuts_ = np.cumsum(n)[:-1]
        return pd.DataFrame({"anchor": x["anchor"], "seg": x["seg"], "at": [runs(np.flatnonzero(f)) for f in np.split(flags, cuts_)]})

    cold = pieces.where("NOT hot").withColumn("_shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("_shard").applyInPandas(shard, f"anchor long, seg long, {ranges}")
    warm = crowded(pieces.where("hot"), length, keep_first)
    partial = cold.union(warm).where(F.size("at") > 0)
    marks = keep(each.join(partial, ["anchor", "seg"], "left").where("copies > 1 OR at IS NOT NULL"))
    is_first = (F.struct("doc_id", "_sig", "start", "n") == F.col("first")) if keep_first else F.lit(False)
    start = F.col("start").cast("long")
    whole = F.array(F.struct(start.alias("lo"), (start + F.col("n") - 1 + length).alias("hi")))
    parts = F.transform(F.coalesce("at", F.array().cast(ranges[3:])), lambda x: F.struct((start + x["lo"]).alias("lo"), (start + x["hi"] - 1 + length).alias("hi")))
    found = join_counted(cuts, marks, ["anchor", "seg"], "copies").select("doc_id", "_sig", F.when((F.col("copies") > 1) & ~is_first, whole).otherwise(parts).alias("spans"))
    found = found.where(F.size("spans") > 0).groupBy("doc_id", "_sig").agg(F.collect_set("spans").alias("spans"))  # a text has no more segments than bytes; repeated rows add none
    return found.select("doc_id", "_sig", F.sort_array(F.flatten("spans")).alias("spans"))


def _merged(found: list) -> list[tuple[int, int]]:
    out: list = []
    for s in found:
        if out and s["lo"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["hi"]))
        else:
            out.append((s["lo"], s["hi"]))
    return out


def remove(docs: DataFrame, length: int = 400, keep_first: bool = True, **sizes) -> DataFrame:
    """doc_id, text (without the repeated bytes; a character that is cut goes), n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text).

    A byte goes if a string of `length` bytes over it also starts elsewhere, in this or another document; with keep_first, if it starts earlier (by doc_id, null first, then the text's hash, then place). Null texts are empty. Repeated rows are
    told apart by their count only: each is a place of its own, and keep_first treats them alike, as first or as copies. Very long texts are read whole, in pieces that overlap. Rows without a doc_id are rows like any other. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    gone = keep(spans(docs, length, keep_first, **sizes)).withColumnsRenamed({"doc_id": "_d", "_sig": "_s"})
    rows = docs.select("doc_id", "text").withColumn("_sig", F.xxhash64("text"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_sig") == F.col("_s")), "left").select("doc_id", "text", "spans")

    def each(batches):
        for b in batches:
            out = {k: [] for k in ("text", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for text, found in zip(b["text"], b["spans"]):
                raw, merged = (text.as_py() or "").encode(), _merged(found.as_py() or [])
                kept, at = [], 0
                for lo, hi in merged:
                    kept.append(raw[at:lo])
                    at = hi
                left = b"".join([*kept, raw[at:]])
                for k, v in zip(out, (left.decode("utf-8", "ignore"), len(raw), len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest())):
                    out[k].append(v)
            yield {"doc_id": b["doc_id"]} | out

    return arrow_map(rows, each, f"doc_id {kind}, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
