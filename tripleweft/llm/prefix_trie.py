"""Prefix tries of conversations: subtries of one first turn are built in tasks; those too large for one are dealt again by their next turn."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, join_counted, keep, partitions, with_offsets

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def subtries(x: pd.DataFrame) -> pd.DataFrame:
    """The nodes of several subtries. x: rows (g, up, d, parent, s, pos, digest, chars, w, ends), one for each turn of each distinct conversation s from the depth d of its subtrie's top on.

    Children are dictionaries from a turn's digest to a node. A node is made after its parent, so going back over the nodes is a postorder: children's sums are ready before their parent's.
    """
    x = x.sort_values(["g", "s", "pos"])
    above, conv, depth, n, chars, ends, kids, group, tops = [], [], [], [], [], [], [], [], {}
    last, at = None, -1
    columns = [x[k].tolist() for k in ("g", "up", "d", "parent", "s", "pos", "digest", "chars", "w", "ends")]
    for i, (g, _, _, _, s, pos, digest, size, w, end) in enumerate(zip(*columns)):
        if (g, s) != last:
            last, at = (g, s), -1
            below = tops.setdefault(g, {})
        else:
            below = kids[at]
        node = below.get(digest)
        if node is None:
            node = below[digest] = len(conv)
            above.append(at)
            conv.append(s)  # conversations come in ascending order: the first has the least id
            depth.append(pos + 1)
            n.append(0)
            chars.append(size)
            ends.append(None)
            kids.append({})
            group.append(i)
        n[node] += w
        ends[node] = end if end is not None else ends[node]
        at = node
    leaves, saved = [0] * len(conv), [0] * len(conv)
    for i in range(len(conv) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * chars[i]
        if above[i] >= 0:
            leaves[above[i]] += leaves[i]
            saved[above[i]] += saved[i]
    return pd.DataFrame({
        "conv_id": conv, "depth": depth, "parent_conv_id": [conv[a] if a >= 0 else columns[3][r] for a, r in zip(above, group)], "n_convs": n, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved,
        "ends": ends, "up": [columns[1][r] for r in group], "top": [a < 0 for a in above],
    })


def rebuilt(table: DataFrame, block: int, most_shared: int, turn: str) -> tuple[DataFrame, DataFrame]:
    """(conversations: c, len; turns: c, pos, digest, chars, len). Conversation c is the first h turns of conversation c - c % block, then its own after its first h; h = crc32(c) % most_shared."""
    digest = F.md5(F.concat(F.length(F.coalesce("role", F.lit(""))).cast("string"), F.lit(":"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    turns = table.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), F.col(turn).alias("turn"), F.unhex(digest).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    turns = with_offsets(keep(turns), ["c", F.col("turn").asc_nulls_first(), "digest"], {"_at": F.lit(1)})
    turns = keep(turns)
    convs = turns.groupBy("c").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    convs = convs.withColumns({"h": F.crc32(F.col("c").cast("string")) % most_shared, "base": F.col("c") - F.pmod("c", F.lit(block))})
    bases = convs.where("c = base").select(F.col("c").alias("base"), F.col("n").alias("_nb"))
    convs = convs.join(bases, "base", "left").withColumn("shared", F.least("h", F.coalesce("_nb", F.lit(0))))  # a base has at most `block` conversations
    convs = keep(convs.withColumn("len", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("_nb"))
    placed = join_counted(turns, convs.select("c", "n", "_first", "h", "shared", "len", "base"), ["c"], "n").withColumn("_pos", F.col("_at") - F.col("_first"))
    own = placed.where("_pos >= h").select("c", (F.col("shared") + F.col("_pos") - F.col("h")).alias("pos"), "digest", "chars", "len")
    starts = placed.where((F.col("c") == F.col("base")) & (F.col("_pos") < most_shared - 1)).groupBy("base").agg(F.array_sort(F.collect_list(F.struct("_pos", "digest", "chars"))).alias("_start"))  # at most most_shared - 1 turns each
    taken = convs.where("shared > 0").join(starts, "base").select("c", "len", F.posexplode(F.slice("_start", F.lit(1), F.col("shared").cast("int"))).alias("pos", "_t"))
    return convs.select("c", "len"), own.union(taken.select("c", F.col("pos").cast("long"), "_t.digest", "_t.chars", "len"))


def ends_of(copies: DataFrame, chunk: int = 4096) -> DataFrame:
    """key -> ends, the SHA-256 of the ascending ids c of each key of copies(key, c), in decimal and joined by commas.

    Ids are dealt by range and joined to strings of at most `chunk` ids; only for keys of several such strings do they meet in a task, where a running hash takes one after the other.
    """
    placed = with_offsets(copies, ["key", "c"], {"_i": F.lit(1)}).withColumn("_part", F.floor(F.col("_i") / chunk))
    parts = keep(placed.groupBy("key", "_part").agg(F.array_join(F.array_sort(F.collect_list("c")).cast("array<string>"), ",").alias("_ids")))
    counts = parts.groupBy("key").agg(F.count("*").alias("_n"), F.first("_ids").alias("_ids"))
    short = counts.where("_n = 1").select("key", F.sha2("_ids", 256).alias("ends"))
    long_ = parts.join(counts.where("_n > 1").select("key"), "key").repartition("key").sortWithinPartitions("key", "_part")

    def each(batches):
        now, running = None, None
        for b in batches:
            for key, ids in zip(b["key"].to_pylist(), b["_ids"]):
                if key != now:
                    if running:
                        yield {"key": [now], "ends": [running.hexdigest()]}
                    now, running = key, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.as_py().encode())
        if running:
            yield {"key": [now], "ends": [running.hexdigest()]}

    return short.union(arrow_map(long_.select("key", "_part", "_ids"), each, "key string, ends string"))


def trie(table: DataFrame, block: int = 100, most_shared: int = 6, most_rows: int = 200_000, least_rows: int = 200, turn: str = "turn") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie of rebuilt conversations of table (conv_id, turn, role, text).

    Equal conversations are counted once, by the least id. The others are dealt by their first turn's digest. A subtrie of more turns than twice a task's fair share (at least least_rows, at most
    most_rows) is oversized: the turns that all of it shares are nodes of their own, found by grouping, and the rest is dealt again by the next turn, until no subtrie is oversized. The others are
    built in tasks, several to a bucket of bounded size. Sums then go up from the last round to the first.

    Null roles and texts are empty. Turns are ordered by number, null first; those of one number (repeated rows too) by digest. Rows without a conv_id are no conversation and are left out.
    Negative ids belong to the hundred below them. Very long conversations are rows, never lists. An empty table has no conversations and no nodes. Other columns are not read.
    """
    spark = table.sparkSession
    convs, turns = rebuilt(table, block, most_shared, turn)
    turns = keep(turns)
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "pos", "digest"))
    heads = turns.groupBy("c").agg(mark(1).alias("_a"), mark(2).alias("_b"), F.max(F.when(F.col("pos") == 0, F.col("digest"))).alias("g"))
    keyed = convs.join(heads, "c", "left").withColumn("key", F.concat_ws(":", "len", "_a", "_b"))  # a row for each conversation on either side
    keyed = keep(keyed.select("c", "len", "g", "key"))
    seqs = keyed.groupBy("key").agg(F.min("c").alias("s"), F.count("*").alias("w"), F.first("len").alias("len"), F.first("g").alias("g"))
    seqs = keep(seqs)
    total = seqs.agg(F.min("s"), F.sum("w")).first()
    nodes = f"{NODE}, up binary, top boolean"
    finish = lambda df: df.select(*[c for c in df.columns if c not in ("ends", "up", "top")], F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    if not total[1]:
        return finish(spark.createDataFrame([], nodes))
    several = join_counted(keyed.select("key", "c"), seqs.where("w > 1").select("key", "w"), ["key"], "w").select("key", "c")
    ends = ends_of(keep(several))
    seqs = seqs.join(ends, "key", "left").withColumn("ends", F.coalesce("ends", F.sha2(F.col("s").cast("string"), 256)))
    seqs = keep(seqs.select("s", "w", "len", "g", "ends"))

    rows = join_counted(turns.select(F.col("c").alias("s"), "pos", "digest", "chars"), seqs.where("len > 0"), ["s"], "len")
    rows = rows.select("g", F.lit(None).cast("binary").alias("up"), F.lit(1).cast("long").alias("d"), F.lit(total[0]).alias("parent"), "s", "pos", "digest", "chars", "w", F.when(F.col("pos") == F.col("len") - 1, F.col("ends")).alias("ends"), "len")
    small, rounds = [], []
    while True:
        rows = keep(rows)
        sizes = keep(rows.groupBy("g").agg(F.count("*").alias("_n")))
        if not rounds:
            share = (sizes.agg(F.sum("_n")).first()[0] or 0) // partitions(spark)
            limit, bucket = min(most_rows, max(least_rows, 2 * share)), min(most_rows, max(least_rows, share))
        within = with_offsets(sizes.where(F.col("_n") <= limit), ["g"], {"_before": F.col("_n")}).select("g", F.floor(F.col("_before") / bucket).alias("_bucket"), "_n")
        small.append(join_counted(rows, keep(within), ["g"], "_n").drop("_n", "len").withColumn("_round", F.lit(len(rounds))))
        over = keep(sizes.where(F.col("_n") > limit))
        if over.isEmpty():
            break
        inside = keep(join_counted(rows, over, ["g"], "_n").drop("_n"))
        # a row for each group and depth
        shape = keep(inside.groupBy("g", "pos").agg(F.count("*").alias("_c"), F.min("digest").alias("_lo"), F.max("digest").alias("_hi"), F.max("chars").alias("chars"), F.max("ends").alias("ends"), F.sum("w").alias("w"), F.min("s").alias("s"), F.min("d").alias("d"), F.min("parent").alias("parent"), F.max("up").alias("up")))
        top = shape.where(F.col("pos") == F.col("d") - 1).select("g", F.col("_c").alias("_all"), F.col("s").alias("_least"))
        counted = shape.groupBy("g").agg(F.count("*").alias("_n"), F.max("pos").alias("_last"))
        top = keep(top.join(counted, "g"))
        apart = join_counted(shape.select("g", "pos", "_c", "_lo", "_hi"), top, ["g"], "_n").where("_c < _all OR _lo <> _hi").groupBy("g").agg(F.min("pos").alias("_apart"))
        top = top.join(apart, "g", "left").withColumn("_upto", F.coalesce("_apart", F.col("_last") + 1)).select("g", "_upto", "_least", "_n")
        top = keep(top)
        spine = join_counted(shape, top, ["g"], "_n").where("pos < _upto")
        rounds.append(keep(spine.select("g", "up", "pos", "d", "parent", "_least", "_upto", "chars", "w", "ends")))
        rest = join_counted(inside, top.drop("_n").join(over, "g"), ["g"], "_n").where("pos >= _upto")
        following = rest.where(F.col("pos") == F.col("_upto")).select("g", "s", F.col("digest").alias("_next"), (F.col("len") - F.col("pos")).alias("_left"))
        rows = join_counted(rest, following, ["g", "s"], "_left")
        rows = rows.select(F.unhex(F.md5(F.concat("g", "_next"))).alias("g"), F.col("g").alias("up"), (F.col("_upto") + 1).alias("d"), F.col("_least").alias("parent"), "s", "pos", "digest", "chars", "w", "ends", "len")
    every = small[0]
    for more in small[1:]:
        every = every.unionByName(more)
    built = keep(every.groupBy("_round", "_bucket").applyInPandas(subtries, nodes))
    tops = built.where("top").select("up", "n_leaves", "saved_tokens")
    out = [built]
    for spine in reversed(rounds):
        below = keep(tops.where("up IS NOT NULL").groupBy(F.col("up").alias("g")).agg(F.count("*").alias("_kids"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved")))
        placed = keep(with_offsets(spine, ["g", "pos"], {"_before": (F.col("w") - 1) * F.col("chars")}))
        of = placed.groupBy("g").agg(F.count("*").alias("_n"), F.max(F.col("_before") + (F.col("w") - 1) * F.col("chars")).alias("_end")).join(below, "g", "left").fillna(0, ["_kids", "_leaves", "_saved"])
        found = join_counted(placed, keep(of), ["g"], "_n")
        is_top = F.col("pos") == F.col("d") - 1
        done = keep(found.select(
            F.col("_least").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.when(is_top, F.col("parent")).otherwise(F.col("_least")).alias("parent_conv_id"), F.col("w").alias("n_convs"),
            F.when(F.col("pos") + 1 < F.col("_upto"), 1).otherwise(F.col("_kids")).cast("long").alias("n_children"), F.greatest("_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.col("_saved") + F.col("_end") - F.col("_before")).alias("saved_tokens"), "ends", "up", is_top.alias("top"),
        ))
        tops = tops.union(done.where("top").select("up", "n_leaves", "saved_tokens"))
        out.append(done)
    root = tops.where("up IS NULL").agg(F.count("*").alias("n_children"), F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    root = root.withColumns({"conv_id": F.lit(total[0]), "depth": F.lit(0), "parent_conv_id": F.lit(None), "n_convs": F.lit(total[1])})
    turnless = seqs.where("len = 0").agg(F.max("ends")).first()[0]
    out.append(root.withColumns({"ends": F.lit(turnless), "up": F.lit(None), "top": F.lit(True)}))
    whole = None
    for df in out:
        df = df.select([F.col(c).cast(t).alias(c) for c, t in (x.split(" ") for x in nodes.split(", "))])
        whole = df if whole is None else whole.union(df)
    return finish(whole)
