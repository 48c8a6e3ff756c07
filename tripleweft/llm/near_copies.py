"""The pipeline's near-duplicates: SimHash over five-word shingles, linked where the sets of shingles have a Jaccard similarity of 0.8 or more.

Fingerprints (those of the SimHash operator, over five words) in its vantage-point tree propose what lies within NEAR bits, and the exact similarity decides. The tree alone can't find all: texts at 0.8 differ in 9.7 of 64 bits on average, and at a reach that finds them (REACH) the
triangle bounds prune nothing, since random fingerprints lie 32 bits apart, give or take 4. So what the tree's links leave apart also meets in min-hash bands; fingerprints drop candidates beyond REACH bits, and the exact similarity decides again.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, join_counted, keep
from .simhash import chosen, forest, links

#: 16 bands of 3 min-hashes: a pair at similarity s meets in a band with probability 1 - (1 - s ** 3) ** 16, at 0.8 with 0.99999.
BANDS, ROWS = 16, 3
#: Bits within which the tree looks for fingerprints.
NEAR = 2
#: Bits in which fingerprints at similarity 0.8 may differ: 9.7 on average, give or take 2.9, so beyond 24 with probability 0.000001.
REACH = 24
MULTIPLIERS = np.random.default_rng(11).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; of a shorter text, of all its words; none without words."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    width, hash_ = min(width, len(found)), xxhash.xxh64_intdigest
    return np.unique(np.array([hash_(b" ".join(found[i : i + width]), 42) for i in range(len(found) - width + 1)], np.uint64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band; texts that agree in all min-hashes of a band have its key in common."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 4096):
        low = np.minimum(low, (found[i : i + 4096, None] * MULTIPLIERS).min(0))
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ low[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def fingerprint(found: np.ndarray) -> int:
    """64 bits; a bit is set if it is in over half of the shingles' hashes."""
    bits = np.unpackbits(found.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.frombuffer(np.packbits(2 * bits > len(found)).tobytes(), ">i8")[0])


def _sets(docs: DataFrame, columns: str, width: int) -> DataFrame:
    """doc_id, sid (a hash of the text's set of shingles), and of n (its size), fp, bands and hashes what columns names."""
    import xxhash

    def each(batches):
        for b in batches:
            for i in range(0, len(b["text"]), 500):
                found = [shingles(t, width) for t in b["text"].slice(i, 500).to_pylist()]
                out = {"doc_id": b["doc_id"].slice(i, 500), "sid": np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in found], np.uint64).view(np.int64)}
                if "hashes" in columns:
                    out["hashes"] = [x.view(np.int64) for x in found]
                else:
                    out |= {"n": [len(x) for x in found], "fp": [fingerprint(x) for x in found], "bands": [band_keys(x) for x in found]}
                yield out

    return arrow_map(docs.select("doc_id", "text"), each, f"doc_id {dict(docs.dtypes)['doc_id']}, sid long, {columns}")


def similar_forest(sets: list, share: float = 0.8) -> np.ndarray:
    """For each of some sets (arrays of distinct hashes), the least index of its component at a Jaccard similarity of share or more; exact, by products of incidence matrices, a block of hashes at a time."""
    sizes = np.array([len(x) for x in sets])
    owner, value = np.repeat(np.arange(len(sets)), sizes), np.concatenate([np.asarray(x) for x in sets])
    _, at, often = np.unique(value, return_inverse=True, return_counts=True)
    place = np.cumsum(often > 1) - 1  # what one set alone holds is in no intersection
    twice = often[at] > 1
    owner, column = owner[twice], place[at[twice]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, 2048):
        part = slice(*np.searchsorted(column, (lo, lo + 2048)))
        block = np.zeros((len(sets), 2048), np.float32)
        block[owner[part], column[part] - lo] = 1
        both += block @ block.T
    x, y = np.nonzero(np.triu(both * (1 + share) >= share * (sizes[:, None] + sizes[None, :]) - 1e-3, 1))
    return forest(len(sets), np.stack((x, y), 1))


def blocks(apart: DataFrame, small: int, part: int) -> DataFrame:
    """key, sid, i, j: where the sets of bands of more than `small` meet. What lies apart from the band's largest component (label <> top), in parts, meets all of its band, in parts: a set goes to as many blocks as the other side has parts, and where few are apart that is one."""
    cut = lambda n, total: F.ceil(F.greatest(F.col(n) / part, F.col(total) / (4000 * part))).cast("int")
    rows = apart.where(F.col("size") > small).withColumns({"_i": cut("others", "others_total"), "_j": cut("size", "total")})
    own = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    loose = rows.where("label <> top").select("key", "sid", own("_i").alias("i"), upto("_j").alias("j"))
    return loose.union(rows.select("key", "sid", upto("_i").alias("i"), own("_j").alias("j")))


def deduplicated(docs: DataFrame, width: int = 5, small: int = 24, part: int = 1000, rounds: int = 8) -> DataFrame:
    """The rows of docs, one document of each group of near copies: that of the least doc_id. Rows without a doc_id stay; rows of one doc_id count as one document.

    Two distinct sets of shingles are linked if their exact similarity is 0.8 or more. Candidates are, first, those whose fingerprints the vantage-point tree joins; then, of those that share a band, what is still apart. In each band's group all are held against
    three centres. Where those links leave some apart, small groups are compared pair by pair. In groups of more than `small`, while more than `part` sets are apart from the group's largest component, more centres, three a round, are drawn from
    these and held against the whole group (up to `rounds` rounds, as long as each joins a fifth of what is left). What is then still apart is compared with all of its group inside tasks, in blocks of two parts of about `part` sets (and 4,000 times as many hashes) at most, of which only a tree of links comes out: n + n * k / part rows for k
    of n sets apart, where k is at most `part`. Nothing is capped. Null and empty texts are alike; very long texts are read whole.
    """
    nodes = keep(_sets(docs.where("doc_id IS NOT NULL"), "n long, fp long, bands array<long>", width).groupBy("sid", "n", "fp", "bands").agg(F.min("doc_id").alias("rep")))
    members = nodes.select("sid", "n", "fp", F.explode("bands").alias("key"))
    several = keep(members.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("total"), *[F.min(F.struct(F.xxhash64("sid", "key", F.lit(k)), "sid", "n", "fp")).alias(f"c{k}") for k in range(3)]).where("size > 1"))
    centres = F.array(*[F.struct(F.col(f"c{k}.sid").alias("other"), F.col(f"c{k}.n").alias("m"), F.col(f"c{k}.fp").alias("_fp")) for k in range(3)])
    members = keep(join_counted(members, several, ["key"], "size").select("key", "sid", "n", "fp", "size", "total", centres.alias("centres")))
    like_sized = F.expr(f"5 * least(n, m) >= 4 * greatest(n, m) AND bit_count(fp ^ _fp) <= {REACH}")
    pair = [F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")]

    # by the tree: each fingerprint's least set with that of its group's root, and the other sets of a fingerprint with its least
    prints = keep(nodes.groupBy("fp").agg(F.min("sid").alias("rep"), F.count("*").alias("_sets")))
    alike = join_counted(nodes.select("fp", "sid"), prints.where("_sets > 1"), ["fp"], "_sets").select("sid", F.col("rep").alias("other"))
    near = keep(links(prints.select("fp", "rep"), NEAR).toDF("sid", "other").union(alike).where("sid <> other").select(*pair).distinct())

    wanted = members.select("sid").union(near.select("a")).union(near.select("b")).distinct()
    reps = nodes.join(wanted, "sid", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    hashes = keep(_sets(docs.join(reps, "doc_id", "left_semi"), "hashes array<long>", width).join(wanted, "sid", "left_semi").select("sid", "hashes").dropDuplicates(["sid"]))

    def linked(pairs):
        side = lambda k: hashes.select(F.col("sid").alias(k), F.col("hashes").alias(f"h{k}"))
        both = F.size(F.array_intersect("ha", "hb"))
        return pairs.join(side("b"), "b").join(side("a"), "a").where(9 * both >= 4 * (F.size("ha") + F.size("hb"))).select(F.col("a").alias("u"), F.col("b").alias("v"))

    def labelled(df, edges):
        found = components(edges).withColumnsRenamed({"node": "_n", "component": "_c"})
        return df.join(found, F.col("sid") == F.col("_n"), "left").withColumn("label", F.coalesce("_c", "sid")).drop("_n", "_c")

    tree = keep(linked(near))
    known = keep(components(tree))
    root = lambda k: known.select(F.col("node").alias(k), F.col("component").alias(f"_{k}"))
    met = members.select("sid", "n", "fp", F.inline("centres")).where("sid <> other").where(like_sized).select(*pair).distinct().join(near, ["a", "b"], "left_anti")
    met = keep(met.join(root("a"), "a", "left").join(root("b"), "b", "left").where("coalesce(_a, a) <> coalesce(_b, b)").select("a", "b"))
    tried = near.union(met)
    edges = tree.union(keep(linked(met)))

    def split(edges):
        """(members of bands that their links leave apart, with each band's largest label; for each such band the number of the others, and of their hashes)"""
        placed = keep(labelled(members.select("key", "sid", "n", "fp", "size", "total"), edges))
        most = placed.groupBy("key", "label").agg(F.count("*").alias("k"), F.sum("n").alias("h")).groupBy("key").agg(F.max(F.struct("k", "label", "h")).alias("top"), F.count("*").alias("labels"), F.sum("k").alias("_rows"), F.sum("h").alias("_all"))
        most = keep(most.where("labels > 1").select("key", F.col("top.label").alias("top"), "_rows", (F.col("_rows") - F.col("top.k")).alias("others"), (F.col("_all") - F.col("top.h")).alias("others_total")))
        return keep(join_counted(placed, most, ["key"], "_rows").drop("_rows")), most

    apart, most = split(edges)
    few = apart.where(F.col("size") <= small)
    others = few.select("key", F.col("sid").alias("other"), F.col("n").alias("m"), F.col("fp").alias("_fp"), F.col("label").alias("_l"))
    rest = few.where("label <> top").join(others, "key").where("label <> _l").where(like_sized).select(*pair).distinct().join(tried, ["a", "b"], "left_anti")
    edges = edges.union(keep(linked(rest)))

    # bands of which more than one part stays apart: more centres, of those that are, each held against all of its band, as long as that joins many
    before = None
    for turn in range(rounds):
        heavy = keep(most.where((F.col("others") > part) & (F.col("_rows") > small)).select("key", "others", F.col("_rows")))
        left = heavy.agg(F.sum("others")).first()[0]
        if not left or before is not None and left > 0.8 * before:
            break
        before = left
        inside = keep(join_counted(apart.drop("others", "others_total"), heavy.select("key", "_rows"), ["key"], "_rows"))
        more = inside.where("label <> top").groupBy("key").agg(*[F.min(F.struct(F.xxhash64("sid", "key", F.lit(3 + 3 * turn + k)), F.col("sid").alias("other"), F.col("n").alias("m"), F.col("fp").alias("_fp"), F.col("label").alias("_l"))).alias(f"c{k}") for k in range(3)])
        more = keep(more.join(heavy.select("key", "_rows"), "key").select("key", "_rows", F.array("c0", "c1", "c2").alias("centres")))
        met = join_counted(inside.drop("_rows"), more, ["key"], "_rows").select("sid", "n", "fp", "label", F.inline("centres"))
        edges = edges.union(keep(linked(met.where("label <> _l").where(like_sized).select(*pair).distinct().join(tried, ["a", "b"], "left_anti"))))
        apart, most = split(edges)

    many = blocks(apart, small, part).join(hashes, "sid")

    def block(x: pd.DataFrame) -> pd.DataFrame:
        x = x.drop_duplicates("sid").sort_values("sid")
        root, sid = similar_forest(x["hashes"].tolist()), x["sid"].to_numpy()
        rest_ = np.flatnonzero(root != np.arange(len(sid)))
        return pd.DataFrame({"u": sid[rest_], "v": sid[root[rest_]]})

    edges = edges.union(keep(many.groupBy("key", "i", "j").applyInPandas(block, "u long, v long").distinct()))

    ids = labelled(nodes.select("sid", "rep"), edges).groupBy("label").agg(F.min("rep").alias("doc_id")).select("doc_id").distinct()
    return chosen(docs, ids)
