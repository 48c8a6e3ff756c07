"""SimHash near-duplicates: fingerprints in a vantage-point tree of Hamming balls."""

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, join_counted, keep, packed


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits over XXH64 (seed 42) of a text's word shingles; a bit is set if it is in over half of them. No words: 0."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) < width:
        found, width = [b" ".join(found)], 1
    joined, hash_ = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - width + 1].tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    total = np.zeros(64, np.int64)
    for i in range(0, len(starts), 1 << 16):
        h = np.array([hash_(joined[a:b], 42) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)])], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def each(batches):
        for b in batches:
            for i in range(0, len(b["text"]), 1000):
                fps = np.array([fingerprint(t, width) for t in b["text"].slice(i, 1000).to_pylist()], np.uint64)
                yield {"doc_id": b["doc_id"].slice(i, 1000), "fp": fps.view(np.int64)}

    return arrow_map(docs.select("doc_id", "text"), each, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


class VantageTree:
    """A tree over a sample: each node has a vantage point and a radius that halves what came to it; leaves are the shards."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 1):
        self.nodes, rng = [], np.random.default_rng(seed)
        self.leaves = 0
        self.root = self._grow(np.sort(sample), leaves, rng)

    def _grow(self, points, leaves, rng) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if leaves > 1 and len(points) > 2:
            best = None
            for v in points[rng.integers(len(points), size=5)]:  # of five, the one with the fewest points at its border
                d = np.bitwise_count(points ^ v).astype(np.int64)
                radius = int(np.median(d))
                inside = int((d <= radius).sum())
                if inside == len(points):
                    radius -= 1
                    inside = int((d <= radius).sum())
                if 0 < inside < len(points):
                    cost = int((np.abs(2 * d - 2 * radius - 1) <= 4).sum()) + abs(2 * inside - len(points))
                    candidate = (cost, int(v), radius)
                    best = candidate if best is None else min(best, candidate)
            if best:
                _, v, radius = best
                near = np.bitwise_count(points ^ np.uint64(v)) <= radius
                left = self._grow(points[near], leaves // 2, rng)
                self.nodes[at] = (v, radius, left, self._grow(points[~near], leaves - leaves // 2, rng))
                return at
        self.nodes[at] = self.leaves
        self.leaves += 1
        return at

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf in which each point lies."""
        out = np.zeros(len(points), np.int64)
        for rows, leaf in self.visits(points, -1):
            out[rows] = leaf
        return out

    def visits(self, points: np.ndarray, reach: int):
        """(rows, leaf) of the leaves that may hold a point within reach; reach -1: of the leaf a point lies in.

        By the triangle inequality, what lies within a radius r of the vantage point has only neighbours within r + reach, and what lies beyond r none below r + 1 - reach.
        """
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            at, rows = stack.pop()
            node = self.nodes[at]
            if not len(rows):
                continue
            if isinstance(node, int):
                yield rows, node
                continue
            v, radius, near, far = node
            d = np.bitwise_count(points[rows] ^ np.uint64(v)).astype(np.int64)
            r = max(reach, 0)
            stack.append((near, rows[d <= radius + r]))
            stack.append((far, rows[d > radius - r]))


def close_pairs(index: np.ndarray, queries: np.ndarray, reach: int, small: int = 192):
    """Yields arrays of (i, q), of all pairs within reach: a vantage-point tree of the index is walked by all queries at once."""
    rng = np.random.default_rng(5)
    stack = [(np.arange(len(index)), np.arange(len(queries)))]
    while stack:
        a, q = stack.pop()
        if not len(a) or not len(q):
            continue
        if len(a) > small:
            v = index[a[rng.integers(len(a))]]
            d = np.bitwise_count(index[a] ^ v)
            radius = int(np.median(d))
            near = d <= radius
            if near.all():
                radius -= 1
                near = d <= radius
            if near.any() and not near.all():
                e = np.bitwise_count(queries[q] ^ v).astype(np.int64)
                stack.append((a[near], q[e <= radius + reach]))
                stack.append((a[~near], q[e > radius - reach]))
                continue
        for k in range(0, len(q), step := max(1, 4_000_000 // len(a))):
            x, y = np.nonzero(np.bitwise_count(index[a][:, None] ^ queries[q[k : k + step]][None, :]) <= reach)
            yield np.stack((a[x], q[k : k + step][y]), 1)


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of n nodes, the least node of its component."""
    label = np.arange(n)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        before = label.copy()
        for side in (0, 1):
            np.minimum.at(label, label[pairs[:, side]], low)
            np.minimum.at(label, pairs[:, side], low)
        while (label[label] != label).any():
            label = label[label]
        if (before == label).all():
            break
    return label


def links(reps: DataFrame, reach: int = 2, shard_rows: int = 4000, sample_rows: int = 50_000, most_rows: int = 200_000, most_pairs: int = 2_000_000) -> DataFrame:
    """Edges (u, v) between representatives that join all of reps(fp, rep) within reach: in each shard, a star for each of its groups.

    A tree over a bounded sample of the fingerprints (sample_rows) cuts space into shards; a fingerprint lies in one and, as a query, goes to every later shard
    that the triangle bounds leave. Shards that more than most_rows fingerprints reach get a tree of their own, and so on, so that shards stay bounded; only a shard that its tree doesn't make smaller by a tenth (fingerprints that lie within reach of each other) is left as it is. Each shard finds its pairs
    exactly and holds at most some most_pairs of them at a time.
    """
    kind = dict(reps.dtypes)["rep"]
    n = reps.count()
    sample = reps.select("fp").orderBy(F.xxhash64("fp")).limit(min(sample_rows, n)).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = VantageTree(sample, max(1, min(-(-n // shard_rows), sample_rows // 20)))

    def placed(tree, fps, own):
        """(rows, leaf, whether it lies there) of every leaf that a fingerprint goes to; a query that lies elsewhere goes to all in reach."""
        home = np.where(own, tree.home(fps), -1)
        for rows, leaf in tree.visits(fps, reach):
            rows = rows[home[rows] <= leaf]
            for i in range(0, len(rows), 100_000):
                part = rows[i : i + 100_000]
                yield part, leaf, home[part] == leaf

    def route(batches):
        for b in batches:
            fps, reps_ = b["fp"].to_numpy().view(np.uint64), b["rep"].to_numpy(zero_copy_only=False)
            for rows, leaf, own in placed(tree, fps, np.ones(len(fps), bool)):
                yield {"leaf": np.full(len(rows), leaf).astype(str), "fp": fps[rows].view(np.int64), "rep": reps_[rows], "own": own}

    def grow(x: pd.DataFrame) -> pd.DataFrame:
        fps = x["fp"].to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"leaf": x["leaf"].head(1), "tree": [pickle.dumps(VantageTree(fps, max(2, len(fps) // 20)))]})

    def split(batches):
        trees: dict = {}
        for b in batches:
            leaves, fps = np.array(b["leaf"].to_pylist(), object), b["fp"].to_numpy().view(np.uint64)
            reps_, owns = b["rep"].to_numpy(zero_copy_only=False), b["own"].to_numpy(zero_copy_only=False)
            for leaf in set(leaves):
                at = np.flatnonzero(leaves == leaf)
                if leaf not in trees:
                    trees[leaf] = pickle.loads(b["tree"][int(at[0])].as_py())
                for rows, below, own in placed(trees[leaf], fps[at], owns[at]):
                    yield {"leaf": [f"{leaf}.{below}"] * len(rows), "fp": fps[at[rows]].view(np.int64), "rep": reps_[at[rows]], "own": own}

    columns = f"leaf string, fp long, rep {kind}, own boolean"
    routed, done, above = arrow_map(reps, route, columns), [], None
    while True:
        routed = keep(routed)
        sizes = routed.groupBy("leaf").agg(F.count("*").alias("_rows"), F.count_if("own").alias("_own")).where(F.col("_rows") > most_rows)
        if above is not None:  # a leaf of nearly all of what was split won't split
            sizes = sizes.join(above, F.regexp_replace("leaf", "[.][^.]*$", "") == F.col("_leaf"), "left").where("_rows < 0.9 * coalesce(_before, _rows * 2)").select("leaf", "_rows", "_own")
        sizes = keep(sizes)
        if sizes.isEmpty():
            done.append(routed)
            break
        above = sizes.select(F.col("leaf").alias("_leaf"), F.col("_rows").alias("_before"))
        inside = join_counted(routed, sizes, ["leaf"], "_rows")
        # each crowded leaf's tree is grown over some 2,000 of its own fingerprints, chosen by hash
        few = inside.where("own").where(F.pmod(F.xxhash64("fp", "leaf"), F.greatest(F.lit(1), (F.col("_own") / 2000).cast("long"))) == 0)
        trees = keep(few.select("leaf", "fp").groupBy("leaf").applyInPandas(grow, "leaf string, tree binary").join(sizes, "leaf"))
        done.append(routed.join(sizes, "leaf", "left_anti"))
        routed = arrow_map(join_counted(routed, trees, ["leaf"], "_rows").select("leaf", "fp", "rep", "own", "tree"), split, columns)

    def shard(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["rep", "fp"])
        fps, reps_, own = x["fp"].to_numpy(np.int64).view(np.uint64), x["rep"].to_numpy(), np.flatnonzero(x["own"].to_numpy())
        root, held, many = np.arange(len(fps)), [], 0

        def reduced():  # pairs become a forest as they come
            tree = np.flatnonzero(root != np.arange(len(fps)))
            return forest(len(fps), np.concatenate([np.stack((tree, root[tree]), 1), *held]))

        for pairs in close_pairs(fps[own], fps, reach):
            pairs = np.stack((own[pairs[:, 0]], pairs[:, 1]), 1)
            held.append(pairs[pairs[:, 0] != pairs[:, 1]])
            many += len(held[-1])
            if many > most_pairs:
                root, held, many = reduced(), [], 0
        root = reduced()
        rest = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"u": reps_[rest], "v": reps_[root[rest]]})

    shards = done[0]
    for more in done[1:]:
        shards = shards.union(more)
    return shards.groupBy("leaf").applyInPandas(shard, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, width: int = 3, reach: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id linked to it, itself included) of every row of docs (doc_id, text).

    Fingerprints link at reach or fewer differing bits, whatever rows have them. Texts without words have fingerprint 0 and are linked like any other. Repeated rows get one answer each;
    rows of one doc_id with several texts are linked by each text's fingerprint on its own. Rows without a doc_id link others like any row, are never a component's id, and get null if they are linked to none
    that has one. Very long texts are read whole. An empty table gives an empty result.
    """
    prints = keep(fingerprints(docs, width))
    reps = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_rows")))
    found = components(links(reps.select("fp", F.col("fp").alias("rep")), reach)).withColumnsRenamed({"node": "_n", "component": "_c"})
    grouped = keep(reps.join(found, F.col("fp") == F.col("_n"), "left").select("fp", "_rows", "_least", F.coalesce("_c", "fp").alias("_group")))
    least = keep(grouped.groupBy("_group").agg(F.min("_least").alias("component_id"), F.count("*").alias("_size")))
    named = keep(join_counted(grouped.select("fp", "_rows", "_group"), least, ["_group"], "_size").select("fp", "_rows", "component_id"))
    out = join_counted(prints, named, ["fp"], "_rows")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, width: int = 3, reach: int = 2) -> DataFrame:
    """The rows of docs, one document of each component: that of the least doc_id. Rows without a doc_id stay; of rows that share one, that with the least hash of its text stays, so reruns agree."""
    groups = near_duplicates(docs, width, reach)
    ids = groups.where("doc_id = component_id").select("doc_id").distinct()
    return chosen(docs, ids)


def chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Of docs, one row for each of ids(doc_id), and all rows without a doc_id. Rows of one doc_id are told apart by hashes: the least of (text's, whole row's) stays; rows alike in both are the same row."""
    rest, kept = docs.where("doc_id IS NULL"), docs.join(ids, "doc_id", "left_semi").select(*docs.columns)
    several = keep(docs.groupBy("doc_id").agg(F.count("*").alias("_c")).where("_c > 1 AND doc_id IS NOT NULL").select("doc_id"))
    if several.isEmpty():
        return kept.unionByName(rest)
    rows = packed(kept.join(several, "doc_id", "left_semi").select(*docs.columns), "doc_id", "text").withColumn("_order", F.struct(F.xxhash64("text"), F.xxhash64("_row")))
    rows = rows.join(rows.groupBy("doc_id").agg(F.min("_order").alias("_least")), "doc_id").where("_order = _least").dropDuplicates(["doc_id"])
    return kept.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(rows.select("_row.*")).unionByName(rest)
