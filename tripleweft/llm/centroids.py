"""Centroid clustering: exact k-means rounds over kd-trees that each task builds of its own vectors (filtering by boxes)."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keep


class BoxTree:
    """A kd-tree over the rows of an integer matrix. Node i holds rows start..end of `vectors`, the box lo..hi around them and their sum; children follow their parent.

    A node is split at the median of its widest side until `leaf` rows are left or all its rows are one point.
    """

    def __init__(self, vectors, spans, boxes, sums):
        self.vectors, self.spans, self.boxes, self.sums = vectors, spans, boxes, sums

    @classmethod
    def build(cls, vectors: np.ndarray, leaf: int = 32) -> tuple["BoxTree", np.ndarray]:
        """(tree, the order in which it holds the rows)."""
        order = np.arange(len(vectors))
        spans, boxes, sums, stack = [], [], [], [(0, len(vectors), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            own = vectors[order[a:b]]
            lo, hi = own.min(0), own.max(0)
            if parent >= 0:
                spans[parent][2 + side] = len(spans)
            at, wide = len(spans), hi - lo
            spans.append([a, b, -1, -1])
            boxes.append((lo, hi))
            sums.append(own.sum(0, dtype=np.int64))
            if b - a > leaf and wide.any():
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, int(wide.argmax())], mid)]
                stack += [(a + mid, b, at, 1), (a, a + mid, at, 0)]
        return cls(vectors[order], np.array(spans, np.int32), np.array(boxes, vectors.dtype), np.array(sums, np.int64)), order

    def to_columns(self) -> dict:
        """Bytes of the four arrays; vectors and boxes in the narrowest type that holds them."""
        most = int(np.abs(self.vectors).max())
        kind = next(k for k in ("<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
        return {"kind": kind, "spans": self.spans.astype("<i4").tobytes(), "vectors": self.vectors.astype(kind).tobytes(), "boxes": self.boxes.astype(kind).tobytes(), "sums": self.sums.astype("<i8").tobytes()}

    @classmethod
    def from_columns(cls, x: dict, size: int) -> "BoxTree":
        read = lambda k, kind: np.frombuffer(x[k], kind)
        return cls(read("vectors", x["kind"]).reshape(-1, size), read("spans", "<i4").reshape(-1, 4), read("boxes", x["kind"]).reshape(-1, 2, size), read("sums", "<i8").reshape(-1, size))

    def assign(self, centroids: np.ndarray):
        """Yields (node, None, cluster) for nodes that go to one cluster whole, and (node, clusters of its rows, None) for leaves that don't.

        In a node, a candidate is pruned if even in the corner of the box that favours it most it is strictly farther than the candidate nearest to the middle;
        equal distances prune nothing, so ties reach a leaf, where the smaller number wins. All sums stay exact: in doubles below 2^53, else in longs.
        """
        size = centroids.shape[1]
        most = max(int(np.abs(self.boxes[0].astype(np.int64)).max()), int(np.abs(centroids).max()))
        if 4 * size * most * most >= 1 << 63:
            raise ValueError(f"components of {most} are too large: squared distances would not fit a long")
        exact = np.float64 if 4 * size * most * most < 1 << 53 else np.int64
        top = np.inf if exact is np.float64 else np.iinfo(np.int64).max
        c = centroids.astype(exact)
        norms = (c * c).sum(1)
        nodes, live = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
        while len(nodes):
            lo, hi = self.boxes[nodes, 0].astype(exact), self.boxes[nodes, 1].astype(exact)
            best = np.where(live, norms - (lo + hi) @ c.T, top).argmin(1)
            for z in np.unique(best):
                at = np.flatnonzero(best == z)
                u = c - c[z]
                nearest = hi[at] @ np.maximum(u, 0).T + lo[at] @ np.minimum(u, 0).T
                live[at] &= norms - norms[z] - 2 * nearest <= 0
            alone = live.sum(1) == 1
            for i in np.flatnonzero(alone):
                yield int(nodes[i]), None, int(best[i])
            ends = self.spans[nodes, 2] < 0
            for i in np.flatnonzero(ends & ~alone):
                a, b = self.spans[nodes[i], :2]
                few = np.flatnonzero(live[i])
                yield int(nodes[i]), few[(norms[few] - 2 * (self.vectors[a:b].astype(exact) @ c[few].T)).argmin(1)], None
            go = ~(ends | alone)
            nodes, live = self.spans[nodes[go], 2:].reshape(-1).astype(np.int64), np.repeat(live[go], 2, axis=0)


def vectors_of(table: DataFrame, size: int) -> DataFrame:
    """vec_id, embedding of the rows of table that have exactly `size` components, none of them null, NaN or infinite."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.select("vec_id", "embedding").where((F.size("embedding") == size) & whole)


def trees(vectors: DataFrame, size: int, scale: int, block: int = 8192) -> DataFrame:
    """A row for each kd-tree: ids of its rows and its arrays. Each task deals its own vectors, as floor(scale * x), into blocks; nothing is shuffled."""

    def each(batches):
        ids, parts, held = [], [], 0

        def tree():
            made, order = BoxTree.build(np.concatenate(parts))
            return {"ids": [pa.concat_arrays(ids).take(pa.array(order))]} | {k: [v] for k, v in made.to_columns().items()}

        for b in batches:
            flat = b["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            whole = np.floor(flat * scale)
            if whole.size and np.abs(whole).max() >= 1 << 31:
                raise ValueError("components beyond 2^31: squared distances would not fit a long")
            whole = whole.astype(np.int64)
            at = 0
            while at < len(whole):
                n = min(block - held, len(whole) - at)
                ids.append(b["vec_id"].slice(at, n))
                parts.append(whole[at : at + n])
                held, at = held + n, at + n
                if held == block:
                    yield tree()
                    ids, parts, held = [], [], 0
        if held:
            yield tree()

    return arrow_map(vectors, each, f"ids array<{dict(vectors.dtypes)['vec_id']}>, kind string, spans binary, vectors binary, boxes binary, sums binary")


def _read(batches, size: int):
    for b in batches:
        for i in range(len(b["kind"])):
            yield b["ids"].slice(i, 1).flatten(), BoxTree.from_columns({k: b[k][i].as_py() for k in ("kind", "spans", "vectors", "boxes", "sums")}, size)


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floor(sum / count) of what is nearest to each. Each task adds up its own trees; a number for each centroid and component reaches the driver."""
    k, size = centroids.shape

    def each(batches):
        total = np.zeros((k, size + 1), np.int64)
        for _, tree in _read(batches, size):
            for node, rows, cluster in tree.assign(centroids):
                a, b = tree.spans[node, :2]
                if rows is None:
                    total[cluster, :size] += tree.sums[node]
                    total[cluster, size] += b - a
                else:
                    own = tree.vectors[a:b].astype(np.int64)
                    for c in np.unique(rows):
                        total[c, :size] += own[rows == c].sum(0)
                        total[c, size] += (rows == c).sum()
        at = np.flatnonzero(total.any(1))
        yield {"cluster": np.repeat(at, size + 1).astype(np.int32), "part": np.tile(np.arange(size + 1, dtype=np.int32), len(at)), "total": total[at].reshape(-1)}

    sums = arrow_map(forest, each, "cluster int, part int, total long").groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {(r.cluster, r.part): int(r.total) for r in sums}
    return np.array([[found[c, j] // found[c, size] for j in range(size)] if (c, size) in found else centroids[c].tolist() for c in range(k)], np.int64)


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: int = 2, block: int = 8192) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every whole vector of table (vec_id, embedding).

    Components count as floor(scale * x). The first centroids are the k vectors with the least SHA-256 of "seed:vec_id" (equal ids: by components); then `rounds` rounds, then
    every vector is assigned once more. Equal distances go to the smaller number; centroids without vectors stay.

    Left out are vectors that are null, of another length, or with a component that is null or not finite. Vectors without a vec_id take part but are no first centroid
    (where no vector has an id, the result is empty). Repeated rows count each; fewer than k vectors are as many centroids. An empty table gives an empty result; other columns
    are not read. Components too large for squared distances in a long (2^27 after scaling, for 64 of them) are an error.
    """
    spark, kind = table.sparkSession, dict(table.dtypes)["vec_id"]
    vectors = vectors_of(table, size)
    first = vectors.where("vec_id IS NOT NULL").withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = [r.embedding for r in first.orderBy("_h", "embedding").limit(k).select("embedding").collect()]  # k rows
    schema = f"vec_id {kind}, cluster int, distance long"
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not first:
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string").select(*columns)
    centroids = np.floor(np.array(first, np.float64) * scale).astype(np.int64)
    forest = keep(trees(vectors, size, scale, block))
    for _ in range(rounds):
        centroids = moved(forest, centroids)

    def each(batches):
        for ids, tree in _read(batches, size):
            label = np.zeros(len(ids), np.int32)
            for node, rows, one in tree.assign(centroids):
                a, b = tree.spans[node, :2]
                label[a:b] = one if rows is None else rows
            away = tree.vectors.astype(np.int64) - centroids[label]
            yield {"vec_id": ids, "cluster": label, "distance": (away * away).sum(1)}

    assigned = keep(arrow_map(forest, each, schema))
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    of_each = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(whole.alias("s")).collect()}  # at most k rows
    about = [(c, s, sum(of_each.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(of_each.items())]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(*columns)
