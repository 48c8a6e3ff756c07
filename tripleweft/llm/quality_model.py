"""Quality classifier: random-indexing word vectors pooled for each document, and a two-layer network with calibrated probabilities."""

import re
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keep
from .language import parts

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_KNOWN: dict = {}


def token_ids(text: str, buckets: int) -> list[int]:
    """The bucket of each word, number and run of marks, lower-cased; hashes are remembered for each process, up to a bound."""
    known, out = _KNOWN, []
    for w in TOKEN.findall(text.lower()):
        i = known.get(w)
        if i is None:
            if len(known) > 1_000_000:
                known.clear()
            i = known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        out.append(i % buckets)
    return out


def index_vectors(buckets: int, size: int, seed: int, nonzero: int = 6) -> np.ndarray:
    """A sparse ternary vector for each bucket; the last row, for gaps, is zero."""
    rng = np.random.default_rng(seed)
    out = np.zeros((buckets + 1, size), np.int8)
    places = np.argsort(rng.random((buckets, size)), axis=1)[:, :nonzero]
    np.put_along_axis(out[:-1], places, rng.choice(np.array([-1, 1], np.int8), (buckets, nonzero)), 1)
    return out


def word_vectors(docs: DataFrame, buckets: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the index vectors of the two words before and after, over all texts; count) of each bucket.

    Every task adds up its own table, in blocks of 256 buckets; the blocks' sums are added as they stream in, and the table (buckets x size numbers, whatever the input) reaches the driver.
    """
    block = 256

    def each(batches):
        index, total, count = index_vectors(buckets, size, seed), np.zeros((buckets, size), np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            for lo, hi in parts(texts, 400_000):
                ids = []
                for t in texts[lo:hi]:
                    ids += token_ids(t, buckets)
                    ids += (buckets, buckets)
                ids = np.array([buckets, buckets, *ids], np.int64)
                near = index[ids]
                around = near[:-4] + near[1:-3] + near[3:-1] + near[4:]
                own = ids[2:-2]
                order = np.argsort(own.astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")
                order = order[: np.searchsorted(own[order], buckets)]
                if len(order):
                    found, starts = np.unique(own[order], return_index=True)
                    total[found] += np.add.reduceat(around[order], starts, axis=0, dtype=np.int32)
                    count += np.bincount(own[order], minlength=buckets)
        for k in range(0, buckets, block):
            if count[k : k + block].any():
                yield {"block": [k // block], "sums": [total[k : k + block].astype("<i8").tobytes()], "counts": [count[k : k + block].astype("<i8").tobytes()]}

    def add(batches):
        held: dict = {}
        for b in batches:
            for k, s, c in zip(b["block"].to_pylist(), b["sums"], b["counts"]):
                s, c = np.frombuffer(s.as_py(), "<i8"), np.frombuffer(c.as_py(), "<i8")
                held[k] = (held[k][0] + s, held[k][1] + c) if k in held else (s, c)
        if held:
            yield {"block": list(held), "sums": [s.tobytes() for s, _ in held.values()], "counts": [c.tobytes() for _, c in held.values()]}

    schema = "block int, sums binary, counts binary"
    rows = arrow_map(arrow_map(docs.select("text"), each, schema).repartition("block"), add, schema).collect()
    sums, counts = np.zeros((buckets, size)), np.zeros(buckets)
    for r in rows:
        sums[r.block * block :][:block] = np.frombuffer(r.sums, "<i8").reshape(-1, size)
        counts[r.block * block :][:block] = np.frombuffer(r.counts, "<i8")
    return sums, counts


def pooled(docs: DataFrame, sums: np.ndarray, counts: np.ndarray) -> DataFrame:
    """doc_id, vec: mean, mean square and mean product of neighbours, of the words' vectors (centred, of length 1; rare words weigh more but in the last), as 32-bit floats. Empty texts: zeros."""
    buckets, size = sums.shape
    share = counts / max(counts.sum(), 1)
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    unit -= share @ unit
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    weight = 1e-3 / (1e-3 + share)
    table = docs.sparkSession.sparkContext.broadcast((unit.astype(np.float32), weight.astype(np.float32)))

    def each(batches):
        vectors, weights = table.value
        weighed = np.hstack([vectors * weights[:, None], vectors * vectors * weights[:, None], weights[:, None]])
        place = np.zeros(buckets, np.int64)
        for b in batches:
            texts, out = [t or "" for t in b["text"].to_pylist()], []
            for low, high in parts(texts, 100_000):
                for lo in range(low, high, 256):
                    ids = [token_ids(t, buckets) for t in texts[lo : min(lo + 256, high)]]
                    sizes = np.array([len(i) for i in ids])
                    some, flat = np.flatnonzero(sizes), np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
                    own = np.zeros((len(ids), 3 * size), np.float32)
                    if len(some):
                        # counts of the words found here (256 texts at most), times the table
                        place[flat] = 1
                        found = np.flatnonzero(place)
                        place[found] = np.arange(len(found))
                        at = np.repeat(np.arange(len(some)) * len(found), sizes[some]) + place[flat]
                        place[found] = 0
                        counted = np.bincount(at, minlength=len(some) * len(found)).reshape(len(some), -1).astype(np.float32) @ weighed[found]
                        own[some, : 2 * size] = counted[:, :-1] / counted[:, -1:]
                        starts, v = (np.cumsum(sizes) - sizes)[some], vectors[flat]
                        v[:-1] *= v[1:]
                        v[starts + sizes[some] - 1] = 0
                        own[some, 2 * size :] = np.add.reduceat(v, starts, axis=0) / sizes[some][:, None]
                    out += [x.tobytes() for x in own]
            yield {"doc_id": b["doc_id"], "vec": out}

    return arrow_map(docs.select("doc_id", "text"), each, f"doc_id {dict(docs.dtypes)['doc_id']}, vec binary")


class Network:
    """Two layers (ReLU, sigmoid) trained by Adam; a temperature fitted on a tenth held back divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        x = (x - self.mean) / self.spread
        self.w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, 1)), np.zeros(1)]
        self.temperature = 1.0
        if not len(x):
            return
        order = rng.permutation(len(x))
        check, rows = order[: len(x) // 10], order[len(x) // 10 :]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            rng.shuffle(rows)
            for k in range(0, len(rows), 128):
                a, b = x[rows[k : k + 128]], y[rows[k : k + 128], None]
                h = np.maximum(a @ self.w[0] + self.w[1], 0)
                d = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - b) / len(a)
                back = (d @ self.w[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((a.T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ d + 1e-4 * self.w[2], d.sum(0))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= 2e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if len(check):
            z, b = self._logit(x[check]), y[check]
            loss = lambda t: np.mean(np.logaddexp(0, z / t) - b * z / t)
            self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def _logit(self, x):
        return (np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self._logit((x - self.mean) / self.spread) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def classify(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 14, size: int = 64, sample: int = 20_000, folds: int = 3, seed: int = 11) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text), from labels (doc_id, quality).

    held_out: crc32 of the doc_id as text (null: the empty text) leaves 1 modulo folds; only other rows' labels are learnt, at most `sample` of them, the first by a hash of doc_id. Word vectors come from all texts.
    Of several labels of a doc_id the least counts, and of several texts the one with the least vector, so reruns learn the same. Null and blank texts are scored like a text of no words; with no label, scores come from an untrained network; repeated rows are scored alike; very long texts are read whole; an empty table gives an empty result.
    """
    held = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % folds == 1
    vectors = keep(pooled(docs, *word_vectors(docs, buckets, size, seed)))
    chosen = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` rows of two numbers, so it may be broadcast; the driver gets their vectors
    known = vectors.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("vec").alias("vec"), F.min("quality").alias("quality")).toPandas().sort_values("doc_id")
    x = np.array([np.frombuffer(v, np.float32) for v in known["vec"]], np.float64).reshape(-1, 3 * size)
    network = Network(x, known["quality"].to_numpy(np.float64))

    def each(batches):
        for b in batches:
            s = network.score(np.frombuffer(b"".join(b["vec"].to_pylist()), np.float32).reshape(-1, 3 * size).astype(np.float64))
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return arrow_map(vectors.withColumn("held_out", held(F.col("doc_id"))), each, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
