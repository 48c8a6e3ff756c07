"""Prefix tries, packing and centroid clustering against plain Python, and on awkward rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripleweft.llm import centroids, packing, prefix_trie, queries

SMALL = "/root/testdata/sf0.001"


def brute_trie(rows):
    own: dict = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))
    order = lambda v: (v[0] is not None, v[0] or 0, hashlib.md5(f"{len(v[1])}:{v[1]}{v[2]}".encode()).digest())
    own = {c: [v[1:] for v in sorted(found, key=order)] for c, found in own.items()}
    whole = {c: own.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + found[h:] for c, found in own.items()}
    members: dict = {}
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members.setdefault(tuple(whole[c][:d]), []).append(c)
    kids: dict = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids.get(p, [])) or 1
        saved[p] = sum(saved[q] for q in kids.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(whole[c]) == len(p)).encode()).hexdigest()
    return sorted((members[p][0], len(p), members[p[:-1]][0] if p else -1, len(members[p]), len(kids.get(p, [])), leaves[p], saved[p], ends(p)) for p in members)


def nodes(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def chats(spark, rows):
    """Extra columns with names that the operator uses."""
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("c", "g", "pos", "digest", "w", "len", "ends", "_at")})


COPIES = [(c, t, "user", f"copied turn {t}" if t < 12 else f"own {c % 3} {t}") for c in range(300, 700) for t in range(12 + c % 3)]
ODD = [
    (0, None, "user", "null comes first"), (0, 1, None, None), (0, 1, "", ""), (0, 2, "user", "x" * 200_000), (1, 0, "user", "Ünïcode \U0001f600"), (1, 0, "user", "Ünïcode \U0001f600"),
    (101, 0, "user", "no base"), (None, 0, "user", "no conversation"), (2, 5, "assistant", "late"), (7, 0, "user", "a"), (7, 1, "user", "b"), (107, 0, "u", "ser"), (207, 0, "us", "er"), (-5, 0, "user", "below"),
]


@pytest.mark.parametrize("sizes", [{}, {"most_rows": 5, "least_rows": 1}])
@pytest.mark.parametrize("rows", ["table", "copies", "odd"])
def test_trie(spark, rows, sizes):
    if rows == "table":
        df = spark.read.parquet(f"{SMALL}/conversations.parquet")
        rows = [tuple(r) for r in df.collect()]
    else:
        rows = COPIES if rows == "copies" else ODD
        df = chats(spark, rows)
    assert nodes(prefix_trie.trie(df, **sizes)) == brute_trie(rows)


def test_trie_of_one_long_conversation(spark):
    rows = [(3, t, "user", f"turn {t}") for t in range(400)] + [(4, t, "user", f"turn {t}") for t in range(401)] + [(5, 0, "user", "turn 0")]
    assert nodes(prefix_trie.trie(chats(spark, rows), most_rows=50, least_rows=1)) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(chats(spark, [])).collect() == []
    assert prefix_trie.trie(chats(spark, [(None, 1, "a", "b")])).collect() == []


def test_ends_over_several_strings(spark):
    df = spark.createDataFrame([("k", c) for c in range(100, 0, -1)] + [("m", 5)], "key string, c long")
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert {tuple(r) for r in prefix_trie.ends_of(df, chunk=7).collect()} == {("k", sha(range(1, 101))), ("m", sha([5]))}


def brute_fit(sizes, room):
    bins, left = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = next((j for j, r in enumerate(left) if r >= sizes[i]), None)
        if at is None:
            at = len(bins)
            bins.append([])
            left.append(room)
        bins[at].append(i)
        left[at] -= sizes[i]
    return bins


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300])
def test_first_fit_decreasing(n):
    sizes = np.random.default_rng(n).integers(1, 65, n)
    bins = packing.first_fit_decreasing(sizes, 64)
    assert bins == brute_fit(sizes.tolist(), 64)
    pieces = [[(i, 0, int(sizes[i])) for i in b] for b in bins]
    full = packing.filled(pieces, 64)
    assert all((k := sum(m for *_, m in b)) == 64 or k & (k - 1) == 0 and k < 64 for b in full)
    at = [0] * n
    for i, a, m in sorted(p for b in full for p in b):
        assert a == at[i] and m > 0
        at[i] += m
    assert at == sizes.tolist()
    assert sum(map(len, full)) <= n + len(bins) + 8  # few cuts


TEXTS = ["", " ", "a b", " a  b ", "a \n b\n\nc d", "it's  we'll\tgo  ", "x y z  w", "\x1c a \x1f b", "1 2,3 !? ...", "no<|endoftext|> end <|endof", "中文 字符 \U0001f600 a", "tail ", "\n", "a\n b", "a b\n"]


def test_segments_have_the_ids_of_the_whole_text():
    coder, plain = packing.SegmentEncoder(queries.BYTE_VOCABULARY, most=10), Tokenizer.from_file(queries.BYTE_VOCABULARY)
    rng = np.random.default_rng(3)
    texts = TEXTS + ["".join(rng.choice(list("ab'  .\n\t1é中 "), 60)) for _ in range(500)]
    for t in texts:
        assert "".join(packing.segments(t)) == t
    assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def check_packed(docs, rows, room=2048):
    """Every id lies in exactly one piece; sequences are gapless, of `room` ids or a power of two; checksums are those of the whole encoding."""
    plain = Tokenizer.from_file(queries.BYTE_VOCABULARY)
    want: Counter = Counter()
    for d, t in docs:
        want[d, tuple(plain.encode(t or "", add_special_tokens=False).ids + [1])] += 1
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in sequences.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at and n > 0
            at += n
        assert at <= room and at & (at - 1) == 0
    pieces: Counter = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    cover: Counter = Counter()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    by_id: dict = {}
    for (d, ids), n in want.items():
        by_id.setdefault(d, []).append((ids, n))
    for (d, start, n, c, total), times in pieces.items():
        assert any(len(ids) == total and crc(ids[start : start + n]) == c for ids, _ in by_id[d])
        cover[d] += n * times
    assert cover == Counter({d: sum(len(ids) * n for ids, n in found) for d, found in by_id.items()})
    for d, found in by_id.items():
        if len(found) == 1 and found[0][1] == 1:
            at = 0
            for start, n in sorted((r.start, r.length) for r in rows if r.doc_id == d):
                assert start == at
                at += n


def test_packing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = packing.pack(docs, queries.BYTE_VOCABULARY, group_docs=64).collect()
    check_packed([tuple(r) for r in docs.collect()], rows)


def test_packing_awkward(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(1 << 60, None), (None, None), (None, "no id " * 2000), (3, "a repeated row"), (3, "a repeated row"), (99, "long text " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("ids", "start", "_place", "_group", "sequence_id", "offset")})
    check_packed(docs, packing.pack(df, queries.BYTE_VOCABULARY).collect())
    assert packing.pack(df.limit(0), queries.BYTE_VOCABULARY).collect() == []


def brute_centroids(rows, k=40, rounds=5):
    kept = [(i, [math.floor(float(x) * 256) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    now = [v for _, v in first]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((away(v, c), j) for j, c in enumerate(now))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        groups = [[v for (_, v), c in zip(kept, of) if c == j] for j in range(len(now))]
        now = [[sum(col) // len(g) for col in zip(*g)] if g else now[j] for j, g in enumerate(groups)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in found), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("cluster", "distance", "ids", "kind", "_h")})


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_centroids(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    assert got(centroids.cluster(df, block=100)) == brute_centroids([tuple(r) for r in df.collect()])


def test_centroids_with_ties_and_copies(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(0, 3, 64) / 256).tolist()) for i in range(150)] + [(i, [0.5] * 64) for i in range(150, 400)] + [(1, [2.0] * 64), (1, [2.0] * 64), (None, [0.25] * 64), (None, None)]
    rows += [(500, [1.0] * 63), (501, [1.0] * 65), (502, [None] * 64), (503, [float("nan")] + [1.0] * 63), (504, [float("inf")] * 64), (505, []), (506, [-7000.0] * 64)]
    assert got(centroids.cluster(vectors(spark, rows), block=64)) == brute_centroids(rows)


def test_centroids_of_few(spark):
    rows = [(5, [0.1] * 64), (6, [0.2] * 64)]
    assert got(centroids.cluster(vectors(spark, rows))) == brute_centroids(rows)
    assert centroids.cluster(vectors(spark, [])).collect() == []
    assert centroids.cluster(vectors(spark, [(None, [0.1] * 64), (1, None)])).collect() == []
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(vectors(spark, [(1, [1e6] * 64), (2, [-1e6] * 64)])).collect()


def test_nodes_are_pruned():
    """Clustered vectors: most nodes are assigned whole, and all assignments are those of all distances."""
    rng = np.random.default_rng(9)
    middles = rng.integers(-400, 400, (40, 64))
    points = (middles[rng.integers(0, 40, 5000)] + rng.integers(-5, 6, (5000, 64))).astype(np.int64)
    tree, order = centroids.BoxTree.build(points)
    label, whole = np.full(len(points), -1), 0
    for node, rows, one in tree.assign(middles):
        a, b = tree.spans[node, :2]
        label[a:b] = one if rows is None else rows
        whole += (b - a) * (rows is None)
    assert (label == ((points[order][:, None] - middles[None]) ** 2).sum(2).argmin(1)).all()
    assert whole > 0.5 * len(points)
    assert (tree.sums[0] == points.sum(0)).all() and sorted(order) == list(range(len(points)))
