"""Benchmark decontamination by greedy string tiling."""

import re

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_map

TOKEN = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of all windows."""
    if len(ids) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        out = out * BASE + (ids[k : k + len(out)].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return out


def tiles(a: list, b: list, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length) of non-overlapping matches, longest first, then by place in a and b, none under least.

    For each length from the longest down, windows of b that no tile touches are kept by their Karp-Rabin hash, and those of a are looked up and compared.
    """
    out, free_a, free_b = [], [True] * len(a), [True] * len(b)
    x, y = np.array(a, np.int64), np.array(b, np.int64)

    def longest() -> int:
        low, high = least - 1, min(len(a), len(b))  # a match of n holds matches of n - 1
        while low < high:
            mid = (low + high + 1) // 2
            if np.isin(rolling(x, mid), rolling(y, mid)).any():
                low = mid
            else:
                high = mid - 1
        return low

    for width in range(longest(), least - 1, -1):
        where: dict = {}
        for j, h in enumerate(rolling(y, width).tolist()):
            where.setdefault(h, []).append(j)
        for i, h in enumerate(rolling(x, width).tolist()):
            for j in where.get(h, ()):
                if all(free_a[i : i + width]) and all(free_b[j : j + width]) and a[i : i + width] == b[j : j + width]:
                    out.append((i, j, width))
                    free_a[i : i + width] = [False] * width
                    free_b[j : j + width] = [False] * width
                    break
    return out


class Items:
    """Some test items: their tokens as numbers, and the items of each seed of `seed` shared tokens."""

    def __init__(self, items: list[tuple], seed: int):
        self.vocabulary: dict = {}
        self.items, self.seeds, self.width = [], {}, seed
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in TOKEN.findall((text or "").lower())]
            if ids:
                self.items.append((name, ids))
        for at, (_, ids) in enumerate(self.items):
            width = min(seed, len(ids))
            for h in set(rolling(np.array(ids), width).tolist()):
                self.seeds.setdefault(width, {}).setdefault(h, []).append(at)
        self.sorted = {w: np.array(sorted(s), np.uint64) for w, s in self.seeds.items()}

    def find(self, text: str | None, threshold: float):
        """(item, tokens, covered tokens, tiles) of the items of which the text covers threshold or more."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in TOKEN.findall((text or "").lower())], np.int64)
        if not len(ids):
            return
        touched: dict = {}
        for width, known in self.sorted.items():
            ok = np.cumsum(np.concatenate(([0], ids < 0)))
            starts = np.flatnonzero(ok[width:] == ok[:-width]) if len(ids) >= width else ()
            if not len(starts):
                continue
            h = rolling(ids, width)[starts]
            hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            for p, k in zip(starts[hit].tolist(), h[hit].tolist()):
                for at in self.seeds[width][k]:
                    touched.setdefault(at, set()).update(range(p, p + width))
        for at, places in sorted(touched.items()):
            name, item = self.items[at]
            if len(places) < threshold * len(item) and len(places) < len(item):
                continue
            own, last = [], None
            for p in sorted(places):  # only what seeds cover can be in a tile; -1 parts what doesn't adjoin
                if last is not None and p != last + 1:
                    own.append(-1)
                own.append(int(ids[p]))
                last = p
            found = tiles(item, own, min(self.width, len(item)))
            covered = sum(n for _, _, n in found)
            if covered >= threshold * len(item):
                yield name, len(item), covered, len(found)


def blocks(benchmark: DataFrame, block_chars: int, seed: int):
    """The items, in blocks of about block_chars: the driver and each task hold one at a time."""
    part, held = [], 0
    for r in benchmark.select("item_id", "text").sort("item_id").toLocalIterator():
        part.append((r[0], r[1]))
        held += len(r[1] or "")
        if held >= block_chars:
            yield Items(part, seed)
            part, held = [], 0
    if part:
        yield Items(part, seed)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, seed: int = 5, block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, item_id, item_tokens, covered_tokens, tiles, coverage of each row of docs (doc_id, text) and item (item_id, text) where tiles cover threshold of the item.

    Tokens are runs of word characters, lower-cased; tiles have at least `seed` tokens (the whole item, if it has fewer). The items are a stated query set: each block of them goes
    to all documents. Null or blank texts and items match nothing; repeated rows each match; very long texts are searched whole; empty tables give an empty result.
    """
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, item_tokens long, covered_tokens long, tiles long, coverage double"
    out = None
    for items in blocks(benchmark, block_chars, seed):

        def each(batches, items=items):
            for b in batches:
                rows = [(d, *f) for d, t in zip(b["doc_id"].to_pylist(), b["text"]) for f in items.find(t.as_py(), threshold)]
                yield dict(zip(("doc_id", "item_id", "item_tokens", "covered_tokens", "tiles"), zip(*rows) if rows else [[]] * 5)) | {"coverage": [r[3] / r[2] for r in rows]}

        one = arrow_map(docs.select("doc_id", "text"), each, schema)
        out = one if out is None else out.unionAll(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, seed: int = 5, block_chars: int = 8_000_000) -> DataFrame:
    """The rows of docs whose text covers threshold of no item; see matches."""
    for items in blocks(benchmark, block_chars, seed):

        def clean(batches, items=items):
            for b in batches:
                yield b.filter([next(items.find(t.as_py(), threshold), None) is None for t in b.column("text")]) if b.num_rows else b

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
