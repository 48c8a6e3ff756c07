"""Packing of token sequences: first-fit decreasing over a tournament tree of bin capacities, in random groups of documents."""

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keep

_LOADED: dict = {}


#: White space but spaces and newlines, and the mark used to cut: a text with one of them is cut with more care.
ODD = re.compile("[\\x00\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: And so is one with white space twice in a row.
TWICE = ("  ", "\n\n", " \n", "\n ")
#: ASCII marks that are neither letters nor digits.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class SegmentEncoder:
    """The ids of whole texts by a byte-level vocabulary, which sees each segment of text once.

    Its pattern takes a space in front of a word to that word and never joins letters, marks and white space otherwise, so a text may be cut around a newline and before a space that stand alone between
    characters that are not white space, and between a word and the marks behind it: the ids are those of the pieces in turn. Pieces are encoded many at a time, a newline between them.
    Texts with a special token's beginning are encoded whole. Some `most` segments are remembered: when half as many are new, those not met since the last time are forgotten.
    """

    def __init__(self, path: str, most: int = 2_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.old, self.half = Tokenizer.from_file(path), {}, {}, most // 2
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.newline = self._ids("\n")[0]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def learn(self, segments) -> None:
        known, old, plain, cut = self.known, self.old, set(), []
        for s in segments:
            if s in old:
                known[s] = old[s]
                continue
            if "\n" in s or s[-1:].isspace() or s[:1].isspace() and s[:1] != " ":
                known[s] = self._ids(s).tobytes()
                continue
            stem = s.rstrip(MARKS)
            if len(stem) < len(s) and stem and stem[-1].isalpha() and stem[-1] < "\u0250":  # letters of old, that all tables of letters have
                marks = s[len(stem) :]
                cut.append((s, stem, marks))
                plain.add(stem)
                plain.add(marks)
            else:
                plain.add(s)
        rest = []
        for p in plain:
            if p in old:
                known[p] = old[p]
            elif p not in known:
                rest.append(p)
        for i in range(0, len(rest), 10_000):
            part = rest[i : i + 10_000]
            ids = self._ids("\n".join(part))
            ends = [*np.flatnonzero(ids == self.newline).tolist(), len(ids)]
            raw, wide, at = ids.tobytes(), ids.itemsize, 0
            for p, end in zip(part, ends, strict=True):
                known[p] = raw[at * wide : end * wide]
                at = end + 1
        for s, stem, marks in cut:
            known[s] = known[stem] + known[marks]

    def encode(self, texts: list) -> list[bytes]:
        """The ids of each text as bytes."""
        if len(self.known) > self.half:
            self.known, self.old = {}, self.known
        cut = [None if "<|" in t else segments(t) for t in texts]
        found = [c and list(map(self.known.get, c)) for c in cut]
        missing = []
        for c, f in zip(cut, found):
            at = []
            if c:
                i = -1
                for _ in range(f.count(None)):
                    i = f.index(None, i + 1)
                    at.append(i)
            missing.append(at)
        self.learn({c[i] for c, at in zip(cut, missing) if at for i in at})
        for c, f, at in zip(cut, found, missing):
            for i in at:
                f[i] = self.known[c[i]]
        return [self._ids(t).tobytes() if f is None else b"".join(f) for t, f in zip(texts, found)]


def segments(text: str) -> list[str]:
    """text cut around single newlines and before single spaces; in texts with other white space, before single spaces alone."""
    if not text:
        return []
    if not text[0].isspace() and not text[-1].isspace() and not any(x in text for x in TWICE) and not ODD.search(text):
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
    parts = text.split(" ")
    out, held = [], parts[0]
    for p in parts[1:]:
        if p and held and not p[0].isspace() and not held[-1].isspace():
            out.append(held)
            held = " " + p
        else:
            held = f"{held} {p}"
    out.append(held)
    return out


def encoder(path: str) -> SegmentEncoder:
    """One for each process, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = SegmentEncoder(path)
    return _LOADED[path]


def first_fit_decreasing(sizes: np.ndarray, room: int) -> list[list[int]]:
    """Bins of at most `room`, each a list of positions in sizes: the largest first (ties by position), each into the first bin that has room for it.

    A tournament tree over the bins holds in each node the largest capacity left below it, so that the first bin with room is found from the root.
    """
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    tree = [room] * (2 * width)
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, at = int(sizes[i]), 1
        while at < width:
            at *= 2
            if tree[at] < size:
                at += 1
        if at - width == len(bins):
            bins.append([])
        bins[at - width].append(i)
        tree[at] -= size
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
    return bins


def filled(bins: list[list[tuple[int, int, int]]], room: int) -> list[list[tuple[int, int, int]]]:
    """Bins of pieces (document, start, length), cut anew so that each holds `room` or a power of two.

    The emptiest bins are poured into the gaps of the fullest; a piece is cut only where a gap ends in it. What is left of the last bin is cut into powers of two.
    """
    load = lambda b: sum(n for *_, n in b)
    ready = lambda n: n == room or n & (n - 1) == 0
    done = [b for b in bins if ready(load(b))]
    rest = sorted((b for b in bins if not ready(load(b))), key=lambda b: -load(b))
    front, held = 0, []
    while front < len(rest):
        now = list(rest[front])
        front += 1
        gap = room - load(now)
        while gap and (held or front < len(rest)):
            if not held:
                held = rest.pop()
            d, start, n = held.pop()
            take = min(gap, n)
            now.append((d, start, take))
            gap -= take
            if take < n:
                held.append((d, start + take, n - take))
        if not gap or ready(load(now)):
            done.append(now)
        else:
            held = now + held
    while held:  # the last bin, by the bits of its size
        now, part = [], 1 << (load(held).bit_length() - 1)
        while part:
            d, start, n = held.pop()
            take = min(part, n)
            now.append((d, start, take))
            part -= take
            if take < n:
                held.append((d, start + take, n - take))
        done.append(now)
    return done


def pack(docs: DataFrame, tokenizer: str, room: int = 2048, end_id: int = 1, group_docs: int = 4096, seed: int = 12) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every row of docs (doc_id, text); end_id follows each text.

    Every whole `room` ids of a document are a sequence of their own, where they lie; only what remains (under `room` ids a document) is shuffled, to random groups of some group_docs
    documents. Each group is packed on its own: first-fit decreasing, then the emptiest sequences are cut to fill the gaps of the others, and what is left over is cut into powers of two. So a
    sequence holds `room` ids, or a power of two, and nothing is padded. room must be a power of two.

    Null and empty texts are the end id alone. Repeated rows, and rows without a doc_id, are packed each. Very long texts are encoded whole in their task, and are one row of `room` ids for
    each sequence from then on. An empty table gives an empty result. Other columns are not read. Groups are random by a hash of a row's place in its input split, written once,
    so a lost executor changes nothing that was packed.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches):
        from pyspark import TaskContext

        coder, split, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        tail = np.array([end_id], coder.kind).tobytes()
        wide = len(tail)
        step = room * wide
        for b in batches:
            for i in range(0, len(b["text"]), 250):
                out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "_place")}
                names = b["doc_id"].slice(i, 250).to_pylist()
                for name, ids in zip(names, coder.encode([t or "" for t in b["text"].slice(i, 250).to_pylist()])):
                    ids += tail
                    at += 1
                    for a in range(0, len(ids), step):
                        part = ids[a : a + step]
                        whole = len(part) == step
                        row = (name, a // wide, len(part) // wide, _crc(part, coder.kind) if whole else None, len(ids) // wide, None if whole else part, split << 32 | at)
                        for k, v in zip(out, row):
                            out[k].append(v)
                yield out

    pieces = keep(arrow_map(docs.select("doc_id", "text"), each, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, _place long"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = pieces.where("ids IS NULL").withColumns({"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")}).select(*names)  # odd numbers
    ends = pieces.where("ids IS NOT NULL")
    groups = max(1, -(-ends.count() // group_docs))
    ends = ends.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "_place"), F.lit(groups))).select("_group", "_place", F.col("doc_id").cast("string"), "start", "doc_tokens", "ids")  # pandas has no null longs

    def packed(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("_place")
        ids, starts = x["ids"].tolist(), x["start"].tolist()
        wide = 2 if coder_kind == "<u2" else 4
        sizes = np.array([len(r) // wide for r in ids])
        bins = [[(i, 0, int(sizes[i])) for i in b] for b in first_fit_decreasing(sizes, room)]
        out = {k: [] for k in ("row", "start", "length", "ids_crc32", "sequence_id", "offset")}
        first = int(x["_group"].iloc[0]) << 33
        for n, b in enumerate(filled(bins, room)):
            at = 0
            for i, a, size in b:
                for k, v in zip(out, (i, starts[i] + a, size, _crc(ids[i][a * wide : (a + size) * wide], coder_kind), first + 2 * n, at)):
                    out[k].append(v)
                at += size
        rows = out.pop("row")
        return pd.DataFrame({k: x[k].take(rows).to_numpy() for k in ("doc_id", "doc_tokens")} | out)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    coder_kind = encoder(tokenizer).kind
    rest = ends.groupBy("_group").applyInPandas(packed, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return whole.unionByName(rest.withColumn("doc_id", F.col("doc_id").cast(kind)))


def _crc(ids: bytes, kind: str) -> int:
    return zlib.crc32(np.frombuffer(ids, kind).astype("<u4").tobytes())
