"""Token ids in wavelet matrices: bit planes with rank and select, a file for each range of documents."""

import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, partitions, shared_path, with_offsets

MAGIC, STEP = b"WVM1", 512
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks without the apostrophe, which the vocabulary takes with letters behind it


class WaveletMatrix:
    """A sequence of unsigned ids below 2^bits as bit planes, the highest bit first; each plane is stably split into zeros and ones.

    to_bytes and from_bytes: magic, n, bits, then a deflated body of each plane's count of zeros, its bits and its ones before every 512 bits.
    """

    def __init__(self, n: int, planes: list, zeros: list, ranks: list):
        self.n, self.planes, self.zeros, self.ranks, self.bits = n, planes, zeros, ranks, len(planes)

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        n, top = len(ids), int(ids.max()) if len(ids) else 0
        now = ids.astype(np.uint16 if top < 1 << 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (now >> bit & 1).astype(bool)
            packed = np.packbits(ones)
            planes.append(packed)
            padded = np.zeros(-(-n // STEP) * STEP // 8, np.uint8)
            padded[: len(packed)] = packed
            counts = np.bitwise_count(padded).reshape(-1, STEP // 8).sum(1, dtype=np.int64)
            ranks.append(np.concatenate(([0], np.cumsum(counts))).astype(np.uint32))
            zeros.append(n - int(ranks[-1][-1]))
            now = np.concatenate((now.take(np.flatnonzero(~ones)), now.take(np.flatnonzero(ones))))  # several times faster than masks
        return cls(n, planes, zeros, ranks)

    def to_bytes(self) -> bytes:
        body = b"".join(struct.pack("<Q", z) + p.tobytes() + r.astype("<u4").tobytes() for z, p, r in zip(self.zeros, self.planes, self.ranks))
        return MAGIC + struct.pack("<QI", self.n, self.bits) + zlib.compress(body, 1)

    @classmethod
    def from_bytes(cls, raw: bytes) -> "WaveletMatrix":
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, bits = struct.unpack_from("<QI", raw, 4)
        body, at = zlib.decompress(raw[16:]), 0
        planes, zeros, ranks = [], [], []
        for _ in range(bits):
            zeros.append(struct.unpack_from("<Q", body, at)[0])
            planes.append(np.frombuffer(body, np.uint8, -(-n // 8), at + 8))
            at += 8 + -(-n // 8)
            ranks.append(np.frombuffer(body, "<u4", -(-n // STEP) + 1, at))
            at += 4 * (-(-n // STEP) + 1)
        return cls(n, planes, zeros, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // STEP
        rest = np.unpackbits(self.planes[level][block * STEP // 8 : -(-i // 8)], count=i - block * STEP) if i > block * STEP else ()
        return int(self.ranks[level][block]) + int(np.sum(rest))

    def access(self, i: int) -> int:
        out = 0
        for k in range(self.bits):
            bit = self.planes[k][i >> 3] >> (7 - (i & 7)) & 1
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            out = out << 1 | int(bit)
        return out

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        if symbol < 0 or symbol >> self.bits:
            return 0, 0
        for k in range(self.bits):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if symbol >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """How often symbol comes among the first i ids."""
        lo, hi = self._range(symbol, 0, i)
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """Where symbol comes for the k-th time, from 0; -1: it doesn't."""
        lo, hi = self._range(symbol, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i = lo + k
        for level in range(self.bits - 1, -1, -1):
            one = symbol >> (self.bits - 1 - level) & 1
            want = i - self.zeros[level] if one else i
            starts = self.ranks[level].astype(np.int64)
            if not one:
                starts = np.minimum(np.arange(len(starts)) * STEP, self.n) - starts
            block = int(np.searchsorted(starts, want, "right")) - 1
            bits = np.unpackbits(self.planes[level][block * STEP // 8 : (block + 1) * STEP // 8])[: self.n - block * STEP]
            i = block * STEP + int(np.flatnonzero(bits == one)[want - starts[block]])
        return i

    def where(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up: each plane says how to merge the zeros and ones below it."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], count=self.n).view(bool)
            now = np.empty_like(out)
            now[np.flatnonzero(~ones)] = out[: self.zeros[k]]
            now[np.flatnonzero(ones)] = out[self.zeros[k] :] | out.dtype.type(1 << self.bits - 1 - k)
            out = now
        return out


_LOADED: dict = {}
PART_BYTES = 1 << 22  # so much text is split into pieces at once


class Encoder:
    """The ids of a text by the tokenizers library, which sees each piece between white space once.

    The vocabulary's rules never cross ASCII white space, so a text's ids are those of its pieces in turn. New pieces are encoded many at a time, a special token between them, since what lies between
    special tokens is encoded on its own; pieces of letters only, each of which is one word, stand between spaces where the vocabulary marks the ends of words. Some `most` pieces are remembered: when half as many are new, those not met since the last time are forgotten.
    """

    def __init__(self, path: str, most: int = 1_500_000, between: str = "<|startoftext|>"):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.old, self.half, self.between = Tokenizer.from_file(path), {b"": b""}, {}, most // 2, between
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.cut = self.tokenizer.token_to_id(between)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _keep(self, part: list, ids: np.ndarray, starts: list, ends: list) -> None:
        raw, wide = ids.tobytes(), ids.itemsize
        for p, a, b in zip(part, starts, ends, strict=True):
            self.known[p] = raw[a * wide : b * wide]

    def add(self, pieces) -> None:
        """Learns pieces; of a piece that ends in a letter and marks, what ends in the letter and the marks are learnt apart."""
        known, old, letters, rest, cut = self.known, self.old, set(), set(), []

        def learn(p):
            if p in old:
                known[p] = old[p]
            elif p not in known:
                (letters if p.isalpha() or not p.isascii() and p.decode().isalpha() else rest).add(p)

        for p in pieces:
            if p in old:
                known[p] = old[p]
            elif p.isalpha():
                letters.add(p)
            else:
                word = p.rstrip(MARKS)
                # the last letter as the vocabulary sees it, since some turn into a letter and a mark, which it takes with marks behind it
                if word and len(word) < len(p) and (word[-1:].isalpha() if word.isascii() else unicodedata.normalize("NFC", word.decode()).lower()[-1].isalpha()) and b"<|" not in p:
                    cut.append((p, word, p[len(word) :]))
                    learn(word)
                    learn(p[len(word) :])
                else:
                    learn(p)
        alone = [p for p in rest if b"<|" in p] if self.cut is not None else [*letters, *rest]
        for p in alone:
            known[p] = self._ids(p.decode()).tobytes()
        letters, rest = ([], []) if self.cut is None else (list(letters), list(rest.difference(alone)))
        for i in range(0, len(letters), 5000):
            part = letters[i : i + 5000]
            ids = self._ids(b" ".join(part).decode())
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(part):  # letters are a word at least, so each piece is one
                self._keep(part, ids, [0, *ends[:-1]], ends)
            else:
                rest += part
        for i in range(0, len(rest), 5000):
            part = rest[i : i + 5000]
            ids = self._ids(self.between.encode().join(part).decode())
            ends = [*np.flatnonzero(ids == self.cut).tolist(), len(ids)]
            self._keep(part, ids, [0, *[e + 1 for e in ends[:-1]]], ends)
        for p, word, marks in cut:
            known[p] = known[word] + known[marks]

    def encode(self, texts) -> list[np.ndarray]:
        """The ids of each text of a list or Arrow array. Arrow numbers the pieces of these texts, each is looked up once, and its ids are taken wherever it stands."""
        if len(self.known) > self.half:
            self.known, self.old = {b"": b""}, self.known
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        special = pc.match_substring(texts, "<|")  # special tokens are spelt in one way only
        low = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(pc.if_else(special, texts, low) if pc.any(special).as_py() else low)
        pieces = lists.flatten().dictionary_encode()
        names = pieces.dictionary.cast(pa.large_binary())
        cuts, raw = np.frombuffer(names.buffers()[1], np.int64)[: len(names) + 1].tolist(), names.buffers()[2].to_pybytes() if len(names) else b""
        names = [raw[a:b] for a, b in zip(cuts, cuts[1:])]  # some four times faster than to_pylist
        found = list(map(self.known.get, names))
        new = [i for i, f in enumerate(found) if f is None]
        self.add([names[i] for i in new])
        for i in new:
            found[i] = self.known[names[i]]
        ids = pa.array(found, pa.large_binary()).take(pieces.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] // np.dtype(self.kind).itemsize if len(ids) else np.zeros(1, np.int64)
        every = np.frombuffer(ids.buffers()[2], self.kind) if at[-1] else np.zeros(0, self.kind)
        ends = at[np.asarray(lists.offsets) - lists.offsets[0].as_py()].tolist()
        return [every[a:b] for a, b in zip(ends, ends[1:])]


def encoder(path: str) -> Encoder:
    """One for each process, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, block_tokens: int = 1 << 18) -> None:
    """Writes the ids of every row of docs (doc_id, text), end_id after each, by ascending doc_id (null first; rows of one doc_id by their text's hash).

    Each range of documents is one file in folder; a row of it holds a block of whole documents, of block_tokens ids or one document: doc_ids,
    ends (running counts of ids in the block) and data, a WaveletMatrix. Null texts are empty; very long ones are a block of their own; repeated rows are written each. Spark's committer drops what a lost executor left.
    """

    def each(batches):
        at, coder = 0, encoder(tokenizer)
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        names, ends, parts, held = [], [], [], 0

        def block():
            nonlocal at, names, ends, parts, held
            data = WaveletMatrix.build(np.concatenate(parts)).to_bytes()
            out = {"shard": [shard], "block": [at], "n_tokens": [held], "doc_ids": [names], "ends": [ends], "data": [data]}
            at, names, ends, parts, held = at + 1, [], [], [], 0
            return out

        tail = np.array([end_id], coder.kind)
        for b in batches:
            step = max(1, min(5000, len(b["text"]) * PART_BYTES // max(1, b["text"].nbytes)))
            for i in range(0, len(b["text"]), step):
                for name, ids in zip(b["doc_id"].slice(i, step).to_pylist(), coder.encode(b["text"].slice(i, step))):
                    if held and held + len(ids) + 1 > block_tokens:
                        yield block()
                    held += len(ids) + 1
                    names.append(name)
                    ends.append(held)
                    parts += [ids, tail]
        if names:
            yield block()

    dealt = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text"))  # texts of one doc_id may lie in several ranges
    dealt = dealt.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), "_h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h").drop("_h")
    arrow_map(dealt, each, f"shard int, block int, n_tokens long, doc_ids array<{dict(docs.dtypes)['doc_id']}>, ends array<long>, data binary").write.parquet(folder)


def read(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of write."""
    files = spark.read.parquet(folder)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    starts = with_offsets(files.select("shard", "block", "n_tokens"), ["shard", "block"], {"first": F.col("n_tokens")}).drop("n_tokens")
    if starts.count() <= 500_000:  # a row for each block of 2^18 ids; else the join shuffles
        starts = F.broadcast(starts)

    def each(batches):
        for b in batches:
            for first, names, ends, data in zip(*[b[k].to_pylist() for k in ("first", "doc_ids", "ends")], b["data"]):
                ids, begins = WaveletMatrix.from_bytes(data.as_py()).decode().astype("<u4"), [0, *ends[:-1]]
                yield {"doc_id": names, "start": [first + a for a in begins], "n_tokens": [b - a for a, b in zip(begins, ends)], "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]}

    return arrow_map(files.join(starts, ["shard", "block"]).select("first", "doc_ids", "ends", "data"), each, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs into a new folder of the shared place and reads the files back. An empty table gives an empty result."""
    folder = shared_path(docs.sparkSession, "tokens")
    write(docs, tokenizer, folder)
    return read(docs.sparkSession, folder)
