"""Language identification: multinomial naive Bayes over hashed character n-grams."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

_LETTER: list = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def grams(texts: list, buckets: int):
    """(counts, ids, has): for each text how many n-grams of 1 to 3 characters it has, their buckets one text after another, and whether it has a letter.

    Texts are lower-cased, and what isn't a letter counts as a space; n-grams of spaces only are left out.
    """
    lower = [t.lower() for t in texts]
    chars = np.frombuffer(("".join("  " + t for t in lower) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 2 for t in lower])  # each text with the spaces before it, so no n-gram of it holds letters of another
    sizes[-1] += 2
    doc = np.repeat(np.arange(len(texts)), sizes)
    letter = letters()[chars]
    c = np.where(letter, chars, np.uint32(32)).astype(np.uint64)
    a, b, d = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    shift, size = np.uint64(40), np.uint64(buckets)
    two = letter[:-1] | letter[1:]
    three = letter[1:-1]
    h1 = (c * a >> shift) % size
    h2 = ((c[:-1] * b + c[1:]) * a >> shift) % size
    h3 = (((c[:-2] * d + c[1:-1]) * b + c[2:]) * a >> shift) % size
    ids = np.concatenate((h1[letter], h2[two], h3[three])).astype(np.int32)
    of = np.concatenate((doc[letter], doc[:-1][two], doc[:-2][three]))
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=len(texts))
    return counts, ids[order], np.bincount(doc[letter], minlength=len(texts)) > 0


def parts(texts: list, chars: int = 1_000_000):
    """Slices of texts of about so many characters."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def learn(docs: DataFrame, buckets: int = 1 << 15, smoothing: float = 0.5) -> tuple[list, np.ndarray]:
    """(languages, their log-probabilities: one row for each bucket, the last for the prior) of all rows of docs (text, lang).

    Every task adds up its own counts; a row for each language and bucket reaches the driver.
    """

    def each(batches):
        total: dict = {}
        for b in batches:
            texts, langs = [t or "" for t in b["text"].to_pylist()], b["lang"].to_pylist()
            for lo, hi in parts(texts):
                counts, ids, _ = grams(texts[lo:hi], buckets)
                code = {x: i for i, x in enumerate(sorted(set(langs[lo:hi])))}
                own = np.array([code[x] for x in langs[lo:hi]])
                table = np.bincount(np.repeat(own, counts) * buckets + ids, minlength=len(code) * buckets).reshape(-1, buckets)
                for x, i in code.items():
                    if x not in total:
                        total[x] = np.zeros(buckets + 1, np.int64)
                    total[x][:-1] += table[i]
                    total[x][-1] += int((own == i).sum())
        for x, t in total.items():
            at = np.flatnonzero(t)
            yield {"lang": [x] * len(at), "bucket": at, "n": t[at]}

    rows = arrow_map(docs.select("text", "lang"), each, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.zeros((buckets + 1, len(langs)))
    table[rows["bucket"], rows["lang"].map({x: i for i, x in enumerate(langs)})] = rows["n"]
    out = np.log(table + smoothing) - np.log((table[:-1] + smoothing).sum(0) if len(langs) else 1)
    out[-1] = np.log(np.maximum(table[-1], 1) / max(table[-1].sum(), 1))
    return langs, out


def predict(docs: DataFrame, model: tuple[list, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score: the likeliest language and its probability, from a text's mean log-probability times the root of its n-grams.

    Languages that tie: the least name. `und` with score 0: the text is null or has no letter, or no language was learnt. Repeated rows are predicted alike, whatever rows are beside them.
    """
    langs, table = model
    table, prior = table[:-1].astype(np.float32), table[-1]
    shared = docs.sparkSession.sparkContext.broadcast(table)  # buckets x languages

    def each(batches):
        names = np.array([*langs, "und"], object)
        for b in batches:
            texts = [t or "" for t in b["text"].to_pylist()]
            best, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
            for lo, hi in parts(texts) if langs else ():
                counts, ids, has = grams(texts[lo:hi], len(shared.value))
                some = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[some]
                total = np.add.reduceat(shared.value[ids], starts, axis=0, dtype=np.float64) if len(some) else np.zeros((0, len(langs)))
                total = (total + prior) / np.sqrt(counts[some])[:, None]
                p = np.exp(total - total.max(1, keepdims=True)) if len(some) else total
                p /= p.sum(1, keepdims=True)
                ok = has[some]
                best[lo + some[ok]], score[lo + some[ok]] = p[ok].argmax(1), p[ok].max(1)
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": names[best].tolist(), "score": score}

    return arrow_map(docs.select("doc_id", "text", "held_out"), each, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang).

    Learns from the rows with a language whose crc32 of the doc_id as text (null: the empty text) isn't divisible by folds. Very long texts are read whole, in slices; texts that are null or have no letter are und; repeated rows get the same answer; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 0)
    return predict(rows, learn(rows.where("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL")))
