"""The pipeline against a version in plain Python, stage by stage."""

import hashlib
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tripleweft.llm import queries

from test_near_copies import kept_by_brute_force
from test_operators import SMALL, WORD, brute_counts, brute_tiles, brute_tokens


def brute_rules(rows):
    """Rows that pass the rules, of hosts that pass."""
    facts, hosts = [], {}
    for r in rows:
        n, _, symbols, dup, repeat = brute_counts(r["text"])
        fails = (n < 10, 100 * repeat > 20 * n, 10 * symbols > 3 * n, dup > 0 and 10 * dup > 3 * n)
        facts.append(fails)
        hosts.setdefault(r["source"], []).append(fails)
    bad = set()
    for k in range(4):
        rates = {s: sum(f[k] for f in found) / len(found) for s, found in hosts.items()}
        m = sum(rates.values()) / len(rates)
        v = sum((x - m) ** 2 for x in rates.values()) / len(rates)
        strength = min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v > 0 else 1e6
        bad |= {s for s, found in hosts.items() if (sum(f[k] for f in found) + m * strength) / (len(found) + strength) > 0.5}
    return [r for r, f in zip(rows, facts) if not f[0] and not f[1] and r["source"] not in bad]


def brute_near(rows):
    """The stage's rule: five words, a Jaccard similarity of 0.8 or more."""
    ids = set(kept_by_brute_force([(r["doc_id"], r["text"]) for r in rows]))
    return [r for r in rows if r["doc_id"] in ids]


def brute_clean(rows, items):
    tokens = lambda t: re.findall(r"\w+", (t or "").lower())
    items = [tokens(t) for t in items]

    def dirty(text):
        text = tokens(text)
        grams = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        for item in items:
            shared = [i for i in range(len(item) - 4) if tuple(item[i : i + 5]) in grams]
            covered = {i + k for i in shared for k in range(5)}
            if item and len(covered) >= 0.5 * len(item):
                spots = {i + k for i in range(len(text) - 4) if tuple(text[i : i + 5]) in {tuple(item[j : j + 5]) for j in shared} for k in range(5)}
                own, last = [], None
                for p in sorted(spots):
                    own += [None] * (last is not None and p != last + 1) + [text[p]]
                    last = p
                if sum(n for *_, n in brute_tiles(item, own, 5)) >= 0.5 * len(item):
                    return True
        return False

    return [r for r in rows if not dirty(r["text"])]


def brute_mix(rows, weights=(5, 2, 1), most=3):
    size = lambda r: len(WORD.findall(r["text"] or ""))
    own: dict = {}
    for r in rows:
        own[r["source"]] = own.get(r["source"], 0) + size(r)
    names = sorted((s for s in own if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in own)
    weight, held = {s: weights[i % 3] for i, s in enumerate(names)}, {}
    while True:
        share = (sum(own.values()) - sum(held.values())) / sum(w for s, w in weight.items() if s not in held)
        over = {s: most * own[s] for s in names if s not in held and share * weight[s] > most * own[s]}
        if not over:
            break
        held |= over
    out = []
    for s in names:
        target = held.get(s, share * weight[s])
        whole = int(target // own[s]) if own[s] else 0
        rest = int(target) - whole * own[s]
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: (hashlib.md5(f"7:{r['doc_id']}".encode()).hexdigest()[:16], str(r["doc_id"]))):
            out += [dict(r) for _ in range(whole)]
            if 0 < rest < size(r):
                words = list(WORD.finditer(r["text"]))
                end = words[rest].start() if rest < len(words) else len(r["text"])
                out.append(dict(r, text=r["text"][:end]))
            elif rest > 0 and size(r):
                out.append(dict(r))
            rest -= min(max(rest, 0), size(r))
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [r.asDict() for r in docs.collect()]
    now, want = docs, rows
    brute = [brute_rules, brute_near, lambda rows: brute_clean(rows, items), brute_mix]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "decontamination", "mixing", "token_output"]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, brute):
        now, want = stage(spark, now, SMALL), plain(want)
        got = sorted((r.doc_id, r.text) for r in now.collect())
        assert now.columns == docs.columns, name
        assert got == sorted((r["doc_id"], r["text"]) for r in want), name
        now = spark.createDataFrame(now.collect(), docs.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, now, SMALL).collect()
    tokenizer = Tokenizer.from_file(queries.VOCABULARY)
    texts: dict = {}
    for r in want:
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert sum(r.n_tokens for r in out) == sum(x[2] for x in brute_tokens([(d, t) for d, found in sorted(texts.items()) for t in found], tokenizer))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == sorted((d, n, c) for d, found in texts.items() for t in found for _, _, n, c in brute_tokens([(d, t)], tokenizer))
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


@pytest.mark.parametrize("k", range(5))
def test_empty(spark, k):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, docs, SMALL).count() == 0
