"""The numbered operators against SQL, brute force, exact round trips and held-out labels, and on awkward rows."""

import hashlib
import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripleweft.llm import decontaminate, html_extract, language, licenses, mixing, quality_model, quality_rules, queries, simhash, suffix_dedup, wavelet

DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")

AWKWARD = [
    (1, None, None, None, 0), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one", None, None, 3), (None, "text without an id " * 4, "de", "b", 1), (None, None, None, None, None),
    (5, "the same words in a row, the same words in a row, the same words in a row " * 9, "en", "b", 1), (5, "the same words in a row, the same words in a row, the same words in a row " * 9, "en", "b", 1),
    (6, "Ünïcode ſtraße 中文 字符 \U0001f600 " * 30, "xx", "ü", 1), (7, "long " + " ".join(f"w{i}" for i in range(60_000)), "en", "a", 1), (8, "No-break space and\x1fcontrol <|endoftext|> #*$%&|<>", "en", "a", 1),
]


def awkward(spark, rows=AWKWARD):
    """Extra columns whose names clash with those the operators use."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("x") for c in ("size", "_h", "kept", "fp", "rep", "spans", "_t", "target", "whole", "extra", "held_out", "_sig", "_d", "vec", "anchor", "component_id", "_s", "n_words", "_n", "_range")})


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda x: (x is not None, x))


def sql_rows(rel_or_df):
    if hasattr(rel_or_df, "fetchall"):
        names, values = rel_or_df.columns, rel_or_df.fetchall()
    else:
        names, values = rel_or_df.columns, [tuple(r) for r in rel_or_df.collect()]
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda v: f"{v:.6g}" if isinstance(v, float) else repr(v)
    return sorted(([r[i] for i in order] for r in values), key=lambda r: [key(v) for v in r])


def alike(a, b):
    """The same rows, but for the last digits of floats."""
    same = lambda x, y: math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) if isinstance(x, float) and isinstance(y, float) else x == y
    return len(a) == len(b) and all(same(x, y) for p, q in zip(a, b) for x, y in zip(p, q))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert alike(sql_rows(queries.queries()[name](spark, DATA)), sql_rows(con.sql(queries.oracle_sql()[name])))


def brute_counts(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    at: dict = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    cover = {i + k for found in at.values() if len(found) > 1 for i in found for k in range(5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark):
    got = quality_rules.verdicts(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    want = sorted((r[0] or 0, *brute_counts(r[1])) for r in AWKWARD)
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality_rules.passed(awkward(spark)).columns == awkward(spark).columns
    assert quality_rules.verdicts(awkward(spark, [])).count() == 0


def test_host_rules_reject_a_bad_host(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "# # # # # $ $ $ $ $ a b c d e"
    rows = [(i, good, None, f"good{i % 8}", 1) for i in range(400)] + [(i, bad, None, "bad", 1) for i in range(400, 500)] + [(500, good, None, "bad", 1)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.verdicts(awkward(spark, rows)).collect()}
    assert got[0] == (False, True) and got[500] == (False, False)


def brute_print(text):
    words = [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g.encode(), seed=42).intdigest()
        for k in range(64):
            bits[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(grams))


def brute_components(prints, reach=2):
    """doc_id -> (fingerprint, least doc_id that can be reached)."""
    distinct = sorted(set(prints.values()))
    low = {fp: min(d for d, p in prints.items() if p == fp) for fp in distinct}
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= reach]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return {d: (f"{p:016x}", low[p]) for d, p in prints.items()}


def test_simhash(spark, documents):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents).collect()}
    want = brute_components({r.doc_id: brute_print(r.text) for r in documents.collect()})
    assert got == want
    assert sorted(ids(simhash.deduplicated(documents))) == sorted({c for _, c in want.values()})


@pytest.mark.parametrize("sizes", [{"shard_rows": 40}, {"shard_rows": 400, "most_rows": 100}])
def test_simhash_shards_lose_no_link(spark, sizes):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 62, 60, dtype=np.int64)
    fps = {0, 1, 3, 7}
    for c in centres.tolist():
        for _ in range(12):
            x = c
            for k in rng.integers(0, 63, rng.integers(0, 4)).tolist():
                x ^= 1 << k
            fps.add(x)
    prints = dict(enumerate(sorted(fps)))
    reps = spark.createDataFrame([(p, d) for d, p in prints.items()], "fp long, rep long")
    edges = simhash.links(reps, 2, **sizes).collect()
    low, wanted = {d: d for d in prints}, brute_components(prints)
    for _ in range(len(prints)):
        before = dict(low)
        for e in edges:
            low[e.u] = low[e.v] = min(low[e.u], low[e.v])
        if before == low:
            break
    assert low == {d: c for d, (_, c) in wanted.items()}


def test_simhash_awkward(spark):
    got = simhash.near_duplicates(awkward(spark))
    assert ids(got) == sorted((r[0] for r in AWKWARD), key=lambda x: (x is not None, x))
    assert {r.component_id for r in got.where("doc_id IN (1, 2, 3)").collect()} == {1}
    assert simhash.near_duplicates(awkward(spark, [])).count() == 0


def brute_removed(rows, length):
    where: dict = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            where[raw[i : i + length]] = where.get(raw[i : i + length], 0) + 1
    out = []
    for d, t in rows:
        raw, gone = (t or "").encode(), set()
        for i in range(len(raw) - length + 1):
            if where[raw[i : i + length]] > 1:
                gone.update(range(i, i + length))
        spans = sum(i - 1 not in gone for i in gone)
        out.append((d, len(raw), len(gone), spans, hashlib.sha256(bytes(b for i, b in enumerate(raw) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


def passages(seed=3):
    """Texts with shared passages of many lengths, runs of one byte, periods, and copies."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, rows = [text(n) for n in (20, 12, 60)], []
    for i in range(40):
        rows.append((i, text(30) + " " + common[i % 3] + " " + text(10) + (" " + common[2][i : i + 150] if i % 4 == 0 else "")))
    return rows + [(40, "a" * 700), (41, "b" + "a" * 300), (42, "ab" * 400), (43, rows[0][1]), (44, "ü" * 200), (45, None), (46, ""), (47, "x" * 99)]


@pytest.mark.parametrize("sizes", [{}, {"hot": 0}, {"hot": 2, "shard_bytes": 2000}])
def test_suffix_removal(spark, sizes):
    rows = passages()
    got = suffix_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string"), 100, keep_first=False, **sizes)
    assert sorted((tuple(r) for r in got.drop("text").collect()), key=repr) == brute_removed(rows, 100)


def heavy(seed=9):
    """One passage in every text, a large group of near copies, a group of exact copies, repeated rows, a long text, nulls."""
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))
    passage, base, rows = text(30), text(60).split(), []
    for i in range(90):
        rows.append((i, f"{text(8)} {passage} {text(5)}"))
    for i in range(90, 180):
        own = list(base)
        for at in rng.integers(0, 60, i % 6):
            own[at] = text(1)
        rows.append((i, " ".join(own)))
    copy = text(50)
    rows += [(i, copy) for i in range(180, 220)] + [(5, rows[5][1]), (200, copy), (None, copy), (None, None), (230, text(9000) + passage + text(2000))]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"hot": 4}])
def test_suffix_removal_with_heavy_copies(spark, sizes):
    rows = heavy()
    got = suffix_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string"), 100, keep_first=False, **sizes)
    # a repeated row is a place of its own
    assert sorted((tuple(r) for r in got.drop("text").collect()), key=repr) == brute_removed(rows, 100)
    assert got.count() == len(rows)


def test_suffix_removal_keeps_the_first(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(1, "first " + passage + " end"), (2, "second " + passage + " over"), (3, "alone " * 3)]
    got = {r.doc_id: r.text for r in suffix_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert passage not in got[2] and got[2].startswith("second") and got[2].endswith("over")


def test_suffix_removal_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r.text or "") < 6000]
    got = suffix_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=False)
    assert sorted((tuple(r) for r in got.drop("text").collect()), key=repr) == brute_removed(rows, 400)
    assert len(suffix_dedup.remove(awkward(spark)).collect()) == len(AWKWARD)
    assert suffix_dedup.remove(awkward(spark, [])).count() == 0


def test_mixing(spark):
    rows = mixing.mix(awkward(spark)).collect()
    assert len(rows) == len(AWKWARD)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    again = sorted((tuple(r) for r in mixing.mix(awkward(spark)).collect()), key=repr)
    assert again == sorted((tuple(r) for r in rows), key=repr)
    size = lambda t: len(WORD.findall(t or ""))
    mixed = mixing.mixed(awkward(spark))
    assert mixed.columns == awkward(spark).columns
    assert sum(size(r.text) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(awkward(spark, [])).count() == 0 and mixing.mixed(awkward(spark, [])).count() == 0


def test_mixing_meets_targets(spark, documents):
    per: dict = {}
    for r in mixing.mix(documents).collect():
        t = per.setdefault((r.target, r.source_size), 0)
        per[(r.target, r.source_size)] = t + r.taken
        assert r.taken <= 3 * r.size
    assert all(abs(t - taken) <= 1 and t <= 3 * s + 1e-6 for (t, s), taken in per.items())


def brute_tokens(rows, tokenizer):
    start, out = 0, []
    for d, t in rows:
        found = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        start += len(found)
    return out


def test_token_output(spark, documents):
    tokenizer = Tokenizer.from_file(queries.VOCABULARY)
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in wavelet.round_trip(documents, queries.VOCABULARY).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == brute_tokens(rows, tokenizer)
    odd = [(d, t) for d, t, *_ in AWKWARD if d is not None and d != 5]
    got = sorted(tuple(r) for r in wavelet.round_trip(awkward(spark).where("doc_id IS NOT NULL AND doc_id <> 5"), queries.VOCABULARY).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == brute_tokens(odd, tokenizer)
    assert wavelet.round_trip(awkward(spark), queries.VOCABULARY).count() == len(AWKWARD)
    assert wavelet.round_trip(awkward(spark, []), queries.VOCABULARY).count() == 0


@pytest.mark.parametrize("n, top", [(1, 1), (7, 2), (1000, 50), (5000, 49_000), (1500, 70_000)])
def test_wavelet_matrix(n, top):
    x = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(x).to_bytes())
    assert (w.decode() == x).all()
    for i in {0, n // 2, n - 1}:
        s = int(x[i])
        assert w.access(i) == s
        assert w.where(s) == np.flatnonzero(x == s).tolist()
        assert [w.rank(s, k) for k in (0, i, n)] == [int((x[:k] == s).sum()) for k in (0, i, n)]
    assert w.count(top + 1_000_000) == 0 and w.select(int(x[0]), n) == -1


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out AND lang IS NOT NULL AND length(text) > 200").collect()
    assert len(got) > 100
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    odd = {r.doc_id: r for r in language.identify(awkward(spark)).collect()}
    assert all(odd[d].lang_pred == "und" for d in (1, 2, 3))
    assert language.identify(awkward(spark)).count() == len(AWKWARD)
    assert language.identify(awkward(spark, [])).count() == 0


def test_quality_classifier(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.classify(docs, labels)
    assert got.count() == docs.count()
    rows = [(r.score, r.quality) for r in got.join(labels, "doc_id").where("held_out").collect()]
    good, bad = [s for s, q in rows if q == 1], [s for s, q in rows if q == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.8
    odd = quality_model.classify(awkward(spark), labels).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    assert quality_model.classify(awkward(spark, []), labels).count() == 0


def test_page_differencing(spark):
    body = "<p>Story {0} has &amp; tells   of the {0}th day.</p><ul><li>one {0}<li>two {0}</ul>"
    page = "<html><head><title>t</title><style>p{{}}</style></head><body><div>Shared line above</div><nav>Home</nav><div class='ad-slot'>Buy</div>" + body + "<script>x</script><form>Name</form><p>Shared line below</p><footer>foot</footer></body></html>"
    rows = [(i, f"http://h.org/a/{i}", page.format(i)) for i in range(4)] + [(9, "http://other.org/", page.format(9)), (10, None, None), (11, "http://h.org/e", ""), (12, "http://h.org/a/4", "<p>unclosed <b>bold"), (None, None, "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "host": F.lit(1)})
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert len(got) == len(rows)
    for i in range(4):
        assert got[i].text == f"Story {i} has & tells of the {i}th day. one {i} two {i}" and got[i].n_chars == len(got[i].text)
    assert got[9].text.startswith("Shared line above") and got[10].text == "" and got[11].n_chars == 0 and got[12].text == "unclosed bold"
    assert html_extract.extract(pages.limit(0)).count() == 0


def longest_common(a, b):
    now = [0] * (len(b) + 1)
    for x in a:
        last, now = now, [0]
        for j, y in enumerate(b):
            now.append(last[j] + 1 if x == y else max(now[-1], last[j + 1]))
    return now[-1]


@pytest.mark.parametrize("most", [1, 50, 200_000_000])
def test_shared_lines_are_a_longest_common_subsequence(most):
    rng = np.random.default_rng(8)
    for n, m, k in ((0, 3, 2), (9, 7, 3), (40, 55, 6), (80, 61, 30)):
        a, b = rng.integers(0, k, n).tolist(), rng.integers(0, k, m).tolist()
        at = html_extract.shared(a, b, most)
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in at))
        assert len(at) == longest_common(a, b)


def brute_tiles(a, b, least):
    """Greedy tiling by comparing every pair of places for each length."""
    out, used_a, used_b = [], set(), set()
    for n in range(min(len(a), len(b)), least - 1, -1):
        for i in range(len(a) - n + 1):
            for j in range(len(b) - n + 1):
                if a[i : i + n] == b[j : j + n] and not used_a & set(range(i, i + n)) and not used_b & set(range(j, j + n)):
                    out.append((i, j, n))
                    used_a |= set(range(i, i + n))
                    used_b |= set(range(j, j + n))
    return out


def test_greedy_tiles():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = (rng.integers(0, 4, rng.integers(1, 24)).tolist() for _ in range(2))
        assert decontaminate.tiles(a, b, 3) == brute_tiles(a, b, 3)


def test_decontamination(spark):
    item = " ".join(f"q{i}" for i in range(40))
    halves = item.split()
    turned = "x y z " + " ".join(halves[20:]) + " some words between them " + " ".join(halves[:20]) + " end"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny one")], "item_id long, text string")
    rows = [*AWKWARD, (20, "before " + item.upper() + " after", None, None, 1), (21, turned, None, None, 1), (22, "a clean text about q1 and q2 and q3", None, None, 1), (23, "a Tiny, one!", None, None, 1)]
    docs = awkward(spark, rows)
    got = {(r.doc_id, r.item_id): (r.covered_tokens, r.tiles) for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(20, 1): (40, 1), (21, 1): (40, 2), (23, 4): (2, 1)}
    assert decontaminate.matches(docs, bench, block_chars=1).count() == 3
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and ids(clean) == sorted((r[0] for r in rows if r[0] not in (20, 21, 23)), key=lambda x: (x is not None, x))
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.matches(docs.limit(0), bench).count() == 0


def test_decontamination_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    tokens = lambda t: re.findall(r"\w+", (t or "").lower())
    items, want = [(r.item_id, tokens(r.text)) for r in bench.collect()], set()
    texts = [(r.doc_id, tokens(r.text)) for r in docs.collect() if len(r.text or "") < 4000]
    for d, text in texts:
        own = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        for k, item in items:
            if any(tuple(item[i : i + 5]) in own for i in range(len(item) - 4)) and sum(n for *_, n in brute_tiles(item, text, 5)) >= 0.5 * len(item):
                want.add((d, k))
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs.where("length(text) < 4000"), bench).collect()}
    assert got == want


def test_licenses(spark):
    prose = "The river ran past the old mill and nobody spoke of it."
    rows = [*AWKWARD, (30, prose + "\nLicensed under the Apache License, Version 2.0.", None, None, 1), (31, "Released under the MIT License.\n" + prose, None, None, 1), (32, prose, None, None, 1)]
    got = {(r.doc_id, r.paragraph, r.family) for r in licenses.scan(awkward(spark, rows)).where("confirmed").collect()}
    assert got == {(30, 1, "apache-2.0"), (31, 0, "mit")}
    assert licenses.scan(awkward(spark, [])).count() == 0
