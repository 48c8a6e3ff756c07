"""Host-level quality rules: failures by host, shrunk by an empirical beta prior, joined back to documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, packed, words

SYMBOLS = "#*$%&|<>"


def counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.withColumn("_w", words(F.col("text"))).withColumn("_l", lines)
    n = F.size("_w")
    grams = F.when(n < 5, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - 4, F.lit(1))), lambda i: F.xxhash64(*[F.element_at("_w", (i + k).cast("int")) for k in range(5)])))
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": (F.octet_length(text) - F.octet_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_g": grams,
    })
    # in most texts no window comes twice; where one does: sort by hash, take positions whose neighbour is equal, and measure their cover
    pairs = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.transform(F.array(pairs), lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
    at = F.sort_array(F.transform(F.element_at(twice, 1), lambda x: x["i"]))
    cover = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")), lambda a, p: F.struct((a["n"] + p + 4 - F.greatest(a["end"], p - 1)).alias("n"), (p + 4).alias("end")))
    repeat = F.when(F.size(F.array_distinct("_g")) < F.size("_g"), cover["n"]).otherwise(0).cast("long")
    return out.withColumn("n_repeat_words", repeat).drop("_w", "_l", "_g")


#: Rules whose failures are counted for each host.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "lines": "n_dup_lines > 0 AND 10 * n_dup_lines > 3 * n_words",
}


def host_rates(counted: DataFrame) -> DataFrame:
    """source, n, and for each rule the rate of failures, shrunk to the mean of all hosts.

    The prior is a beta by moments: its mean is the hosts' mean rate m, its strength m(1-m)/v - 1 for their variance v, held in 1 to 10^6.
    """
    raw = keep(counted.groupBy("source").agg(F.count("*").alias("n"), *[F.count_if(F.expr(r)).alias(k) for k, r in RULES.items()]))
    stats = raw.agg(*[f(F.col(k) / F.col("n")).alias(f"{w}_{k}") for k in RULES for w, f in (("m", F.avg), ("v", F.var_pop))]).first()
    out = {}
    for k in RULES:
        m, v = stats[f"m_{k}"] or 0.0, stats[f"v_{k}"] or 0.0
        strength = min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v > 0 else 1e6
        out[k] = (F.col(k) + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    return raw.select("source", "n", *[x.alias(k) for k, x in out.items()])


def judged(docs: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """docs (source, text, ...) without text, with the five counts, base_failed and kept.

    base_failed: under 10 words, or over 20 % of the words in 5-word windows that come twice. kept: not base_failed, and of no host
    where the shrunk rate of any rule's failures exceeds host_limit. Null sources are one host; null or blank texts fail; repeated rows are
    judged alike; an empty table gives an empty result.
    """
    counted = counts(docs).withColumn("base_failed", F.expr(f"({RULES['short']}) OR ({RULES['repeats']})"))
    counted = keep(counted.drop("text"))
    worst = F.greatest(*[F.col(k) for k in RULES])
    bad = keep(host_rates(counted).where(worst > host_limit).select(F.col("source").alias("_s"), F.lit(True).alias("_bad")))
    if bad.count() <= 100_000:  # else the join shuffles
        bad = F.broadcast(bad)
    out = counted.join(bad, F.col("source").eqNullSafe(F.col("_s")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("_bad").isNull()).drop("_s", "_bad")


def verdicts(docs: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """doc_id, source, the five counts, base_failed and kept of every row; see judged."""
    return judged(docs.select("doc_id", "source", "text"), host_limit)


def passed(docs: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with their columns, whatever their names."""
    return judged(packed(docs, "source", "text"), host_limit).where("kept").select("_row.*")


ORACLE = """
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
base AS (SELECT t.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM t JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
fails AS (SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS f FROM (
  SELECT source, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule,
    unnest([n_words < 10, 100 * n_repeat_words > 20 * n_words, 10 * n_symbols > 3 * n_words, n_dup_lines > 0 AND 10 * n_dup_lines > 3 * n_words]) AS failed FROM judged) GROUP BY source, rule),
prior AS (SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS s FROM (SELECT rule, avg(f / n) AS m, var_pop(f / n) AS v FROM fails GROUP BY rule)),
bad AS (SELECT DISTINCT source FROM fails JOIN prior USING (rule) WHERE (f + m * s) / (n + s) > 0.5)
SELECT doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM judged.source) AS kept
FROM judged
"""
