"""Scoring formulas as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the activation score.
ALPHA, BETA, LAMBDA, THETA_BASE, MATURITY_MAX = 0.6, 0.4, 0.35, 0.10, 1.023e11


def activation(maturity: Column, quality: Column, in_domain: Column, depth: Column) -> Column:
    """(alpha C + beta D) e^(-lambda depth): C the log-scaled maturity, D the domain's quality, a fifth of it outside the active domains."""
    c = F.least(F.log1p(F.greatest(maturity, F.lit(0.0))) / F.log1p(F.lit(MATURITY_MAX)), F.lit(1.0))
    return (ALPHA * c + BETA * F.when(in_domain, 1.0).otherwise(0.2) * quality) * F.exp(-LAMBDA * depth)


def threshold(n_words: Column, n_types: Column) -> Column:
    return F.greatest(THETA_BASE - 0.005 * F.least(n_words + 0.5 * n_types, F.lit(10)), F.lit(0.04))


def state(n: Column) -> Column:
    return F.when(n < 2, "isolated").when(n < 10, "emerging").when(n < 50, "stable").otherwise("core")


def gravity(maturity: Column, n: Column, hits: Column) -> Column:
    return 0.45 * F.least(F.lit(1.0), F.log1p(maturity) / 12) + 0.45 * F.least(F.lit(1.0), F.log1p(n) / 10) + F.least(F.lit(0.3), 0.1 * hits)


def noisy_or(column: Column) -> Column:
    """An aggregate: 1 - product of (1 - s); a certain row makes it 1."""
    rest = F.exp(F.sum(F.when(column < 1, F.log1p(-column))))
    return F.when(F.max(column) >= 1, F.lit(1.0)).otherwise(1 - rest)


def jaccard(a: Column, b: Column) -> Column:
    """Distance of two arrays; of two empty ones, 1."""
    return F.coalesce(1 - F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def game_phase(ply: Column) -> Column:
    return F.when(ply < 20, "opening").when(ply < 40, "middlegame").otherwise("endgame")


def eval_band(value: Column) -> Column:
    return F.when(value.isNull(), "unknown").when(value > 2, "winning").when(value > 0.5, "better").when(value > -0.5, "equal").when(value > -2, "worse").otherwise("losing")


def clean_name(name: Column) -> Column:
    """At most 35 characters and four words, none of them a stop word, without stray marks at its ends."""
    parts = F.split(name, " ")
    stop = F.array(*[F.lit(x) for x in ("the", "of", "and", "a", "in", "to", "for", "with")])
    return (F.length(name) <= 35) & ~name.rlike("^[_-] ") & ~name.rlike("'$") & (F.size(parts) <= 4) & ~F.arrays_overlap(parts, stop)
