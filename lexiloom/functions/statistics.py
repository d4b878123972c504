"""Corpus statistics as Column expressions, over any counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PER = 10_000
CRITICAL_G2 = 15.13


def rate(count: Column, tokens: Column) -> Column:
    """Occurrences per PER tokens; 0 without tokens."""
    return F.when(tokens > 0, F.round(count * PER / tokens, 3)).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def log_likelihood(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Dunning's G² of a in c against b in d; 0 if either corpus is empty."""
    term = lambda x, e: F.when(x > 0, x * F.ln(x / e)).otherwise(F.lit(0.0))
    g2 = 2 * (term(a, c * (a + b) / (c + d)) + term(b, d * (a + b) / (c + d)))
    return F.when((c > 0) & (d > 0), F.round(g2, 3)).otherwise(F.lit(0.0))


def log_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Binary logarithm of the ratio of rates, with half an occurrence added to each; 0 if either corpus is empty."""
    return F.when((c > 0) & (d > 0), F.round(F.log2(((a + 0.5) / c) / ((b + 0.5) / d)), 3)).otherwise(F.lit(0.0))


def with_keyness(df, a: Column, b: Column, c: Column, d: Column):
    """Adds log_likelihood, effect_size, direction and significant, the last two by the rounded values."""
    df = df.withColumns({"log_likelihood": log_likelihood(a, b, c, d), "effect_size": log_ratio(a, b, c, d)})
    return df.withColumns({"direction": F.when(F.col("effect_size") > 0, "over").otherwise("under"), "significant": F.col("log_likelihood") > CRITICAL_G2})


def pmi(joint: Column, anchors: Column, others: Column, corpus: Column) -> Column:
    """Pointwise mutual information in bits; totals of 0 count as 1."""
    n, x, y = (F.greatest(v, F.lit(1)) for v in (corpus, anchors, others))
    return F.round(F.log2((joint / n) / ((x / n) * (y / n))), 3)
