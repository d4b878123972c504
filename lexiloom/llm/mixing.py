"""Mixing sources to target weights (operator 5), in DataFrame functions only.

Temperature mixing: the weights of the sources are their token shares raised to an exponent and normalised. The exponent
is bisected to the flattest mixture that keeps both limits: the entropy is at most `entropy` times that of equal weights,
and no source is passed over more than `repeats` times. The token budget is the smallest that uses every document at
least once, so that nothing is lost: the source with the most tokens for its weight is passed over once.

The weights are realised as budgeted block permutations. A pass over a source takes its documents in the order of a hash
of seed, pass and identifier. The documents of all passes are laid end to end until the source's budget is met, and cut
into blocks: block b of the mixture has, of each source, what lies in the b-th equal part of the source's budget, so each
block has the target weights. Offsets come from token sums of hash buckets, in two steps (BUCKET_GROUP buckets make a group), so no source is sorted or
summed up in one task.

Defined results: a null or empty text has 0 tokens; documents without tokens come once, at their place. A null source is
a source of its own. A source without any tokens has weight 0 and its documents come once, in block 0. Rows with one
identifier share a place. Empty tables give empty results. Columns called copy, block, place or weight are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.scratch import materialize, quoted

STEPS = 40
BUCKET_TOKENS, BUCKET_GROUP = 1_000_000, 1000


def tokens_of(text: str) -> Column:
    """Words of the text: runs of anything but ASCII white space."""
    t = F.coalesce(F.col(text), F.lit(""))
    for c in "\t\n\v\f\r":
        t = F.replace(t, F.lit(c), F.lit(" "))
    starts = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    simple = starts + 1  # single spaces, none at the ends
    odd = F.contains(t, F.lit("  ")) | F.startswith(t, F.lit(" ")) | F.endswith(t, F.lit(" ")) | (t == "")
    return F.when(odd, F.regexp_count(t, F.lit("[^ ]+"))).otherwise(simple).cast("long")


def exponent(sources: DataFrame, entropy: float, repeats: float) -> float:
    """The exponent for the table of sources (source, tokens): bisected on grouped sums, which are one row a step."""
    shares = sources.filter("tokens > 0")
    total, most, least, n = shares.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens"), F.count("*")).first()
    if not n or n == 1:
        return 1.0
    p = F.col("tokens") / total

    def fits(a: float) -> bool:
        if (1 - a) * math.log(most / least) > math.log(repeats):
            return False
        w = F.pow(p, F.lit(a))
        z, wlw = shares.agg(F.sum(w), F.sum(w * F.log(w))).first()
        return math.log(z) - wlw / z <= entropy * math.log(n)

    low, high = 0.0, 1.0
    if fits(low):
        return low
    if not fits(high):  # the sources' own shares are flatter than the limit
        return high
    # the repetition limit alone has a closed form, from which the search starts
    low = max(low, 1 - math.log(repeats) / math.log(most / least)) if most > least else low
    if fits(low + 1e-9):
        return low + 1e-9
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
        if high - low < 1e-6:
            break
    return high


def weights(sources: DataFrame, entropy: float, repeats: float) -> DataFrame:
    """(source, tokens, weight, passes): `passes` is the budget over the tokens, at least 1."""
    a = exponent(sources, entropy, repeats)
    raw = sources.withColumn("raw", F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(a))).otherwise(F.lit(0.0)))
    z, budget = raw.agg(F.sum("raw"), F.max(F.when(F.col("raw") > 0, F.col("tokens") / F.col("raw")))).first()
    out = raw.withColumn("weight", F.col("raw") / (z or 1.0)).withColumn("passes", F.when(F.col("raw") > 0, F.greatest(F.lit(1.0), F.round(F.col("raw") * (budget or 1.0) / F.col("tokens"), 6))).otherwise(1.0))
    return out.drop("raw")


def mix(docs: DataFrame, entropy: float = 0.98, repeats: float = 1.5, block_tokens: int = 2_000_000, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows of `docs`, as often as the mixture takes them, with weight (of the source), copy (from 0), block, and place.

    Within a block the rows are permuted by `place`, a hash.
    """
    names = [c for c in docs.columns if c not in ("copy", "block", "place", "weight")]
    key = F.col(source)
    sized = materialize(docs.select(F.col(doc_id).alias("id"), key.alias("s"), tokens_of(text).alias("n")), "mix-tokens")
    table = materialize(sized.groupBy("s").agg(F.sum("n").alias("tokens")), "mix-sources", 1)
    plan = materialize(weights(table, entropy, repeats), "mix-weights", 1)
    budget = plan.agg(F.sum(F.col("passes") * F.col("tokens"))).first()[0] or 0.0
    blocks = max(1, math.ceil(budget / block_tokens))

    # the documents of a source, in the order of each pass, in hash buckets of about BUCKET_TOKENS tokens
    plan = plan.withColumns({"__lx_buckets": F.greatest(F.lit(1), F.ceil(F.col("tokens") / BUCKET_TOKENS)).cast("int"), "__lx_s": F.col("s")}).drop("s").withColumnsRenamed({"tokens": "__lx_tokens", "passes": "__lx_passes"})
    rows = docs.select(*quoted(names), F.col(doc_id).alias("__lx_id"), tokens_of(text).alias("__lx_n")).join(plan, key.eqNullSafe(F.col("__lx_s")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil("__lx_passes").cast("int") - 1)))
    rows = rows.withColumn("place", F.xxhash64(F.lit(seed), F.col("copy"), F.col("__lx_id")))
    rows = rows.withColumn("__lx_bucket", F.pmod(F.col("place"), F.col("__lx_buckets")))
    light = sized.join(plan, F.col("s").eqNullSafe(F.col("__lx_s"))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil("__lx_passes").cast("int") - 1)))
    light = light.withColumn("__lx_bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("copy"), F.col("id")), F.col("__lx_buckets")))
    sums = light.groupBy("s", "copy", "__lx_bucket").agg(F.sum("n").alias("sum"))
    # offsets of buckets within their group of BUCKET_GROUP, then of the groups, so that no source is summed up in one task
    sums = materialize(sums.withColumn("__lx_group", F.floor(F.col("__lx_bucket") / BUCKET_GROUP)), "mix-buckets")
    upto = lambda c, *keys: F.coalesce(F.sum(c).over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("s", F.col("copy").alias("g_copy"), F.col("__lx_group").alias("g_group")).agg(F.sum("sum").alias("g_sum"))
    groups = groups.withColumn("g_place", F.struct("g_copy", "g_group")).select(F.col("s").alias("g_s"), "g_copy", "g_group", upto("g_sum", "s", "g_place").alias("g_before"))
    inner = sums.withColumn("inner", upto("sum", "s", "copy", "__lx_group", "__lx_bucket"))
    both = inner.join(groups, F.col("s").eqNullSafe(F.col("g_s")) & (F.col("copy") == F.col("g_copy")) & (F.col("__lx_group") == F.col("g_group")))
    offsets = materialize(both.select(F.col("s").alias("__lx_os"), F.col("copy").alias("__lx_oc"), F.col("__lx_bucket").alias("__lx_ob"), (F.col("inner") + F.col("g_before")).alias("__lx_before")), "mix-offsets")
    share = F.col("__lx_passes") * F.col("__lx_tokens")  # tokens of the source in the budget
    offsets = offsets.withColumnRenamed("__lx_before", "__lx_first")
    rows = rows.join(offsets, F.col("__lx_s").eqNullSafe(F.col("__lx_os")) & (F.col("copy") == F.col("__lx_oc")) & (F.col("__lx_bucket") == F.col("__lx_ob")))
    rows = rows.filter((F.col("copy") == 0) | (F.col("__lx_first") < share))  # buckets beyond the budget aren't exchanged
    within = F.sum("__lx_n").over(Window.partitionBy("__lx_s", "copy", "__lx_bucket").orderBy("place", "__lx_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__lx_start", F.col("__lx_first") + F.coalesce(within, F.lit(0)))
    rows = rows.filter((F.col("copy") == 0) | (F.col("__lx_start") < share))
    block = F.when(share > 0, F.least(F.lit(blocks - 1), F.floor(F.col("__lx_start") * blocks / share))).otherwise(F.lit(0)).cast("int")
    return rows.withColumn("block", block).select(*quoted(names), "weight", "copy", "block", "place")


def mixed_docs(docs: DataFrame, entropy: float = 0.98, repeats: float = 1.25) -> DataFrame:
    """The mixture as rows of `docs`."""
    return mix(docs, entropy, repeats).select(*quoted(docs.columns))
