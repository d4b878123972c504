"""How filters interact: what each removes at each place of each order (operator 12).

Documents become masks of the filters that they fail; equal masks of a part are one cell, so what follows is small. A
recursive query then extends prefixes of filter orders by unused letters: it joins each prefix with the cells of its part,
carries the bits applied so far, and each level of the recursion emits the metrics of that step. An order shares its
prefixes with others, so 325 prefixes a part make up the 120 orders of five filters.

Defined results: a null text is empty, a null part is the empty string. Of equal texts all but those with the smallest
identifier fail as copies, rows that repeat that identifier don't; rows without an identifier are never copies, nor is
anything a copy of them. Of labels that repeat an identifier the largest count. Empty tables have no parts, and so no
rows. Other columns of the inputs aren't looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from string import ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.scratch import materialize

#: The filters in order of their bits.
LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
MEASURES = ("n", "good", "toxic")


def failed_alone(text: Column) -> Column:
    """Bits of the filters that look at a text alone: A short, B repetitive, C upper case, D symbols.

    Words, white space and the letters of C and D are ASCII, so bytes are counted; UTF-8 has them in no other character.
    """

    @F.arrow_udf("int")
    def masks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        upper, symbols, later = ascii_uppercase.encode(), b"#$%&*|", bytes(range(0x80, 0xC0))
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                words = x.split()  # at [\x20\x09-\x0D]+, as bytes have no other white space
                n, size = len(words), len(x)
                points = len(x.translate(None, later))
                capitals = size - len(x.translate(None, upper))
                mask = (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 2 * points) << 2
                out.append(mask | (len(x.translate(None, symbols)) < size) << 3)
            yield pa.array(out, pa.int32())

    return masks(F.coalesce(text, F.lit("")).cast("binary"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents (doc_id, text, source) of a part fail just the filters of a mask,
    and how many of them `labels` (doc_id, quality, toxic) call good or toxic.

    Rows meet by identifier and by digest, without their texts; those of one digest, label and part are summed before they
    are exchanged, so a text that a third of all documents share is a few rows a task.
    """
    rows = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("part"),
        failed_alone(F.col("text")).alias("mask"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    )
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    flag = lambda c: F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))
    kind = ["digest", "part", "mask", "good", "toxic"]
    named = rows.filter("doc_id is not null").join(known, "doc_id", "left").select("doc_id", "digest", "part", "mask", flag("q").alias("good"), flag("t").alias("toxic"))
    each = named.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    sums = each.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    firsts = sums.groupBy("digest").agg(F.min("least").alias("first"), F.sum("n").alias("copies")).filter("copies > 1")
    judged = sums.join(firsts, "digest", "left")
    originals = F.when(F.col("copies").isNull(), F.col("n")).when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(F.lit(0))
    both = F.array(F.struct(F.col("mask"), originals.alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - originals).alias("n")))
    split = judged.select("part", "good", "toxic", F.inline(both))
    nameless = rows.filter("doc_id is null").select("part", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "mask", F.lit(1).cast("long").alias("n"))
    every = split.unionByName(nameless)
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")).filter("n > 0")


def prefixes(found: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, applied, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost): the
    step that ends each prefix of an order. `found`: cells; a part has at most one for each set of filters."""
    spark = found.sparkSession
    tables = materialize(found.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells")), "audit-cells", 1)
    filters = spark.createDataFrame([(x, 1 << k) for k, x in enumerate(letters)], "letter string, bit int")

    def total(measure: str, where: str) -> str:
        return f"aggregate(filter(c.cells, x -> {where}), 0L, (s, x) -> s + x.{measure})"

    here = "(x.mask & w.applied) = 0 and (x.mask & f.bit) <> 0"
    query = f"""
        WITH RECURSIVE walk(part, filter_order, step, applied, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) MAX RECURSION LEVEL {len(letters) + 2} AS (
          SELECT part, '', 0, 0, '', 0L, 0L, 0L, 0L, 0L, 0L FROM {{tables}}
          UNION ALL
          SELECT w.part, w.filter_order || f.letter, w.step + 1, w.applied | f.bit, f.letter,
            {total("n", "(x.mask & (w.applied | f.bit)) = 0")}, {total("n", here)},
            {total("n", "(x.mask & w.applied) <> 0 and (x.mask & f.bit) <> 0")}, {total("n", "x.mask = f.bit")},
            {total("good", here)}, {total("toxic", here)}
          FROM walk w JOIN {{filters}} f ON (w.applied & f.bit) = 0 JOIN {{tables}} c ON c.part = w.part)
        SELECT * FROM walk WHERE step > 0"""
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")  # rows grow with the parts; levels are bounded by the letters
    try:
        return materialize(spark.sql(query, tables=tables, filters=filters), "audit-prefixes")
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)


def audit(found: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Of each part, order and step the metrics of prefixes(), with shapley: what the step's filter removes, summed over
    all orders. An order's steps are its prefixes."""
    walked, n = prefixes(found, letters), len(letters)
    left = F.lit(0)
    for k in range(1, n + 1):
        left = F.when(F.col("step") == k, math.factorial(n - k)).otherwise(left)  # orders that go on from a prefix
    shapley = walked.groupBy("part", "letter").agg(F.sum(F.col("removed") * left).alias("shapley"))
    orders = walked.filter(F.col("step") == n).select("part", F.col("filter_order").alias("whole"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    steps = orders.withColumn("filter_order", F.expr("left(whole, step)")).join(walked.drop("step"), ["part", "filter_order"])
    return steps.join(shapley, ["part", "letter"]).select("part", F.col("whole").alias("filter_order"), "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
