"""Sharding by histogram sort (operator 1), in DataFrame functions only.

Rows are sorted by a 64-bit key: 32 bits of the text's hash, then 32 bits of the identifier's, so that equal texts are
neighbours, and yet a group of copies that holds a third of all rows can be cut anywhere. The histogram counts exact
bytes and rows below candidate key boundaries; buckets heavier than the tolerance get finer boundaries in the next
round, until each bucket is light enough to serve as a step of the splitters. The splitters are the boundaries nearest
to equal shares of bytes. Rows are exchanged once, by bucket, and sorted within it; a row's slot is the number of rows
in earlier buckets of its shard plus its place in its bucket.

Size bounds: in a round at most `total / leaf` buckets are heavy, each of which gets 2**FINER children, whatever the
number of rows, so both what the driver sees and the broadcast list of buckets have a bound set by `shards`, `tolerance`
and the number of times that `bucket_bytes` go into all bytes (100,000 for 100 TB).

Defined results: a null text has 0 bytes, a null identifier is hashed as such. Rows that repeat both identifier and text
can't be told apart and stay in one bucket, whose bytes are then the only thing that may exceed the tolerance; their
slots are dealt in any order. An empty table gives an empty result. Columns named shard or slot are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.scratch import materialize, quoted

FIRST, FINER, BITS = 12, 6, 64


def key_of(doc_id: str, text: str) -> Column:
    """The 64-bit sort key; the order is that of the unsigned number."""
    high = F.xxhash64(text).bitwiseAND(F.lit(-(1 << 32)))
    return high.bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.lit("id"), F.col(doc_id)), 32))


def bytes_of(text: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


@dataclass(frozen=True)
class Bucket:
    """Keys whose first `bits` bits are `prefix`."""

    prefix: int
    bits: int
    size: int
    rows: int

    @property
    def low(self) -> int:
        return self.prefix << (BITS - self.bits)


def histogram(keys: DataFrame, leaf_share: float, bucket_bytes: int) -> list[Bucket]:
    """Buckets in key order that hold `leaf_share` of all bytes and `bucket_bytes` at most, as far as keys differ; `keys`:
    (key, size)."""
    done: list[Bucket] = []
    bits, heavy, most = FIRST, None, None
    while True:
        at = keys.withColumn("prefix", F.shiftrightunsigned("key", BITS - bits))
        if heavy is not None:
            up = keys.sparkSession.createDataFrame([(x,) for x in heavy], "up long")
            at = at.withColumn("up", F.shiftrightunsigned("key", BITS - bits + FINER)).join(F.broadcast(up), "up", "left_semi")
        found = [Bucket(r["prefix"] & ((1 << bits) - 1), bits, r["size"], r["n"]) for r in at.groupBy("prefix").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()]
        most = most or max(1.0, min(bucket_bytes, leaf_share * sum(b.size for b in found)))
        too_big = [b for b in found if b.size > most and b.rows > 1 and bits + FINER <= BITS]
        halved = set(too_big)
        done += [b for b in found if b not in halved]
        if not too_big:
            return sorted(done, key=lambda b: b.low)
        bits, heavy = bits + FINER, [_signed(b.prefix, bits) for b in too_big]


def _signed(prefix: int, bits: int) -> int:
    return prefix - (1 << 64) if bits == BITS and prefix >= 1 << 63 else prefix


def splitters(buckets: list[Bucket], shards: int) -> list[tuple[Bucket, int, int]]:
    """(bucket, shard, first slot): a bucket belongs to the shard in whose equal share of bytes its middle lies."""
    total, below, out, slots = sum(b.size for b in buckets), 0, [], [0] * shards
    for b in buckets:
        shard = min(shards - 1, (2 * below + b.size) * shards // (2 * total))
        out.append((b, shard, slots[shard]))
        slots[shard] += b.rows
        below += b.size
    return out


def assign_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", tolerance: float = 1 / 64, bucket_bytes: int = 1 << 30) -> DataFrame:
    """All rows of `docs` with shard (0 to `shards` - 1) and slot (gapless from 0 in each shard).

    Bytes (UTF-8 of the text, plus 8 a row) of the shards differ from equal shares by `tolerance` of a share at most,
    unless one row alone is larger. `bucket_bytes` bounds what one task sorts.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    keys = materialize(docs.select(key_of(doc_id, text).alias("key"), bytes_of(text).alias("size")), "shard-keys")
    placed = splitters(histogram(keys, tolerance / shards, bucket_bytes), shards)
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = _located(spark, docs.select(*quoted(names)).withColumn("__lx_key", key_of(doc_id, text)), placed)
    # the sort is on the key's unsigned order, which within a bucket is that of the signed key
    place = F.row_number().over(Window.partitionBy("__lx_bucket.no").orderBy("__lx_key", doc_id))
    return rows.withColumn("__lx_place", place).select(*quoted(names), F.col("__lx_bucket.shard").alias("shard"), (F.col("__lx_bucket.first") + F.col("__lx_place") - 1).alias("slot"))


def _located(spark: SparkSession, rows: DataFrame, placed: list[tuple[Bucket, int, int]]) -> DataFrame:
    """Adds __lx_bucket, by the list of buckets at each number of bits (see the module's text for its bound)."""
    levels = sorted({b.bits for b, _, _ in placed})
    for bits in levels:
        part = [(_signed(b.prefix, bits), (no, shard, first)) for no, (b, shard, first) in enumerate(placed) if b.bits == bits]
        table = spark.createDataFrame(part, f"__lx_p{bits} long, __lx_b{bits} struct<no:int,shard:int,first:long>")
        rows = rows.withColumn(f"__lx_p{bits}", F.shiftrightunsigned("__lx_key", BITS - bits)).join(F.broadcast(table), f"__lx_p{bits}", "left")
    return rows.withColumn("__lx_bucket", F.coalesce(*(F.col(f"__lx_b{b}") for b in levels)) if levels else F.lit(None).cast("struct<no:int,shard:int,first:long>"))
