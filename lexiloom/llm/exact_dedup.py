"""Exact deduplication as a stateful stream (operator 6).

A file stream of documents feeds a keyed state without expiry, kept on disk by RocksDB: for each digest of a normalised
text the state holds the stable identifier that stays (the smallest), the content locator of that row (its file and
identifier) and the number of rows. Rows are pre-aggregated by digest before the exchange to the state, so a digest that
holds a third of all rows sends one row for each task. Each batch's changed states are written under the number of the
batch, so that a batch that is done again replaces its own output. Every hit (a row whose digest is held by another row)
is then checked: the text of the row that stays is fetched and compared byte by byte. The joins on the digest have one
row for each digest on one side; rows of a digest that holds a large part of all are dealt over many tasks. Rows that share a digest but not the bytes are grouped by the bytes themselves.

Defined results: a null text counts as empty; texts are equal when identical after each run of ASCII white space became
one space. A row with a null identifier groups as any other; a null sorts last, so it stays only if all identifiers of
its group are null. Of repeated rows with one identifier all get the same result (drop_duplicates keeps one of them).
Empty tables give empty results. Other columns pass through; those named as an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.scratch import broadcast_if_small, join_dealt, materialize, new_folder, quoted

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def normalized(text: Column) -> Column:
    """The text that is compared: null is empty, runs of ASCII white space are one space."""
    plain = F.coalesce(text, F.lit(""))
    for c in "\t\n\v\f\r":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " +", " ")).otherwise(plain)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keyed_state(stream: DataFrame, state_dir: str, digest: Callable[[Column], Column], doc_id: str, text: str, state_partitions: int | None = None) -> DataFrame:
    """Feeds what is new in `stream` to the state in `state_dir` and returns the whole state.

    Called again with the same `state_dir`, it goes on where it stopped: batches that are committed aren't read again.
    Returns (digest, keep, group_size), `keep` being a struct of rank, id and locator.
    """
    spark = stream.sparkSession
    row = F.struct(F.col(doc_id).isNull().cast("int").alias("rank"), F.col(doc_id).alias("id"), F.col("_metadata.file_path").alias("locator"))
    keyed = stream.select(digest(normalized(F.col(text))).alias("digest"), row.alias("row"))
    state = keyed.groupBy("digest").agg(F.min("row").alias("keep"), F.count("*").alias("group_size"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").option("compression", "zstd").parquet(f"{state_dir}/changed/batch={batch}")

    conf = _STREAM_CONF | ({"spark.sql.shuffle.partitions": str(state_partitions)} if state_partitions else {})
    with _settings(spark, conf):
        query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    schema = T.StructType([*state.schema.fields, T.StructField("batch", T.IntegerType())])
    kept = spark.read.schema(schema).option("basePath", f"{state_dir}/changed").parquet(f"{state_dir}/changed")
    newest = F.max_by(F.struct("keep", "group_size"), F.col("batch"))
    return kept.groupBy("digest").agg(newest.alias("s")).select("digest", "s.keep", "s.group_size")


def mark_duplicates(stream: DataFrame, docs: DataFrame, state_dir: str, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """All rows of `docs` (of which `stream` brings those that the state doesn't have yet) with keep_id, keep_locator,
    group_size, kept and text_sha256.

    `digest`: of a normalised text, as a string. A weak one gives right results too, as bytes are compared.
    """
    names = [c for c in docs.columns if c not in ("keep_id", "keep_locator", "group_size", "kept", "text_sha256")]
    state = keyed_state(stream, state_dir, digest, doc_id, text)
    state = materialize(state.select(F.col("digest").alias("__lx_digest"), F.col("keep").alias("__lx_state"), "group_size"), "dedup-state")
    rows = docs.withColumn("__lx_norm", normalized(F.col(text))).withColumn("__lx_digest", digest(F.col("__lx_norm"))).withColumn("text_sha256", sha256(F.col("__lx_norm")))

    total = state.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    shared = broadcast_if_small(state.filter("group_size > 1").select("__lx_digest", F.col("__lx_state.id").alias("__lx_keep"), F.col("group_size").alias("__lx_size")))
    held = materialize(rows.select(F.col(doc_id).alias("__lx_id"), "__lx_norm", "__lx_digest").join(shared, "__lx_digest"), "dedup-held")
    stays = F.col("__lx_id").eqNullSafe(F.col("__lx_keep"))
    kept_text = held.filter(stays).groupBy("__lx_digest").agg(F.min("__lx_norm").alias("__lx_kept"), F.first("__lx_size").alias("__lx_size"))
    hits = join_dealt(held.filter(~stays).select("__lx_id", "__lx_norm", "__lx_digest"), kept_text, "__lx_digest", "__lx_size", total, "__lx_id")
    other = materialize(hits.filter("__lx_norm <> __lx_kept").select("__lx_digest", "__lx_norm", "__lx_id"), "dedup-collisions")

    collided = not other.isEmpty()
    out = rows.select(*quoted(names), "text_sha256", "__lx_digest", *["__lx_norm"] * collided, F.col(doc_id).alias("__lx_by"))
    out = join_dealt(out, state, "__lx_digest", "group_size", total, "__lx_by")
    out = out.withColumn("keep_id", F.col("__lx_state.id")).withColumn("keep_locator", F.col("__lx_state.locator"))
    if collided:
        out = _apart(out, other)
    return out.withColumn("kept", F.col(doc_id).eqNullSafe(F.col("keep_id"))).select(*quoted(names), "keep_id", "keep_locator", "group_size", "kept", "text_sha256")


def _apart(out: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose bytes differ from those of the row that their digest keeps, grouped by their bytes."""
    own = other.groupBy("__lx_digest", "__lx_norm").agg(F.min("__lx_id").alias("__lx_own"), F.count("*").alias("__lx_n"))
    gone = own.groupBy("__lx_digest").agg(F.sum("__lx_n").alias("__lx_gone"))
    out = out.join(own, ["__lx_digest", "__lx_norm"], "left").join(gone, "__lx_digest", "left")
    apart = F.col("__lx_n").isNotNull()
    return out.withColumns(
        {
            "keep_id": F.when(apart, F.col("__lx_own")).otherwise(F.col("keep_id")),
            "keep_locator": F.when(~apart, F.col("keep_locator")),
            "group_size": F.coalesce("__lx_n", F.col("group_size") - F.coalesce("__lx_gone", F.lit(0))),
        }
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with its columns. `docs` is written once, for the stream to read.

    Of repeated rows with one identifier and one text, one stays.
    """
    folder = new_folder(docs.sparkSession, "dedup-input")
    docs.write.option("compression", "zstd").parquet(folder)
    spark = docs.sparkSession
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 64).parquet(folder)
    written = spark.read.schema(docs.schema).parquet(folder)
    marked = mark_duplicates(stream, written.select(F.col(doc_id), F.col(text)), new_folder(spark, "dedup-state"), doc_id, text)
    light = materialize(marked.select(F.col(doc_id).alias("__lx_id"), "kept", F.col("text_sha256").alias("__lx_sha")), "dedup-marks")
    gone = broadcast_if_small(light.filter("not kept").select("__lx_id", "__lx_sha").distinct())
    same = F.col(doc_id).eqNullSafe(F.col("__lx_id")) & (F.col("__lx_own") == F.col("__lx_sha"))
    out = written.withColumn("__lx_own", sha256(normalized(F.col(text)))).join(gone, same, "left_anti")
    repeated = materialize(light.filter("kept").groupBy("__lx_id", "__lx_sha").count().filter("count > 1"), "dedup-repeats")
    if not repeated.isEmpty():
        one = out.join(repeated, same, "left_semi").dropDuplicates([doc_id, "__lx_own"])
        out = out.join(repeated, same, "left_anti").union(one)
    return out.select(*quoted(docs.columns))
