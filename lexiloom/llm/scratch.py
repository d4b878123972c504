"""Written intermediate results in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests on one
machine) a temporary folder of this process is used; on a cluster an unset folder is an error. A written table cuts lineage, survives a lost executor, and has a known size, so that
Catalyst decides by size whether a join on it is broadcast.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than one of HOT parts of all rows, so there are fewer hot keys than that; its rows are
#: dealt over DEALS tasks.
HOT, DEALS = 1000, 64

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spark-lexiloom-")
    return "file://" + _local_roots[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is not created."""
    return f"{shared_root(spark)}/lexiloom/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Writes `df` as Parquet into the shared folder and returns a DataFrame that reads it.

    `parts`: merges the result into so many files at most (no shuffle), for small tables that loops read again.
    """
    path = new_folder(df.sparkSession, name)
    (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a materialized DataFrame that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def quoted(names: list[str]) -> list[Column]:
    """Columns by their whole names, dots and all."""
    return [F.col(f"`{c}`") for c in names]


def broadcast_if_small(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """`df` with a broadcast hint if its rows take `most_bytes` at most, else as it is; it sums their lengths."""
    long = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    fixed = 8 * (len(df.columns) + 2)
    size = df.agg(F.sum(sum(long, F.lit(fixed))).alias("n")).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df


def join_dealt(rows: DataFrame, one: DataFrame, key: str, count: str, total: int, by: str) -> DataFrame:
    """`rows` joined with `one`, which has one row for each `key` and the number of its rows in `count`.

    Rows of a hot key are dealt over DEALS tasks by a hash of the column `by`, and the key's row is copied to each. As
    counts sum up to `total` at most, fewer than HOT keys are hot: that list alone is broadcast. Null keys match nothing.
    """
    hot = F.broadcast(one.filter((F.col(count) * HOT > total) & (F.col(count) > DEALS)).select(key, F.lit(DEALS).alias("__lx_deals")))
    deals = F.coalesce("__lx_deals", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("__lx_deal", F.pmod(F.xxhash64(by), deals).cast("int")).drop("__lx_deals")
    copied = one.withColumn("__lx_hot", (F.col(count) * HOT > total) & (F.col(count) > DEALS))
    copied = copied.withColumn("__lx_deal", F.explode(F.sequence(F.lit(0), F.when(F.col("__lx_hot"), DEALS - 1).otherwise(0)))).drop("__lx_hot")
    return dealt.join(copied, [key, "__lx_deal"]).drop("__lx_deal")


def for_long_rows(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to 1000 rows: with whole documents, the usual 10,000 take hundreds of MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the driver's folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(docs: DataFrame, folder: str, name: str, files_per_batch: int) -> DataFrame:
    """A file stream over the table that `docs` reads, with its columns; a table is a folder of files, or one file."""
    reader = docs.sparkSession.readStream.schema(docs.schema).option("maxFilesPerTrigger", files_per_batch)
    if any(f.endswith(f"/{name}.parquet") for f in docs.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(f"{folder}/{name}.parquet")
