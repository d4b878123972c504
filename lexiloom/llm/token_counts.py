"""Delta-maintained token counts (operator 8).

A store is a folder in the shared file system. A batch brings documents to insert or revise, and identifiers to delete.
It is compared with what the ledger says about these documents, and becomes signed rows (+ for what is new, - for what
goes), which are written under the batch's number, with their sums by source, language and tokenizer version. Totals are
the sums over committed batches, so they are additive and never recounted. A batch is committed by the last of its
writes, a marker; one that is done again while not committed replaces its own files, and a committed one is skipped.

Defined results: a null or empty text has 0 tokens. Null source or language is a group of its own. A batch's rows
that repeat an identifier count once, the one with the longest text. Rows with a null identifier are counted, each of
them, but can't be revised or deleted, so a batch that brings them again under another number counts them again. Deleting what isn't there, or inserting what is there unchanged,
changes nothing. Groups whose documents are all gone have no row. Empty batches and empty stores give empty results.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, batch int"
SUMS = "source string, lang string, tokenizer string, docs long, tokens long, batch int"


@dataclass(frozen=True)
class Tokenizer:
    """A version's name and a factory, called once in each Python worker, of a function from texts to counts."""

    version: str
    counter: Callable[[], Callable[[list[str]], list[int]]]


def byte_pair_tokenizer(ranks: str, pattern: str, version: str) -> Tokenizer:
    """Of a file of ranks (a token in base 64 and its rank on each line), read here and sent to the tasks."""
    with open(ranks, "rb") as f:
        lines = f.read()

    def counter():
        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        encoding = tiktoken.Encoding(version, pat_str=pattern, mergeable_ranks=known, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(x)) for x in texts]

    return Tokenizer(version, counter)


def counted(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """Adds `tokens` to all rows of `docs`."""

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = tokenizer.counter()
        for batch in texts:
            yield pd.Series(of([x or "" for x in batch]), dtype="int64")

    return docs.withColumn("tokens", count(F.col(text)))


class Rollup:
    """The store in `folder`."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def committed(self) -> list[int]:
        """Numbers of the committed batches."""
        path = f"{self.folder}/commits"
        return sorted(r[0] for r in self.spark.read.schema("batch int").parquet(f"{path}/*").distinct().collect()) if self._exists(path) else []

    def _read(self, kind: str, schema: str) -> DataFrame:
        done = self.committed()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*(f"{self.folder}/{kind}/batch={b}" for b in done))

    def documents(self) -> DataFrame:
        """What the ledger says: (doc_id, source, lang, tokenizer, docs, tokens) of documents that are there."""
        return self._read("ledger", LEDGER).groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens)."""
        return self._read("sums", SUMS).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0")

    def commit(self, batch: int, upserts: DataFrame, tokenizer: Tokenizer, deletes: DataFrame | None = None) -> bool:
        """Brings `upserts` (doc_id, source, lang, text) and `deletes` (doc_id) of one tokenizer version into the totals.

        False if the batch was committed before.
        """
        if batch in self.committed():
            return False
        rows = counted(upserts.select("doc_id", "source", "lang", "text"), tokenizer)
        none = F.col("doc_id").isNull()
        longest = F.max_by(F.struct("source", "lang", "tokens"), F.struct("tokens", F.col("source"), F.col("lang")))
        new = rows.groupBy("doc_id", F.when(none, F.struct("source", "lang")).alias("own")).agg(longest.alias("x"), F.count("*").alias("n"), F.sum("tokens").alias("all"))
        docs, tokens = F.when(none, F.col("n")).otherwise(F.lit(1).cast("long")), F.when(none, F.col("all")).otherwise(F.col("x.tokens"))
        new = new.select("doc_id", "x.source", "x.lang", F.lit(tokenizer.version).alias("tokenizer"), docs.alias("docs"), tokens.alias("tokens"))
        signed = new
        if self.committed():
            touched = new.select("doc_id") if deletes is None else new.select("doc_id").union(deletes.select("doc_id")).distinct()
            old = self.documents().filter(F.col("tokenizer") == tokenizer.version).join(touched, "doc_id", "left_semi")
            if deletes is not None:
                signed = signed.join(deletes.select("doc_id").distinct(), "doc_id", "left_anti")
            signed = signed.union(old.select("doc_id", *KEYS, -F.col("docs"), -F.col("tokens")))
        elif deletes is not None:
            signed = signed.join(deletes.select("doc_id").distinct(), "doc_id", "left_anti")
        ledger = f"{self.folder}/ledger/batch={batch}"
        net = signed.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")
        net.write.mode("overwrite").option("compression", "zstd").parquet(ledger)
        sums = self.spark.read.schema(net.schema).parquet(ledger).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/sums/batch={batch}")
        self.spark.range(1).select(F.lit(batch).alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/{batch}")
        return True
