import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and columns whose names clash."""
    near = " ".join(f"w{k}" for k in range(120))
    rows = [
        (1, "same text twice here", "en", "a"), (2, "same  text\ttwice here", "en", "a"), (2, "same  text\ttwice here", "en", "a"), (3, None, None, None), (4, "", "en", None), (5, "   \n\t ", "fr", "b"), (None, "no identifier", "en", "b"),
        (6, near, "en", "b"), (7, near + " more", "en", "b"), (8, near.replace("w60 ", "other "), "de", "b"), (9, "x" * 200_000, "en", "a"), (10, "wörter ßü éè   漢字 𝒳 \x00 <s>", "de", "a"), (11, "word " * 5000, "en", "b"), (12, "tiny", "es", "c"),
    ]
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n", T.LongType()), ("kept", T.StringType()), ("shard", T.StringType()), ("piece_ids", T.StringType()))])
    docs = spark.createDataFrame([(*r, k, "was here", "mine", "old") for k, r in enumerate(rows)], schema)
    clashing = ("tokens", "passes", "buckets", "s", "hi_symbol_share", "lo_word_length", "keep", "digest", "total", "a.b", "key", "ids", "row", "id", "size", "rep")
    return docs.select("*", *(F.lit(c).alias(c) for c in clashing))


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
    return c
