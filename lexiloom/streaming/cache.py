"""Tables with keys whose newest row counts: translations of verses, glosses of words, vectors of models.

Rows are appended by numbered batches and never rewritten; a batch that is done again replaces its own files, and one
without Spark's mark of success isn't read. Of rows with one key the one of the last batch counts, in a batch the one that
is greatest by `created` and then by its values. A null key is a key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.frequency import top_surface
from lexiloom.plans.corpus import Corpus

TRANSLATIONS = "verse_id long, lang string, text string, provider string, created timestamp"
WORD_TRANSLATIONS = "word string, lang string, text string, provider string, created timestamp"
VECTORS = "verse_id long, model string, vector array<float>"


def newest(rows: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """One row for each key, the greatest by `order` and then by the other columns: one aggregate, combined map-side."""
    keys, order = list(keys), list(order)
    rest = [c for c in rows.columns if c not in {*keys, *order}]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__lx_row"))
    return best.select(*(F.col(c) if c in keys else F.col("__lx_row")[c].alias(c) for c in rows.columns))


def _done(spark: SparkSession, folder: str) -> list[str]:
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*/_SUCCESS")
    found = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(mark)
    return sorted(str(f.getPath().getParent().toString()) for f in found or [])


def put(rows: DataFrame, folder: str, batch: int) -> None:
    """Adds a batch; with a number that is there already it replaces that batch."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def table(spark: SparkSession, folder: str, schema: str, keys: Iterable[str]) -> DataFrame:
    """What counts of a folder's batches; empty where there are none."""
    done = _done(spark, folder)
    if not done:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", folder).parquet(*done)
    order = ["batch", *(["created"] if "created" in rows.columns else [])]
    return newest(rows, keys, order).drop("batch")


def look_up(asked: DataFrame, cache: DataFrame, keys: Iterable[str]) -> DataFrame:
    """`asked` with `cached` (whether the key was tried) and `translation`, null where it was never tried or where the
    try gave nothing, which the cache holds as an empty text."""
    keys = list(keys)
    known = cache.select(*keys, F.col("text").alias("__lx_text"), F.lit(True).alias("cached"))
    out = asked.join(known, keys, "left")
    return out.select(*asked.columns, F.coalesce("cached", F.lit(False)).alias("cached"), F.expr("nullif(__lx_text, '')").alias("translation"))


def page(verses: DataFrame, cache: DataFrame, lang: str, limit: int = 25) -> DataFrame:
    """(verse_id, language, text, cached, translation, wanted) of a page of verses, at most `limit` (more are an error):
    what the cache has of each in `lang`, and whether a translator is still to be asked: not for what was tried, nor for
    verses that are in that language already."""
    if verses.limit(limit + 1).count() > limit:
        raise ValueError(f"a page has at most {limit} verses")
    found = look_up(verses.select("verse_id", "language", "text"), cache.filter(F.col("lang") == lang), ["verse_id"])
    return found.withColumn("wanted", ~F.col("cached") & ~F.coalesce(F.col("language") == lang, F.lit(False)))


def gloss(corpus: Corpus, cache: DataFrame, lang: str) -> DataFrame:
    """(lemma, surface, cached, translation): each lemma by its most frequent form, and what the cache has of that form."""
    forms = top_surface(corpus).select("lemma", "surface", F.col("surface").alias("word"))
    return look_up(forms, cache.filter(F.col("lang") == lang), ["word"]).drop("word")
