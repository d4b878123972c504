"""Ingestion of verses from a file stream into tables by work.

Each micro-batch is checked (script of each work), its verses are placed (the first of a place wins, those of earlier
batches before those of later ones), and written under the batch's number, so that a batch that is done again replaces
its own files. The totals are maintained from the batch's own counts. The last of a batch's writes marks it as committed;
readers see committed batches alone, so a batch that stopped half-way is as if it had never been.

A batch may replace works: from then on, only what it and later batches brought of them counts. Nothing is rewritten: the
batch notes which works it replaces, and readers leave out the rows of earlier batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.health import validate_language
from lexiloom.plans.corpus import Corpus, first_of_each
from lexiloom.streaming import totals as kept
from lexiloom.streaming.text_index import Blocks, TextIndex

PLACE = ["work_id", "division_id", "chapter", "number"]


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def committed(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the committed batches."""
    path = f"{folder}/commits"
    return sorted(r[0] for r in spark.read.schema("batch int").parquet(f"{path}/*").distinct().collect()) if _exists(spark, path) else []


def table(spark: SparkSession, folder: str, name: str, schema, before: int | None = None) -> DataFrame:
    """What counts of a table (`verses`, `lemma_index` or one of totals.py) after the committed batches, or those `before` one,
    with the number of the batch."""
    done = [b for b in committed(spark, folder) if before is None or b < before]
    read = lambda name, schema: spark.read.schema(schema).option("basePath", f"{folder}/{name}").parquet(*(f"{folder}/{name}/batch={b}" for b in done))
    if not done:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    rows = spark.read.schema(schema).option("basePath", f"{folder}/{name}").parquet(*(f"{folder}/{name}/batch={b}" for b in done))
    since = read("replaced", "work_id string").groupBy("work_id").agg(F.max("batch").alias("since"))
    return rows.join(since, "work_id", "left").filter(F.col("batch") >= F.coalesce("since", F.lit(-1))).drop("since").select(*rows.columns)


def replaced(spark: SparkSession, folder: str) -> DataFrame:
    """(work_id, since): the committed batch that replaced a work last."""
    done = committed(spark, folder)
    if not done:
        return spark.createDataFrame([], "work_id string, since int")
    rows = spark.read.schema("work_id string").option("basePath", f"{folder}/replaced").parquet(*(f"{folder}/replaced/batch={b}" for b in done))
    return rows.groupBy("work_id").agg(F.max("batch").alias("since"))


def text_index(spark: SparkSession, folder: str) -> Blocks:
    """The text index of what the committed batches brought."""
    return TextIndex(spark, f"{folder}/text").read(committed(spark, folder), replaced(spark, folder))


def searchable(spark: SparkSession, folder: str, like) -> Corpus:
    """The verses that count, with the indexes and totals that were kept for them, so that nothing is indexed again;
    `like`: their schema."""
    corpus, index = Corpus(table(spark, folder, "verses", like).drop("batch")), text_index(spark, folder)
    corpus.text_postings, corpus.text_lengths = index.postings, index.lengths
    corpus.lemma_index = table(spark, folder, "lemma_index", kept.SCHEMAS["lemma_index"]).drop("batch")
    corpus.lemma_totals, corpus.divisions, corpus.works = totals(spark, folder), divisions(spark, folder), works(spark, folder)
    return corpus


def rows_of_batch(spark: SparkSession, folder: str, name: str, batch: int) -> DataFrame:
    """What a batch wrote to a table of totals.py."""
    return spark.read.schema(kept.SCHEMAS[name]).parquet(f"{folder}/{name}/batch={batch}")


def loaded_works(spark: SparkSession, folder: str, like) -> DataFrame:
    """(work_id) of works that are there, so that a build which is started again can leave them out."""
    return table(spark, folder, "verses", like).select("work_id").distinct()


def ingest_batch(verses: DataFrame, batch: int, folder: str, arrival: str = "verse_id", replaces: bool = False, checked: bool = False) -> None:
    """Writes what is new and valid of a batch to `verses`, `lemma_index`, the tables of totals.py and the segments of `text`
    below the folder. With `replaces`, its works' earlier rows count no longer; works that aren't valid replace nothing.
    With `checked`, all works are known to be valid."""
    spark = verses.sparkSession
    if batch in committed(spark, folder):
        return
    valid = verses if checked else verses.join(validate_language(Corpus(verses)).filter("valid").select("work_id"), "work_id", "left_semi")
    fresh = first_of_each(valid, arrival)
    new = fresh.select(*verses.columns)
    if not replaces:
        known = table(spark, folder, "verses", verses.schema, before=batch)
        touched = known.join(fresh.select("work_id").distinct(), "work_id", "left_semi")
        new = fresh.join(touched.select(*PLACE), PLACE, "left_anti").select(*verses.columns)
    new.write.mode("overwrite").parquet(f"{folder}/verses/batch={batch}")
    corpus = Corpus(spark.read.schema(verses.schema).parquet(f"{folder}/verses/batch={batch}"))
    kept.write_batch(corpus, folder, batch)
    kept.write_index(corpus, folder, batch)
    TextIndex(spark, f"{folder}/text").add(corpus.verses, batch)
    anew = corpus.verses.select("work_id").distinct() if replaces else spark.createDataFrame([], "work_id string")
    anew.coalesce(1).write.mode("overwrite").parquet(f"{folder}/replaced/batch={batch}")
    spark.range(1).select(F.lit(batch).alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/{batch}")
    TextIndex(spark, f"{folder}/text").merge(committed(spark, folder), replaced(spark, folder))


def ingest(stream: DataFrame, folder: str, replaces: bool = False) -> None:
    """Brings all that is new in a stream of verses (with the columns of a corpus) into the folder, then stops."""
    query = stream.writeStream.foreachBatch(lambda df, n: ingest_batch(df, n, folder, replaces=replaces)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """(lemma, work_id, count, verse_count) over all batches; a verse is in one batch, so the sums are exact."""
    return kept.word_totals(table(spark, folder, "totals", kept.SCHEMAS["totals"]))


def divisions(spark: SparkSession, folder: str) -> DataFrame:
    """Divisions with their totals over all batches, as totals.division_totals() has them."""
    return kept.division_totals(table(spark, folder, "divisions", kept.SCHEMAS["divisions"]))


def works(spark: SparkSession, folder: str) -> DataFrame:
    """Works with their totals over all batches, as totals.work_totals() has them."""
    return kept.work_totals(table(spark, folder, "works", kept.SCHEMAS["works"]), divisions(spark, folder))


def dispersion(spark: SparkSession, folder: str, stems) -> DataFrame:
    """(work_id, divisions_present, divisions_total, dispersion) of some words over all batches, without the index."""
    return kept.dispersion(table(spark, folder, "presence", kept.SCHEMAS["presence"]), works(spark, folder), stems)
