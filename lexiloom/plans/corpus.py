"""The corpus: works, divisions and verses, and the positional index and totals derived from them."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions.counts import SCHEMA, count_terms

#: Lines of one document that its verse identifiers leave room for.
LINES = 1 << 20
#: What is kept, written and read besides the verses.
DERIVED = ("lemma_index", "text_postings", "text_lengths", "lemma_totals", "divisions", "works")


@dataclass
class Corpus:
    """`verses`: (verse_id, work_id, tradition, language, division_id, division_ordinal, division_name, section, chapter,
    number, ref, text), and `title`, if works have one. All else is derived from it, lazily; persist() keeps what queries
    share. A corpus that was written also has `places`: (verse_id, language, words, work_id,
    division_id), in buckets by verse (else None).
    `kept`: whether the totals are tables, or have to be counted."""

    verses: DataFrame
    places: DataFrame | None = None
    kept: bool = False

    @cached_property
    def words(self) -> DataFrame:
        """(verse columns, words): all words of each verse in order."""
        return self.verses.select("verse_id", "work_id", "language", "division_id", T.words(T.normalize(F.col("text"), F.col("language"))).alias("words"))

    @cached_property
    def text_postings(self) -> DataFrame:
        """(term, verse_id, position): the words of the text index, folded, none left out."""
        return self.verses.select("verse_id", F.posexplode(T.plain_words(F.col("text"))).alias("position", "term")).select("term", "verse_id", "position")

    @cached_property
    def text_lengths(self) -> DataFrame:
        """(verse_id, work_id, length) in words of the text index."""
        return self.verses.select("verse_id", "work_id", F.size(T.plain_words(F.col("text"))).alias("length"))

    @cached_property
    def terms(self) -> DataFrame:
        """(work_id, language, division_id, verse_id, position, surface): words that are terms; positions count all words."""
        placed = self.words.select("work_id", "language", "division_id", "verse_id", F.posexplode("words").alias("position", "surface"))
        return placed.filter(T.is_term(F.col("surface"), F.col("language")))

    @cached_property
    def lemma_index(self) -> DataFrame:
        """(lemma, work_id, division_id, verse_id, surface, position) of all terms."""
        return T.stemmed(self.terms, "surface", "language").select("lemma", "work_id", "division_id", "verse_id", "surface", "position")

    @cached_property
    def form_totals(self) -> DataFrame:
        """(work_id, language, surface, lemma, count): forms are counted first, and each is stemmed once."""
        forms = self.terms.groupBy("work_id", "language", "surface").agg(F.count("*").alias("count"))
        return T.stemmed(forms, "surface", "language").select("work_id", "language", "surface", "lemma", "count")

    @property
    def lemma_counts(self) -> DataFrame:
        """(lemma, work_id, count): what lemma_totals has, without counting verses where the totals aren't kept."""
        if self.kept:
            return self.lemma_totals.select("lemma", "work_id", "count")
        return self.form_totals.groupBy("lemma", "work_id").agg(F.sum("count").alias("count"))

    @cached_property
    def verse_tokens(self) -> DataFrame:
        return self.words.select("verse_id", "work_id", "division_id", F.size("words").cast("long").alias("token_count"))

    @property
    def _counts(self) -> DataFrame:
        return self.words.select("work_id", "division_id", "language", "words").mapInArrow(count_terms, SCHEMA)

    @property
    def division_counts(self) -> DataFrame:
        """(lemma, work_id, division_id, count, verse_count) of all terms; rows without a lemma have the number of all words,
        and of all verses."""
        return self._counts.groupBy("lemma", "work_id", "division_id").agg(F.sum("count").alias("count"), F.sum("verse_count").alias("verse_count"))

    @cached_property
    def lemma_totals(self) -> DataFrame:
        """(lemma, work_id, count, verse_count); a verse is one row, so what frames of them hold adds up."""
        return self._counts.filter("lemma is not null").groupBy("lemma", "work_id").agg(F.sum("count").alias("count"), F.sum("verse_count").alias("verse_count"))

    @cached_property
    def sizes(self) -> DataFrame:
        """What divisions and works are summed up from, by one pass over the verses: a row for each division of a work."""
        title = F.col("title") if "title" in self.verses.columns else F.concat("tradition", F.lit(" ("), "language", F.lit(")"))
        words = F.size(T.words(T.normalize(F.col("text"), F.col("language")))).cast("long")
        return self.verses.groupBy("work_id", "division_id").agg(
            F.first("tradition").alias("tradition"), F.first("language").alias("language"), F.first(title).alias("title"), F.first("division_ordinal").alias("ordinal"),
            F.min("division_name").alias("name"), F.first("section").alias("section"), F.count("*").alias("total_verses"), F.sum(words).alias("total_tokens"),
        )

    @cached_property
    def divisions(self) -> DataFrame:
        """(division_id, work_id, ordinal, name, section, total_tokens)."""
        rows = self.sizes.filter("division_id is not null").groupBy("division_id")
        return rows.agg(F.first("work_id").alias("work_id"), F.first("ordinal").alias("ordinal"), F.min("name").alias("name"), F.first("section").alias("section"), F.sum("total_tokens").alias("total_tokens"))

    @cached_property
    def works(self) -> DataFrame:
        """(work_id, title, tradition, language, total_tokens, total_verses, divisions)."""
        names = self.sizes.groupBy("work_id").agg(F.first("tradition").alias("tradition"), F.first("language").alias("language"), F.first("title").alias("title"), F.sum("total_verses").alias("total_verses"))
        sizes = self.divisions.groupBy("work_id").agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("divisions"))
        return names.join(sizes, "work_id")

    def persist(self) -> Corpus:
        """Keeps the index and the small tables in the executors' memory and disk, for a session of many queries."""
        for name in ("words", *DERIVED):
            setattr(self, name, getattr(self, name).persist())
        self.kept = True
        return self

    def write(self, folder: str, buckets: int = 64) -> None:
        """Verses, index and totals as Parquet, by work, the index in order of lemma, so that scans skip row groups.

        Rows are dealt by ranges of (lemma, verse), so a frequent word's postings are many tasks' work. Words in order
        are written by write_places().
        """
        self.verses.write.mode("overwrite").partitionBy("work_id").parquet(f"{folder}/verses")
        index = self.lemma_index
        index.repartitionByRange("work_id", "lemma", "verse_id").sortWithinPartitions("work_id", "lemma", "verse_id").write.mode("overwrite").partitionBy("work_id").parquet(f"{folder}/lemma_index")
        self.text_postings.repartitionByRange("term", "verse_id").sortWithinPartitions("term", "verse_id").write.mode("overwrite").parquet(f"{folder}/text_postings")
        for name in ("text_lengths", "lemma_totals", "divisions", "works"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        self.write_places(folder, buckets)

    def write_places(self, folder: str, buckets: int = 64) -> None:
        """All words of each verse in order, in buckets by verse: the words around a hit are found without an exchange of
        them, and a verse is one row, so there is less to write than of the index."""
        spark, table = self.verses.sparkSession, _table_of(folder)
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        rows = self.words.select("verse_id", "language", "words", "work_id", "division_id").repartition(buckets, "verse_id")
        rows.write.mode("overwrite").format("parquet").bucketBy(buckets, "verse_id").sortBy("verse_id").option("path", f"{folder}/places").saveAsTable(table)
        spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/layout")

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Corpus:
        """What write() has written."""
        corpus = Corpus(spark.read.parquet(f"{folder}/verses"), kept=True)
        for name in DERIVED:
            setattr(corpus, name, spark.read.parquet(f"{folder}/{name}"))
        corpus.places = read_places(spark, folder)
        return corpus


def read_places(spark: SparkSession, folder: str) -> DataFrame:
    """What write_places() has written, by a table in the session's catalogue, as only that keeps how rows lie."""
    buckets = spark.read.parquet(f"{folder}/layout").first().buckets
    table, columns = _table_of(folder), "verse_id long, language string, words array<string>, work_id string, division_id string"
    where = f"{folder}/places".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (verse_id) SORTED BY (verse_id) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(table)


def _table_of(folder: str) -> str:
    """The name of the table over a folder's buckets in the session's catalogue."""
    return "lexiloom_places_" + hashlib.sha256(folder.encode()).hexdigest()[:16]


def first_of_each(verses: DataFrame, arrival: str) -> DataFrame:
    """Of verses with one place (work, division, chapter, number) the first that arrived."""
    place = Window.partitionBy("work_id", "division_id", "chapter", "number").orderBy(arrival)
    return verses.withColumn("__lx_n", F.row_number().over(place)).filter("__lx_n = 1").drop("__lx_n")


def from_documents(docs: DataFrame) -> Corpus:
    """Documents as a corpus: four traditions of sources in each language make the works, a source is a division, a
    document a chapter, and each line with something in it a verse."""
    k = F.coalesce(F.expr("try_cast(substring(source, 4) as int)"), F.lit(0))
    rows = docs.select("doc_id", "lang", "source", k.alias("k"), F.posexplode(F.split("text", "\n")).alias("line", "text")).filter(F.col("text").rlike(r"\S"))
    tradition = F.concat(F.lit("t"), (F.col("k") % 4).cast("string"))
    work = F.concat_ws("-", "lang", tradition)
    ordinal = F.floor(F.col("k") / 4).cast("int") + 1
    section = F.when(ordinal <= 2, "A").when(ordinal <= 4, "B")
    # a line beyond the room would have the identifier of another document's
    number = F.when(F.col("line") + 1 < LINES, F.col("line") + 1).otherwise(F.raise_error(F.lit(f"a document has more than {LINES - 1} lines")).cast("int"))
    return Corpus(
        rows.select(
            (F.col("doc_id") * LINES + number).alias("verse_id"),
            work.alias("work_id"),
            tradition.alias("tradition"),
            F.col("lang").alias("language"),
            F.concat(work, F.lit("/"), ordinal.cast("string")).alias("division_id"),
            ordinal.alias("division_ordinal"),
            F.col("source").alias("division_name"),
            section.alias("section"),
            F.col("doc_id").alias("chapter"),
            number.alias("number"),
            F.concat("source", F.lit(" "), F.col("doc_id").cast("string"), F.lit(":"), number.cast("string")).alias("ref"),
            "text",
        )
    )
