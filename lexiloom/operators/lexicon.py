"""Semantic fields: named sets of terms in several languages, with labels by language of the interface.

As a DataFrame a lexicon is (field, labels map<lang, label>, terms map<lang, array<term>>).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T


def terms(lexicon: DataFrame) -> DataFrame:
    """(field, language, term, lemma): one row for each term."""
    by_lang = lexicon.select("field", F.explode("terms").alias("language", "terms")).select("field", "language", F.explode("terms").alias("term"))
    normal = by_lang.select("*", F.explode(F.array(T.normalize(F.col("term"), F.col("language")))).alias("__lx_n"))  # a row, so that stems refer to a column
    return T.stemmed(normal, "__lx_n", "language").drop("__lx_n")


def label(labels: Column, ui_lang: str) -> Column:
    """The label in a language, else the English one, else the first; null without any."""
    return F.coalesce(F.try_element_at(labels, F.lit(ui_lang)), F.try_element_at(labels, F.lit("en")), F.try_element_at(F.map_values(labels), F.lit(1)))


def fields(lexicon: DataFrame, ui_lang: str = "en") -> DataFrame:
    """(field, label, languages, term_count), the number of terms being over all languages."""
    count = F.aggregate(F.map_values("terms"), F.lit(0), lambda n, x: n + F.size(x))
    return lexicon.select("field", F.coalesce(label(F.col("labels"), ui_lang), F.col("field")).alias("label"), F.array_join(F.array_sort(F.map_keys("terms")), ",").alias("languages"), count.cast("long").alias("term_count"))


def field_stems(lexicon: DataFrame, field: str, language: str) -> DataFrame:
    """(lemma): distinct stems of a field in a language; empty for an unknown field."""
    return terms(lexicon).filter((F.col("field") == field) & (F.col("language") == language)).select("lemma").distinct()


def fields_containing(lexicon: DataFrame, words: DataFrame) -> DataFrame:
    """(language, lemma, field) for words (language, lemma): the fields that hold a word's stem."""
    return words.join(terms(lexicon).select("language", "lemma", "field").distinct(), ["language", "lemma"]).distinct()


def resolve(spark: SparkSession, language: str, term: str | None = None, extra_terms: Iterable[str] = (), lexicon: DataFrame | None = None, field: str | None = None) -> DataFrame:
    """(lemma): the stems of a term, of further terms and of a field. A term is stemmed as one word; empty ones count
    for nothing. The terms of a request are few; those of a field stay a DataFrame."""
    asked = [(t, language) for t in [term, *extra_terms] if t and t.strip()]
    rows = spark.createDataFrame(asked, "term string, language string").select("*", F.explode(F.array(F.trim(T.normalize(F.col("term"), F.col("language"))))).alias("__lx_n"))
    out = T.stemmed(rows, "__lx_n", "language").select("lemma").filter("lemma <> ''")
    if lexicon is not None and field:
        out = out.union(field_stems(lexicon, field, language))
    return out.distinct()
