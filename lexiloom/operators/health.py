"""Is a corpus what it says: script of each work, basic words, plausible sizes; and what to take out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.plans.corpus import Corpus

LEAST_WORDS = 5


def validate_language(corpus: Corpus, first: int | None = None) -> DataFrame:
    """(work_id, language, script, expected, share, valid) by all verses of each work, or its `first` ones; a work whose
    language is unknown should be in the Latin script. Null texts have no letters."""
    verses = corpus.verses
    if first is not None:
        place = F.row_number().over(Window.partitionBy("work_id").orderBy("division_ordinal", "chapter", "number", "verse_id"))
        verses = verses.withColumn("__lx_n", place).filter(F.col("__lx_n") <= first)
    counts = T.script_counts(F.col("text"))
    sums = verses.groupBy("work_id", "language").agg(*(F.sum(c).alias(f"n_{k}") for k, c in counts.items()))
    found = sums.withColumn("d", T.script_of({k: F.col(f"n_{k}") for k in counts})).withColumn("expected", T.expected_script(F.col("language")))
    valid = (F.col("d.script") == F.col("expected")) & (F.col("d.share") >= T.LEAST_SCRIPT_SHARE)
    return found.select("work_id", "language", F.col("d.script").alias("script"), "expected", F.round("d.share", 4).alias("share"), valid.alias("valid"))


def corpus_clean(corpus: Corpus) -> DataFrame:
    """Verses of the works that pass; to be written in place of the table."""
    bad = validate_language(corpus).filter("not valid").select("work_id")
    return corpus.verses.join(bad, "work_id", "left_anti")


def control_vocabulary(corpus: Corpus, controls: Iterable[tuple[str, str]]) -> DataFrame:
    """(work_id, word) of the control words (language, word) that a work of that language lacks; controls are few."""
    controls = list(controls)
    wanted = corpus.works.sparkSession.createDataFrame(controls, "language string, word string")
    pairs = corpus.works.select("work_id", "language").join(F.broadcast(wanted), "language")
    there = corpus.lemma_index.filter(F.col("surface").isin(*{w for _, w in controls})).select("work_id", F.col("surface").alias("word")).distinct()
    return pairs.join(there, ["work_id", "word"], "left_anti").select("work_id", "word")


def corpus_health(corpus: Corpus, controls: Iterable[tuple[str, str]]) -> DataFrame:
    """One row for each work with its three verdicts: script, vocabulary (half the control words at least), verse size."""
    controls = list(controls)
    n = {lang: sum(k == lang for k, _ in controls) for lang, _ in controls}
    total = F.coalesce(*(F.when(F.col("language") == k, F.lit(v)) for k, v in n.items()), F.lit(0)) if n else F.lit(0)
    lacking = control_vocabulary(corpus, controls).groupBy("work_id").agg(F.count("*").alias("missing_words")) if n else None
    rows = corpus.works.join(validate_language(corpus).select("work_id", F.col("valid").alias("language_ok")), "work_id", "left")
    rows = rows.join(lacking, "work_id", "left").fillna(0, ["missing_words"]) if lacking is not None else rows.withColumn("missing_words", F.lit(0).cast("long"))
    average = F.round(F.col("total_tokens") / F.col("total_verses"), 3)
    return rows.select(
        "work_id", "language_ok", "missing_words", (F.col("missing_words") <= F.floor(total / 2)).alias("vocabulary_ok"), average.alias("words_per_verse"), (F.col("total_tokens") / F.col("total_verses") >= LEAST_WORDS).alias("size_ok")
    )
