"""What a reader's client does with results: cleaned query words, marked hits, sorted tables, files of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a word of a request may carry around it.
AROUND = " .,;:!¡?¿"
_BEFORE, _REST = r"(^|[^\p{L}\p{N}_])", r"[\p{L}\p{N}_]*"


def clean_word(word: Column) -> Column:
    """A word of a request without punctuation around it, in small letters; null stays null, and may become empty."""
    return F.lower(F.btrim(word, F.lit(AROUND)))


def highlighted(text: Column, forms: Column, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """`text` with each word marked that begins with one of `forms` (array), whatever the case.

    Forms of two letters or fewer, blank and null ones mark nothing; a text without forms stays as it is.
    """
    long = F.filter(F.coalesce(forms, F.array().cast("array<string>")), lambda w: F.length(F.trim(w)) > 2)
    safe = F.transform(long, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_])", r"\\$1"))
    pattern = F.concat(F.lit(f"(?iu){_BEFORE}((?:"), F.array_join(safe, "|"), F.lit(f"){_REST})"))
    return F.when(F.size(long) > 0, F.regexp_replace(text, pattern, F.lit(f"$1{opening}$2{closing}"))).otherwise(text)


def frequency_table(frequencies: DataFrame) -> DataFrame:
    """Works of a frequency table that have a hit, the densest first."""
    return frequencies.filter(F.col("raw_count") > 0).orderBy(F.desc("per_10k"), "work_id")


def write_json(rows: DataFrame, folder: str) -> None:
    """Results as lines of JSON, nulls included, so that every object has every name."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(folder)
