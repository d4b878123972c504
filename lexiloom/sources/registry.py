"""Known works: what they are, how their places are cited, and the reader of their files."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources import readers

Reader = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Source:
    """A work. `cited`: what stands before chapter and number in a place; the division's name if it is None."""

    work_id: str
    tradition: str
    title: str
    edition: str
    language: str
    read: Reader
    year: int | None = None
    license: str = "public domain"
    cited: str | None = None
    division_label: str = "book"
    verse_label: str = "verse"

    def ref(self) -> Column:
        """How a place is cited."""
        before = F.col("division_name") if self.cited is None else F.lit(self.cited)
        return F.concat(before, F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), F.col("number").cast("string"))


def load(spark: SparkSession, source: Source, path: str) -> DataFrame:
    """The verses of a source's files as rows of a corpus. A source under a licence that isn't accepted is an error."""
    if source.license.lower() not in readers.ACCEPTED_LICENSES:
        raise ValueError(f"{source.work_id}: {source.license} isn't an accepted licence")
    return readers.as_corpus_rows(source.read(spark, path), source.work_id, source.tradition, source.language, source.ref(), f"{source.title} ({source.edition})")


def catalogue(spark: SparkSession, sources: Iterable[Source]) -> DataFrame:
    """A row for each source."""
    rows = [(s.work_id, s.tradition, s.title, s.edition, s.language, s.year, s.license, s.division_label, s.verse_label) for s in sources]
    return spark.createDataFrame(rows, "work_id string, tradition string, title string, edition string, language string, year int, license string, division_label string, verse_label string")


def _suras(spark: SparkSession, path: str) -> DataFrame:
    return readers.sura_files(spark, path, {"Meccan": "Mecano", "Medinan": "Medinés"})


def _bible(spark: SparkSession, path: str) -> DataFrame:
    return readers.nested_books(spark, path, *TESTAMENTS)


def _bible_by_book(spark: SparkSession, path: str) -> DataFrame:
    """A folder with `books.json` and a file for each book, named by its number."""
    return readers.book_files(spark, f"{path}/books.json", f"{path}/[0-9]*.json", *TESTAMENTS)


def _tanakh(spark: SparkSession, path: str) -> DataFrame:
    """A folder with a file for each book, named by its English name."""
    return readers.licensed_versions(spark, f"{path}/*.json", [(english, k, spanish, section) for k, (english, spanish, section) in enumerate(TANAKH, 1)])


def _translated(spark: SparkSession, path: str) -> DataFrame:
    return readers.verse_files(spark, path, "siva")


# Sections of a Bible, and the books of the Tanakh (English name, Spanish name, section) in order.
TESTAMENTS = ("Antiguo Testamento", "Nuevo Testamento")
TANAKH = (
    ("Genesis", "Génesis", "Torá"), ("Exodus", "Éxodo", "Torá"), ("Leviticus", "Levítico", "Torá"), ("Numbers", "Números", "Torá"), ("Deuteronomy", "Deuteronomio", "Torá"),
    ("Joshua", "Josué", "Neviim"), ("Judges", "Jueces", "Neviim"), ("I Samuel", "1 Samuel", "Neviim"), ("II Samuel", "2 Samuel", "Neviim"), ("I Kings", "1 Reyes", "Neviim"), ("II Kings", "2 Reyes", "Neviim"),
    ("Isaiah", "Isaías", "Neviim"), ("Jeremiah", "Jeremías", "Neviim"), ("Ezekiel", "Ezequiel", "Neviim"), ("Hosea", "Oseas", "Neviim"), ("Joel", "Joel", "Neviim"), ("Amos", "Amós", "Neviim"),
    ("Obadiah", "Abdías", "Neviim"), ("Jonah", "Jonás", "Neviim"), ("Micah", "Miqueas", "Neviim"), ("Nahum", "Nahúm", "Neviim"), ("Habakkuk", "Habacuc", "Neviim"), ("Zephaniah", "Sofonías", "Neviim"),
    ("Haggai", "Hageo", "Neviim"), ("Zechariah", "Zacarías", "Neviim"), ("Malachi", "Malaquías", "Neviim"), ("Psalms", "Salmos", "Ketuvim"), ("Proverbs", "Proverbios", "Ketuvim"), ("Job", "Job", "Ketuvim"),
    ("Song of Songs", "Cantar de los Cantares", "Ketuvim"), ("Ruth", "Rut", "Ketuvim"), ("Lamentations", "Lamentaciones", "Ketuvim"), ("Ecclesiastes", "Eclesiastés", "Ketuvim"), ("Esther", "Ester", "Ketuvim"),
    ("Daniel", "Daniel", "Ketuvim"), ("Ezra", "Esdras", "Ketuvim"), ("Nehemiah", "Nehemías", "Ketuvim"), ("I Chronicles", "1 Crónicas", "Ketuvim"), ("II Chronicles", "2 Crónicas", "Ketuvim"),
)
#: Public-domain editions whose formats the readers know.
SOURCES = (
    Source("kjv", "cristianismo", "Biblia", "King James Version", "en", _bible, 1611, division_label="libro", verse_label="versiculo"),
    Source("rv1909", "cristianismo", "Biblia", "Reina-Valera 1909", "es", _bible_by_book, 1909),
    Source("tanaj-jps", "judaismo", "Tanaj", "JPS 1917 (dominio público)", "en", _tanakh, 1917, division_label="libro"),
    Source("quran-pickthall", "islam", "Corán", "M. Pickthall 1930", "en", _suras, 1930, cited="Q", division_label="sura", verse_label="aleya"),
    Source("gita-arnold", "hinduismo", "Bhagavad Gita", "Edwin Arnold, The Song Celestial 1885", "en", readers.flat_json, 1885, cited="BG", division_label="capitulo", verse_label="sloka"),
    Source("gita-sivananda", "hinduismo", "Bhagavad Gita", "Swami Sivananda", "en", _translated, cited="BG", division_label="capitulo", verse_label="sloka"),
)
#: The works of the default set, one for each tradition, in one language.
DEFAULT_SET = ("kjv", "tanaj-jps", "quran-pickthall", "gita-arnold")
