"""Readers of published text formats. Each gives verses: (division_ordinal, division_name, section, chapter, number, text).

All read files that Spark can reach; fetching them is not this library's work. Schemas are stated, never inferred.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import LEAST_SCRIPT_SHARE, detect_script, expected_script, strip_html

VERSE = "division_ordinal int, division_name string, section string, chapter int, number int, text string"
COLUMNS = ("division_ordinal", "division_name", "section", "chapter", "number", "text")


_VERSES = f"array<struct<{VERSE.replace(' ', ':').replace(',:', ',')}>>"
#: A file that isn't JSON, or has something else than the format says, is an error, not an empty one.
STRICT = {"mode": "FAILFAST"}
#: Licences under which texts may be passed on, in small letters.
ACCEPTED_LICENSES = ("public domain", "pd", "cc0")
#: Roman numerals of chapters.
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", STRICT["mode"]).json(path)


def _list_or_field(spark: SparkSession, path: str, name: str, kind: str) -> DataFrame:
    """One row for each file, with the list that it is or that its object has under `name`."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"))
    own = F.from_json("value", f"struct<{name}:{kind}>", STRICT)[name]
    return raw.select(F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", kind, STRICT)).otherwise(own).alias(name))


def flat_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of verses, or an object with a list `verses`."""
    return _list_or_field(spark, path, "verses", _VERSES).select(F.explode("verses").alias("v")).select("v.*")


def sample_works(spark: SparkSession, path: str) -> DataFrame:
    """An object with a map `works` from work to verses; adds work_id."""
    rows = _json(spark, path, f"works map<string, {_VERSES}>")
    return rows.select(F.explode("works").alias("work_id", "verses")).select("work_id", F.explode("verses").alias("v")).select("work_id", "v.*")


def nested_books(spark: SparkSession, path: str, first_section: str = "Old Testament", second_section: str = "New Testament", last_of_first: int = 39) -> DataFrame:
    """A list of books, or an object with one, with chapters with verses. A chapter's number is `chapter` or `num`, a
    verse's `verse` or `num`, and 0 without; the name of a book is `name` or `book`; the first 39 books are the first
    section. Empty verses are kept, those without a text are dropped."""
    verse = "struct<verse:int, num:int, text:string>"
    rows = _list_or_field(spark, path, "books", f"array<struct<name:string, book:string, chapters:array<struct<chapter:int, num:int, verses:array<{verse}>>>>>")
    books = rows.select(F.posexplode("books").alias("b", "book"))
    chapters = books.select("b", F.coalesce("book.name", "book.book").alias("name"), F.posexplode("book.chapters").alias("c", "chapter"))
    verses = chapters.select("b", "name", "c", "chapter", F.posexplode("chapter.verses").alias("v", "verse"))
    ordinal = F.col("b") + 1
    section = F.when(ordinal <= last_of_first, first_section).otherwise(second_section)
    return verses.select(
        ordinal.alias("division_ordinal"), F.col("name").alias("division_name"), section.alias("section"), F.coalesce("chapter.chapter", "chapter.num", F.lit(0)).alias("chapter"), F.coalesce("verse.verse", "verse.num", F.lit(0)).alias("number"), F.trim("verse.text").alias("text")
    ).filter(F.col("text").isNotNull())


def book_files(spark: SparkSession, index: str, books: str, first_section: str = "Old Testament", second_section: str = "New Testament", last_of_first: int = 39) -> DataFrame:
    """An index of books and a file for each book with chapters with verses. The index is a list, or an object with a list
    or a map `books`; a book's number is `nr` or `book_nr`, else its place in the index. A file's number is its `nr`, else
    that in its name; the name of a book is that of its file, else of the index. Empty verses are kept, those without a
    text are dropped; so are files of books that the index doesn't have."""
    entry = "struct<nr:int, book_nr:int, name:string>"
    raw = spark.read.text(index, wholetext=True).select(F.ltrim("value").alias("v"))
    as_map = F.map_values(F.from_json("v", f"struct<books:map<string,{entry}>>", STRICT)["books"])
    as_list = F.from_json("v", f"struct<books:array<{entry}>>", STRICT)["books"]
    of_map = F.startswith(F.ltrim(F.coalesce(F.get_json_object("v", "$.books"), F.lit(""))), F.lit("{"))
    listed = F.when(F.startswith("v", F.lit("[")), F.from_json("v", f"array<{entry}>", STRICT)).when(of_map, as_map).otherwise(as_list)
    names = raw.select(F.posexplode(listed).alias("at", "b"))
    names = names.select(F.coalesce(F.expr("nullif(b.nr, 0)"), F.expr("nullif(b.book_nr, 0)"), F.col("at") + 1).alias("nr"), F.col("b.name").alias("listed"))
    rows = _json(spark, books, "nr int, name string, chapters array<struct<chapter:int, verses:array<struct<verse:int, text:string>>>>")
    in_name = F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1)
    rows = rows.withColumn("nr", F.coalesce("nr", in_name.try_cast("int")))
    chapters = rows.select("nr", "name", F.explode("chapters").alias("c")).select("nr", "name", F.coalesce("c.chapter", F.lit(0)).alias("chapter"), F.explode("c.verses").alias("v"))
    out = chapters.join(F.broadcast(names), "nr")  # an index has a book a row
    section = F.when(F.col("nr") <= last_of_first, first_section).otherwise(second_section)
    name = F.coalesce(F.expr("nullif(name, '')"), "listed")
    return out.select(F.col("nr").alias("division_ordinal"), name.alias("division_name"), section.alias("section"), "chapter", F.col("v.verse").alias("number"), F.trim("v.text").alias("text")).filter(F.col("text").isNotNull())


def licensed_versions(spark: SparkSession, path: str, books: Iterable[tuple[str, int, str, str]], licenses: Iterable[str] = ACCEPTED_LICENSES) -> DataFrame:
    """API answers `versions` with `license` and `text`, of which the first counts. An answer without a version, or whose
    first one is under another licence, fails the job: nothing of it may be passed on, and no book may be missing unseen.
    Texts are arrays of chapters, or flat for books of one chapter. `books`: (file stem, ordinal, name, section). Markup
    goes, empty verses are dropped."""
    info = spark.createDataFrame(list(books), "file string, division_ordinal int, division_name string, section string")
    rows = _json(spark, path, "versions array<struct<license:string, versionTitle:string, text:array<string>>>")
    rows = rows.withColumn("file", F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))).withColumn("v", F.try_element_at("versions", F.lit(1)))
    free = F.coalesce(F.lower(F.trim("v.license")).isin(*licenses), F.lit(False))
    closed = F.raise_error(F.concat(F.col("file"), F.lit(": no version, or its licence isn't accepted: "), F.coalesce("v.license", F.lit("none"))))
    texts = rows.select("file", F.posexplode(F.when(free, F.col("v.text")).otherwise(closed.cast("array<string>"))).alias("c", "chapter"))
    nested = F.startswith(F.col("chapter"), F.lit("["))
    verses = F.when(nested, F.from_json("chapter", "array<string>")).otherwise(F.array("chapter"))
    each = texts.select("file", "c", nested.alias("nested"), F.posexplode(verses).alias("v", "raw"))
    out = each.join(F.broadcast(info), "file")
    number = F.when(F.col("nested"), F.col("v") + 1).otherwise(F.col("c") + 1)
    chapter = F.when(F.col("nested"), F.col("c") + 1).otherwise(1)
    return out.select("division_ordinal", "division_name", "section", chapter.alias("chapter"), number.alias("number"), strip_html(F.col("raw")).alias("text")).filter(F.col("text") != "")


def sura_files(spark: SparkSession, path: str, sections: dict[str, str], language: str = "en") -> DataFrame:
    """An answer with suras: number, name, revelationType (named by `sections`, else as it is) and verses; a sura is a
    division and its only chapter. If the first verse isn't in the script of `language` the job fails: for an unknown
    edition such an answer holds another one."""
    rows = _json(spark, path, "data struct<surahs:array<struct<number:int, englishName:string, revelationType:string, ayahs:array<struct<numberInSurah:int, text:string>>>>>")
    first = detect_script(F.col("data.surahs")[0]["ayahs"][0]["text"])
    right = (first["script"] == expected_script(F.lit(language))) & (first["share"] >= LEAST_SCRIPT_SHARE)
    wrong = F.raise_error(F.concat(F.lit(f"not in the script of {language}: "), first["script"]))
    suras = rows.select(F.explode(F.when(right, F.col("data.surahs")).otherwise(wrong.cast(rows.schema["data"].dataType["surahs"].dataType))).alias("s")).select("s.*").select("*", F.explode("ayahs").alias("v"))
    named: Column = F.coalesce("revelationType", F.lit(""))
    for k, v in sections.items():
        named = F.when(F.col("revelationType") == k, v).otherwise(named)
    name = F.coalesce("englishName", F.concat(F.lit("Sura "), F.col("number").cast("string")))
    return suras.select(F.col("number").alias("division_ordinal"), name.alias("division_name"), named.alias("section"), F.col("number").alias("chapter"), F.col("v.numberInSurah").alias("number"), F.trim("v.text").alias("text"))


def chaptered_text(spark: SparkSession, path: str, least_characters: int = 20, named: str = "Chapter") -> DataFrame:
    """Plain text between the lines `*** START` and `*** END`, if it has them, with headings `CHAPTER` and a Roman numeral
    up to XVIII; others are skipped with what follows. Blank lines part stanzas, which are numbered before those of
    `least_characters` or less are dropped."""
    heading = r"\nCHAPTER\s+([IVXL]+)\s*\n"
    body = F.regexp_replace(F.regexp_replace("value", r"(?s)\A.*?\*\*\* START", ""), r"(?s)\*\*\* END.*\z", "")
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace(body, "\r\n", "\n").alias("body"))
    parts = F.arrays_zip(F.regexp_extract_all("body", F.lit(heading), F.lit(1)).alias("numeral"), F.slice(F.split("body", heading), 2, 1_000_000).alias("stanzas"))
    number = F.create_map(*(x for k, n in enumerate(ROMAN, 1) for x in (F.lit(n), F.lit(k))))
    chapters = whole.select(F.explode(parts).alias("x")).select(number[F.col("x")["numeral"]].alias("k"), F.col("x")["stanzas"].alias("stanzas")).filter("k is not null")
    stripped = F.filter(F.transform(F.split("stanzas", r"\n\s*\n"), lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")), lambda x: x != "")
    stanzas = chapters.select("k", F.posexplode(stripped).alias("n", "stanza")).select("k", "n", F.regexp_replace("stanza", r"[^\S\n]*\n[^\S\n]*", " ").alias("text"))
    return stanzas.filter(F.length("text") > least_characters).select(F.col("k").alias("division_ordinal"), F.concat(F.lit(f"{named} "), F.col("k").cast("string")).alias("division_name"), F.lit(None).cast("string").alias("section"), F.col("k").alias("chapter"), (F.col("n") + 1).alias("number"), "text")


def verse_files(spark: SparkSession, path: str, translator: str) -> DataFrame:
    """A file for each verse: chapter, verse, and texts by translator (`et`, or `ht` where that is missing or empty)."""
    rows = _json(spark, path, f"chapter int, verse int, `{translator}` struct<et:string, ht:string>")
    english = F.col(f"`{translator}`.et")
    text = F.when(english != "", english).otherwise(F.col(f"`{translator}`.ht"))
    return rows.select(F.col("chapter").alias("division_ordinal"), F.concat(F.lit("Chapter "), F.col("chapter").cast("string")).alias("division_name"), F.lit(None).cast("string").alias("section"), "chapter", F.col("verse").alias("number"), F.trim(text).alias("text")).filter(F.col("text") != "")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Semantic fields of a JSON file: (field, labels, terms). A label may be one string, which then is the English one."""
    raw = _json(spark, path, "fields map<string, struct<label:string, description:string, terms:map<string, array<string>>>>")
    rows = raw.select(F.explode("fields").alias("field", "x"))
    labels = F.when(F.startswith("x.label", F.lit("{")), F.from_json("x.label", "map<string,string>")).otherwise(F.create_map(F.lit("en"), F.col("x.label")))
    return rows.select("field", labels.alias("labels"), "x.terms")


def as_corpus_rows(verses: DataFrame, work_id: str, tradition: str, language: str, ref: Column | None = None, title: str | None = None) -> DataFrame:
    """Verses of a reader as rows of a corpus. `ref`: how a place is cited; `name chapter:number` by default. `title`: of
    the work, if it has one."""
    place = F.concat("division_name", F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), F.col("number").cast("string"))
    division = F.concat(F.lit(f"{work_id}/"), F.col("division_ordinal").cast("string"))
    return verses.select(
        F.xxhash64(division, "chapter", "number").alias("verse_id"), F.lit(work_id).alias("work_id"), F.lit(tradition).alias("tradition"), F.lit(language).alias("language"), division.alias("division_id"),
        "division_ordinal", "division_name", "section", F.col("chapter").cast("long").alias("chapter"), "number", (place if ref is None else ref).alias("ref"), "text",
        *([] if title is None else [F.lit(title).alias("title")]),
    )
