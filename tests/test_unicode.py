"""NFC and NFD against Python's own, over the whole plane and over marks in any order."""

import random
import unicodedata

from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions.unicode import nfc, nfd


def held(spark, texts):
    rows = spark.createDataFrame([(x,) for x in texts], "t string").repartition(4).select("t", nfc(F.col("t")).alias("c"), nfd(F.col("t")).alias("d")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.c == unicodedata.normalize("NFC", r.t), [hex(ord(x)) for x in r.t]
        assert r.d == unicodedata.normalize("NFD", r.t), [hex(ord(x)) for x in r.t]


def known():
    return [chr(n) for n in (*range(1, 0xD800), *range(0xE000, 0x1F000), *range(0x2F800, 0x2FA1E)) if unicodedata.category(chr(n)) != "Cn"]


def test_every_character(spark):
    """Each character alone between letters, decomposed, and before a mark; many to a text."""
    points = known()
    held(spark, ["".join(f"a{c}b{unicodedata.normalize('NFD', c)}.{c}̣́ " for c in points[i : i + 20]) for i in range(0, len(points), 20)])


def test_sequences_of_marks(spark):
    rng = random.Random(3)
    marks = [c for c in known() if unicodedata.combining(c)]
    second = ["া", "ீ", "ᅡ", "ᆨ", "ᆧ", "ᇂ", "ା", "͏"]
    starters = ["a", "o", "A", "é", "ộ", "ữ", "Å", "가", "각", "ᄀ", "ে", "ெ", "ﭏ", "豈", "אּ", "'", " ", "\n", "", "𝅗𝅥", "क़", "𑂙"]
    texts = []
    for _ in range(3000):
        texts.append("".join(rng.choice(starters) + "".join(rng.choice(rng.choice([marks, marks[:40], second])) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 6))))
    held(spark, texts)


def test_nulls_and_long_texts(spark):
    long = "wörter " * 50_000
    rows = spark.createDataFrame([(1, None), (2, ""), (3, unicodedata.normalize("NFD", long)), (4, "a" * 300_000 + "́")], "k int, t string").select("k", nfc(F.col("t")).alias("c")).collect()
    assert {r.k: r.c for r in rows} == {1: None, 2: "", 3: long, 4: "a" * 299_999 + "á"}


def test_decomposed_words_stay_whole(spark):
    text = unicodedata.normalize("NFD", "L'élève naïf, où ça? 한국어 ἄνθρωπος")
    words = T.words(T.normalize(F.lit(text), F.lit("fr")))
    assert spark.range(1).select(words.alias("w")).first().w == ["l'élève", "naïf", "où", "ça", "한국어", "ἄνθρωπος"]
    assert spark.range(1).select(T.words(T.normalize(F.lit(unicodedata.normalize("NFD", "razón")), F.lit("es"))).alias("w")).first().w == ["razon"]


def test_single_marks(spark):
    """Texts below U+0180 take a short way, others the long one, with the same results; neither way has a mark left out."""
    letters = "".join(map(chr, range(0x20, 0x180)))
    texts = [letters, unicodedata.normalize("NFD", letters), "é̂ é̂", "x́ é", "́e", "é ế", "é ’", "", None, *(c + "a" for c in letters)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("t", nfc(F.col("t")).alias("c"), nfd(F.col("t")).alias("d")).collect()
    for r in rows:
        assert (r.c, r.d) == ((None, None) if r.t is None else (unicodedata.normalize("NFC", r.t), unicodedata.normalize("NFD", r.t)))
    short = spark.range(1).select(nfd(F.lit("é")).alias("d")).union(spark.createDataFrame([("é",)], "d string").select(nfd(F.col("d"))))
    assert [r.d for r in short.collect()] == ["é", "é"]
