"""Totals under replaced works, builds of many sources, registry, presets, vectors as bytes, pages of translations."""

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.functions import vectors as V
from lexiloom.operators import encoders, frequency
from lexiloom.plans.corpus import Corpus
from lexiloom.sources import readers, registry
from lexiloom.streaming import build, cache, ingest
from tests.test_corpus import VERSE, corpus


def _verses(spark, rows, first=0):
    """Rows: (work, division ordinal, number, text); identifiers go on from `first`."""
    full = [(first + k, w, w[0], "en", f"{w}/{d}", d, f"{w} book {d}", None if d % 2 else "s", 1, n, f"{w} {d}:{n}", t) for k, (w, d, n, t) in enumerate(rows)]
    return spark.createDataFrame(full, VERSE)


def test_totals_equal_a_rebuild(spark, tmp_path):
    """After each batch totals, divisions, works and dispersion are those of a corpus made of the verses that count."""
    dice, out, first = random.Random(1), str(tmp_path / "kept"), 0
    words = ["mercy", "water", "stone", "river", "king", "and"]
    for batch in range(3):
        rows = [(w, dice.choice([1, 2, 64, 65, 130]), dice.randrange(40), " ".join(dice.choices(words, k=4))) for w in dice.sample(["aa", "bb", "cc"], 2) for _ in range(12)]
        verses = _verses(spark, rows, first)
        first += len(rows)
        ingest.ingest_batch(verses, batch, out, replaces=batch == 1)
        rebuilt = Corpus(ingest.table(spark, out, "verses", verses.schema).drop("batch"))
        kept = ingest.searchable(spark, out, verses.schema)
        for name in ("lemma_totals", "divisions", "works", "lemma_index"):
            want = getattr(rebuilt, name)
            assert sorted(map(repr, getattr(kept, name).select(*want.columns).collect())) == sorted(map(repr, want.collect())), (batch, name)
        for stems in (["water", "stone"], ["nowhere"]):
            want = sorted(frequency.dispersion(rebuilt, stems).collect())
            assert sorted(ingest.dispersion(spark, out, stems).collect()) == want == sorted(frequency.dispersion(kept, stems).collect())


def test_no_batches(spark, tmp_path):
    like = corpus(spark, []).verses.schema
    kept = ingest.searchable(spark, str(tmp_path / "none"), like)
    assert [getattr(kept, x).count() for x in ("verses", "lemma_index", "lemma_totals", "divisions", "works")] == [0] * 5


def _write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def _source(name, language="en"):
    return registry.Source(name, f"tradition {name}", f"Title {name}", "edition", language, readers.flat_json)


def _flat(*texts):
    return [{"division_ordinal": 1 + k % 2, "division_name": f"book {k % 2}", "section": None, "chapter": 1, "number": k, "text": t} for k, t in enumerate(texts)]


def test_build(spark, tmp_path):
    """One broken file of five is reported, four works are there, and a second run loads the fifth alone."""
    out = str(tmp_path / "out")
    texts = {k: _flat("mercy and justice", "water over stones", f"only in {k}") for k in "abcde"}
    pairs = [(_source(k), _write(tmp_path / f"{k}.json", '[{"text": "cut off' if k == "c" else texts[k])) for k in "abcde"]
    said = []
    report = build.build(spark, pairs, out, skip_failed=True, on_progress=lambda *x: said.append(x)).collect()
    assert [(r.work_id, r.status) for r in report] == [("a", "ok"), ("b", "ok"), ("c", "error"), ("d", "ok"), ("e", "ok")]
    assert (report[0].verses, report[0].tokens, report[0].divisions, report[0].error) == (3, 9, 2, None)
    assert report[2].verses is None and "malformed" in report[2].error.lower()
    assert said[4:6] == [("c", "descargando"), ("c", "error")]
    assert {r.work_id: r.title for r in ingest.works(spark, out).collect()} == {k: f"Title {k} (edition)" for k in "abde"}
    _write(tmp_path / "c.json", texts["c"])
    done = len(ingest.committed(spark, out))
    again = build.build(spark, pairs, out, skip_failed=True).collect()
    assert [r.status for r in again] == ["ya-descargado", "ya-descargado", "ok", "ya-descargado", "ya-descargado"]
    assert len(ingest.committed(spark, out)) == done + 1 and ingest.works(spark, out).count() == 5


def test_build_errors(spark, tmp_path):
    """Errors are raised without skip_failed; a text in another script is one, and leaves the work as it was."""
    out, good = str(tmp_path / "out"), _write(tmp_path / "g.json", _flat("good words"))
    wrong, empty = _write(tmp_path / "w.json", _flat("\u0628\u0633\u0645 \u0627\u0644\u0644\u0647")), _write(tmp_path / "e.json", [])
    assert [r.status for r in build.build(spark, [(_source("x"), good)], out).collect()] == ["ok"]
    with pytest.raises(ValueError, match="arabe"):
        build.build(spark, [(_source("x"), wrong)], out, resume=False)
    assert ingest.works(spark, out).first().total_verses == 1
    report = build.build(spark, [(_source("x"), wrong), (_source("y"), empty), (_source("x"), good)], out, skip_failed=True, resume=False).collect()
    assert [(r.status, r.verses) for r in report] == [("error", None), ("ok", 0), ("ok", 1)]
    assert ingest.works(spark, out).count() == 1 and ingest.totals(spark, out).count() == 2


def test_registered_works(spark, tmp_path):
    by = {s.work_id: s for s in registry.SOURCES}
    assert len(by) == 6 and set(registry.DEFAULT_SET) <= set(by) and all(by[k].language == "en" for k in registry.DEFAULT_SET)
    assert len(registry.TANAKH) == 39
    bible = tmp_path / "bible"
    bible.mkdir()
    _write(bible / "books.json", [{"nr": 1, "name": "G\u00e9nesis"}, {"nr": 40, "name": "Mateo"}])
    for nr in (1, 40):
        _write(bible / f"{nr}.json", {"chapters": [{"chapter": 1, "verses": [{"verse": 2, "text": "en el principio"}]}]})
    rows = registry.load(spark, by["rv1909"], str(bible)).orderBy("division_ordinal").collect()
    assert [(r.ref, r.section, r.title) for r in rows] == [("G\u00e9nesis 1:2", "Antiguo Testamento", "Biblia (Reina-Valera 1909)"), ("Mateo 1:2", "Nuevo Testamento", "Biblia (Reina-Valera 1909)")]
    books = tmp_path / "tanakh"
    books.mkdir()
    for name in ("Genesis", "I Samuel"):
        _write(books / f"{name}.json", {"versions": [{"license": "Public Domain", "text": [["<b>In</b> the beginning", ""], ["second"]]}]})
    rows = registry.load(spark, by["tanaj-jps"], str(books)).orderBy("division_ordinal", "chapter").collect()
    assert [(r.division_ordinal, r.ref, r.section, r.text) for r in rows] == [(1, "G\u00e9nesis 1:1", "Tor\u00e1", "In the beginning"), (1, "G\u00e9nesis 2:1", "Tor\u00e1", "second"), (8, "1 Samuel 1:1", "Neviim", "In the beginning"), (8, "1 Samuel 2:1", "Neviim", "second")]
    sura = {"number": 2, "englishName": "Al-Baqara", "revelationType": "Medinan", "ayahs": [{"numberInSurah": 1, "text": "words"}]}
    row = registry.load(spark, by["quran-pickthall"], _write(tmp_path / "q.json", {"data": {"surahs": [sura]}})).first()
    assert (row.section, row.ref) == ("Medin\u00e9s", "Q 2:1")


def test_titles(spark):
    verses = corpus(spark, [("aa", 1, None, 1, "words")]).verses
    assert Corpus(verses).works.first().title == "a (en)" and Corpus(verses.withColumn("title", F.lit("T (e)"))).works.first().title == "T (e)"


def test_presets(spark):
    assert [p.identifier for p in encoders.PRESETS.values()] == ["torch:paraphrase-multilingual-MiniLM-L12-v2", "static:potion-multilingual-128M", "static:potion-multilingual-128M:d256", "static:potion-multilingual-128M:d128:int8"]
    for name, preset in encoders.PRESETS.items():
        assert encoders.named(preset.identifier) == name and encoders.resolve(name) == encoders.resolve(preset.identifier) == preset
    assert encoders.named("static:other") is None and encoders.resolve("some/model") == encoders.Preset("torch", "some/model")
    with pytest.raises(ValueError, match="no known encoder"):
        encoders.resolve("static:other")
    v = spark.createDataFrame([([3.0, 4.0] + [0.5] * 254,)], "v array<double>")
    small, same = v.select(encoders.PRESETS["minimo"].applied(F.col("v")), encoders.PRESETS["calidad"].applied(F.col("v"))).first()
    assert len(small) == 128 and max(map(abs, small)) <= 127 and len(same) == 256


def test_vectors_as_bytes(spark):
    vectors = [[1.5, -2.25, 0.1], [], None, [float(x) for x in np.random.default_rng(7).normal(size=300)]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id int, v array<double>").select("id", V.packed(F.col("v")).alias("b")).orderBy("id")
    got = rows.select("b", V.unpacked(F.col("b")).alias("v")).collect()
    assert [None if r.b is None else bytes(r.b) for r in got] == [None if v is None else struct.pack(f"<{len(v)}f", *v) for v in vectors]
    assert [r.v for r in got] == [None if v is None else np.asarray(v, "<f4").tolist() for v in vectors]
    with pytest.raises(Exception, match="buffer size"):
        rows.limit(1).select(V.unpacked(F.lit(b"abc"))).collect()


def test_pages_of_translations(spark):
    verses = spark.createDataFrame([(1, "en", "one"), (2, "en", "two"), (3, "es", "tres"), (4, "en", "four"), (5, None, "five")], "verse_id long, language string, text string")
    known = spark.createDataFrame([(1, "es", "uno"), (2, "fr", "deux"), (4, "es", "")], "verse_id long, lang string, text string")
    got = {r.verse_id: (r.cached, r.translation, r.wanted) for r in cache.page(verses, known, "es").collect()}
    assert got == {1: (True, "uno", False), 2: (False, None, True), 3: (False, None, False), 4: (True, None, False), 5: (False, None, True)}
    with pytest.raises(ValueError, match="at most 4"):
        cache.page(verses, known, "es", limit=4)


def test_tied_scripts(spark):
    """The script that comes first wins, as in a count of letter by letter."""
    texts = ["ab \u05d0\u05d1", "\u05d0\u05d1 ab", "\u0430b", "b\u0430", "[\u0430] b", "\u05d0\u0430a", "abc \u0430", "\u4e2d", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.detect_script(F.col("t")).alias("d")).orderBy("id").collect()
    assert [r.d.script for r in rows] == ["latino", "hebreo", "cirilico", "latino", "cirilico", "hebreo", "latino", "otro", "ninguno", "ninguno"]
