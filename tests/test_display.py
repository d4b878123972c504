import json

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import display, similarity
from lexiloom.sources import readers, registry
from lexiloom.streaming import cache


def test_clean_word(spark):
    rows = spark.createDataFrame([("¿Rewh?",), (" .Ñu;",), ("...",), ("a.b",), (None,)], "w string").select(display.clean_word(F.col("w")))
    assert [r[0] for r in rows.collect()] == ["rewh", "ñu", "", "a.b", None]


def test_highlighted(spark):
    cases = [
        ("Mercy, mercy merciful", ["mercy"], "<mark>Mercy</mark>, <mark>mercy</mark> merciful"),
        ("unmerciful merc-a", ["merc", "a"], "unmerciful <mark>merc</mark>-a"),
        ("a.b axb", ["a.b"], "<mark>a.b</mark> axb"),
        ("ther ther", ["ther", None, " "], "<mark>ther</mark> <mark>ther</mark>"),
        ("cost $1 \\", ["cost"], "<mark>cost</mark> $1 \\"),
        ("er", ["er"], "er"), ("", ["mercy"], ""), ("mercy", [], "mercy"), ("mercy", None, "mercy"), (None, ["mercy"], None),
    ]
    rows = spark.createDataFrame([c[:2] for c in cases], "t string, f array<string>").select(display.highlighted(F.col("t"), F.col("f")))
    assert [r[0] for r in rows.collect()] == [c[2] for c in cases]


def test_write_json(spark, tmp_path):
    display.write_json(spark.createDataFrame([(1, None), (2, "ñ")], "a int, b string").coalesce(1), str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda x: x["a"]) == [{"a": 1, "b": None}, {"a": 2, "b": "ñ"}]


def test_cache(spark, tmp_path):
    folder, schema, keys = str(tmp_path / "words"), "word string, lang string, text string, provider string", ["word", "lang"]
    assert cache.table(spark, folder, schema, keys).count() == 0
    put = lambda rows, n: cache.put(spark.createDataFrame(rows, schema), folder, n)
    put([("sea", "es", "mar", "x"), ("sky", "es", "", "x"), ("sea", "fr", "mer", "x"), ("sun", "es", "so", "x"), ("sun", "es", "sol", "x")], 0)
    put([("sea", "es", "MAR", "y"), (None, "es", "nada", "y")], 1)
    put([("sea", "es", "la mar", "z"), (None, "es", "nada", "y")], 1)  # done again
    (tmp_path / "words" / "batch=2").mkdir()  # stopped half-way
    got = cache.table(spark, folder, schema, keys)
    assert {(r.word, r.lang): (r.text, r.provider) for r in got.collect()} == {("sea", "es"): ("la mar", "z"), ("sky", "es"): ("", "x"), ("sea", "fr"): ("mer", "x"), ("sun", "es"): ("sol", "x"), (None, "es"): ("nada", "y")}
    asked = spark.createDataFrame([("sea",), ("sky",), ("moon",), (None,)], "word string")
    found = cache.look_up(asked, got.filter("lang = 'es'"), ["word"]).collect()
    assert {r.word: (r.cached, r.translation) for r in found} == {"sea": (True, "la mar"), "sky": (True, None), "moon": (False, None), None: (False, None)}


def test_preferred_model(spark):
    rows = spark.createDataFrame([("static:a",)] * 3 + [("static:b",)] * 4 + [("torch:c",)] + [("other",)] * 9, "model string")
    best = lambda df: [tuple(r) for r in similarity.preferred_model(df).collect()]
    assert best(rows) == [("torch:c", 1)]
    assert best(rows.filter("model not like 'torch%'")) == [("static:b", 4)]
    assert best(rows.filter("model = 'other'")) == [("other", 9)]
    assert best(rows.limit(0)) == []


def test_comparison_means(spark):
    rows = spark.createDataFrame([("a", 0.5, 1, 1.0), ("b", 1.0, 0, None), ("c", 0.0, 0, float("nan"))], "query string, overlap double, same_first int, rho double")
    assert tuple(similarity.comparison_means(rows).first()) == (3, 0.5, 0.333333, 1.0)


def test_registry(spark, tmp_path):
    path = tmp_path / "v.json"
    path.write_text(json.dumps([{"division_ordinal": 2, "division_name": "Two", "section": None, "chapter": 2, "number": 7, "text": "words"}]))
    source = next(s for s in registry.SOURCES if s.cited == "BG" and s.read is readers.flat_json)
    row = registry.load(spark, source, str(path)).first()
    assert (row.work_id, row.ref, row.text) == (source.work_id, "BG 2:7", "words")
    assert registry.catalogue(spark, registry.SOURCES).count() == len(registry.SOURCES)
    closed = registry.Source("x", "x", "x", "x", "en", readers.flat_json, license="all rights reserved")
    with pytest.raises(ValueError, match="accepted"):
        registry.load(spark, closed, str(path))
