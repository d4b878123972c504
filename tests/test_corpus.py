import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import statistics as S
from lexiloom.functions.vectors import l2_normalize
from lexiloom.operators import context, frequency, health, lexicon, search, similarity
from lexiloom.plans.corpus import Corpus, first_of_each, from_documents
from lexiloom.sources import readers
from lexiloom.streaming import ingest

VERSE = "verse_id long, work_id string, tradition string, language string, division_id string, division_ordinal int, division_name string, section string, chapter long, number int, ref string, text string"


def corpus(spark, rows):
    """Rows: (work, division ordinal, section, number, text)."""
    full = [(k, w, w[0], "en", f"{w}/{d}", d, f"{w} book {d}", s, 1, n, f"{w} {d}:{n}", t) for k, (w, d, s, n, t) in enumerate(rows)]
    return Corpus(spark.createDataFrame(full, VERSE))


@pytest.fixture(scope="module")
def small(spark):
    rows = [("aa", 1 + n % 3, ["x", "y", None][n % 3], n, "mercy and justice walk with mercy" if n % 2 else "water flows over stones") for n in range(100)]
    rows += [("bb", 1, None, n, "mercy speaks") for n in range(5)] + [("cc", 1, None, 1, "silence")]
    return corpus(spark, rows).persist()


def value(spark, column, a, b, c, d):
    return spark.createDataFrame([(a, b, c, d)], "a long, b long, c long, d long").select(column.alias("x")).first()["x"]


def test_log_likelihood(spark):
    cols = [F.col(x) for x in "abcd"]
    assert value(spark, S.log_likelihood(*cols), 10, 20, 1000, 2000) == 0
    assert value(spark, S.log_likelihood(*cols), 0, 0, 1000, 2000) == 0
    assert value(spark, S.log_likelihood(*cols), 5, 0, 0, 100) == 0
    assert value(spark, S.log_ratio(*cols), 0, 5, 100, 100) < 0
    assert value(spark, S.log_likelihood(*cols), 30, 0, 1000, 1000) == 41.589


def test_zero_rows_stay_and_sums_agree(spark, small):
    works = {r.work_id: r for r in frequency.frequency_by_work(small, ["mercy"]).collect()}
    assert works["cc"].raw_count == 0 and works["cc"].per_10k == 0
    assert works["aa"].raw_count == 100 and works["aa"].verse_count == 50
    assert works["aa"].per_10k == round(100 * 10000 / works["aa"].total_tokens, 3)
    divisions = frequency.frequency_by_division(small, ["mercy"], "aa").collect()
    assert sum(r.raw_count for r in divisions) == 100 and sum(r.total_tokens for r in divisions) == works["aa"].total_tokens
    sections = frequency.frequency_by_section(small, ["mercy"], "aa").collect()
    assert [r.section for r in sections] == ["x", "y", "Sin sección"] and sum(r.raw_count for r in sections) == 100
    forms = frequency.surface_forms(small, ["mercy", "water"]).collect()
    assert sum(r["count"] for r in forms) == 155 and abs(sum(r.share for r in forms) - 100) <= 1


def test_unknown(spark, small):
    assert frequency.frequency_by_division(small, ["mercy"], "zz").count() == 0
    assert frequency.frequency_by_section(small, ["mercy"], "zz").count() == 0
    assert frequency.keyness_pair(small, ["mercy"], "aa", "zz").count() == 0
    assert frequency.frequency_by_work(small, []).filter("raw_count > 0").count() == 0


def test_concordance_leaves_room(spark, small):
    rows = context.concordance(small, ["mercy"]).collect()
    assert sum(r.work_id == "aa" for r in rows) == 40 and sum(r.work_id == "bb" for r in rows) == 5
    first, second = (context.concordance(small, ["mercy"], limit=10, offset=o).collect() for o in (0, 10))
    assert not {r.verse_id for r in first} & {r.verse_id for r in second}
    assert context.concordance_total(small, ["mercy"]).first().total == 55


def test_collocations(spark, small):
    rows = {r.lemma: r for r in context.collocations(small, ["mercy"], window=5).collect()}
    assert rows["justic"].joint_count == 100 and rows["justic"].example == "justice"  # near both hits of each verse
    assert "mercy" not in rows


def test_search(spark, small):
    found = lambda q: search.search(small, q, limit=None).count()
    assert found("mercy") == 55 and found("mercy NOT speaks") == 50 and found('"mercy and"') == 50 and found("wat*") == 50
    assert found("silence OR speaks") == 6 and found("") == 0 and found('"and mercy"') == 0
    assert [r.text for r in search.search(small, "silence", limit=1).collect()] == ["silence"]


TEXTS = ["a b", "c only", "a c", "b", "the lions and the lamb", "creó el cielo", "Creo en ti", "a-b c", None, "a b c d", "the lamb and lions", "d d d", "cielos"]
REQUESTS = [
    "a b OR c", "a OR b c", "a NOT b OR c", "c NOT a b", "a AND b OR d", "a NOT b NOT c", "d OR a NOT c AND b", "(a OR d) AND c", "a AND (b OR c)", "creo", "creó", "CREÓ OR cielo", '"the lamb"', '"lamb and"', '"the li" *', "ciel*", "cié*", '"a b" OR d', '"a-b"', "the NOT lamb",
]


@pytest.mark.parametrize("query", REQUESTS)
def test_search_is_that_of_fts5(spark, query):
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize = 'unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(TEXTS))
    want = {r[0] for r in db.execute("SELECT rowid FROM t WHERE t MATCH ?", (query,))}
    rows = [(k, "w", "t", "en", "w/1", 1, "b", None, 1, k, str(k), t) for k, t in enumerate(TEXTS)]
    assert {r.verse_id for r in search.search(Corpus(spark.createDataFrame(rows, VERSE)), query, limit=None).collect()} == want


def test_concordance_is_in_reading_order(spark):
    full = [(1, "w2", "b", "en", "w2/1", 1, "one", None, 2, 1, "r1", "mercy"), (2, "w1", "z", "en", "w1/1", 1, "one", None, 1, 1, "r2", "mercy"), (3, "w2", "b", "en", "w2/2", 2, "two", None, 1, 1, "r3", "mercy"), (4, "w3", "b", "en", "w3/1", 1, "uno", None, 2, 2, "r4", "mercy"), (5, "w2", "b", "en", "w2/1", 1, "one", None, 1, 9, "r5", "Mercies")]
    rows = context.concordance(Corpus(spark.createDataFrame(full, VERSE)), ["mercy"]).collect()
    assert [r.verse_id for r in rows] == [5, 1, 4, 3, 2] and (rows[0].work_title, rows[0].division, rows[0].matched_forms) == ("b (en)", "one", "mercies")
    assert [r.verse_id for r in context.concordance(Corpus(spark.createDataFrame(full, VERSE)), ["mercy"], limit=2, offset=1).collect()] == [1, 4]


def test_vectors(spark):
    rows = [(0, [1.0, 0.0, 0.0], "a"), (1, [0.98, 0.2, 0.0], "b"), (2, [0.7, 0.7, 0.0], "c"), (3, [0.0, 0.0, 1.0], "d"), (4, [0.3, 0.9, 0.0], "e")]
    v = spark.createDataFrame(rows, "verse_id long, vector array<double>, tradition string")
    assert [r.verse_id for r in similarity.search(v, [1, 0, 0]).collect()] == [0, 1, 2, 4]  # 0.3 is enough
    assert [r.verse_id for r in similarity.search(v, [1, 0, 0], top_k=1, keep=F.col("tradition") == "e").collect()] == [4]
    assert len(similarity.search(v, [1, 0, 0], top_k=1).collect()) == 1 and len(similarity.search(v, [1, 0, 0], top_k=1, spare=True).collect()) == 2
    assert {r.tradition for r in similarity.cross_tradition(v, 0).collect()} == {"b", "c", "d", "e"}
    assert spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>").select(l2_normalize(F.col("v")).alias("v")).collect()[1].v == [0.6, 0.8]


def test_every_query_is_searched(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PART", 64)
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(300, 8))
    rows[50:200] = rows[0]  # one very common vector
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rows)] + [(300, None), (301, [1.0] * 9), (302, [1.0] * 7 + [None])], "verse_id long, vector array<double>")
    got = similarity.search_all(v, v.filter("verse_id % 20 = 0"), top_k=6, min_similarity=-1e9).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.verse_id)
    want = {}
    for q in range(0, 300, 20):
        scores = [sum(float(x) * float(y) for x, y in zip(rows[q], row, strict=True)) for row in rows]
        want[q] = sorted(range(300), key=lambda k: (-scores[k], k))[:6]
    assert found == want


def test_groups_fold_in_order(spark):
    texts = ["alpha beta gamma delta", "alpha beta gamma epsilon", "other words entirely", ""]
    found = spark.createDataFrame([(k, t, 0.9 - k / 10) for k, t in enumerate(texts)], "verse_id long, text string, similarity double")
    assert {r.verse_id: r.leader for r in similarity.grouped(found).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}  # 3 of 5 is 0.6
    assert [(r.a, r.b) for r in similarity.same_passages(found).collect()] == [(0, 1)]


def test_all_documents_are_compared(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    texts = []
    for n in (1, 2, 3, 5, 8, 40, 90):
        for _ in range(6):
            base = list(rng.choice(vocabulary, n, replace=False))
            texts += [" ".join(base), " ".join(base[::-1])] + [" ".join([*base[: len(base) - d], *rng.choice(vocabulary, d)]) for d in {0, n // 8, n // 5, n // 4, n // 3, n // 2}]
    texts += ["", None, "a b c"]
    sets = [frozenset(w for w in (x or "").split() if len(w) > 3) for x in texts]
    first = [sets.index(s) if s else k for k, s in enumerate(sets)]
    reps = [k for k in range(len(sets)) if first[k] == k and sets[k]]
    want = {(f, k, True) for k, f in enumerate(first)} | {(a, b, False) for a in reps for b in reps if a < b and 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(list(enumerate(texts)), "verse_id long, text string")
    got = [(r.a, r.b, r.same) for r in similarity.all_same_passages(docs).collect()]
    assert len(got) == len(want) and set(got) == want and any(not same for *_, same in want)


def test_compare_rankings(spark):
    a = spark.createDataFrame([("q", k, k) for k in range(1, 5)], "query string, item int, rank int")
    b = a.withColumn("rank", 5 - F.col("rank"))
    r = similarity.compare_rankings(a, b, 4).first()
    assert (r.overlap, r.same_first, r.rho) == (1.0, 0, -1.0)


def test_health(spark):
    c = corpus(spark, [("aa", 1, None, 1, "these are plain words in latin"), ("bb", 1, None, 1, "بسم الله الرحمن الرحيم"), ("cc", 1, None, 1, "god")])
    assert {r.work_id: r.valid for r in health.validate_language(c).collect()} == {"aa": True, "bb": False, "cc": True}
    assert {r.work_id for r in health.corpus_clean(c).collect()} == {"aa", "cc"}
    report = {r.work_id: r for r in health.corpus_health(c, [("en", "god"), ("en", "plain"), ("en", "words")]).collect()}
    assert report["aa"].missing_words == 1 and report["aa"].vocabulary_ok and not report["cc"].vocabulary_ok and not report["cc"].size_ok


def test_first_of_each_and_nulls(spark):
    rows = spark.createDataFrame([("w", "d", 1, 1, 5), ("w", "d", 1, 1, 2), ("w", "d", 1, 2, 9)], "work_id string, division_id string, chapter int, number int, at int")
    assert sorted(r["at"] for r in first_of_each(rows, "at").collect()) == [2, 9]
    docs = spark.createDataFrame([(1, None, "en", "src1"), (2, "Word\n\n another", None, None), (3, "", "en", "odd")], "doc_id long, text string, lang string, source string")
    assert from_documents(docs).lemma_totals.count() == 2
    assert from_documents(docs.limit(0)).works.count() == 0


def test_lexicon(spark, tmp_path):
    data = {"fields": {"mercy": {"label": {"en": "Mercy", "es": "Misericordia"}, "terms": {"en": ["mercy", "mercies"], "es": ["piedad"]}}, "old": {"label": "Old", "terms": {"en": ["aged"]}}}}
    (tmp_path / "l.json").write_text(json.dumps(data))
    lex = readers.lexicon(spark, str(tmp_path / "l.json"))
    assert {r.field: (r.label, r.term_count) for r in lexicon.fields(lex, "es").collect()} == {"mercy": ("Misericordia", 3), "old": ("Old", 1)}
    assert [r.lemma for r in lexicon.field_stems(lex, "mercy", "en").collect()] == ["mercy"]
    assert {r.lemma for r in lexicon.resolve(spark, "en", " Gods ", ["", "gods"], lex, "mercy").collect()} == {"god", "mercy"}


def _write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_flat_readers(spark, tmp_path):
    verse = {"division_ordinal": 1, "division_name": "Book", "section": None, "chapter": 1, "number": 1, "text": "Some words"}
    assert readers.flat_json(spark, _write(tmp_path / "flat.json", {"verses": [verse]})).first().text == "Some words"
    assert [r.number for r in readers.flat_json(spark, _write(tmp_path / "list.json", [verse, verse | {"number": 2}])).collect()] == [1, 2]
    assert readers.sample_works(spark, _write(tmp_path / "works.json", {"works": {"w": [verse, verse]}})).count() == 2
    work = readers.as_corpus_rows(readers.flat_json(spark, str(tmp_path / "flat.json")), "w", "t", "en")
    assert Corpus(work).works.first().total_tokens == 2 and work.first().ref == "Book 1:1"


def test_nested_books(spark, tmp_path):
    books = [{"name": "B", "chapters": [{"num": 3, "verses": [{"num": 4, "text": "one"}, {"verse": 7, "text": " two "}, {"text": ""}, {"verse": 9}]}]}] + [{"book": f"C{k}", "chapters": [{"chapter": 1, "verses": [{"text": "x"}]}]} for k in range(39)]
    for value in (books, {"books": books}):
        rows = readers.nested_books(spark, _write(tmp_path / "books.json", value)).collect()
        assert [(r.division_name, r.chapter, r.number, r.text, r.section) for r in rows[:4]] == [("B", 3, 4, "one", "Old Testament"), ("B", 3, 7, "two", "Old Testament"), ("B", 3, 0, "", "Old Testament"), ("C0", 1, 0, "x", "Old Testament")]
        assert (rows[-1].division_ordinal, rows[-1].section) == (40, "New Testament")


def test_book_files(spark, tmp_path):
    _write(tmp_path / "index.json", {"books": {"1": {"nr": 1, "name": "First"}, "40": {"nr": 40, "name": "Fortieth"}}})
    for nr in (1, 40):
        _write(tmp_path / f"b{nr}.json", {"nr": nr, "chapters": [{"chapter": 2, "verses": [{"verse": 3, "text": " words "}]}]})
    rows = readers.book_files(spark, str(tmp_path / "index.json"), str(tmp_path / "b*.json")).collect()
    assert sorted((r.division_ordinal, r.division_name, r.section, r.chapter, r.number, r.text) for r in rows) == [(1, "First", "Old Testament", 2, 3, "words"), (40, "Fortieth", "New Testament", 2, 3, "words")]
    # an index as a list, numbers by other names and by place, names of the files, and a file's number in its name
    for index in ([{"book_nr": 2, "name": "x"}, {"name": "Second"}, {"nr": 0, "book_nr": 3}], {"books": [{"book_nr": 2, "name": "x"}, {"name": "Second"}, {"book_nr": 3}]}):
        _write(tmp_path / "list.json", index[1:] if isinstance(index, list) else {"books": index["books"][1:]})
        _write(tmp_path / "1.json", {"chapters": [{"chapter": 1, "verses": [{"verse": 1, "text": "one"}, {"verse": 2, "text": " "}]}]})
        _write(tmp_path / "3.json", {"name": "Own", "chapters": [{"verses": [{"verse": 1, "text": "three"}]}]})
        got = readers.book_files(spark, str(tmp_path / "list.json"), str(tmp_path / "[0-9].json"), "A", "B", 2).collect()
        assert sorted((r.division_ordinal, r.division_name, r.section, r.chapter, r.number, r.text) for r in got) == [(1, "Second", "A", 1, 1, "one"), (1, "Second", "A", 1, 2, ""), (3, "Own", "B", 0, 1, "three")]


def test_broken_files(spark, tmp_path):
    """A file that isn't JSON is an error, not an empty work."""
    (tmp_path / "list.json").write_text('[{"text": "cut off')
    (tmp_path / "object.json").write_text('{"books": [{"name": "cut off"')
    for read in (lambda: readers.flat_json(spark, str(tmp_path / "list.json")), lambda: readers.nested_books(spark, str(tmp_path / "object.json")), lambda: readers.verse_files(spark, str(tmp_path / "object.json"), "siva")):
        with pytest.raises(Exception, match="(?i)malformed"):
            read().collect()


def test_only_open_licences_are_read(spark, tmp_path):
    _write(tmp_path / "x.json", {"versions": [{"license": " Public Domain ", "text": [["<b>one</b>", ""], ["two"]]}, {"license": "closed", "text": ["no"]}]})
    _write(tmp_path / "y.json", {"versions": [{"license": "PD", "text": ["flat one", "", "flat three"]}]})
    _write(tmp_path / "z.json", {"versions": [{"license": "closed", "text": ["no"]}, {"license": "pd", "text": ["yes"]}]})
    _write(tmp_path / "e.json", {"versions": []})
    info = [("x", 1, "X", "s"), ("y", 2, "Y", "s"), ("z", 3, "Z", "s"), ("e", 4, "E", "s")]
    rows = readers.licensed_versions(spark, str(tmp_path / "[xy].json"), info).orderBy("division_ordinal", "chapter", "number").collect()
    assert [(r.division_name, r.chapter, r.number, r.text) for r in rows] == [("X", 1, 1, "one"), ("X", 2, 1, "two"), ("Y", 1, 1, "flat one"), ("Y", 1, 3, "flat three")]
    for name in ("[xz]", "[xe]"):
        with pytest.raises(Exception, match="licence"):
            readers.licensed_versions(spark, str(tmp_path / f"{name}.json"), info).collect()


def test_suras(spark, tmp_path):
    sura = lambda n, kind, text: {"number": n, "englishName": f"S{n}", "revelationType": kind, "ayahs": [{"numberInSurah": k, "text": text} for k in (1, 2)]}
    rows = readers.sura_files(spark, _write(tmp_path / "q.json", {"data": {"surahs": [sura(1, "Meccan", " In the name "), sura(2, "Other", "words")]}}), {"Meccan": "Mecano"}).collect()
    assert [(r.division_ordinal, r.division_name, r.section, r.chapter, r.number, r.text) for r in rows] == [(1, "S1", "Mecano", 1, 1, "In the name"), (1, "S1", "Mecano", 1, 2, "In the name"), (2, "S2", "Other", 2, 1, "words"), (2, "S2", "Other", 2, 2, "words")]
    arabic = _write(tmp_path / "a.json", {"data": {"surahs": [sura(1, "Meccan", "بسم الله الرحمن الرحيم")]}})
    assert readers.sura_files(spark, arabic, {}, "ar").count() == 2
    with pytest.raises(Exception, match="not in the script of en"):
        readers.sura_files(spark, arabic, {}).collect()


def test_chaptered_text(spark, tmp_path):
    text = "intro\n*** START OF IT ***\nCHAPTER I\n\nFirst stanza of some length\n   goes on\n\nshort\n\nThird stanza is long enough\n\nCHAPTER IV\n\nAnother chapter with a stanza\n\nCHAPTER XL\n\nThere is no such chapter at all\n*** END OF IT ***\nA footer that is not a stanza\n"
    rows = readers.chaptered_text(spark, _write(tmp_path / "g.txt", text)).collect()
    assert [(r.division_ordinal, r.chapter, r.number, r.text) for r in rows] == [(1, 1, 1, "First stanza of some length goes on"), (1, 1, 3, "Third stanza is long enough"), (4, 4, 1, "Another chapter with a stanza")]


def test_verse_files(spark, tmp_path):
    for k, texts in enumerate(({"et": " one ", "ht": "no"}, {"et": "", "ht": "two"}, {"ht": "three"}, {"et": ""}), 1):
        _write(tmp_path / f"v{k}.json", {"chapter": 2, "verse": k, "siva": texts})
    rows = readers.verse_files(spark, str(tmp_path / "v*.json"), "siva").collect()
    assert sorted((r.chapter, r.number, r.text) for r in rows) == [(2, 1, "one"), (2, 2, "two"), (2, 3, "three")]


def test_a_work_is_replaced(spark, tmp_path):
    out = str(tmp_path / "out")
    ingest.ingest_batch(corpus(spark, [("aa", 1, None, 1, "first words"), ("aa", 1, None, 2, "more words"), ("bb", 1, None, 1, "other text")]).verses, 0, out)
    ingest.ingest_batch(corpus(spark, [("aa", 1, None, 1, "second edition")]).verses, 3, out, replaces=True)
    ingest.ingest_batch(corpus(spark, [("aa", 1, None, 1, "not counted twice")]).verses, 3, out, replaces=True)
    ingest.ingest_batch(corpus(spark, [("aa", 1, None, 1, "late"), ("aa", 1, None, 2, "appended")]).verses, 5, out)
    assert {r.lemma for r in ingest.totals(spark, out).filter("work_id = 'aa'").collect()} == {"second", "edition", "append"}
    assert {r.lemma for r in ingest.totals(spark, out).filter("work_id = 'bb'").collect()} == {"text"}
    assert {r.work_id for r in ingest.loaded_works(spark, out, corpus(spark, []).verses.schema).collect()} == {"aa", "bb"}
    ingest.ingest_batch(corpus(spark, [("bb", 1, None, 1, "lost")]).verses, 6, out, replaces=True)
    (tmp_path / "out" / "commits" / "6").rename(tmp_path / "uncommitted")
    assert {r.lemma for r in ingest.totals(spark, out).filter("work_id = 'bb'").collect()} == {"text"}


def test_stream_ingest_is_idempotent(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("aa", 1, None, 1, "first words here"), ("aa", 1, None, 1, "a later verse in the same place"), ("bb", 1, None, 1, "بسم الله")]
    corpus(spark, rows).verses.coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(VERSE).parquet(source)
    ingest.ingest(stream(), out)
    ingest.ingest(stream(), out)
    again = corpus(spark, [("aa", 1, None, 1, "late again"), ("aa", 1, None, 2, "second words")])
    again.verses.withColumn("verse_id", F.col("verse_id") + 100).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest(stream(), out)
    assert {(r.lemma, r["count"]) for r in ingest.totals(spark, out).collect()} == {("first", 1), ("word", 2), ("second", 1)}


def test_written_corpus_reads_back(spark, small, tmp_path):
    small.write(str(tmp_path / "c"))
    back = Corpus.read(spark, str(tmp_path / "c"))
    assert sorted(back.lemma_totals.collect()) == sorted(small.lemma_totals.collect())


def exchanges_above(plan: str, scan: str) -> list[list[str]]:
    """Of each scan in a plan's text, the exchanges between it and the root."""
    lines, found = plan.splitlines(), []
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    for k, line in enumerate(lines):
        if scan in line and "FileScan" in line:
            above, at = [], depth(line)
            for x in reversed(lines[:k]):
                if depth(x) < at:
                    at = depth(x)
                    above.append(x.strip())
            found.append([x for x in above if "Exchange" in x])
    return found


def test_neighbours_are_found_in_the_buckets_by_verse(spark, tmp_path):
    """The same rows as from the index itself, and of the written words only what joined goes through an exchange."""
    rng = np.random.default_rng(5)
    words = [f"term{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    lines = [(f"w{k % 3}", 1 + k % 4, None, k, " ".join(rng.choice(words, int(rng.integers(1, 60))))) for k in range(400)]
    c = corpus(spark, lines)
    folder = str(tmp_path / "it's")
    c.write(folder, buckets=5)
    back = Corpus.read(spark, folder)
    assert back.places.count() == 400
    stems = [r.lemma for r in c.lemma_totals.select("lemma").distinct().orderBy("lemma").limit(3).collect()]
    for work in (None, "w1"):
        want = context.collocations(c, stems, work, limit=None).collect()
        assert context.collocations(back, stems, work, limit=None).collect() == want and len(want) > 20
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = context.collocations(back, stems)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "Bucketed: true" in plan
    found = exchanges_above(plan, "lexiloom_places")
    assert found and not any("verse_id" in x for above in found for x in above)  # what goes through exchanges is (lemma, count)
    small_again = corpus(spark, lines[:30])
    small_again.write(folder, buckets=3)  # another number of buckets in the same place
    again = Corpus.read(spark, folder)
    assert again.places.count() == 30


def test_too_many_lines_are_an_error(spark):
    """Identifiers of verses leave room for a number of lines; a document beyond it isn't confused with the next."""
    from lexiloom.plans.corpus import LINES, from_documents

    docs = lambda n: spark.createDataFrame([(1, "x\n" * n, "en", "src1"), (2, "y", "en", "src1")], "doc_id long, text string, lang string, source string")
    ids = from_documents(docs(5)).verses.select("verse_id").collect()
    assert len({r[0] for r in ids}) == 6
    with pytest.raises(Exception, match="more than"):
        from_documents(docs(LINES)).verses.agg({"verse_id": "max"}).collect()
