"""Operators 11 to 13 against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import byte_pairs, filter_audit, manifest, queries

from .test_operators import FOLDER, docs_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# 11


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(VOCABULARY)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_joined_parts_are_the_librarys(library, monkeypatch):
    """Texts of awkward characters, cut anywhere, with windows of two tokens."""
    monkeypatch.setattr(byte_pairs, "WINDOW", 2)
    of, rng = byte_pairs.Encoder(byte_pairs.Vocabulary.load(VOCABULARY)), random.Random(7)
    bits = ["a", "b", " ", " ", "\n", "'", "s", "'s", "'ll", "l", "1", "22", "!", "é", "漢", "𝒳", "<|endoftext|>", "<|end", "oftext|>", "́", "\xa0", "x" * 70, "!" * 80, " " * 70, "ab" * 60, "the ", "1" * 90, "'" * 75, "é" * 50, "漢" * 40]
    for _ in range(500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 60)))
        size = rng.choice([1, 3, 17, 100, 150, 333])
        parts = [of.part(text[i : i + size]) for i in range(0, len(text), size)]
        while len(parts) > 1:
            parts = [of.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        assert (parts[0] & ~byte_pairs.STARTS).tolist() == ids_of(library, text), (size, text)


def test_both_libraries_know_the_same_characters(library):
    """Short texts are encoded by the faster library; letters, digits and white space must be the same to both."""
    of = byte_pairs.Encoder(byte_pairs.Vocabulary.load(VOCABULARY))
    points = [c for c in (*range(1, 0x3400), *range(0xA000, 0xAC00), *range(0xD700, 0xD800), *range(0xF000, 0x20000, 3)) if not 0xD800 <= c <= 0xDFFF]
    for i in range(0, len(points), 500):
        text = "".join(f"a{chr(c)}a1{chr(c)}1!{chr(c)}! {chr(c)} " for c in points[i : i + 500])
        assert of.ids(text).tolist() == ids_of(library, text), hex(points[i])


@pytest.mark.parametrize("part", [50, 32_768])
def test_byte_pairs_odd(spark, odd, library, part):
    """Nulls, long words, repeated rows and clashing names; some parts are cut inside words."""
    docs = odd.withColumn("at", F.lit("x")).withColumn("copies", F.lit("x"))
    vocabulary = byte_pairs.Vocabulary.load(VOCABULARY)
    found = byte_pairs.encode(docs, vocabulary, part=part)
    assert sorted(found.columns) == sorted([c for c in docs.columns if c != "text"])
    rows = found.withColumn("back", byte_pairs.decoded(F.col("ids"), vocabulary)).collect()
    texts = {r.n: r.text for r in docs.collect()}
    assert sorted(r.n for r in rows) == sorted(texts)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == ids_of(library, texts[r.n]) and r.back == (texts[r.n] or "")
    assert byte_pairs.encode(docs.limit(0), vocabulary).count() == 0


def test_byte_pairs_query(spark, library):
    want = {}
    for r in docs_of(spark).collect():
        ids = ids_of(library, r.text)
        want[r.doc_id] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r[0]: tuple(r[1:]) for r in queries.op11_byte_pairs(spark, FOLDER).collect()} == want


# 12


def brute_audit(docs, labels):
    good, toxic = ({r.doc_id for r in labels if r[k] == 1 and r.doc_id is not None} for k in ("quality", "toxic"))
    rows = []
    for r in docs:
        text = r.text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
        copy = r.doc_id is not None and any(o.doc_id is not None and o.doc_id < r.doc_id and (o.text or "") == text for o in docs)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": copy,
        }
        rows.append((r.source or "", {k for k, v in fails.items() if v}, r.doc_id in good, r.doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, removed = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                here = [r for r in left if x in r[1]]
                gone = sum(x in r[1] for r in own) - len(here)
                left = [r for r in left if x not in r[1]]
                removed[x] += len(here)
                out[part, "".join(order), k + 1] = [len(left), len(here), gone, sum(r[1] == {x} for r in own), sum(r[2] for r in here), sum(r[3] for r in here), x]
        for (p, *_), v in out.items():
            if p == part:
                v[6] = removed[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (6, 1, None), (7, None, 1), (None, 1, 1), (99, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    docs = odd.withColumn("mask", F.lit("mine")).withColumn("part", F.lit("x")).withColumn("quality", F.lit(1))
    got = filter_audit.audit(filter_audit.cells(docs, labels)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == brute_audit(docs.collect(), labels.collect()) and len(got) == 600 * 4
    assert filter_audit.audit(filter_audit.cells(docs.limit(0), labels.limit(0))).count() == 0


def test_copies_of_one_text(spark):
    """A text shared by a third of all rows, in parts and with labels: only the first isn't a copy."""
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).alias("toxic"))
    sums = {(r.part, r["mask"] // 16): (r.n, r.good, r.toxic) for r in filter_audit.cells(docs, labels).collect()}
    assert sums == {("0", 0): (301, 301, 0), ("0", 1): (149, 149, 0), ("1", 0): (300, 300, 300), ("1", 1): (150, 150, 150)}


# 13


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute_manifest(docs):
    rows = [(r.lang, r.doc_id, sha("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, r.text)))), r) for r in docs]
    langs = sorted({r[0] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for g in langs}
    levels = {g: brute_levels([r[2] for r in own]) for g, own in trees.items()}
    top = brute_levels([levels[g][-1][0] for g in langs])
    out = []
    for at, g in enumerate(langs):
        for k, (_, doc_id, leaf, r) in enumerate(trees[g]):
            changed = zlib.crc32(str(doc_id).encode()) % 3 == 0 if doc_id is not None else False
            low = None if r.text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
            x, proof = sha("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, low)))) if changed else leaf, ""
            for own, every in ((k, levels[g]), (at, top)):
                for level in every[:-1]:
                    run = level[own - own % 8 : own - own % 8 + 8]
                    proof += "".join(run[: own % 8] + run[own % 8 + 1 :])
                    x = sha("".join([*run[: own % 8], x, *run[own % 8 + 1 :]]))
                    own //= 8
            out.append((doc_id, leaf, levels[g][-1][0], top[-1][0], sha(proof), x, x == top[-1][0]))
    return out


@pytest.mark.parametrize("levels", [4, 1])
def test_manifest_odd(spark, odd, levels, monkeypatch, tmp_path):
    """All kinds of nulls, repeated rows and a single row of a language; with blocks of 8 there are more rounds."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    docs = docs_of(spark).select("doc_id", "source", "lang", "n_chars", "text").unionByName(odd.select("doc_id", "source", "lang", F.when(F.col("n") > 2, F.col("n")).alias("n_chars"), "text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_manifest(docs.collect())))
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_nothing_and_of_clashing_names(spark, odd):
    docs = odd.select("*", *(F.lit("mine").alias(c) for c in ("tree", "at", "block", "root", "order", "path")))
    found = manifest.with_proofs(docs, F.col("lang"), "doc_id", manifest.leaf_of(F.col("doc_id")))
    rows = found.collect()
    assert sorted(r.n for r in rows) == sorted(r.n for r in odd.collect()) and {(r["a.b"], r.tree, r.digest) for r in rows} == {("a.b", "mine", "digest")}
    assert all(manifest.fold(r.leaf, r.proof) == r.root for r in rows)
    assert manifest.with_proofs(docs.limit(0), F.col("lang"), "doc_id", manifest.leaf_of(F.col("doc_id"))).count() == 0


def test_postorder():
    """Closed places against a walk, for all small trees."""
    for leaves in range(1, 200):
        top, want = manifest.height(leaves, 3), {}

        def walk(level, k, leaves=leaves, want=want):
            if level:
                for child in range(3 * k, min(3 * k + 3, -(-leaves // 3 ** (level - 1)))):
                    walk(level - 1, child)
            want[level, k] = len(want)

        walk(top, 0)
        for level in range(top + 1):
            n = -(-leaves // 3**level)
            assert manifest.postorder(level, np.arange(n), leaves, top, 3).tolist() == [want[level, k] for k in range(n)]


@pytest.mark.parametrize("levels", [4, 1])
def test_log(spark, levels, monkeypatch):
    """Rounds append into one postorder log: every place once, each parent after its children and of their digests."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rows = spark.range(75).select(F.lit("t").alias("tree"), F.col("id").alias("at"), F.lit(75).cast("long").alias("size"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    got = sorted(manifest.build(rows).nodes().collect(), key=lambda r: r.position)
    want = brute_levels([sha(str(k)) for k in range(75)])
    assert [r.position for r in got] == list(range(75 + 10 + 2 + 1))
    for level, digests in enumerate(want):
        assert [r.digest for r in got if r.level == level] == digests


# 10


def test_urls_of_clashing_names(spark):
    """Nulls, repeated rows, very long URLs, and columns named as results and intermediate ones."""
    urls = [None, "", "no scheme", "http://a.net/x", "http://a.net/x", "https://EXAMPLE.com/de/" + "y" * 100_000, "http://example.net/en/?q", "ftp://h.org/fr/1"] * 2
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    rows = rows.select("*", *(F.lit("mine").alias(c) for c in ("host", "rule", "p", "g", "h", "size", "a.b", "suffix", "key", "n")))
    got = {r.page_id: r for r in queries.url_filter.judge(rows, queries.URL_RULES).collect()}
    assert set(got) == set(range(16)) and {r["a.b"] for r in got.values()} == {"mine"}
    assert [got[k].rule for k in range(8)] == [None, None, None, "net/", "net/", "example.com/de/", "example.net/en/", "org/fr/"]
    assert [got[k].verdict for k in range(3, 8)] == ["block", "block", "block", "allow", "allow"]
