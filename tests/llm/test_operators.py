import collections
import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import components, exact_dedup, language, mixing, near_dedup, pieces, quality, queries, sharding, token_counts, toxicity, url_filter
from lexiloom.llm.scratch import materialize, new_folder

FOLDER = "/root/testdata/sf0.001"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def docs_of(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", ["op3_quality", "op6_exact_dedup", "op12_filter_audit", "op13_manifest"])
def test_against_sql(spark, con, name):
    want = con.sql(queries.SQL[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, FOLDER).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.select(*columns).fetchall()))


# 1


def test_shards(spark):
    placed = sharding.assign_shards(docs_of(spark), 6).select("doc_id", "shard", "slot", sharding.bytes_of("text").alias("size")).toPandas()
    assert sorted(placed.doc_id) == sorted(r.doc_id for r in docs_of(spark).collect())
    for _, s in placed.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    sizes = placed.groupby("shard")["size"].sum()
    assert len(sizes) == 6 and (sizes - sizes.mean()).abs().max() <= placed["size"].max() + sizes.mean() / 64


def test_a_hot_group_is_cut(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    sizes = [r["sum(size)"] for r in sharding.assign_shards(rows, 24).select("shard", sharding.bytes_of("text").alias("size")).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 24 and max(sizes) < 1.03 * min(sizes)


def test_shards_odd(spark, odd):
    """Null texts, repeated rows and a clashing column: nothing is lost, and slots are gapless."""
    placed = sharding.assign_shards(odd.withColumn("slot", F.lit("mine")), 3)
    rows = placed.collect()
    assert dict(placed.dtypes)["shard"] == "int" and sorted(r.n for r in rows) == sorted(r.n for r in odd.collect())
    for k in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == k)
        assert own == list(range(len(own)))
    assert sharding.assign_shards(odd.limit(0), 3).count() == 0


def test_shards_query_against_brute_force(spark):
    """Of all documents in order of their keys, a shard is a run, and no shard is off its share by more than a text and
    the tolerance; size and crc are those of Python."""
    import zlib

    rows = queries.op1_sharding(spark, FOLDER).collect()
    texts = {r.doc_id: r.text or "" for r in docs_of(spark).collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {k: (len(t.encode()) + 8, zlib.crc32(t.encode())) for k, t in texts.items()}
    keys = {r.doc_id: r.key % 2**64 for r in docs_of(spark).select("doc_id", sharding.key_of("doc_id", "text").alias("key")).collect()}
    order = [r for r in sorted(rows, key=lambda r: keys[r.doc_id])]
    assert [r.shard for r in order] == sorted(r.shard for r in order)
    assert all(a.shard < b.shard or a.slot + 1 == b.slot for a, b in zip(order, order[1:], strict=False))
    share = sum(r.size for r in rows) / 24
    for k in range(24):
        assert abs(sum(r.size for r in rows if r.shard == k) - share) <= max(r.size for r in rows) + share / 64


def test_buckets_have_a_byte_bound(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("key"), F.lit(100).cast("long").alias("size"))
    buckets = sharding.histogram(keys, 1.0, 5000)
    assert max(b.size for b in buckets) <= 5000 and sum(b.rows for b in buckets) == 4000


# 2


def test_toxicity_learns(spark):
    rows = [(k, f"plain words here number {k} " + ("you foo fool" if k % 4 == 0 else "you are fine"), int(k % 4 == 0)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    weights = toxicity.learn(docs, docs.filter("doc_id < 300").select("doc_id", F.col("y").alias("label")))
    found = toxicity.with_scores(docs.filter("doc_id >= 300"), weights).collect()
    assert all((r.score >= 0.7) == bool(r.y) for r in found) and len(weights) < 60


def test_ftrl_is_sparse_and_follows_its_formula():
    rows = [np.array([1, 2]), np.array([2, 3])] * 50
    w, bias = toxicity.train(rows, np.array([1.0, 0.0] * 50), toxicity.Ftrl(l1=1.0))
    assert set(np.flatnonzero(w)) <= {1, 2, 3} and w[1] > 0 > w[3]
    assert not toxicity.train(rows, np.array([1.0, 0.0] * 50), toxicity.Ftrl(l1=1e9))[0].any()


def test_toxicity_against_a_plain_loop(spark):
    """One shard, so the weights are those of a coordinate-by-coordinate FTRL in the same order; held-out texts aren't
    learnt from, nor are identifiers."""
    docs, labels = docs_of(spark), spark.read.parquet(f"{FOLDER}/labels.parquet")
    own = labels.filter(~toxicity.held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    f = toxicity.Ftrl()
    chosen = own.withColumn("h", F.xxhash64(F.lit("ftrl"), "doc_id")).join(docs, "doc_id").orderBy("h", "doc_id").collect()
    bias = 1 << toxicity.DIM_BITS
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == bias else f.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((f.beta + math.sqrt(n[i])) / f.alpha)

    hashes = toxicity.WordHashes()
    rows = [([*{int(i) for i in toxicity.features(r.text, hashes)}, bias], r.label) for r in chosen]
    for _ in range(f.passes):
        for at, y in rows:
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
            for i in at:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / f.alpha * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in z if i != bias and weight(i)}
    found = toxicity.learn(docs, own)
    assert set(found) - {-1} == set(want) and all(abs(found[i] - w) < 1e-6 for i, w in want.items())
    scores = {r.doc_id: r for r in queries.op2_toxicity(spark, FOLDER).collect()}
    for r in docs.collect():
        margin = weight(bias) + sum(want.get(i, 0.0) for i in {int(i) for i in toxicity.features(r.text, hashes)})
        assert abs(scores[r.doc_id].score - 1 / (1 + math.exp(-margin))) < 1e-6 and scores[r.doc_id].predicted == int(scores[r.doc_id].score >= 0.7)


def test_toxicity_of_repeated_and_clashing_rows(spark):
    """The highest label and the first text of an identifier count; a column `score` is replaced; long texts are scored."""
    docs = spark.createDataFrame([(1, "a foul word", "x"), (1, "zz", "x"), (2, "b", "x"), (3, "foul " * 100_000, "x"), (None, None, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (9, 1)], "doc_id long, label int")
    f = toxicity.Ftrl(l1=0.0)
    assert toxicity.learn(docs, labels, ftrl=f) == toxicity.learn(docs.filter("text <> 'zz'"), labels.filter("label = 1 or doc_id = 2"), ftrl=f)
    found = toxicity.with_scores(docs, toxicity.learn(docs, labels, ftrl=f))
    assert found.columns == ["doc_id", "text", "score"] and all(0 <= r.score <= 1 for r in found.collect())


def test_toxicity_odd(spark, odd):
    none = odd.select("doc_id", F.lit(None).cast("int").alias("label"))
    assert {r.score for r in toxicity.with_scores(odd, toxicity.learn(odd, none)).collect()} == {0.5}
    assert toxicity.with_scores(odd.limit(0), {}).count() == 0


# 3


def brute_signals(text):
    words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in text).split(" ") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(grams)
    covered = {p for i, g in enumerate(grams) if n[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), len(lines)


@pytest.mark.parametrize("text", ["", "a b c a b c a b c", "x y\nx y\n\n x y # | \x1c z", "a a a a a", "one", "é " * 40 + "\r\n\t" + "b c d " * 3])
def test_signals(text):
    assert quality.signals_of(text) == brute_signals(text)


def test_sketches_merge(spark):
    signals = materialize(quality.with_signals(docs_of(spark)).drop("text"), "t")
    parts = [quality.sketches(signals.filter(f"doc_id % 2 = {k}"), ["lang"]) for k in (0, 1)]
    whole = {tuple(r) for r in quality.sketches(signals, ["lang"]).collect()}
    assert {tuple(r) for r in quality.merged(parts[0].union(parts[1]), ["lang"]).collect()} == whole


@pytest.mark.parametrize("others", [0, 4])
def test_a_dirty_source_does_not_open_its_fence(spark, others):
    """Shares of symbols as sf0.1's junk has them; a third of all rows and more are of the dirty source."""
    for junk in (24, 26, 30, 49, *((60, 74) if others else ())):
        shares = [72 + k % 300 if k % 100 < junk else 0 for k in range(300)]
        rows = [("dirty", x, 900 if x else 0, 900 if x else 0) for x in shares] + [(f"s{k % others}", 0, 0, 0) for k in range(100 * others)]
        signals = spark.createDataFrame([("en", s, x, d, r, 50) for s, x, d, r in rows], "lang string, source string, symbol_share long, dup_line_share long, repeat_share long, word_length long")
        limits = {r.source: r for r in quality.thresholds(quality.sketches(signals, ["lang", "source"])).collect()}
        assert (limits["dirty"].hi_symbol_share, limits["dirty"].hi_dup_line_share, limits["dirty"].hi_repeat_share) == (5, 2, 7), junk
    even = spark.createDataFrame([("en", "a", 40 + k % 20, k % 9, k % 9, 50) for k in range(300)], signals.schema)
    assert quality.thresholds(quality.sketches(even, ["lang", "source"])).first().hi_symbol_share >= 59  # a source of its own kind loses nothing


def brute_limits(values, level, reach, usual):
    """(total, lo, hi) of one group's values of one metric; `usual` is None for the rule of two sides."""
    bins = sorted(v if v < 128 else v >> (v.bit_length() - 7) << (v.bit_length() - 7) for v in values)
    at = lambda p: bins[-(-len(bins) * p // 100) - 1]
    if usual is None:
        iqr = max(1, at(75) - at(25))
        return len(bins), max(0, at(25) - reach * iqr), at(75) + reach * iqr
    return len(bins), 0, at(25) + (1 + reach) * max(1, min(at(level) - at(25), usual))


def test_thresholds_against_brute_force(spark):
    """Groups of 60 documents and more, of small numbers, with ties, a null language and a null source."""
    random = np.random.default_rng(5)
    rows = []
    for lang, source, n, scale in (("en", "a", 300, 40), ("en", "b", 80, 10), ("en", None, 60, 90), ("de", "a", 7, 300), (None, "c", 100, 20)):
        rows += [(lang, source, *(int(x) for x in random.integers(0, scale, 3)), int(40 + random.integers(0, 30))) for _ in range(n)]
    rows += [("en", "a", 5000, 990, 990, 7000)]  # far beyond 1000
    names = [r.metric for r in quality.RULES]
    signals = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{k} long" for k in names))
    found = {(r.lang, r.source): r for r in quality.thresholds(quality.sketches(signals, ["lang", "source"])).collect()}
    groups, differ = {(r[0], r[1]) for r in rows}, set()
    for k, rule in enumerate(quality.RULES, 2):
        of = lambda keep, k=k: [r[k] for r in rows if keep(r)]
        at = lambda v, p: sorted(x if x < 128 else x >> (x.bit_length() - 7) << (x.bit_length() - 7) for x in v)[-(-len(v) * p // 100) - 1]
        spreads = sorted(at(v, rule.level) - at(v, 25) for v in (of(lambda r, g=g: r[:2] == g) for g in groups) if len(v) >= 50)
        usual = None if rule.two_sided else 2 * spreads[-(-len(spreads) // 2) - 1]
        limits = lambda v, rule=rule, usual=usual: brute_limits(v, rule.level, rule.reach, usual)
        _, lo_all, hi_all = limits(of(lambda r: True))
        for g in groups:
            n, lo, hi = limits(of(lambda r, g=g: r[:2] == g))
            m, lo_lang, hi_lang = limits(of(lambda r, g=g: r[0] == g[0]))
            mix = lambda x, y, z, n=n, m=m: (n * x + quality.PRIOR * ((m * y + quality.PRIOR * z) // (m + quality.PRIOR))) // (n + quality.PRIOR)
            assert (found[g][f"lo_{rule.metric}"], found[g][f"hi_{rule.metric}"]) == (mix(lo, lo_lang, lo_all), mix(hi, hi_lang, hi_all)), (g, rule)
            differ.add((rule.metric, found[g][f"hi_{rule.metric}"]))
    assert len(differ) > 12


def test_each_rule_rejects_and_clean_documents_stay(spark):
    folder = "/root/testdata/sf0.1"  # smaller tables have no document far in the tail of repeated words
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source")
    signals = materialize(quality.with_signals(docs).drop("text"), "t")
    limits = quality.thresholds(quality.sketches(signals.filter("not base_failed"), ["lang", "source"]))
    judged = signals.filter("not base_failed").join(limits, ["lang", "source"])
    gone = judged.agg(*(F.sum(F.expr(f"int({r.metric} > hi_{r.metric} or {r.metric} < lo_{r.metric})")).alias(r.metric) for r in quality.RULES)).first()
    assert all(gone), gone
    kept = quality.judge_signals(signals).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("quality = 1 and not base_failed").select("kept").collect()
    assert sum(r.kept for r in kept) >= 0.98 * len(kept)


def test_quality_odd(spark, odd):
    """Documents under 50 words, and those that repeat themselves, go; near, longer texts stay, whatever else is null."""
    good = quality.keep_good(odd)
    assert good.columns == odd.columns and sorted(r.doc_id for r in good.collect()) == [6, 7, 8]
    judged = quality.judge_signals(quality.with_signals(odd.withColumn("n_words", F.lit("mine"))))
    assert dict(judged.dtypes)["n_words"] == "bigint" and dict(judged.dtypes)["kept"] == "boolean" and judged.count() == odd.count()
    assert quality.keep_good(odd.limit(0)).count() == 0


# 4


def test_language(spark):
    docs = docs_of(spark)
    found = language.with_languages(docs, language.learn(docs.filter("doc_id % 3 <> 1"))).filter("doc_id % 3 = 1").select("lang", "languages.*").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)


def test_a_mixture_is_found(spark):
    docs = docs_of(spark)
    model = language.learn(docs)
    texts = {r.lang: r.text[:4000] for r in docs.filter("length(text) > 4000").collect()}
    langs = sorted(texts)[:2]
    mixed = spark.createDataFrame([("\n".join(texts[k] for k in langs),)], "text string")
    shares = language.with_languages(mixed, model).first().languages.shares
    assert set(langs) <= set(shares) and all(abs(shares[k] - 0.5) < 0.2 for k in langs)


def test_language_against_plain_mixtures(spark):
    """The registered query against expectation maximisation written out for each trigram, and counts made here."""
    letters = language.letter_table()
    docs = docs_of(spark).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()
    counts = {k: collections.Counter() for k in sorted({r.lang for r in docs if r.lang})}
    for r in docs:
        if r.lang and r.text and not r.out:
            counts[r.lang].update(language.trigrams(r.text, letters).tolist())
    sizes = {k: sum(c.values()) + language._SMOOTH * 2**language.DIM_BITS for k, c in counts.items()}
    p = lambda k, g: (counts[k][g] + language._SMOOTH) / sizes[k]
    found = {r.doc_id: r for r in queries.op4_language(spark, FOLDER).collect()}
    assert len({round(r.score, 6) for r in found.values()}) > 20
    for r in docs[:60]:
        grams = collections.Counter(language.trigrams(r.text, letters).tolist())
        total, mix = sum(grams.values()), {k: 1 / len(counts) for k in counts}
        for _ in range(language.STEPS):
            new = dict.fromkeys(counts, 0.0)
            for g, n in grams.items():
                whole = sum(mix[k] * p(k, g) for k in counts)
                for k in counts:
                    new[k] += n * mix[k] * p(k, g) / whole / total
            mix = new
        single = {k: sum(n * math.log(p(k, g)) for g, n in grams.items()) for k in counts}
        best = max(single, key=single.get)
        if found[r.doc_id].lang_pred == best:
            assert abs(found[r.doc_id].score - mix[best] / sum(mix.values())) < 1e-3
        else:
            assert len(json.loads(found[r.doc_id].shares)) > 1


def test_a_small_share_is_found(spark):
    """One part in a hundred of another language, which gains far more than its penalty."""
    docs = docs_of(spark)
    model, texts = language.learn(docs), {r.lang: r.text for r in docs.filter("length(text) > 3000").collect()}
    langs = sorted(texts)[:2]
    text = (texts[langs[0]] + "\n") * 40 + texts[langs[1]][:1500]
    shares = language.with_languages(spark.createDataFrame([(text,)], "text string"), model).first().languages.shares
    assert set(langs) <= set(shares) and 0 < shares[langs[1]] < 0.05


def test_language_odd(spark, odd):
    rows = {r.doc_id: r.languages for r in language.with_languages(odd, language.learn(odd)).collect()}
    assert rows[3].lang_pred == rows[4].lang_pred == rows[5].lang_pred == "und" and rows[9].lang_pred in ("en", "de", "fr", "es")
    assert language.with_languages(odd, language.learn(odd.limit(0))).first().languages.lang_pred == "und"


# 5


def test_mixture_meets_its_limits(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "big").when(F.col("id") < 2700, "mid").otherwise("small").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"))
    mixed = mixing.mix(docs, entropy=1.0, repeats=2.0, block_tokens=5000).select("doc_id", "source", "copy", "block", "weight", mixing.tokens_of("text").alias("n")).toPandas()
    assert set(mixed.doc_id) == set(range(3000)) and mixed["copy"].max() == 1
    own = docs.groupBy("source").agg(F.sum(mixing.tokens_of("text")).alias("n")).toPandas().set_index("source")["n"]
    got = mixed.groupby("source")["n"].sum()
    assert (got / own).max() <= 2.02 and abs((got / own)["big"] - 1) < 1e-9 and (got / own)["small"] > 1.95
    share = mixed.drop_duplicates("source").set_index("source")["weight"]
    assert np.allclose(got / got.sum(), share, atol=0.01)
    blocks = mixed[mixed.block < mixed.block.max()].groupby(["block", "source"])["n"].sum().unstack()
    assert ((blocks.div(blocks.sum(axis=1), axis=0) - share).abs() < 0.08).all().all()


def test_entropy_is_bisected(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "s string, tokens long")
    a = mixing.exponent(sources, entropy=0.7, repeats=1e9)
    w = np.array([1000, 100, 10]) ** a
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() / math.log(3) - 0.7) < 1e-4


def test_tokens(spark):
    texts = ["", None, " a", "a ", "a  b", "a\nb\tc", "a b", "one two three"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.tokens_of("text").alias("n")).collect()
    assert [r.n for r in rows] == [len((t or "").encode().split()) for t in texts]


def test_mixture_against_brute_force(spark):
    """The registered query: weights, copies and blocks of each document, recomputed in Python from the sources' tokens."""
    rows = queries.op5_mixing(spark, FOLDER).collect()
    n = {r.doc_id: len((r.text or "").encode().split()) for r in docs_of(spark).collect()}
    source = {r.doc_id: r.source for r in docs_of(spark).collect()}
    tokens = collections.Counter()
    for k, s in source.items():
        tokens[s] += n[k]
    assert {r.doc_id for r in rows} == set(n) and all(r.n_tokens == n[r.doc_id] for r in rows)

    def mixture(a):
        raw = {s: t**a for s, t in tokens.items() if t}
        return {s: x / sum(raw.values()) for s, x in raw.items()}

    def fits(a):
        w = mixture(a)
        return -sum(x * math.log(x) for x in w.values()) <= 0.98 * math.log(len(w)) and (1 - a) * math.log(max(tokens.values()) / min(tokens.values())) <= math.log(1.5)

    low, high = 0.0, 1.0
    if fits(high):
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(middle) else (middle, high)
    w = mixture(high)
    assert all(abs(r.weight - w[r.source]) < 1e-4 for r in rows)
    budget = max(tokens[s] / w[s] for s in w)
    for s in w:
        got = sum(r.n_tokens for r in rows if r.source == s)
        assert 0 <= got - budget * w[s] + 1e-3 * budget and got <= budget * w[s] + max(n.values()) + 1e-3 * budget
        first = [r.doc_id for r in rows if r.source == s and r.copy == 0]
        assert sorted(first) == sorted(k for k in n if source[k] == s)


def test_offsets_of_many_buckets(spark, monkeypatch):
    """Buckets of buckets give the places that one running sum gives."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2900, "a").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"))
    whole = sorted(map(tuple, mixing.mix(docs, block_tokens=500).select("doc_id", "copy", "block").collect()))
    monkeypatch.setattr(mixing, "BUCKET_TOKENS", 50)
    monkeypatch.setattr(mixing, "BUCKET_GROUP", 7)
    cut = mixing.mix(docs, block_tokens=500).select("doc_id", "copy", "block", "source", mixing.tokens_of("text").alias("n")).collect()
    assert {r[0] for r in whole} == {r.doc_id for r in cut} == set(range(3000))
    by_block = collections.Counter()
    for r in cut:
        by_block[r.block] += r.n
    full = sorted(by_block)[1:-1]
    assert all(abs(by_block[k] - 500) < 30 for k in full)


def test_mixing_odd(spark, odd):
    mixed = mixing.mixed_docs(odd)
    assert mixed.columns == odd.columns and {r.n for r in mixed.collect()} == {r.n for r in odd.collect()}
    assert mixing.mixed_docs(odd.limit(0)).count() == 0


# 6


def test_state_goes_on_and_bytes_are_checked(spark, tmp_path):
    source, state = str(tmp_path / "in"), new_folder(spark, "t")
    schema = "doc_id long, text string"
    spark.createDataFrame([(5, "a  b"), (7, "c")], schema).coalesce(1).write.parquet(source)
    weak = lambda c: F.lit("one digest for all")
    read = lambda: spark.read.schema(schema).parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    first = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark_duplicates(stream(), read(), state, digest=weak).collect()}
    assert first == {5: (5, 1, True), 7: (7, 1, True)}
    spark.createDataFrame([(3, "a b"), (9, "c"), (1, "d")], schema).coalesce(1).write.mode("append").parquet(source)
    again = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark_duplicates(stream(), read(), state, digest=weak).collect()}
    assert again == {5: (3, 2, False), 3: (3, 2, True), 7: (7, 2, True), 9: (7, 2, False), 1: (1, 1, True)}


def test_exact_odd(spark, odd):
    left = exact_dedup.drop_duplicates(odd).collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 1, 3, 5, 6, 7, 8, 9, 10, 11, 12]
    assert exact_dedup.drop_duplicates(odd.limit(0)).count() == 0


# 7


def brute_components(rows, width, percent):
    sets = {}
    for r in rows:
        w = r.text.encode().lower().split() if r.text else []
        sets[r.doc_id] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    found = near_dedup.near_duplicates(docs_of(spark), width=width, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(docs_of(spark).collect(), width, percent)


def test_a_family_of_copies(spark, monkeypatch):
    """Many copies of one text with edits, so that most lists are long, in small blocks."""
    monkeypatch.setattr(near_dedup, "SHORT", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    random = np.random.default_rng(3)
    rows = []
    for k in range(120):
        words = [f"w{i}" for i in range(100)]
        for i in random.choice(100, k % 9, replace=False):
            words[i] = f"x{k}.{i}"
        rows.append((1000 - k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_duplicates(docs, width=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(docs.collect(), 3, 85)


def test_near_odd(spark, odd):
    found = {r.doc_id: r for r in near_dedup.near_duplicates(odd).collect()}
    assert found[3].n_shingles == found[5].n_shingles == 0 and found[5].kept and found[None].kept
    assert found[7].component_id == 6 and found[2].component_id == 1
    assert near_dedup.drop_near_duplicates(odd).columns == odd.columns and near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_least_matches():
    assert all(sum(math.comb(32, k) * (p / 100) ** k * (1 - p / 100) ** (32 - k) for k in range(near_dedup.least_matches(p))) <= near_dedup.MISS for p in (50, 80, 85, 99))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


# 8


def words_tokenizer(version="words"):
    return token_counts.Tokenizer(version, lambda: lambda texts: [len(x.split()) for x in texts])


def test_rollup(spark):
    store = token_counts.Rollup(spark, new_folder(spark, "t"))
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, source string, lang string, text string")
    ids = lambda *r: spark.createDataFrame([(k,) for k in r], "doc_id long")
    totals = lambda: {(r.source, r.lang): (r.docs, r.tokens) for r in store.totals().collect()}
    assert store.totals().count() == 0
    first = rows((1, "a", "en", "x y"), (2, "a", "en", "z"), (3, "b", None, None), (None, "d", "en", "no identifier"), (None, "d", "en", "nor here"), (None, None, None, None))
    assert store.commit(1, first, words_tokenizer()) and not store.commit(1, first, words_tokenizer())
    unnamed = {("d", "en"): (2, 4), (None, None): (1, 0)}
    assert totals() == {("a", "en"): (2, 3), ("b", None): (1, 0)} | unnamed
    store.commit(2, rows((1, "b", "en", "x y z"), (2, "a", "en", "z"), (4, "c", "en", "new")), words_tokenizer(), ids(3, 99))
    assert totals() == {("a", "en"): (1, 1), ("b", "en"): (1, 3), ("c", "en"): (1, 1)} | unnamed
    store.commit(3, first.limit(0), words_tokenizer(), ids(1, 2, 4))
    assert totals() == unnamed


def test_rollup_odd(spark, odd):
    """Repeated identifiers count once, by the longest text; null identifiers each; other columns don't matter."""
    store = token_counts.Rollup(spark, new_folder(spark, "t"))
    store.commit(1, odd.withColumn("tokens", F.lit("mine")), words_tokenizer())
    assert sum(r.docs for r in store.totals().collect()) == odd.count() - 1
    long = store.documents().filter("doc_id = 11").first()
    assert long.tokens == 5000
    assert store.commit(2, odd.limit(0), words_tokenizer()) and store.totals().count() == len({(r.source, r.lang) for r in odd.collect()})


def test_rollup_of_documents(spark):
    found = {(r.source, r.lang): (r.docs, r.tokens) for r in queries.op8_token_counts(spark, FOLDER).collect()}
    tokenizer = token_counts.byte_pair_tokenizer("/opt/tokenizers/byte_bpe_50k.tiktoken", queries.PATTERN, "v")
    count, want, seen = tokenizer.counter(), collections.defaultdict(lambda: [0, 0]), set()
    for r in docs_of(spark).orderBy("doc_id").collect():
        if r.text not in seen:
            seen.add(r.text)
            want[r.source, r.lang][0] += 1
            want[r.source, r.lang][1] += count(["".join(c for c in r.text if c not in "#*$%&|<>")])[0]
    assert found == {k: tuple(v) for k, v in want.items()}


# 9


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    library, table = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load_table(MODEL)
    docs = docs_of(spark).select("doc_id", "text")
    encoded = pieces.encode(docs, table, sample_docs=20, dictionary_size=500)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = pieces.with_texts(encoded, table).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.piece_ids == library.encode(texts[r.doc_id]) and r.text == texts[r.doc_id]


def test_pieces_odd(spark, odd):
    import sentencepiece

    library, table = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load_table(MODEL)
    rows = {r.n: r.text for r in odd.collect()}
    found = pieces.with_texts(pieces.encode(odd, table), table).collect()
    assert sorted(r.n for r in found) == sorted(rows)
    for r in found:
        assert r.text == (rows[r.n] or "") and r.kept == "was here" and r.piece_ids == library.encode(r.text)
    assert pieces.encode(odd.limit(0), table).count() == 0
    checked = pieces.encode(odd.withColumn("same", F.lit("mine")), table, verified="same")
    assert dict(checked.dtypes)["same"] == "boolean" and {r.same for r in checked.collect()} == {True}


def test_words_of_odd_texts():
    for text in ("", "a", " a", "a  b   c    d", "\n\n a\n", "x\x01y z", pieces.MARKS + " a  b\nc", "▁a ▁▁b", "   ", "a \n b"):
        want = re.findall(r" +[^ \n]*|[^ \n]+|\n", " " + text.replace(pieces.SPACE, " "))
        assert [w for w in pieces.words_of(text) if w] == want


def test_pieces_that_are_late():
    """All others are in two parts when their turn comes; the model is one of merges, so most are."""
    table = pieces.load_table(MODEL)
    late = table.late()
    assert late and len(late) < 100 and all(set(p) == {pieces.SPACE} for p in late)


def test_viterbi_on_log_probabilities(spark):
    parts = {"▁": -3.0, "a": -2.0, "b": -2.5, "c": -4.0, "ab": -3.1, "bc": -4.5, "abc": -9.5, "▁a": -3.5, "ca": -5.0}
    table = pieces.PieceTable(tuple((p, k, s) for k, (p, s) in enumerate(parts.items())), tuple(range(100, 356)), False)
    words = ["▁abcab", "abcabc", "▁", "bcbcbca", "x▁a", "ab" * 29]

    def best(word):
        sums = [(0.0, [0])]
        for e in range(1, len(word) + 1):
            options = [(sums[s][0] - parts.get(word[s:e], -4.0 if e - s == 1 else -1e9), [*sums[s][1], e]) for s in range(e)]
            sums.append(min(options, key=lambda o: o[0]))
        return sums[-1][0]

    ids = pieces._Ids(table)
    found = {r.word: r for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), table).collect()}
    for w in words:
        r = found.get(w)
        cuts = list(range(len(w) + 1)) if r is None else [i for i in range(len(w) + 1) if r.cuts >> i & 1]
        assert abs(sum(-parts.get(w[s:e], -4.0) for s, e in zip(cuts, cuts[1:], strict=False)) - best(w)) < 1e-9
        assert ids.of(w, None if r is None else r.cuts)


def test_runs_of_spaces_are_those_of_the_library(spark):
    """An edge may come to span two pieces after a merge of a later rank."""
    import sentencepiece

    library, table = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load_table(MODEL)
    texts = {k: f"a{' ' * k}b" for k in range(1, 71)} | {100 + k: f"{' ' * k}x = {'-' * k}{'=' * k}|{'a' * k}" for k in range(1, 71)}
    encoded = pieces.encode(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), table, sample_docs=20, dictionary_size=10)
    assert {r.doc_id: r.piece_ids for r in encoded.collect()} == {k: library.encode(x) for k, x in texts.items()}
    ids = pieces._Ids(table)
    long = [f"{pieces.SPACE * k}b" for k in range(61, 200)]
    assert [ids.of(w, None) for w in long] == [library.encode(w.replace(pieces.SPACE, " ")[1:]) for w in long]


def test_long_words_fold_alike(monkeypatch):
    import sentencepiece

    library, ids = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces._Ids(pieces.load_table(MODEL))
    for word in ("international" * 20, "x" * 500, "ßüéa" * 100):
        assert ids.of("▁" + word, None) == library.encode(word)


# 10


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x?q=/de/", "https://example.net/fr", "http://badexample.net", "http://www.example.com/de/1#top", "http://x.org/fr/", "http://x.org/frx", "no scheme/net/", None, "ftp://host", "://net/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows, queries.URL_RULES).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[1] == ("example.net", "/fr", "net/", "block")
    assert got[2][:3] == ("badexample.net", "", None) and got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow") and got[5][2] is None
    assert got[6][:3] == got[7][:3] == ("", "", None) and got[9][:3] == ("net", "/", "net/") and {v[3] for v in got.values()} == {"allow", "block"}
    assert url_filter.judge(rows.limit(0), queries.URL_RULES).count() == 0


def test_trees_learn(spark):
    rows = spark.range(600).select(F.concat(F.lit("http://h"), (F.col("id") % 7).cast("string"), F.lit(".example.org/p"), F.repeat(F.lit("/a"), (F.col("id") % 5).cast("int")), F.when(F.col("id") % 2 == 0, "?x=1&y=2").otherwise("")).alias("url"), (F.col("id") % 2 == 0).alias("y"), F.col("id"))
    host, path = url_filter.split_url("url")
    rows = rows.withColumns({"host": host, "path": path, "label": F.when(F.col("id") % 3 > 0, F.col("y"))})
    scored = url_filter.with_scores(rows, url_filter.learn(rows, "label", trees=3)).filter("label is null").collect()
    assert all((r.score >= 0.5) == r.y for r in scored)


def test_join_dealt(spark):
    """A hot key's rows are dealt, and each meets its partner once; null keys and keys without a partner meet none."""
    from lexiloom.llm.scratch import DEALS, join_dealt

    keys = ["hot"] * 700 + ["warm"] * 40 + [f"k{i}" for i in range(60)] + [None] * 90 + ["alone"] * 3
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    one = rows.filter("key is not null and key <> 'alone'").groupBy("key").agg(F.count("*").alias("n"))
    out = join_dealt(rows, one, "key", "n", rows.count(), "id")
    assert out.columns == ["key", "id", "n"]
    assert sorted((r.id, r.key, r.n) for r in out.collect()) == sorted((i, k, keys.count(k)) for i, k in enumerate(keys) if k not in (None, "alone"))
    assert one.filter("n > 64").count() == 1 and DEALS > 1
