"""Queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import byte_pairs, exact_dedup, filter_audit, language, manifest, mixing, near_dedup, pieces, quality, sharding, token_counts, toxicity, url_filter
from lexiloom.llm.scratch import for_long_rows, new_folder, read_table, stream_table

Query = Callable[[SparkSession, str], DataFrame]


#: The folder of public tokenizers; a parameter of the queries that need one.
TOKENIZERS = "/opt/tokenizers"
#: How the byte-pair tokenizer splits texts, a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document, by equal bytes."""
    placed = sharding.assign_shards(read_table(spark, folder, "documents").select("doc_id", "text"), 24)
    return placed.select(
        "doc_id",
        sharding.bytes_of("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document; labels of two thirds of them are learnt."""
    for_long_rows(spark)
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    labels = read_table(spark, folder, "labels").filter(~toxicity.held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.with_scores(docs, toxicity.learn(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Signals and verdict of every document."""
    for_long_rows(spark)
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    signals = quality.with_signals(docs).drop("text")
    return quality.judge_signals(signals).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; those of two thirds of them are learnt."""
    for_long_rows(spark)
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.filter(~toxicity.held_out(F.col("doc_id"))))
    found = language.with_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "languages.lang_pred", "languages.score", F.to_json("languages.shares").alias("shares"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "source", mixing.tokens_of("text").alias("n_tokens"), F.round("weight", 9).alias("weight"), "copy", "block", "place")


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Group, size and verdict of every document."""
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    marked = exact_dedup.mark_duplicates(stream_table(docs, folder, "documents", 8), docs, new_folder(spark, "op6-state"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Component and verdict of every document; three words and 85 % by the contract."""
    for_long_rows(spark)
    return near_dedup.near_duplicates(read_table(spark, folder, "documents"), width=3, percent=85)


def op8_token_counts(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Totals after all documents came in, texts with junk symbols were revised (without them), and copies were deleted."""
    for_long_rows(spark)
    docs = read_table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    tokenizer = token_counts.byte_pair_tokenizer(f"{tokenizers}/byte_bpe_50k.tiktoken", PATTERN, "byte_bpe_50k")
    store = token_counts.Rollup(spark, new_folder(spark, "op8-rollup"))
    store.commit(1, docs, tokenizer)
    store.commit(1, docs, tokenizer)  # a batch that comes again changes nothing
    revised = docs.withColumn("text", F.regexp_replace("text", r"[#*$%&|<>]+", "")).filter(docs["text"].rlike(r"[#*$%&|<>]") & F.col("doc_id").isNotNull())
    texts = docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    first = texts.agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).join(first, "h").filter("doc_id <> first").select("doc_id")
    store.commit(2, revised, tokenizer, copies)
    return store.totals()


def op9_pieces(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    for_long_rows(spark)
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, pieces.load_table(f"{tokenizers}/piece_bpe_32k.model"), verified="round_trip")
    return encoded.select("doc_id", F.size("piece_ids").alias("n_pieces"), "piece_ids", "round_trip")


URL_RULES = [
    url_filter.Rule("net", "/", True),
    url_filter.Rule("example.net", "/en/", False),
    url_filter.Rule("example.com", "/de/", True),
    url_filter.Rule("org", "/fr/", False),
]


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    pages = read_table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op11_byte_pairs(spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Tokens of every document, as digests, and the digest of what they decode to."""
    for_long_rows(spark)
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    vocabulary = byte_pairs.Vocabulary.load(f"{tokenizers}/byte_bpe_50k.json")
    encoded = byte_pairs.encode(docs, vocabulary)
    text = byte_pairs.decoded(F.col("ids"), vocabulary)
    return encoded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(text, 256).alias("decoded_sha256"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters removes at each step of each order, by source."""
    for_long_rows(spark)
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(filter_audit.cells(docs, read_table(spark, folder, "labels").select("doc_id", "quality", "toxic")))


def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Proofs of all documents, and where they lead from texts in lower case, for one in three."""
    for_long_rows(spark)
    docs = read_table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda text: manifest.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(F.translate("text", ascii_uppercase, ascii_lowercase)))
    proved = manifest.with_proofs(docs, F.col("lang"), "doc_id", leaf(F.col("text")), tampered=tampered)
    root = manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    out = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.digests_of(F.col("proof")), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_pieces": op9_pieces,
    "op10_url_filter": op10_url_filter,
    "op11_byte_pairs": op11_byte_pairs,
    "op12_filter_audit": op12_filter_audit,
    "op13_manifest": op13_manifest,
}

OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents),
base AS (
  SELECT doc_id, lang, source,
    regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
pos AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM base WHERE len(w) >= 3),
grams AS (SELECT doc_id, i, (w[i], w[i + 1], w[i + 2]) AS g FROM pos),
rep AS (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, i + o AS p FROM grams JOIN rep USING (doc_id, g), (VALUES (0), (1), (2)) AS t(o)),
ncov AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY 1),
s AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM base LEFT JOIN ncov USING (doc_id)),
m AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    {'symbol': 1000 * n_symbols // greatest(1, word_chars), 'dup': 1000 * n_dup_lines // greatest(1, n_lines),
     'repeat': 1000 * n_repeat_words // greatest(1, n_words), 'len': 10 * word_chars // greatest(1, n_words)} AS v
  FROM s),
long AS (
  SELECT lang, source, unnest([('symbol', v.symbol), ('dup', v.dup), ('repeat', v."repeat"), ('len', v.len)]) AS t FROM m WHERE NOT base_failed),
binned AS (
  SELECT lang, source, t[1] AS metric, (t[2] >> greatest(0, length(bin(t[2])) - 7)) << greatest(0, length(bin(t[2])) - 7) AS bin FROM long),
rules(metric, level, reach) AS (VALUES ('symbol', 90, 4), ('dup', 98, 1), ('repeat', 95, 6), ('len', 75, 4)),
hist AS (
  SELECT 'source' AS kind, lang, source, metric, bin, count(*) AS n FROM binned GROUP BY ALL
  UNION ALL SELECT 'lang', lang, NULL, metric, bin, count(*) FROM binned GROUP BY ALL
  UNION ALL SELECT 'all', NULL, NULL, metric, bin, count(*) FROM binned GROUP BY ALL),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY kind, lang, source, metric ORDER BY bin) AS c, sum(n) OVER (PARTITION BY kind, lang, source, metric) AS total FROM hist),
q AS (
  SELECT kind, lang, source, metric, max(total)::BIGINT AS total, max(level) AS level, max(reach) AS reach,
    min(CASE WHEN 100 * c >= 25 * total THEN bin END) AS q25, min(CASE WHEN 100 * c >= 50 * total THEN bin END) AS q50,
    min(CASE WHEN 100 * c >= 75 * total THEN bin END) AS q75, min(CASE WHEN 100 * c >= level * total THEN bin END) AS qp
  FROM cum JOIN rules USING (metric) GROUP BY ALL),
peers AS (
  SELECT metric, count(*) FILTER (kind = 'source') AS sources, quantile_disc(qp - q25, 0.5) FILTER (kind = 'source') AS by_source,
    count(*) FILTER (kind = 'lang') AS langs, quantile_disc(qp - q25, 0.5) FILTER (kind = 'lang') AS by_lang
  FROM q WHERE kind <> 'all' AND total >= 50 GROUP BY metric),
spread AS (
  SELECT q.*, greatest(1, least(qp - q25, 2 * CASE WHEN sources >= 3 THEN by_source WHEN langs >= 3 THEN by_lang ELSE q50 - q25 END)) AS s, greatest(1, q75 - q25) AS r
  FROM q LEFT JOIN peers USING (metric)),
fence AS (
  SELECT kind, lang, source, metric, total, CASE WHEN metric = 'len' THEN greatest(0, q25 - reach * r) ELSE 0 END AS lo,
    CASE WHEN metric = 'len' THEN q75 + reach * r ELSE q25 + (1 + reach) * s END AS hi
  FROM spread),
coarse AS (
  SELECT l.lang, l.metric, (l.total * l.lo + 300 * a.lo) // (l.total + 300) AS lo, (l.total * l.hi + 300 * a.hi) // (l.total + 300) AS hi
  FROM fence l JOIN fence a ON l.kind = 'lang' AND a.kind = 'all' AND l.metric = a.metric),
used AS (
  SELECT f.lang, f.source, f.metric, (f.total * f.lo + 300 * c.lo) // (f.total + 300) AS lo, (f.total * f.hi + 300 * c.hi) // (f.total + 300) AS hi
  FROM fence f JOIN coarse c ON f.kind = 'source' AND f.lang IS NOT DISTINCT FROM c.lang AND f.metric = c.metric),
limits AS (
  SELECT lang, source, max(CASE WHEN metric = 'symbol' THEN hi END) AS hi_symbol, max(CASE WHEN metric = 'dup' THEN hi END) AS hi_dup,
    max(CASE WHEN metric = 'repeat' THEN hi END) AS hi_repeat, max(CASE WHEN metric = 'len' THEN hi END) AS hi_len, max(CASE WHEN metric = 'len' THEN lo END) AS lo_len
  FROM used GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND v.symbol <= hi_symbol AND v.dup <= hi_dup AND v."repeat" <= hi_repeat AND v.len <= hi_len AND v.len >= lo_len) AS kept
FROM m LEFT JOIN limits ON m.lang IS NOT DISTINCT FROM limits.lang AND m.source IS NOT DISTINCT FROM limits.source
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first_of AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT d.part, coalesce(l.quality = 1, false)::INT AS good, coalesce(l.toxic = 1, false)::INT AS toxic,
    (len(w) < 200)::INT * 1 + (100 * len(list_distinct(w)) < 50 * len(w))::INT * 2
    + (100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 2 * length(d.text))::INT * 4
    + regexp_matches(d.text, '[#$%&*|]')::INT * 8 + coalesce(d.doc_id > first_of.first, false)::INT * 16 AS mask
  FROM d JOIN first_of ON d.text = first_of.text LEFT JOIN l ON d.doc_id = l.doc_id),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
step AS (
  SELECT c.part, x.letter, x.bit, s.applied,
    sum(n * ((mask & (s.applied | x.bit)) = 0)::INT)::BIGINT AS kept,
    sum(n * ((mask & s.applied) = 0 AND (mask & x.bit) <> 0)::INT)::BIGINT AS removed,
    sum(n * ((mask & s.applied) <> 0 AND (mask & x.bit) <> 0)::INT)::BIGINT AS redundant,
    sum(n * (mask = x.bit)::INT)::BIGINT AS unique_fails,
    sum(good * ((mask & s.applied) = 0 AND (mask & x.bit) <> 0)::INT)::BIGINT AS good_lost,
    sum(toxic * ((mask & s.applied) = 0 AND (mask & x.bit) <> 0)::INT)::BIGINT AS toxic_lost
  FROM cell c, letters x, (SELECT unnest(range(32)) AS applied) s WHERE (s.applied & x.bit) = 0 GROUP BY ALL),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
places AS (
  SELECT filter_order, k AS step, filter_order[k] AS letter,
    coalesce(list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0) AS applied
  FROM orders, (SELECT unnest(range(1, 6)) AS k) t)
SELECT s.part, p.filter_order, p.step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY s.part, s.letter)::BIGINT AS shapley
FROM places p JOIN step s ON p.letter = s.letter AND p.applied = s.applied
"""

OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, text, doc_id::VARCHAR AS a, n_chars::VARCHAR AS c,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head
  FROM documents),
crc AS (
  SELECT *, xor(list_reduce(list_transform(string_split(a, ''), lambda x: ascii(x)::BIGINT),
      lambda s, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384), xor(s, b)), 4294967295), 4294967295) AS crc
  FROM d),
base AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS lowered
  FROM crc),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS r FROM base),
up AS (
  SELECT tree, 0 AS lvl, i, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM up) WHERE n > 1 GROUP BY tree, lvl, i // 8),
subroots AS (
  SELECT tree, lvl AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i
  FROM (SELECT *, max(lvl) OVER (PARTITION BY tree) AS top FROM up) WHERE lvl = top),
forest AS (
  SELECT 0 AS lvl, i, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM forest) WHERE n > 1 GROUP BY lvl, i // 8),
root AS (SELECT arg_max(h, lvl) AS root, max(lvl) AS height FROM forest),
runs AS (
  SELECT tree, lvl, i // 8 AS run, list(h ORDER BY i) AS hs FROM up GROUP BY ALL
  UNION ALL SELECT NULL, lvl, i // 8, list(h ORDER BY i) FROM forest GROUP BY ALL),
steps AS (
  SELECT l.r, runs.lvl AS k, (l.i >> (3 * runs.lvl)) % 8 AS own, hs
  FROM leaves l JOIN subroots s ON l.tree = s.tree JOIN runs ON runs.tree = l.tree AND runs.lvl < s.height AND runs.run = l.i >> (3 * runs.lvl + 3)
  UNION ALL
  SELECT l.r, s.height + runs.lvl, (s.i >> (3 * runs.lvl)) % 8, hs
  FROM leaves l JOIN subroots s ON l.tree = s.tree JOIN runs ON runs.tree IS NULL AND runs.run = s.i >> (3 * runs.lvl + 3) JOIN root ON runs.lvl < root.height),
sides AS (SELECT r, k, coalesce(list_aggregate(hs[:own], 'string_agg', ''), '') AS before, coalesce(list_aggregate(hs[own + 2:], 'string_agg', ''), '') AS after FROM steps),
proofs AS (SELECT r, string_agg(before || after, '' ORDER BY k) AS proof FROM sides GROUP BY r),
folds AS (
  SELECT r, 0 AS k, coalesce(lowered, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.r, f.k + 1, sha256(before || h || after) FROM folds f JOIN sides s ON f.r = s.r AND f.k = s.k),
folded AS (SELECT r, arg_max(h, k) AS folded_root FROM folds GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots s ON l.tree = s.tree CROSS JOIN root JOIN folded f ON l.r = f.r LEFT JOIN proofs p ON l.r = p.r
"""

SQL: dict[str, str] = {
    "op6_exact_dedup": OP6_SQL,
    "op3_quality": OP3_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_manifest": OP13_SQL,
}
