"""The queries in DuckDB's SQL: a second implementation, written apart from the one on Spark."""

from __future__ import annotations

from lexiloom.functions.text import STOPWORDS, SUFFIXES

_STOP = {k: " ".join(words) for k, words in STOPWORDS.items()}
_RULES = SUFFIXES


def _suffix_case(lang: str, least: int) -> str:
    return "CASE " + " ".join(f"WHEN w1 LIKE '%{a}' AND length(w1) - {len(a) - len(b)} >= {least} THEN left(w1, length(w1) - {len(a)}) || '{b}'" for a, b in _RULES[lang]) + " ELSE w1 END"


def _quoted(words: str) -> str:
    return ", ".join(f"'{w}'" for w in words.split())


_EDITORIAL = r"\[[^\]]{0,80}\]|\{[^}]{0,80}\}|<[^>]{0,80}>"
_MARKS = r"[\x{0591}-\x{05C7}\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0951}-\x{0954}]"
_WORD = r"[\p{L}\p{Nl}\p{No}]+(?:[''’\-][\p{L}\p{Nl}\p{No}]+)*"

VERSES = rf"""
src AS (
  SELECT doc_id, lang, source, coalesce(try_cast(substr(source, 4) AS INT), 0) AS k, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, lang, source, k, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS number FROM src),
verses AS (
  SELECT doc_id * 1048576 + number AS verse_id, lang || '-t' || (k % 4) AS work_id, 't' || (k % 4) AS tradition, lang AS language,
    lang || '-t' || (k % 4) || '/' || (k // 4 + 1) AS division_id, k // 4 + 1 AS ordinal, source AS name,
    CASE WHEN k // 4 + 1 <= 2 THEN 'A' WHEN k // 4 + 1 <= 4 THEN 'B' END AS section,
    doc_id AS chapter, number, source || ' ' || doc_id || ':' || number AS ref, text
  FROM lines WHERE regexp_matches(text, '\S')),
normal AS (
  SELECT *, lower(replace(replace(regexp_replace(regexp_replace(nfc_normalize(text), '{_EDITORIAL}', ' ', 'g'), '{_MARKS}', '', 'g'), '’', ''''), chr(173), '')) AS low FROM verses),
folded AS (SELECT * EXCLUDE (low), CASE WHEN language IN ('es', 'en') THEN strip_accents(nfc_normalize(low)) ELSE low END AS normal FROM normal),
words AS (SELECT *, regexp_extract_all(normal, '{_WORD}') AS w FROM folded)"""

INDEX = rf"""{VERSES},
placed AS (SELECT work_id, language, division_id, verse_id, unnest(w) AS surface, unnest(range(0, len(w))) AS position FROM words),
terms AS (
  SELECT * FROM placed WHERE length(surface) >= 2 AND (surface IN ('dios', 'god', 'lord', 'senor', 'allah', 'alma', 'soul')
    OR NOT ((language = 'es' AND surface IN ({_quoted(_STOP["es"])})) OR (language = 'en' AND surface IN ({_quoted(_STOP["en"])}))))),
stem1 AS (
  SELECT *, CASE
    WHEN language = 'es' AND length(surface) > 4 THEN CASE
      WHEN surface LIKE '%ces' AND length(surface) >= 5 THEN left(surface, length(surface) - 3) || 'z'
      WHEN surface LIKE '%yes' AND length(surface) >= 5 THEN left(surface, length(surface) - 2)
      WHEN surface LIKE '%es' AND length(surface) >= 6 THEN left(surface, length(surface) - 2)
      WHEN surface LIKE '%s' AND length(surface) >= 5 THEN left(surface, length(surface) - 1) ELSE surface END
    WHEN language = 'en' AND length(surface) > 3 THEN CASE
      WHEN regexp_matches(surface, '(ss|us|is|as)$') THEN surface
      WHEN surface LIKE '%ies' AND length(surface) >= 5 THEN left(surface, length(surface) - 3) || 'y'
      WHEN surface LIKE '%es' AND length(surface) >= 5 THEN left(surface, length(surface) - 2)
      WHEN surface LIKE '%s' AND length(surface) >= 4 THEN left(surface, length(surface) - 1) ELSE surface END
    ELSE surface END AS w1 FROM terms),
stem2 AS (
  SELECT *, CASE WHEN language = 'es' AND length(surface) > 4 THEN {_suffix_case("es", 4)}
    WHEN language = 'en' AND length(surface) > 3 THEN {_suffix_case("en", 3)} ELSE w1 END AS w2 FROM stem1),
idx AS (
  SELECT work_id, language, division_id, verse_id, surface, position,
    CASE WHEN language = 'es' AND length(surface) > 4 AND regexp_matches(w2, '[oae]$') AND length(w2) >= 5 THEN left(w2, length(w2) - 1)
      WHEN language = 'en' AND length(surface) > 3 AND w2 LIKE '%e' AND length(w2) >= 4 THEN left(w2, length(w2) - 1) ELSE w2 END AS lemma
  FROM stem2),
totals AS (SELECT lemma, work_id, count(*) AS count, count(DISTINCT verse_id) AS verse_count FROM idx GROUP BY 1, 2),
divisions AS (
  SELECT division_id, any_value(work_id) AS work_id, any_value(ordinal)::INT AS ordinal, min(name) AS name, any_value(section) AS section, sum(len(w))::BIGINT AS total_tokens
  FROM words GROUP BY 1),
works AS (
  SELECT work_id, any_value(tradition) AS tradition, any_value(language) AS language, count(*) AS total_verses, sum(len(w))::BIGINT AS total_tokens, count(DISTINCT division_id) AS divisions,
    any_value(tradition) || ' (' || any_value(language) || ')' AS title
  FROM words GROUP BY 1),
stems(lemma) AS (VALUES ('er'), ('ther'), ('rewh'), ('thatin')),
hits AS (SELECT * FROM idx WHERE lemma IN (FROM stems))"""

LEXICON = rf"""{INDEX},
counts AS (SELECT language, surface, length(surface) AS n, count(*) AS c FROM idx WHERE length(surface) BETWEEN 4 AND 8 GROUP BY 1, 2),
best AS (SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY language, n ORDER BY c DESC, surface) <= 20),
stem_of AS (SELECT DISTINCT language, surface, lemma FROM idx),
lex AS (SELECT 'length' || n AS field, language, surface AS term, lemma FROM best JOIN stem_of USING (language, surface))"""


def _rate(n: str, t: str) -> str:
    return f"CASE WHEN {t} > 0 THEN round({n} * 10000 / {t}, 3) ELSE 0.0 END"


def _g2(a: str, b: str, c: str, d: str) -> str:
    term = lambda x, e: f"(CASE WHEN {x} > 0 THEN {x} * ln({x} / ({e})) ELSE 0.0 END)"
    return f"""CASE WHEN {c} > 0 AND {d} > 0 THEN round(2 * ({term(a, f"{c} * ({a} + {b}) / ({c} + {d})")} + {term(b, f"{d} * ({a} + {b}) / ({c} + {d})")}), 3) ELSE 0.0 END"""


def _lr(a: str, b: str, c: str, d: str) -> str:
    return f"CASE WHEN {c} > 0 AND {d} > 0 THEN round(log2((({a} + 0.5::DOUBLE) / {c}) / (({b} + 0.5::DOUBLE) / {d})), 3) ELSE 0.0 END"


def _keyness(rows: str, columns: str, a: str, b: str, c: str, d: str, more: str = "") -> str:
    """`columns` of a relation with the four keyness columns."""
    return f"""SELECT {columns}, log_likelihood, effect_size, CASE WHEN effect_size > 0 THEN 'over' ELSE 'under' END AS direction, log_likelihood > 15.13 AS significant
    FROM (SELECT *, {_g2(a, b, c, d)} AS log_likelihood, {_lr(a, b, c, d)} AS effect_size FROM ({rows})) {more}"""


_BY_WORK = f"""
freq AS (SELECT work_id, sum(count)::BIGINT AS raw_count, sum(verse_count)::BIGINT AS verse_count FROM totals WHERE lemma IN (FROM stems) GROUP BY 1),
disp AS (SELECT work_id, count(DISTINCT division_id) AS present FROM hits GROUP BY 1),
by_work AS (
  SELECT w.work_id, w.title, w.tradition, w.language, coalesce(raw_count, 0) AS raw_count, coalesce(verse_count, 0) AS verse_count, total_tokens,
    {_rate("coalesce(raw_count, 0)", "total_tokens")} AS per_10k, round(coalesce(present, 0) / divisions, 3) AS dispersion, coalesce(present, 0) AS divisions_present, divisions AS divisions_total
  FROM works w LEFT JOIN freq USING (work_id) LEFT JOIN disp USING (work_id))"""

_VECTORS = """v AS (SELECT vec_id AS verse_id, embedding::DOUBLE[] AS vector, 't' || label AS tradition, 'm' || (vec_id % 3) AS model FROM embeddings),
q AS (SELECT vector AS q FROM v WHERE verse_id = 0),
scored AS (SELECT v.*, list_inner_product(vector, q) AS score FROM v, q)"""

_SCRIPT_RANGES = {"latino": r"\x{0041}-\x{024F}", "arabe": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}", "hebreo": r"\x{0590}-\x{05FF}\x{FB1D}-\x{FB4F}", "devanagari": r"\x{0900}-\x{097F}", "griego": r"\x{0370}-\x{03FF}", "cirilico": r"\x{0400}-\x{04FF}"}


def _scripts(rows: str, key: str) -> str:
    """CTEs: of `rows` (key, text), (key, script, share)."""
    counts = ", ".join(f"length(regexp_replace(letters, '[^{r}]', '', 'g')) AS {k}" for k, r in _SCRIPT_RANGES.items())
    names = " ".join(f"WHEN {k} = most THEN '{k}'" for k in _SCRIPT_RANGES)
    return rf"""letters AS (SELECT {key}, regexp_replace(coalesce(text, ''), '[^\p{{L}}]', '', 'g') AS letters FROM ({rows})),
n AS (SELECT {key}, length(letters) AS n, {counts} FROM letters),
m AS (SELECT *, greatest({", ".join(_SCRIPT_RANGES)}) AS most FROM n),
script AS (SELECT {key}, CASE WHEN n = 0 THEN 'ninguno' WHEN most = 0 THEN 'otro' {names} END AS script, CASE WHEN most > 0 THEN most / n ELSE 0.0 END AS share FROM m)"""


_VALID = f"""sample AS (SELECT work_id, language, string_agg(text, ' ') AS text FROM verses GROUP BY ALL),
{_scripts("FROM sample", "work_id, language")},
valid AS (SELECT work_id, language, script, 'latino' AS expected, round(share, 4) AS share, script = 'latino' AND share >= 0.6 AS valid FROM script)"""

_CONTROLS = """controls(language, word) AS (VALUES ('en', 'the'), ('en', 'er'), ('en', 'zzzznoexiste'), ('es', 'cion'), ('fr', 'ment'), ('de', 'heit')),
missing AS (SELECT work_id, word FROM works JOIN controls USING (language) WHERE NOT EXISTS (FROM idx WHERE idx.work_id = works.work_id AND surface = word))"""

_HIT_VERSES = """found AS (SELECT work_id, verse_id, count(*) AS hits, string_agg(DISTINCT surface, ',' ORDER BY surface) AS matched_forms FROM hits GROUP BY 1, 2),
numbered AS (SELECT f.*, v.ref, v.text, v.tradition, v.name, v.ordinal, v.chapter, v.number, row_number() OVER (PARTITION BY f.work_id ORDER BY ordinal, chapter, number, f.verse_id) AS row_in_work FROM found f JOIN verses v USING (verse_id))"""

_TOP = """top AS (
  SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY s1 DESC, item) AS ra, row_number() OVER (PARTITION BY query ORDER BY s2 DESC, item) AS rb FROM (
    SELECT a.tradition AS query, v.verse_id AS item, list_inner_product(v.vector, a.vector) AS s1, list_inner_product(v.vector[1:32], a.vector[1:32]) AS s2
    FROM v, (SELECT tradition, vector FROM v WHERE verse_id IN (SELECT min(verse_id) FROM v GROUP BY tradition)) a))"""

_RESULTS = """found AS (SELECT verse_id, score FROM scored ORDER BY score DESC, verse_id LIMIT 120),
texts AS (SELECT verse_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda w: length(w) > 3)) AS w FROM found JOIN documents ON doc_id = verse_id)"""

SQL: dict[str, str] = {
    "normalize_text": f"WITH {VERSES} SELECT verse_id, normal FROM folded",
    "tokenize": f"WITH {INDEX} SELECT verse_id, position::INT AS position, surface, lemma FROM idx",
    "token_count": f"WITH {VERSES} SELECT verse_id, len(w) AS token_count FROM words",
    "stem": f"WITH {INDEX} SELECT DISTINCT language, surface, lemma FROM idx",
    "ngrams": f"WITH {VERSES}, g AS (SELECT unnest(w[:-2]) || ' ' || unnest(w[2:]) AS gram FROM words WHERE len(w) >= 2) SELECT gram, count(*) AS n FROM g GROUP BY 1",
    "strip_html": r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<sup[^>]*class="[^"]*footnote-marker[^"]*"[^>]*>.*?</sup>|<i[^>]*class="[^"]*footnote[^"]*"[^>]*>.*?</i>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""",
    "detect_script": f"WITH {_scripts('SELECT doc_id, text FROM documents', 'doc_id')} SELECT doc_id, script, round(share, 4) AS share FROM script",
    "verse_dedup": "SELECT role AS work_id, conv_id AS division_id, (turn // 2)::BIGINT AS number, min(turn) AS turn FROM conversations GROUP BY 1, 2, 3",
    "lemma_totals": f"WITH {INDEX} SELECT * FROM totals",
    "division_totals": f"WITH {INDEX} SELECT division_id, total_tokens FROM divisions",
    "work_totals": f"WITH {INDEX} SELECT work_id, total_tokens, total_verses FROM works",
    "list_works": f"WITH {INDEX} SELECT work_id, title, tradition, language, total_tokens, total_verses, divisions FROM works",
    "list_divisions": f"WITH {INDEX} SELECT ordinal, name, section, total_tokens FROM divisions WHERE work_id = 'en-t3'",
    "health_counts": f"WITH {INDEX} SELECT count(*) AS works, sum(divisions)::BIGINT AS divisions, sum(total_verses)::BIGINT AS verses, sum(total_tokens)::BIGINT AS tokens, (SELECT count(*) FROM idx) AS postings FROM works",
    "ingest_stats": f"WITH {INDEX} SELECT w.work_id, total_verses AS verses, total_tokens AS tokens, divisions, coalesce(sum(count), 0)::BIGINT AS postings FROM works w LEFT JOIN totals USING (work_id) GROUP BY ALL",
    "log_likelihood": f"WITH {INDEX}, t AS (SELECT * FROM totals WHERE work_id LIKE 'en-%'), n AS (SELECT lemma, sum(count)::BIGINT AS n FROM t GROUP BY 1), e AS (SELECT sum(total_tokens)::BIGINT AS t FROM works WHERE language = 'en') "
    + _keyness("SELECT t.lemma, t.work_id, t.count AS a, n - t.count AS b, total_tokens AS c, e.t - total_tokens AS d FROM t JOIN n USING (lemma) JOIN works USING (work_id), e", "lemma, work_id", "a", "b", "c", "d"),
    "semantic_fields": f"WITH {LEXICON} SELECT field, 'Palabras de ' || field AS label, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, count(*) AS term_count FROM lex GROUP BY 1",
    "lexicon_terms": f"WITH {LEXICON} SELECT field, language, term, lemma FROM lex",
    "field_stems": f"WITH {LEXICON} SELECT DISTINCT lemma FROM lex WHERE field = 'length6' AND language = 'en'",
    "fields_containing": f"WITH {LEXICON} SELECT DISTINCT language, lemma, field FROM lex JOIN (SELECT DISTINCT language, lemma FROM idx) USING (language, lemma)",
    "resolve_query": f"WITH {LEXICON} SELECT lemma, sum(count)::BIGINT AS count FROM totals WHERE lemma IN ('ther', 'rewh') OR lemma IN (SELECT lemma FROM lex WHERE field = 'length6' AND language = 'en') GROUP BY 1",
    "search_text": rf"""WITH {VERSES}, t AS (SELECT verse_id, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}\p{{Co}}]+') AS w FROM verses)
      SELECT verse_id FROM t WHERE list_contains(w, 'ther') OR (contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') AND NOT (list_contains(w, 'er') AND len(list_filter(w, lambda x: starts_with(x, 'th'))) > 0))""",
    "kept_dispersion": f"""WITH {INDEX}, p AS (SELECT lemma, work_id, count(DISTINCT division_id) AS divisions_present FROM idx GROUP BY ALL)
      SELECT lemma, work_id, count, verse_count, divisions_present, divisions AS divisions_total, round(divisions_present / divisions, 3) AS dispersion, total_tokens, total_verses FROM totals JOIN p USING (lemma, work_id) JOIN works USING (work_id)""",
    "search_ranked": rf"""WITH {VERSES}, t AS (SELECT verse_id, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}\p{{Co}}]+') AS w FROM verses),
      tf AS (SELECT verse_id, len(w) AS n, x.k, len(list_filter(w, lambda y: y = x.k)) AS f FROM t, (VALUES ('rewh'), ('thatin'), ('cion')) x(k)),
      s AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM t), df AS (SELECT k, count(*) FILTER (f > 0) AS df FROM tf GROUP BY k),
      gain AS (SELECT verse_id, k, f, ln(1 + (docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * n / mean)) AS g FROM tf JOIN df USING (k), s),
      per AS (SELECT verse_id, sum(g) AS score, count(*) FILTER (f > 0 AND k <> 'cion') AS free, count(*) FILTER (f > 0 AND k = 'cion') AS other FROM gain GROUP BY 1)
      SELECT verse_id, round(score, 4) AS score FROM per JOIN t USING (verse_id) WHERE free > 0 OR (other > 0 AND NOT list_contains(w, 'er')) ORDER BY round(score, 6) DESC, verse_id LIMIT 50""",
    "vector_search": f"WITH {_VECTORS} SELECT verse_id, round(score, 4) AS similarity FROM scored ORDER BY score DESC, verse_id LIMIT 20",
    "vector_search_all": f"WITH {_VECTORS}, pairs AS (SELECT a.verse_id AS query_id, b.verse_id, list_inner_product(b.vector, a.vector) AS s FROM v a, v b WHERE a.verse_id % 20 = 0) SELECT query_id, verse_id, round(s, 4) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, verse_id)::INT AS rank FROM pairs QUALIFY rank <= 40",
    "near_duplicates": f"WITH {_VECTORS}, {_RESULTS} SELECT a.verse_id AS a, b.verse_id AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 4) AS overlap FROM texts a JOIN texts b ON a.verse_id < b.verse_id WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.6",
    "near_duplicates_all": """WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+'), lambda w: length(w) > 3))) AS w FROM documents),
      c AS (SELECT *, CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY w) ELSE doc_id END AS rep FROM t), x AS (SELECT doc_id AS r, len(w) AS n, unnest(w) AS u FROM c WHERE rep = doc_id),
      j AS (SELECT a.r AS a, b.r AS b, a.n AS na, b.n AS nb, count(*) AS m FROM x a JOIN x b ON a.u = b.u AND a.r < b.r GROUP BY ALL)
      SELECT rep AS a, doc_id AS b, 1.0::DOUBLE AS overlap, true AS same FROM c UNION ALL SELECT a, b, round(m / (na + nb - m), 4), false FROM j WHERE m / (na + nb - m) >= 0.6""",
    "cross_tradition": f"WITH {_VECTORS} SELECT tradition, verse_id, round(score, 4) AS similarity, row_number() OVER (PARTITION BY tradition ORDER BY score DESC, verse_id)::INT AS rank FROM scored WHERE tradition <> (SELECT tradition FROM v WHERE verse_id = 0) QUALIFY rank <= 3",
    "pending_embeddings": f"WITH {_VECTORS} SELECT doc_id AS verse_id FROM documents WHERE doc_id NOT IN (SELECT verse_id FROM v WHERE model = 'm1')",
    "embedding_models": f"WITH {_VECTORS} SELECT model, count(*) AS n FROM v GROUP BY 1",
    "l2_normalize": "WITH d AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM d) SELECT vec_id AS verse_id, round(list_inner_product(v, v), 6) AS norm, round(v[1], 6) AS first FROM u",
    "engine_comparison": f"""WITH {_VECTORS}, {_TOP}, joint AS (SELECT query, count(*) AS n, max((ra = 1 AND rb = 1)::INT) AS same, sum((ra - rb) * (ra - rb)) AS d2 FROM top WHERE ra <= 10 AND rb <= 10 GROUP BY 1)
      SELECT t.query, round(coalesce(n, 0) / 10, 4) AS overlap, coalesce(same, 0) AS same_first, round(CASE WHEN n > 1 THEN 1 - 6 * d2 / (n * (n * n - 1)) END, 4) AS rho FROM (SELECT DISTINCT query FROM top) t LEFT JOIN joint USING (query)""",
    "translation_pending": "SELECT conv_id, turn FROM conversations c WHERE role = 'user' AND NOT EXISTS (FROM conversations a WHERE a.role = 'assistant' AND a.conv_id = c.conv_id AND a.turn = c.turn + 1)",
    "frequency_by_work": f"WITH {INDEX}, {_BY_WORK} SELECT * FROM by_work",
    "dispersion": f"WITH {INDEX}, {_BY_WORK} SELECT work_id, divisions_present, divisions_total, dispersion FROM by_work",
    "frequency_by_division": f"WITH {INDEX}, h AS (SELECT division_id, count(*) AS n FROM hits GROUP BY 1) SELECT ordinal, name, section, coalesce(n, 0) AS raw_count, total_tokens, {_rate('coalesce(n, 0)', 'total_tokens')} AS per_10k FROM divisions LEFT JOIN h USING (division_id) WHERE work_id = 'en-t3'",
    "frequency_by_section": f"""WITH {INDEX}, h AS (SELECT division_id, count(*) AS n FROM hits GROUP BY 1),
      s AS (SELECT coalesce(section, 'Sin sección') AS section, count(*) AS divisions, sum(total_tokens)::BIGINT AS total_tokens, coalesce(sum(n), 0)::BIGINT AS raw_count FROM divisions LEFT JOIN h USING (division_id) WHERE work_id = 'en-t3' GROUP BY 1) """
    + _keyness(f"SELECT *, {_rate('raw_count', 'total_tokens')} AS per_10k, (SELECT sum(raw_count)::BIGINT FROM s) - raw_count AS b, (SELECT sum(total_tokens)::BIGINT FROM s) - total_tokens AS d FROM s", "section, divisions, total_tokens, raw_count, per_10k", "raw_count", "b", "total_tokens", "d"),
    "keyness_matrix": f"WITH {INDEX}, {_BY_WORK}, s AS (SELECT * FROM by_work WHERE language = 'en') "
    + _keyness("SELECT *, (SELECT sum(raw_count)::BIGINT FROM s) - raw_count AS b, (SELECT sum(total_tokens)::BIGINT FROM s) - total_tokens AS d FROM s", "work_id, raw_count, total_tokens, per_10k", "raw_count", "b", "total_tokens", "d"),
    "keyness_pair": f"WITH {INDEX}, {_BY_WORK} "
    + _keyness(
        "SELECT x.work_id AS target_work_id, x.raw_count AS target_raw_count, x.total_tokens AS target_total_tokens, x.per_10k AS target_per_10k, y.work_id AS reference_work_id, y.raw_count AS reference_raw_count, y.total_tokens AS reference_total_tokens, y.per_10k AS reference_per_10k FROM by_work x, by_work y WHERE x.work_id = 'en-t3' AND y.work_id = 'en-t0'",
        "target_work_id, target_raw_count, target_total_tokens, target_per_10k, reference_work_id, reference_raw_count, reference_total_tokens, reference_per_10k", "target_raw_count", "reference_raw_count", "target_total_tokens", "reference_total_tokens",
    ),
    "heatmap": f"""WITH {INDEX}, h AS (SELECT division_id, count(*) AS n FROM hits GROUP BY 1), r AS (SELECT work_id, ordinal, coalesce(n, 0) AS raw_count, {_rate("coalesce(n, 0)", "total_tokens")} AS per_10k FROM divisions LEFT JOIN h USING (division_id))
      SELECT *, CASE WHEN per_10k > 0 THEN round(0.08::DOUBLE + 0.85::DOUBLE * per_10k / max(per_10k) OVER (PARTITION BY work_id), 4) ELSE 0.0 END AS intensity FROM r""",
    "surface_forms": f"WITH {INDEX} SELECT surface, count(*) AS count, count(DISTINCT verse_id) AS verse_count, round(100 * count(*) / (SELECT count(*) FROM hits), 1) AS share FROM hits GROUP BY 1",
    "top_surface": f"WITH {INDEX}, c AS (SELECT lemma, surface, count(*) AS count FROM idx GROUP BY 1, 2) SELECT lemma, surface, count FROM c QUALIFY row_number() OVER (PARTITION BY lemma ORDER BY count DESC, surface) = 1",
    "distinctive_vocabulary": f"""WITH {INDEX}, s AS (SELECT lemma, coalesce(sum(count) FILTER (work_id = 'en-t3'), 0)::BIGINT AS count, coalesce(sum(count) FILTER (work_id <> 'en-t3'), 0)::BIGINT AS count_elsewhere FROM totals WHERE work_id LIKE 'en-%' GROUP BY 1),
      k AS ({_keyness("SELECT s.*, (SELECT total_tokens FROM works WHERE work_id = 'en-t3') AS c, (SELECT sum(total_tokens)::BIGINT FROM works WHERE language = 'en' AND work_id <> 'en-t3') AS d FROM s WHERE count >= 5", "lemma, count, count_elsewhere, c", "count", "count_elsewhere", "c", "d")})
      SELECT lemma, count, count_elsewhere, {_rate("count", "c")} AS per_10k, log_likelihood, effect_size FROM k WHERE effect_size > 0 AND significant ORDER BY log_likelihood DESC, lemma LIMIT 50""",
    "concordance": f"""WITH {INDEX}, {_HIT_VERSES} SELECT work_id, works.title AS work_title, numbered.tradition, numbered.name AS division, verse_id, ref, text, hits, matched_forms, row_in_work::INT AS row_in_work
      FROM numbered JOIN works USING (work_id) WHERE row_in_work <= 40 ORDER BY numbered.tradition, ordinal, chapter, number, work_id, verse_id LIMIT 100""",
    "concordance_total": f"WITH {INDEX} SELECT count(DISTINCT verse_id) AS total FROM hits",
    "parallel": f"WITH {INDEX}, {_HIT_VERSES} SELECT work_id, tradition, row_in_work::INT AS row_in_work, ref, text, hits FROM numbered WHERE row_in_work <= 5",
    "collocations": f"""WITH {INDEX}, j AS (SELECT b.lemma, count(*) AS joint_count, min(b.surface) AS example FROM hits a JOIN idx b ON a.verse_id = b.verse_id AND b.position <> a.position AND abs(b.position - a.position) <= 5
        WHERE b.lemma NOT IN (FROM stems) GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 40)
      SELECT lemma, example, joint_count, round(log2((joint_count / n) / ((h / n) * (t / n))), 3) AS pmi FROM (SELECT j.*, (SELECT sum(total_tokens)::BIGINT FROM works) AS n, (SELECT count(*) FROM hits) AS h, (SELECT sum(count)::BIGINT FROM totals WHERE totals.lemma = j.lemma) AS t FROM j)""",
    "validate_language": f"WITH {VERSES}, {_VALID} SELECT * FROM valid",
    "corpus_clean": f"WITH {VERSES}, {_VALID} SELECT work_id, count(*) AS verses FROM verses WHERE work_id IN (SELECT work_id FROM valid WHERE valid) GROUP BY 1",
    "control_vocabulary": f"WITH {INDEX}, {_CONTROLS} SELECT * FROM missing",
    "corpus_health": f"""WITH {INDEX}, {_CONTROLS}, {_VALID}, c AS (SELECT language, count(*) AS n FROM controls GROUP BY 1), x AS (SELECT work_id, count(*) AS k FROM missing GROUP BY 1)
      SELECT w.work_id, valid AS language_ok, coalesce(k, 0) AS missing_words, coalesce(k, 0) <= coalesce(c.n, 0) // 2 AS vocabulary_ok, round(total_tokens / total_verses, 3) AS words_per_verse, total_tokens / total_verses >= 5 AS size_ok
      FROM works w LEFT JOIN valid USING (work_id) LEFT JOIN x USING (work_id) LEFT JOIN c ON c.language = w.language""",
}

_FORMS = "array_to_string(list_filter(string_split(matched_forms, ','), lambda w: length(w) > 2), '|')"

SQL |= {
    "vector_search_verses": f"WITH {INDEX}, {_VECTORS}, s AS (SELECT verse_id, round(score, 4) AS similarity FROM scored ORDER BY score DESC, verse_id LIMIT 20) SELECT verses.verse_id, similarity, work_id, title AS work_title, verses.tradition, ref, text FROM s JOIN verses ON verses.verse_id = s.verse_id * 1048576 + 1 JOIN works USING (work_id)",
    "engine_means": f"WITH e AS ({SQL['engine_comparison']}) SELECT count(*) AS queries, round(avg(overlap), 6) AS overlap, round(avg(same_first), 6) AS same_first, round(avg(rho), 6) AS rho FROM e",
    "model_choice": f"WITH {_VECTORS} SELECT model, count(*) AS n FROM v GROUP BY 1 ORDER BY CASE WHEN model LIKE 'm2%' THEN 0 WHEN model LIKE 'm0%' THEN 1 ELSE 2 END, n DESC, model LIMIT 1",
    "reduced_vectors": "WITH h AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS v FROM embeddings) SELECT vec_id AS verse_id, array_to_string(list_transform(v, lambda x: round(x / sqrt(list_inner_product(v, v)) * 127)::INT), ' ') AS codes FROM h",
    "highlight": rf"""WITH c AS ({SQL['concordance']}), p AS (SELECT verse_id, text, {_FORMS} AS forms FROM c)
      SELECT verse_id, CASE WHEN forms = '' THEN text ELSE regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_])((?:' || forms || ')[\p{{L}}\p{{N}}_]*)', '\1<mark>\2</mark>', 'gi') END AS text FROM p""",
    "query_words": "WITH w AS (SELECT lower(trim(unnest(string_split(text, ' ')), ' .,;:!¡?¿')) AS word FROM conversations WHERE role = 'user') SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1",
    "translation_cache": """SELECT u.conv_id, u.turn, a.turn IS NOT NULL AS cached, CASE WHEN u.conv_id % 3 <> 0 THEN nullif(a.text, '') END AS translation
      FROM conversations u LEFT JOIN conversations a ON a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'""",
    "gloss": f"WITH t AS ({SQL['top_surface']}) SELECT lemma, surface, length(surface) % 4 <> 0 AS cached, CASE WHEN length(surface) % 4 IN (2, 3) THEN reverse(surface) END AS translation FROM t",
    "frequency_table": f"WITH {INDEX}, {_BY_WORK} SELECT * FROM by_work WHERE raw_count > 0 ORDER BY per_10k DESC, work_id",
}

SQL |= {
    "normalize_decomposed": SQL["normalize_text"],
    "search_segments": SQL["search_text"],
    "collocations_placed": SQL["collocations"],
    # leads: places of the leaders so far; a result joins the first of them that is the same passage
    "vector_search_grouped": f"""WITH RECURSIVE {_VECTORS}, best AS (SELECT verse_id, round(score, 4) AS similarity FROM scored ORDER BY score DESC, verse_id LIMIT 40),
      p AS (SELECT verse_id, similarity, row_number() OVER (ORDER BY similarity DESC, verse_id) AS k, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z'']+'), lambda w: length(w) > 3)) AS w FROM best JOIN documents ON doc_id = verse_id),
      same AS (SELECT b.k, list(a.k) AS earlier FROM p a JOIN p b ON a.k < b.k AND len(a.w) > 0 AND len(b.w) > 0 AND 5 * len(list_intersect(a.w, b.w)) >= 3 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) GROUP BY 1),
      fold AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS lead, []::BIGINT[] AS leads UNION ALL
        SELECT n.k, n.lead, CASE WHEN n.lead IS NULL THEN list_append(n.leads, n.k) ELSE n.leads END FROM (SELECT p.k, list_min(list_intersect(f.leads, s.earlier)) AS lead, f.leads FROM fold f JOIN p ON p.k = f.k + 1 LEFT JOIN same s ON s.k = p.k) n),
      first AS (SELECT unnest(leads[1:20]) AS k FROM fold WHERE k = (SELECT max(k) FROM fold))
      SELECT p.verse_id, l.verse_id AS leader, p.similarity FROM fold f JOIN p USING (k) JOIN p l ON l.k = coalesce(f.lead, f.k) WHERE l.k IN (FROM first)""",
    "cross_tradition_all": f"WITH {_VECTORS}, pairs AS (SELECT a.verse_id AS query_id, b.tradition, b.verse_id, list_inner_product(b.vector, a.vector) AS s FROM v a, v b WHERE a.verse_id % 20 = 0 AND a.tradition <> b.tradition) SELECT query_id, tradition, verse_id, round(s, 4) AS similarity, row_number() OVER (PARTITION BY query_id, tradition ORDER BY s DESC, verse_id)::INT AS rank FROM pairs QUALIFY rank <= 3",
}
