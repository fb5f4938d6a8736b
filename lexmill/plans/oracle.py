"""DuckDB SQL with the same columns and rows as queries.py."""

from __future__ import annotations

from .queries import COMPONENTS, EXCLUDED, MIN_COUNT

W = "a-zß-öø-ÿœ"
TOKENIZE = f"regexp_extract_all(lower(text), '[{W}]+|[^{W}\\s]+')"
CORPORA = ("de", "en", "es", "fr")
RUN = "coalesce(list_bool_or(list_transform(range(1, greatest(length(token) - 2, 1)), lambda i: length(token) >= i + 3 AND substr(token, i, 4) = repeat(substr(token, i, 1), 4))), false)"
VALID = f"(regexp_full_match(token, '[{W}]{{2,30}}') AND NOT {RUN} AND len(list_distinct(string_split(token, ''))) > 1)"

TOK = f"""tok AS (SELECT doc_id, lang AS corpus, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, lang, {TOKENIZE} AS t FROM documents)),
val AS (SELECT token FROM (SELECT DISTINCT token FROM tok) WHERE {VALID})"""
CNT = TOK + """,
cnt AS (SELECT corpus, token AS word, count(*) AS cnt FROM tok SEMI JOIN val USING (token) GROUP BY ALL),
tot AS (SELECT corpus, CAST(sum(cnt) AS BIGINT) AS total FROM cnt GROUP BY ALL),
freq AS (SELECT corpus, word, CAST(cnt AS DOUBLE) / total AS freq FROM cnt JOIN tot USING (corpus))"""


def mix(weights: dict[str, float], name: str = "freq") -> str:
    return " + ".join(["CAST(0.0 AS DOUBLE)"] + [f"coalesce(max({name}) FILTER (corpus = '{c}'), CAST(0.0 AS DOUBLE)) * CAST({weights[c]!r} AS DOUBLE)" for c in CORPORA])


EQUAL = {c: 0.25 for c in CORPORA}
MERGED = CNT + f""",
merged AS (SELECT word, {mix(EQUAL)} AS freq, list_sort(list(corpus)) AS sources FROM freq GROUP BY word)"""
SEQ = TOK + """,
seq AS (SELECT corpus, doc_id, pos, CASE WHEN val.token IS NOT NULL THEN tok.token END AS w FROM tok LEFT JOIN val USING (token)),
win AS (SELECT corpus, w AS w1, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM seq WINDOW x AS (PARTITION BY corpus, doc_id ORDER BY pos)),
g1 AS (SELECT corpus, 1 AS n, w1, CAST(NULL AS VARCHAR) AS w2, CAST(NULL AS VARCHAR) AS w3, count(*) AS cnt FROM win WHERE w1 IS NOT NULL GROUP BY corpus, w1),
g2 AS (SELECT corpus, 2 AS n, w1, w2, CAST(NULL AS VARCHAR) AS w3, count(*) AS cnt FROM win WHERE w1 IS NOT NULL AND w2 IS NOT NULL GROUP BY corpus, w1, w2),
g3 AS (SELECT corpus, 3 AS n, w1, w2, w3, count(*) AS cnt FROM win WHERE w1 IS NOT NULL AND w2 IS NOT NULL AND w3 IS NOT NULL GROUP BY corpus, w1, w2, w3)"""
GRAMS = SEQ + f""",
g AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3),
gtot AS (SELECT corpus, n, CAST(sum(cnt) AS BIGINT) AS total FROM g GROUP BY ALL),
gf AS (SELECT g.*, CAST(cnt AS DOUBLE) / total AS f FROM g JOIN gtot USING (corpus, n)),
gm AS (SELECT n, w1, w2, w3, {mix(EQUAL, "f")} AS freq FROM gf GROUP BY n, w1, w2, w3),
raw AS (SELECT n, w1, w2, w3, CAST(sum(cnt) AS BIGINT) AS cnt FROM g GROUP BY ALL HAVING sum(cnt) >= 2),
src AS (SELECT w1 AS word, count(*) AS n_sources FROM g1 WHERE cnt >= 2 GROUP BY 1),
vt AS (SELECT src.word, n_sources, freq FROM src JOIN gm ON gm.n = 1 AND gm.w1 = src.word WHERE n_sources >= 2 AND freq >= 5e-6),
s2 AS (SELECT w1, w2, cnt FROM raw WHERE n = 2 AND cnt >= {MIN_COUNT} AND w1 IN (SELECT word FROM vt) AND w2 IN (SELECT word FROM vt)),
s3 AS (SELECT w1, w2, w3, cnt FROM raw WHERE n = 3 AND cnt >= {MIN_COUNT} AND w1 IN (SELECT word FROM vt) AND w2 IN (SELECT word FROM vt) AND w3 IN (SELECT word FROM vt)),
uni AS (SELECT word, log10(freq) AS score FROM vt),
bi AS (SELECT s2.w1, s2.w2, log10(b.freq / a.freq) AS score FROM s2 JOIN gm b ON b.n = 2 AND b.w1 = s2.w1 AND b.w2 = s2.w2 JOIN gm a ON a.n = 1 AND a.w1 = s2.w1),
tri AS (SELECT s3.w1, s3.w2, s3.w3, log10(c.freq / b.freq) AS score FROM s3 JOIN gm c ON c.n = 3 AND c.w1 = s3.w1 AND c.w2 = s3.w2 AND c.w3 = s3.w3 JOIN gm b ON b.n = 2 AND b.w1 = s3.w1 AND b.w2 = s3.w2)"""
ROMS = "list_sort(list_distinct(list_filter([word, regexp_replace(word, '[aeiou]', '', 'g'), replace(replace(word, 'th', 't'), 'ch', 'c')], lambda x: x <> '')))"
UPSERT = MERGED + f""",
up AS (SELECT word, freq, sources, CASE WHEN word = 'the' THEN ['da', 'the', 'thee'] ELSE {ROMS} END AS romanizations, word = 'the' AS overridden FROM merged
  UNION ALL SELECT 'lexmillword', (SELECT min(freq) FROM merged WHERE freq > 0), ['overrides'], ['lexmil', 'lexmill'], true
  UNION ALL SELECT 'the', (SELECT min(freq) FROM merged WHERE freq > 0), ['overrides'], ['da', 'the', 'thee'], true WHERE NOT EXISTS (SELECT 1 FROM merged WHERE word = 'the'))"""
LISTED = UPSERT + f""",
listed AS (SELECT * FROM up WHERE overridden OR word NOT IN ({", ".join(f"'{w}'" for w in EXCLUDED)})),
judged AS (SELECT *, CASE
    WHEN NOT overridden AND len(sources) < 2 AND NOT (len(sources) = 1 AND list_contains(sources, 'en')) THEN 'few_sources'
    WHEN NOT overridden AND freq < 5e-6 THEN 'low_frequency'
    WHEN NOT overridden AND list_min(list_transform(romanizations, lambda r: length(r))) > 0 AND length(regexp_replace(word, '[^{W}]', '', 'g')) / list_min(list_transform(romanizations, lambda r: length(r))) > 2.0 THEN 'length_ratio'
    WHEN len(romanizations) = 0 THEN 'no_variants' END AS removed_reason FROM listed),
entries AS (SELECT word, freq AS frequency, sources, romanizations, overridden FROM judged WHERE removed_reason IS NULL)"""
IDS = LISTED + """,
ided AS (SELECT CAST(row_number() OVER (ORDER BY round(frequency, 12) DESC, word) - 1 AS BIGINT) AS word_id, word, round(frequency, 12) AS frequency, sources, romanizations FROM entries)"""
NUCLEI = "greatest(1, len(regexp_extract_all(word, '[aeiouyäöüéèêáíó ú]')))".replace("ó ú", "óú")
DOUBTFUL = LISTED + f""",
first AS (SELECT word, round(freq, 12) AS frequency, len(sources) AS source_count,
    coalesce(list_reduce(list_prepend('', romanizations), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END), '') AS max_rom,
    coalesce(list_reduce(romanizations, lambda a, x: CASE WHEN length(x) < length(a) THEN x ELSE a END), '') AS min_rom FROM listed),
h AS (SELECT *, {NUCLEI} AS nuclei, len(regexp_extract_all(word, '[bcdfghjklmnpqrstvwxzßçñ]')) AS consonants, length(regexp_replace(word, '[^{W}]', '', 'g')) AS base_len,
    CASE WHEN max_rom = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(lower(max_rom), '[aeiouy]+'))) END AS rom_clusters,
    len(regexp_extract_all(lower(max_rom), '[^aeiouy\\s]')) AS rom_consonants FROM first)"""
KEYS = MERGED + """,
keys AS (SELECT word, round(freq, 12) AS freq FROM merged)"""
EDGES = f"""edge AS (SELECT query_id, len AS n, s - 1 AS s, s - 1 + k AS e, word, -ln(greatest(freq, 1e-7)) + 0.5 AS c
  FROM (SELECT query_id, length(text) AS len, s, k, substr(text, s, k) AS piece FROM q, unnest(range(1, length(text) + 1)) AS t(s), unnest(range(1, 31)) AS u(k) WHERE s + k <= length(text) + 1) JOIN keys ON piece = word)"""
TOGETHER = KEYS + f""",
q AS (SELECT item_id AS query_id, array_to_string(list_filter({TOKENIZE}, lambda token: {VALID}), '') AS text FROM benchmark),
{EDGES}"""
SEARCH = KEYS + f""",
bw AS (SELECT DISTINCT token FROM (SELECT unnest({TOKENIZE}) AS token FROM benchmark) WHERE {VALID}),
q AS (SELECT token AS query_id, token AS text FROM bw),
{EDGES},
paths AS (SELECT query_id, n, e AS place, c AS cost, word AS words, word AS output FROM edge WHERE s = 0
  UNION ALL SELECT p.query_id, p.n, x.e, p.cost + x.c, p.words || ' ' || x.word, p.output || x.word FROM paths p JOIN edge x ON p.query_id = x.query_id AND p.place = x.s)"""
WIKI = r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
'<!-- x -->== H ==' || chr(10) || '* ''''''B'''''' [[A|b]] [[C]] {{t|{{u}}}}<ref>r</ref>' || chr(10) || html,
'<!--.*?-->', '', 'gs'), '\{\|.*?\|\}', '', 'gs'), '<ref[^>]*>.*?</ref>|<ref[^/>]*/>', '', 'gs'), '\[\[(?:หมวดหมู่|Category):[^\]]+\]\]', '', 'g'), '\[\[(?:ไฟล์|File|Image):[^\]]+\]\]', '', 'g'),
'\{\{[^{}]*\}\}', '', 'g'), '\{\{[^{}]*\}\}', '', 'g'), '\{\{[^{}]*\}\}', '', 'g'), '\{\{[^{}]*\}\}', '', 'g'), '\{\{[^{}]*\}\}', '', 'g'),
'\[\[[^\]]*?\|([^\]]+)\]\]', '\1', 'g'), '\[\[([^\]|]+)\]\]', '\1', 'g'), '\[https?://[^\]]*\]', '', 'g'), '<[^>]+>', '', 'g'), '''{2,5}', '', 'g'), '(?m)^=+.*?=+$', '', 'g'), '(?m)^[*#:;]+\s*', '', 'g') AS text
FROM pages"""
PAIRS = f""",
pairs AS (SELECT CASE WHEN length(token) % 3 = 0 THEN reverse(token) ELSE regexp_replace(token, '[aeiou]', '', 'g') END AS latin_input, token AS expected
  FROM (SELECT DISTINCT unnest({TOKENIZE}) AS token FROM benchmark) WHERE {VALID}),
rec AS (SELECT latin_input, expected, e.word IS NOT NULL AS has_word, coalesce(list_contains(romanizations, lower(latin_input)), false) AS has_key, len(romanizations) AS n_variants FROM pairs LEFT JOIN entries e ON e.word = expected)"""


ITEMS = "d AS (SELECT doc_id, text, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents)"
NUMBER = "CAST('0x' || substr(md5(query_id), 1, 15) AS BIGINT)"
STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
PARTS = MERGED + """,
best AS (SELECT x.word, s, max(k) AS k FROM (SELECT word, s, k, substr(word, s, k) AS piece FROM merged, unnest(range(1, length(word) + 1)) AS t(s), unnest(range(3, length(word))) AS u(k) WHERE length(word) >= 10 AND s + k <= length(word) + 1) x
  SEMI JOIN merged m ON m.word = x.piece GROUP BY ALL),
steps AS (SELECT word, 1 AS place, '' AS parts FROM merged WHERE length(word) >= 10
  UNION ALL SELECT x.word, place + k, CASE WHEN parts = '' THEN '' ELSE parts || '|' END || substr(x.word, place, k) FROM steps x JOIN best b ON b.word = x.word AND b.s = x.place),
done AS (SELECT word, parts FROM steps WHERE place = length(word) + 1)"""


def rows(table: list[tuple], kind: str) -> str:
    return ", ".join(f"('{g}', {list(v)!r})" for k, g, v in table if k == kind)


SYLLABLES = f"""
WITH o AS (SELECT * FROM (VALUES {rows(COMPONENTS, "onset")}) t(onset, os)), v AS (SELECT * FROM (VALUES {rows(COMPONENTS, "vowel")}) t(vowel, vs)),
c AS (SELECT * FROM (VALUES {rows(COMPONENTS, "coda")}, ('', [''])) t(coda, cs)),
a AS (SELECT onset, vowel, coda, os, cs, list_filter(vs, lambda x: NOT (vowel = 'a' AND coda = '' AND x = 'u') AND NOT (coda IN ('j', 'w') AND right(x, 1) IN ('r', 'h'))) AS vs FROM o, v, c),
b AS (SELECT onset, vowel, coda, os, vs, CASE WHEN coda = 'w' AND len(list_filter(vs, lambda x: right(x, 1) = 'i')) > 0 THEN list_filter(cs, lambda x: x <> 'o') ELSE cs END AS cs FROM a)
SELECT onset || '-' || vowel || '-' || coda AS syllable_id, array_to_string(list_sort(list_distinct(list(x || y || z))), '|') AS variants
FROM b, unnest(os) t1(x), unnest(vs) t2(y), unnest(cs) t3(z) GROUP BY ALL"""
SOURCES, JOINED_ROMS = "array_to_string(sources, '|') AS sources", "array_to_string(romanizations, '|') AS romanizations"
RANK = lambda c: f"CAST(max(r) FILTER (corpus = '{c}') AS INTEGER) AS {c}_rank"
FLAGS = f"regexp_full_match(token, '[{W}]+')"

SQL = {
    "word_counts": f"WITH {CNT} SELECT * FROM cnt",
    "word_freq_normalized": f"WITH {CNT} SELECT * FROM freq",
    "word_freq_merged": f"WITH {MERGED} SELECT word, round(freq, 12) AS freq FROM merged",
    "word_freq_merged_weighted": f"WITH {CNT} SELECT word, round({mix({'de': 0.2, 'en': 0.4, 'es': 0.2, 'fr': 0.2})}, 12) AS freq FROM freq GROUP BY word",
    "word_provenance": f"WITH {MERGED} SELECT word, len(sources) AS n_sources, {SOURCES} FROM merged",
    "wordlist_ranked": f"WITH {MERGED} SELECT row_number() OVER (ORDER BY round(freq, 12) DESC, word) AS rank, word, round(freq, 12) AS frequency, len(sources) AS source_count, {SOURCES} FROM merged",
    "topk_words_with_ranks": f"""WITH {MERGED}, top AS (SELECT word, round(freq, 12) AS merged_freq FROM merged ORDER BY 2 DESC, 1 LIMIT 500),
        r AS (SELECT corpus, word, row_number() OVER (PARTITION BY corpus ORDER BY freq DESC, word) AS r FROM freq SEMI JOIN top USING (word)),
        w AS (SELECT word, {", ".join(RANK(c) for c in CORPORA)}, count(*) AS corpus_count FROM r GROUP BY word)
        SELECT row_number() OVER (ORDER BY merged_freq DESC, word) AS rank, * FROM top LEFT JOIN w USING (word)""",
    "source_word_stats": f"WITH {MERGED} SELECT source, count(*) AS words, count(*) FILTER (n = 1) AS unique_words FROM (SELECT len(sources) AS n, unnest(sources) AS source FROM merged) GROUP BY source",
    "token_validity_flags": f"WITH {TOK} SELECT token, length(token) BETWEEN 2 AND 30 AS length_ok, {FLAGS} AS script_ok, NOT {RUN} AS no_run, len(list_distinct(string_split(token, ''))) > 1 AS not_one_letter, {VALID} AS valid FROM (SELECT DISTINCT token FROM tok)",
    "token_segments": f"WITH {SEQ}, n AS (SELECT *, sum(CASE WHEN w IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY corpus, doc_id ORDER BY pos) AS seg_id FROM seq) SELECT corpus, doc_id, pos, CAST(seg_id AS BIGINT) AS seg_id, w AS token FROM n WHERE w IS NOT NULL",
    "ngram1_counts": f"WITH {SEQ} SELECT corpus, w1, cnt FROM g1",
    "ngram2_counts": f"WITH {SEQ} SELECT corpus, w1, w2, cnt FROM g2",
    "ngram3_counts": f"WITH {SEQ} SELECT corpus, w1, w2, w3, cnt FROM g3",
    "ngram_raw_merged": f"WITH {GRAMS} SELECT * FROM raw",
    "ngram_norm_merged": f"WITH {GRAMS} SELECT n, w1, w2, w3, round(freq, 12) AS freq FROM gm",
    "ngrams_vocab_filtered": f"""WITH {SEQ}, top AS (SELECT w AS word FROM seq WHERE w IS NOT NULL GROUP BY w ORDER BY count(*) DESC, w LIMIT 1000),
        s AS (SELECT corpus, doc_id, pos, CASE WHEN w IN (SELECT word FROM top) THEN w END AS w FROM seq),
        b AS (SELECT corpus, w AS w1, lead(w) OVER (PARTITION BY corpus, doc_id ORDER BY pos) AS w2 FROM s)
        SELECT corpus, w1, w2, count(*) AS cnt FROM b WHERE w1 IS NOT NULL AND w2 IS NOT NULL GROUP BY ALL""",
    "token_source_counts": f"WITH {GRAMS} SELECT * FROM src",
    "valid_tokens": f"WITH {GRAMS} SELECT word, n_sources, round(freq, 12) AS freq FROM vt",
    "surviving_bigrams": f"WITH {GRAMS} SELECT * FROM s2",
    "surviving_trigrams": f"WITH {GRAMS} SELECT * FROM s3",
    "lm_unigram_scores": f"WITH {GRAMS} SELECT word, round(score, 9) AS score FROM uni",
    "lm_bigram_scores": f"WITH {GRAMS} SELECT w1, w2, round(score, 9) AS score FROM bi",
    "lm_trigram_scores": f"WITH {GRAMS} SELECT w1, w2, w3, round(score, 9) AS score FROM tri",
    "sbo_backoff_lookup": f"""WITH {GRAMS}, b AS (SELECT item_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT item_id, {TOKENIZE} AS t FROM benchmark)),
        bs AS (SELECT item_id, pos, CASE WHEN {VALID} THEN token END AS w FROM b),
        bw AS (SELECT w AS prev2, lead(w) OVER x AS prev1, lead(w, 2) OVER x AS word FROM bs WINDOW x AS (PARTITION BY item_id ORDER BY pos)),
        qs AS (SELECT DISTINCT * FROM bw WHERE prev2 IS NOT NULL AND prev1 IS NOT NULL AND word IS NOT NULL)
        SELECT prev2, prev1, qs.word, round(coalesce(pow(10.0, tri.score), CAST(0.4 AS DOUBLE) * coalesce(pow(10.0, bi.score), CAST(0.4 AS DOUBLE) * coalesce(pow(10.0, uni.score), CAST(6e-6 AS DOUBLE)))), 12) AS prob
        FROM qs LEFT JOIN uni ON uni.word = qs.word LEFT JOIN bi ON bi.w1 = prev1 AND bi.w2 = qs.word LEFT JOIN tri ON tri.w1 = prev2 AND tri.w2 = prev1 AND tri.w3 = qs.word""",
    "clean_wikitext_pages": WIKI,
    "html_tag_strip": "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages",
    "overrides_upsert": f"WITH {UPSERT} SELECT word, round(freq, 12) AS freq, {SOURCES}, {JOINED_ROMS}, overridden FROM up",
    "exclusion_antijoin": f"WITH {LISTED} SELECT word, overridden FROM listed",
    "dataset_filter_reasons": f"WITH {LISTED} SELECT removed_reason, count(*) AS n FROM judged GROUP BY 1",
    "dataset_filtered": f"WITH {LISTED} SELECT word, round(frequency, 12) AS frequency, overridden FROM entries",
    "vocab_limit": f"WITH {LISTED} SELECT word, overridden FROM listed WHERE overridden UNION ALL SELECT word, overridden FROM (SELECT word, overridden FROM listed WHERE NOT overridden ORDER BY round(freq, 12) DESC, word LIMIT 98)",
    "trie_dataset_entries": f"WITH {IDS} SELECT word_id, word, frequency, {SOURCES}, {JOINED_ROMS} FROM ided",
    "trie_flat_keys": f"WITH {IDS} SELECT word_id, word, unnest(romanizations) AS romanization_key, frequency, {SOURCES} FROM ided",
    "key_collisions": f"WITH {LISTED}, k AS (SELECT DISTINCT unnest(romanizations) AS romanization_key, word FROM listed) SELECT romanization_key, count(*) AS n_words, array_to_string(list_sort(list(word)), '|') AS words FROM k GROUP BY 1 HAVING count(*) >= 2",
    "collision_histogram": f"WITH {LISTED}, k AS (SELECT DISTINCT unnest(romanizations) AS k, word FROM listed) SELECT n_words, count(*) AS n_keys FROM (SELECT k, count(*) AS n_words FROM k GROUP BY k) GROUP BY 1",
    "source_coverage": f"WITH {LISTED}, x AS (SELECT len(romanizations) AS n, len(sources) AS k, unnest(sources) AS source FROM listed) SELECT source, count(*) AS total, count(*) FILTER (n > 0) AS success, count(*) FILTER (n = 0) AS failed, CAST(sum(n) AS BIGINT) AS variant_sum, count(*) FILTER (k = 1) AS unique_words FROM x GROUP BY 1",
    "coverage_by_source_count": f"WITH {LISTED} SELECT len(sources) AS source_count, count(*) AS total, count(*) FILTER (len(romanizations) > 0) AS success, CAST(sum(len(romanizations)) AS BIGINT) AS variant_sum FROM listed GROUP BY 1",
    "variant_stats": f"WITH {LISTED}, n AS (SELECT len(romanizations) AS n FROM listed) SELECT count(*) AS vocab_size, CAST(sum(n) AS BIGINT) AS total_keys, round(avg(n), 9) AS avg_variants, min(n) AS min_variants, max(n) AS max_variants, (SELECT count(DISTINCT k) FROM (SELECT unnest(romanizations) AS k FROM listed)) AS unique_keys, list_sort(list(n))[count(*) // 2 + 1] AS median_variants FROM n",
    "variant_buckets": f"WITH {LISTED} SELECT CASE WHEN len(romanizations) = 0 THEN '0' WHEN len(romanizations) <= 5 THEN '1-5' WHEN len(romanizations) <= 10 THEN '6-10' WHEN len(romanizations) <= 20 THEN '11-20' WHEN len(romanizations) <= 50 THEN '21-50' ELSE '51+' END AS bucket, count(*) AS n_words FROM listed GROUP BY 1",
    "review_filter": f"WITH {LISTED} SELECT word FROM entries WHERE list_contains(sources, 'en') AND len(sources) >= 2 AND len(romanizations) >= 2 AND (contains(word, 'th') OR len(list_filter(romanizations, lambda r: contains(r, 'th'))) > 0)",
    "review_page": f"WITH {LISTED} SELECT word, round(frequency, 12) AS frequency FROM entries ORDER BY 2 DESC, 1 LIMIT 30 OFFSET 20",
    "heuristic_h1": f"WITH {DOUBTFUL} SELECT word, frequency, source_count, nuclei, rom_clusters, nuclei - rom_clusters AS discrepancy, max_rom FROM h WHERE nuclei - rom_clusters >= 1",
    "heuristic_h2": f"WITH {DOUBTFUL} SELECT word, frequency, source_count, consonants, rom_consonants, 0 AS silent, consonants - rom_consonants AS discrepancy, max_rom FROM h WHERE consonants - rom_consonants >= 2",
    "heuristic_h3": f"WITH {DOUBTFUL}, r AS (SELECT *, CASE WHEN length(min_rom) > 0 THEN base_len / length(min_rom) ELSE 999.0 END AS ratio FROM h) SELECT word, frequency, source_count, base_len, length(min_rom) AS min_rom_len, round(ratio, 2) AS ratio, min_rom FROM r WHERE ratio > 2.0",
    "heuristic_h4": f"WITH {DOUBTFUL} SELECT word, frequency, source_count, consonants, length(max_rom) AS max_rom_len, max_rom FROM h WHERE consonants >= 3 AND length(max_rom) <= 5",
    "classify_words": f"""WITH {IDS}, w AS (SELECT word, romanizations[-1] AS rom, len(romanizations) * 4 AS many, {NUCLEI} AS n, word IN ('the', 'es', 'en', 'de') AS a FROM ided),
        c AS (SELECT *, regexp_matches(lower(rom), '^(kh|th|ph|ch|kr|tr|pr|kl|pl|bl|fr|fl)') AS k FROM w)
        SELECT word, CASE WHEN a THEN 'ambiguous' WHEN n >= 3 THEN 'compound' WHEN many > 10 THEN 'variant' WHEN length(word) <= 2 AND n = 1 THEN 'edge' ELSE 'common' END AS category,
        CASE WHEN n >= 4 OR (a AND n >= 2) THEN 'hard' WHEN (n = 1 AND NOT k) OR (n <= 2 AND many <= 5) THEN 'easy' WHEN n >= 3 OR k OR many > 8 THEN 'medium' ELSE 'easy' END AS difficulty FROM c""",
    "benchmark_export": f"WITH {IDS} SELECT unnest(romanizations) AS latin_input, word AS expected, CASE WHEN length(word) > 6 THEN 'compound' ELSE 'common' END AS category, CASE WHEN length(word) > 8 THEN 'hard' WHEN length(word) > 4 THEN 'medium' ELSE 'easy' END AS difficulty FROM ided WHERE word_id % 3 <> 1",
    "llm_batches": f"WITH {MERGED}, r AS (SELECT word, row_number() OVER (ORDER BY round(freq, 12) DESC, word) - 1 AS r FROM merged) SELECT CAST(r // 100 AS BIGINT) AS batch, count(*) AS n, string_agg(word, '|' ORDER BY r) AS words FROM r WHERE r < 1000 GROUP BY 1",
    "llm_parse": f"WITH {MERGED}, r AS (SELECT word, row_number() OVER (ORDER BY round(freq, 12) DESC, word) - 1 AS r FROM merged) SELECT word FROM r WHERE r < 1000 AND r % 100 < 3",
    "release_hash_diff": """WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS name, md5(text) AS h FROM documents), a AS (SELECT name, h FROM d WHERE doc_id % 5 <> 0), b AS (SELECT name, CASE WHEN doc_id % 11 = 0 THEN 'other' ELSE h END AS h FROM d WHERE doc_id % 7 <> 0)
        SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'NEW' WHEN a.name IS NULL THEN 'REMOVED' WHEN a.h = b.h THEN 'UNCHANGED' ELSE 'CHANGED' END AS status FROM a FULL JOIN b ON a.name = b.name""",
    "benchmark_recall": f"""WITH {LISTED}{PAIRS}, t AS (SELECT count(*) AS total, count(*) FILTER (has_key) AS hits, count(*) FILTER (NOT has_word) AS word_missing, count(*) FILTER (has_word AND NOT has_key) AS key_missing, count(DISTINCT expected) AS unique_words, count(DISTINCT expected) FILTER (has_word) AS words_covered, count(DISTINCT expected) FILTER (n_variants = 0) AS zero_variant_words FROM rec)
        SELECT *, round(coalesce(hits / nullif(total, 0), 0), 9) AS recall, round(coalesce(hits / nullif(total - word_missing, 0), 0), 9) AS adjusted_recall FROM t""",
    "benchmark_missed": f"WITH {LISTED}{PAIRS} SELECT latin_input, expected, CASE WHEN has_word THEN 'key_missing' ELSE 'word_missing' END AS reason FROM rec WHERE NOT has_key",
    "ranking_coverage_rollup": f"""WITH {GRAMS}, t AS (SELECT item_id, {TOKENIZE} AS t FROM benchmark),
        b AS (SELECT CASE item_id % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'bigram' ELSE 'compound' END AS type, CASE WHEN item_id % 3 = 0 THEN '' ELSE coalesce(t[1], '') END AS w1, coalesce(t[2], '') AS w2 FROM t),
        hit AS (SELECT type, CASE WHEN w1 <> '' AND w2 <> '' THEN EXISTS (SELECT 1 FROM raw r WHERE r.n = 2 AND r.w1 = b.w1 AND r.w2 = b.w2) ELSE EXISTS (SELECT 1 FROM raw r WHERE r.n = 1 AND r.w1 = CASE WHEN b.w2 <> '' THEN b.w2 ELSE b.w1 END) END AS ok FROM b)
        SELECT coalesce(type, 'TOTAL') AS type, count(*) AS total, count(*) FILTER (ok) AS hits FROM hit GROUP BY ROLLUP (type)""",
    "metrics_mrr_p_at_k": f"""WITH {ITEMS}, j AS (SELECT w, string_split(b.text, ' ')[3] AS e FROM (SELECT item_id, string_split(text, ' ') AS w FROM d) d JOIN benchmark b USING (item_id)),
        r AS (SELECT len(w) AS n, CASE WHEN list_contains(w, e) THEN len(list_distinct(w[1:list_position(w, e)])) ELSE 0 END AS p FROM j)
        SELECT count(*) AS n, round(avg(CASE WHEN p = 1 THEN 1.0 ELSE 0.0 END), 9) AS p_at_1, round(avg(CASE WHEN p BETWEEN 1 AND 3 THEN 1.0 ELSE 0.0 END), 9) AS p_at_3, round(avg(CASE WHEN p BETWEEN 1 AND 10 THEN 1.0 ELSE 0.0 END), 9) AS p_at_10,
        round(avg(CASE WHEN p > 0 THEN 1 / p ELSE 0 END), 9) AS mrr, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 9) AS coverage FROM r""",
    "metrics_word_f1": f"""WITH {ITEMS}, j AS (SELECT doc_id, list_distinct(string_split(d.text, ' ')) AS p, list_distinct(string_split(b.text, ' ')) AS e FROM d JOIN benchmark b USING (item_id)), h AS (SELECT doc_id, len(list_intersect(p, e)) AS h, len(p) AS n, len(e) AS m FROM j)
        SELECT doc_id, round(h / n, 9) AS precision, round(h / m, 9) AS recall, round(CASE WHEN h = 0 THEN 0 ELSE 2.0 * h / (n + m) END, 9) AS f1 FROM h""",
    "syllable_variants": SYLLABLES,
    "lattice_edges": f"WITH {TOGETHER} SELECT query_id, s, e, word FROM edge",
    "kbest_paths_exhaustive": f"WITH RECURSIVE {SEARCH} SELECT {NUMBER} AS query_id, words, round(cost, 9) AS cost FROM paths WHERE place = n",
    "kbest_paths_viterbi": f"WITH RECURSIVE {SEARCH}, o AS (SELECT query_id, output, min(cost) AS cost FROM paths WHERE place = n GROUP BY 1, 2) SELECT {NUMBER} AS query_id, output, round(cost, 9) AS cost FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cost, output) = 1",
    "compound_decompose": f"WITH RECURSIVE {PARTS} SELECT word, parts FROM done",
    "wordlist_redistributed": f"""WITH RECURSIVE {PARTS},
        given AS (SELECT unnest(string_split(parts, '|')) AS word, freq / len(string_split(parts, '|')) AS share, sources FROM done JOIN merged USING (word)),
        more AS (SELECT word, sum(share) AS share, flatten(list(sources)) AS more FROM given GROUP BY word)
        SELECT m.word, round(freq + coalesce(share, 0), 12) AS freq, array_to_string(list_sort(list_distinct(list_concat(sources, coalesce(more, [])))), '|') AS sources FROM merged m LEFT JOIN more USING (word) WHERE m.word NOT IN (SELECT word FROM done)""",
    "source_lines": f"SELECT 'lines' AS corpus, {STRIPPED.format('t')} AS text FROM (SELECT regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS t FROM conversations) WHERE {STRIPPED.format('t')} <> ''",
    "source_delimited": f"SELECT 'delimited' AS corpus, text FROM documents WHERE {STRIPPED.format('text')} <> ''",
    "source_titled": "SELECT 'titled' AS corpus, 'No. ' || doc_id AS text FROM documents UNION ALL SELECT 'titled', text FROM documents WHERE text <> ''",
    "source_wiki": "SELECT 'wiki' AS corpus, text FROM benchmark UNION ALL SELECT 'wiki', text FROM benchmark",
    "source_words": f"WITH {MERGED} SELECT word FROM merged WHERE length(word) % 7 <> 0",
    "file_gram_counts": f"WITH {GRAMS} SELECT w1, w2, cnt FROM raw WHERE n = 2",
    "file_gram_freqs": f"WITH {GRAMS} SELECT w1, round(freq, 12) AS freq FROM gm WHERE n = 1",
    "file_tokens": f"WITH {CNT} SELECT corpus, word, cnt FROM cnt",
    "file_wordlist": f"WITH {MERGED} SELECT row_number() OVER (ORDER BY round(freq, 12) DESC, word) AS rank, word, round(freq, 12) AS frequency, CAST(len(sources) AS INTEGER) AS source_count, {SOURCES} FROM merged",
    "file_first_words": f"WITH {MERGED} SELECT row_number() OVER (ORDER BY round(freq, 12) DESC, word) AS rank, word FROM merged QUALIFY rank <= 100",
    "file_variants": f"WITH {MERGED} SELECT word, array_to_string({ROMS}, '|') AS romanizations FROM merged",
    "file_flat_keys": f"WITH {IDS} SELECT word_id, word, unnest(romanizations) AS romanization_key, frequency, {SOURCES} FROM ided",
    "file_report": f"WITH {LISTED}{PAIRS} SELECT latin_input, expected FROM pairs",
    "corpus_sizes": f"WITH {SEQ}, d AS (SELECT lang AS corpus, count(*) AS texts FROM documents GROUP BY 1) SELECT corpus, texts, count(*) AS tokens, count(w) AS valid_tokens FROM d JOIN seq USING (corpus) GROUP BY ALL",
    "streaming_word_counts": f"WITH {CNT} SELECT * FROM cnt",
}


#: Columns that are 32-bit in Spark.
INTS = {
    "word_provenance": ["n_sources"], "wordlist_ranked": ["source_count"], "topk_words_with_ranks": ["rank"], "token_segments": ["pos", "seg_id"],
    "coverage_by_source_count": ["source_count"], "variant_stats": ["min_variants", "max_variants", "median_variants"],
    "heuristic_h1": ["source_count", "nuclei", "rom_clusters", "discrepancy"], "heuristic_h2": ["source_count", "consonants", "rom_consonants", "discrepancy"],
    "heuristic_h3": ["source_count", "base_len", "min_rom_len"], "heuristic_h4": ["source_count", "consonants", "max_rom_len"],
    "llm_batches": ["n"], "lattice_edges": ["s", "e"],
}


def oracle_sql() -> dict[str, str]:
    typed = lambda k, q: f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in INTS[k])}) FROM ({q}) AS q" if k in INTS else q
    return {k: typed(k, q) for k, q in SQL.items()}
