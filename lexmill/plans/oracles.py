"""The core queries in DuckDB's SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations


def _corpus(column: str = "corpus", least: int = 2) -> str:
    return f"""
docs AS (SELECT {column} AS corpus, doc_id AS doc_ord, coalesce(text, '') AS text FROM documents WHERE {column} IS NOT NULL),
listed AS (SELECT corpus, doc_ord, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{{least},}}')) AS toks FROM docs),
toks AS (SELECT corpus, doc_ord, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM listed),
freq AS (SELECT corpus, tok, count(*) AS c FROM toks GROUP BY corpus, tok)"""


_POS = """,
pos AS (SELECT corpus, tok, row_number() OVER (PARTITION BY corpus ORDER BY doc_ord, pos) - 1 AS gpos FROM toks),
sizes AS (SELECT corpus, count(*) AS n FROM toks GROUP BY corpus)"""

_STATS = """,
sums AS (SELECT corpus, sum(c)::DOUBLE AS n, count(*)::DOUBLE AS v, sum(c * c)::DOUBLE AS s2, sum((c = 1)::INT)::DOUBLE AS h1,
    sum(c * length(tok))::DOUBLE AS chars, sum(c * log2(c::DOUBLE)) AS clog FROM freq GROUP BY corpus),
base AS (SELECT *, greatest(0, log2(n) - clog / n) AS h FROM sums),
stats AS (SELECT corpus, n::BIGINT AS n_tokens, v::BIGINT AS vocab_size, v / n AS ttr, v / sqrt(n) AS root_ttr,
    CASE WHEN n > 1 AND v > 1 THEN ln(v) / ln(n) ELSE 0 END AS log_ttr, h1 / n AS hapax_ratio,
    CASE WHEN n >= 2 THEN 10000 * (s2 - n) / (n * n) ELSE 0 END AS yules_k, CASE WHEN n >= 2 THEN 1 - (s2 - n) / (n * (n - 1)) ELSE 0 END AS simpsons_d,
    h AS entropy, CASE WHEN v > 1 THEN h / log2(v) ELSE 0 END AS norm_entropy, pow(2, h) AS perplexity, chars / n AS avg_word_len FROM base)"""

_MEASURES = ("n_tokens", "vocab_size", "ttr", "root_ttr", "log_ttr", "hapax_ratio", "yules_k", "simpsons_d", "entropy", "norm_entropy", "perplexity", "avg_word_len")
_ROUNDED = ", ".join(m if m in ("n_tokens", "vocab_size") else f"round({m}, 6) AS {m}" for m in _MEASURES)
_ROUNDED_0 = ", ".join(f"coalesce({m}, 0) AS {m}" if m in ("n_tokens", "vocab_size") else f"coalesce(round({m}, 6), 0) AS {m}" for m in _MEASURES)


def _full_stats(column: str) -> str:
    return f"WITH {_corpus(column)}{_STATS} SELECT corpus, {_ROUNDED_0} FROM (SELECT DISTINCT corpus FROM docs) LEFT JOIN stats USING (corpus)"


_SPACE = "\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _clean(x: str) -> str:
    untagged = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')"
    unlinked = f"regexp_replace({untagged}, 'https?://[^{_SPACE}]+|www\\.[^{_SPACE}]+', ' ', 'g')"
    return _strip(f"regexp_replace(lower({unlinked}), '[{_SPACE}]+', ' ', 'g')")


def _dataset(name: str, key: str, fields: str) -> str:
    return f"""(SELECT try_cast(regexp_replace(regexp_replace(k, '\\.0+\\s*$', ''), '\\D', '', 'g') AS BIGINT) AS entity, * EXCLUDE (k) FROM (
  SELECT rid, max({key}::VARCHAR) AS k, max(post) AS post, {', '.join(f'max({f}) AS {f}' for f in fields.split())} FROM {name} WHERE rid IS NOT NULL GROUP BY rid))"""


_SETS = f"""
pl AS {_dataset('political_leaning', 'author_ID', 'political_leaning attrs')},
b AS {_dataset('birth_year', 'auhtor_ID', 'birth_year')},
n AS {_dataset('nationality', '"author_ID "', 'nationality gender')},
keys AS (SELECT DISTINCT 'birth_year' AS ds, entity FROM b WHERE entity IS NOT NULL UNION ALL SELECT DISTINCT 'nationality', entity FROM n WHERE entity IS NOT NULL
  UNION ALL SELECT DISTINCT 'political_leaning', entity FROM pl WHERE entity IS NOT NULL),
named AS (SELECT * FROM (VALUES ('b_y+n', 'birth_year', 'nationality'), ('b_y+p_l', 'birth_year', 'political_leaning'), ('n+p_l', 'nationality', 'political_leaning')) t(corpus, df1, df2)),
pairs AS (SELECT corpus, df1, df2, x.entity FROM named JOIN keys x ON x.ds = df1 JOIN keys y ON y.ds = df2 AND y.entity = x.entity),
merged AS (SELECT corpus, df1, df2, count(*) AS merged_rows FROM pairs GROUP BY ALL),
rows AS (SELECT 'birth_year' AS dataset, count(*) AS n_rows FROM b UNION ALL SELECT 'nationality', count(*) FROM n UNION ALL SELECT 'political_leaning', count(*) FROM pl),
allposts AS (SELECT 'birth_year' AS ds, entity, rid, post FROM b UNION ALL SELECT 'nationality', entity, rid, post FROM n UNION ALL SELECT 'political_leaning', entity, rid, post FROM pl),
sided AS (SELECT corpus, p.entity, post, rid, CASE WHEN ds = df1 THEN 0 ELSE 1 END AS side FROM pairs p JOIN allposts a ON a.entity = p.entity AND a.ds IN (df1, df2) WHERE post IS NOT NULL),
mposts AS (SELECT corpus, entity, post, min((side, rid)) AS ord FROM sided GROUP BY corpus, entity, post)"""

_KEYS = {"birth_year": "auhtor_ID", "nationality": '"author_ID "', "political_leaning": "author_ID"}
_PAIRWISE = "WITH " + ", ".join(
    f"""k{i} AS MATERIALIZED (SELECT DISTINCT entity FROM (SELECT try_cast(regexp_replace(regexp_replace(max({key}::VARCHAR), '\\.0+\\s*$', ''), '\\D', '', 'g') AS BIGINT) AS entity
  FROM {name} WHERE rid IS NOT NULL GROUP BY rid) WHERE entity IS NOT NULL)""" for i, (name, key) in enumerate(_KEYS.items())
) + """ SELECT 'b_y+n' AS corpus, 'birth_year' AS df1, 'nationality' AS df2, entity FROM k0 JOIN k1 USING (entity)
UNION ALL SELECT 'b_y+p_l', 'birth_year', 'political_leaning', entity FROM k0 JOIN k2 USING (entity) UNION ALL SELECT 'n+p_l', 'nationality', 'political_leaning', entity FROM k1 JOIN k2 USING (entity)"""

_FIELDS = {"political_leaning": ("author_ID", "political_leaning attrs posted_at"), "birth_year": ("auhtor_ID", "birth_year posted_at"), "nationality": ('"author_ID "', "nationality gender posted_at")}
_CELLS = "".join(f",\nwhole_{n} AS {_dataset(n, key, fields)}" for n, (key, fields) in _FIELDS.items()) + ",\ncells AS (" + "\n  UNION ALL ".join(
    f"SELECT '{n}' AS ds, entity, '{c}' AS field, {c}::VARCHAR AS value, rid FROM whole_{n} WHERE entity IS NOT NULL" for n, (_, fields) in _FIELDS.items() for c in ["post", *fields.split()]
) + ")"

_MERGED_FREQ = f""",
mtoks AS (SELECT corpus, unnest(list_filter(string_split_regex(lower({_clean('post')}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{2,}}'))) AS tok FROM mposts),
freq AS (SELECT corpus, tok, count(*) AS c FROM mtoks GROUP BY corpus, tok)"""

_TEXTS = f""",
joined AS (SELECT corpus, entity, count(*) AS n_posts, {_strip("string_agg(post, ' ' ORDER BY ord)")} AS text FROM mposts GROUP BY corpus, entity),
texts AS (SELECT corpus, min(entity) AS entity, arg_min(n_posts, entity) AS n_posts, length(text) AS n_chars FROM joined WHERE length(text) > 20 GROUP BY corpus, text)"""

_ENHANCED = f"WITH {_SETS}{_MERGED_FREQ}{_STATS}, enhanced AS (SELECT * FROM stats JOIN merged USING (corpus))"


def _ngrams(n: int) -> str:
    words = ", ".join(f"lead(tok, {k}) OVER w AS w{k + 1}" if k else "tok AS w1" for k in range(n))
    return f"""SELECT corpus, {n} AS n, coalesce(ngram_count, 0) AS ngram_count, coalesce(unique_ngrams, 0) AS unique_ngrams, coalesce(round(unique_ngrams / ngram_count, 6), 0) AS ngram_ttr,
  round(h1 / ngram_count, 6) AS ngram_hapax_ratio, round(greatest(0, log2(ngram_count::DOUBLE) - clog / ngram_count), 6) AS ngram_entropy, round(top / ngram_count, 6) AS most_common_ngram_freq
FROM sizes LEFT JOIN (
  SELECT corpus, sum(c)::BIGINT AS ngram_count, count(*) AS unique_ngrams, sum((c = 1)::INT) AS h1, sum(c * log2(c::DOUBLE)) AS clog, max(c) AS top FROM (
    SELECT corpus, {', '.join(f'w{k + 1}' for k in range(n))}, count(*) AS c FROM (SELECT corpus, {words} FROM pos WINDOW w AS (PARTITION BY corpus ORDER BY gpos)) WHERE w{n} IS NOT NULL GROUP BY ALL)
  GROUP BY corpus) USING (corpus)"""


_NGRAMS = f"WITH {_corpus()}{_POS}, grams AS ({' UNION ALL '.join(_ngrams(n) for n in (1, 2, 3))})"

#: Windows as they are defined: each with the different tokens that stand in it.
_MATTR = """,
members AS (SELECT DISTINCT corpus, n, tok, unnest(range(greatest(gpos - 99, 0), least(gpos, greatest(n - 100, 0)) + 1)) AS start FROM pos JOIN sizes USING (corpus)),
windows AS (SELECT corpus, start, count(*) / least(100, any_value(n)) AS t FROM members GROUP BY corpus, start),
mattr AS (SELECT corpus, avg(t) AS mattr FROM windows GROUP BY corpus)"""

_ZIPF = """,
ranks AS (SELECT corpus, c, row_number() OVER (PARTITION BY corpus ORDER BY c DESC, tok) AS rank FROM freq),
zipf AS (SELECT corpus, coalesce(-regr_slope(ln(c), ln(rank)), 0) AS zipf_exponent FROM ranks GROUP BY corpus)"""

_HEAPS = """,
firsts AS (SELECT corpus, tok, min(gpos) // 200 + 1 AS chunk FROM pos GROUP BY corpus, tok),
chunks AS (SELECT corpus, n, unnest(range(1, greatest(1, (n + 199) // 200) + 1)) AS chunk FROM sizes),
news AS (SELECT corpus, chunk, count(*) AS new FROM firsts GROUP BY corpus, chunk),
curve AS (SELECT corpus, least(chunk * 200, n) AS corpus_size, (sum(coalesce(new, 0)) OVER (PARTITION BY corpus ORDER BY chunk))::BIGINT AS vocab_size FROM chunks LEFT JOIN news USING (corpus, chunk)),
heaps AS (SELECT corpus, CASE WHEN count(*) > 1 THEN exp(regr_intercept(ln(vocab_size), ln(corpus_size))) ELSE 0 END AS heaps_k,
  CASE WHEN count(*) > 1 THEN regr_slope(ln(vocab_size), ln(corpus_size)) ELSE 0 END AS heaps_beta FROM curve GROUP BY corpus)"""

_BURST = """,
gaps AS (SELECT corpus, tok, gpos - lag(gpos) OVER (PARTITION BY corpus, tok ORDER BY gpos) AS gap FROM pos),
burst AS (SELECT corpus, tok, count(*) AS c, coalesce((stddev_pop(gap) - avg(gap)) / nullif(stddev_pop(gap) + avg(gap), 0), 0) AS burstiness FROM gaps GROUP BY corpus, tok)"""

_PMI = """,
wanted AS (SELECT * FROM (VALUES ('the', 'best'), ('best', 'part'), ('my', 'brother'), ('the', 'the'), ('part', 'nowhereword')) t(w1, w2)),
ones AS (SELECT corpus, w1, w2, gpos, n FROM pos JOIN wanted ON tok = w1 JOIN sizes USING (corpus)),
dens AS (SELECT corpus, w1, w2, n, count(*) AS c1, sum(least(n, gpos + 6) - greatest(0, gpos - 5) - 1) AS den FROM ones GROUP BY ALL),
mets AS (SELECT o.corpus, o.w1, o.w2, count(*) AS co FROM ones o JOIN pos p ON p.corpus = o.corpus AND p.tok = o.w2 AND abs(p.gpos - o.gpos) <= 5 AND p.gpos <> o.gpos GROUP BY ALL)"""

_SHARED = """,
vs AS (SELECT corpus, count(*) AS v FROM freq GROUP BY corpus),
both_ AS (SELECT a.corpus AS c1, b.corpus AS c2, a.v AS v1, b.v AS v2 FROM vs a JOIN vs b ON a.corpus < b.corpus),
inter AS (SELECT a.corpus AS c1, b.corpus AS c2, count(*) AS s FROM freq a JOIN freq b ON a.tok = b.tok AND a.corpus < b.corpus GROUP BY ALL),
over_ AS (SELECT c1, c2, v1, v2, coalesce(s, 0) AS s FROM both_ LEFT JOIN inter USING (c1, c2)),
jac AS (SELECT c1, c2, coalesce(s / nullif(v1 + v2 - s, 0), 0)::DOUBLE AS similarity FROM over_)"""

_TFIDF = """,
df AS (SELECT tok, count(*) AS df FROM freq GROUP BY tok),
raw AS (SELECT corpus, tok, c * (ln((SELECT count(DISTINCT corpus) FROM freq)::DOUBLE / (df + 1)) + 1) AS x FROM freq JOIN df USING (tok)),
norms AS (SELECT corpus, sqrt(sum(x * x)) AS norm FROM raw GROUP BY corpus),
weights AS (SELECT corpus, tok, x / (norm + 1e-8) AS w FROM raw JOIN norms USING (corpus))"""

_BY_SOURCE = f"WITH {_corpus('source')}"
_DOC = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
listed AS (SELECT doc_id, t, list_filter(string_split_regex(lower(t), '[^\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{LEAST,}')) AS toks,
  len(list_filter(string_split_regex(t, '[.!?]+'), lambda s: regexp_matches(s, '[^SPACE]'))) AS s FROM d),
words AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS i FROM listed),
kept AS (SELECT doc_id, tok, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i FROM words WHERE length(tok) >= KEEP),
freq AS (SELECT doc_id, tok, count(*) AS c FROM kept GROUP BY doc_id, tok),
sums AS (SELECT doc_id, sum(c)::DOUBLE AS n, count(*)::DOUBLE AS v, sum(c * c)::DOUBLE AS s2, sum((c = 1)::INT)::DOUBLE AS h1, sum(c * length(tok))::DOUBLE AS l1,
  sum(c * length(tok) * length(tok))::DOUBLE AS l2, sum(c * log2(c::DOUBLE)) AS clog FROM freq GROUP BY doc_id),
syl AS (SELECT doc_id, count(*)::DOUBLE AS a, sum(length(tok))::DOUBLE AS chars, sum(greatest(1, len(regexp_extract_all(tok, '[aeiouy]+')) -
  CASE WHEN tok LIKE '%e' AND len(regexp_extract_all(tok, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))::DOUBLE AS spoken FROM words GROUP BY doc_id),
prev AS (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id, tok ORDER BY i), -1) AS p FROM kept),
moved AS (SELECT doc_id, sum(greatest(0, least(i, n - 100) - greatest(p + 1, i - 99, 0) + 1)) AS held FROM prev JOIN sums USING (doc_id) WHERE n >= 100 GROUP BY doc_id)
""".replace("SPACE", _SPACE)


def _doc(least: int, keep: int = 1) -> str:
    return _DOC.replace("LEAST", str(least)).replace("KEEP", str(keep))


_READ = """round(CASE WHEN a > 0 AND s > 0 THEN greatest(0, least(100, 206.835 - 1.015 * (a / s) - 84.6 * (spoken / a))) ELSE 0 END, 6) AS flesch_reading_ease,
  round(CASE WHEN a > 0 AND s > 0 THEN greatest(0, 4.71 * (chars / a) + 0.5 * (a / s) - 21.43) ELSE 0 END, 6) AS ari, round(coalesce(n, 0) / greatest(s, 1), 6) AS avg_sentence_length"""


def _corr(columns: tuple[str, ...], source: str) -> str:
    cells = [
        f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 5) AS r FROM {source}" for a in columns for b in columns
    ]
    return " UNION ALL ".join(cells)


ORACLE_SQL = {
    "corpus_stats": _full_stats("corpus"),
    "corpus_stats_by_lang": _full_stats("lang"),
    "corpus_stats_by_source": _full_stats("source"),
    "merged_corpus_stats": f"WITH {_SETS}{_MERGED_FREQ}{_STATS} SELECT corpus, {_ROUNDED} FROM stats",
    "tokenization_summary": f"WITH {_corpus()}{_STATS} SELECT corpus, n_tokens, vocab_size FROM stats",
    "word_length_stats": f"""WITH {_corpus()}, m AS (SELECT corpus, sum(c)::DOUBLE AS n, sum(c * length(tok)) / sum(c)::DOUBLE AS a, sum(c * length(tok) * length(tok)) / sum(c)::DOUBLE AS q FROM freq GROUP BY corpus)
SELECT corpus, round(a, 6) AS avg_word_len, round(CASE WHEN n >= 2 THEN q - a * a ELSE 0 END, 6) AS word_len_var FROM m""",
    "freq_distribution": f"""WITH {_corpus()}, m AS (SELECT corpus, count(*)::DOUBLE AS n, avg(c) AS mu, stddev_pop(c) AS sd FROM freq GROUP BY corpus),
z AS (SELECT corpus, n, mu, sd, sum(pow((c - mu) / nullif(sd, 0), 3)) AS z3, sum(pow((c - mu) / nullif(sd, 0), 4)) AS z4, median(c) AS med, max(c) AS top,
  sum((c = 1)::INT)::BIGINT AS h1, sum((c = 2)::INT)::BIGINT AS h2, sum((c >= 10)::INT)::BIGINT AS h10 FROM freq JOIN m USING (corpus) GROUP BY corpus, n, mu, sd)
SELECT corpus, round(mu, 5) AS mean, round(med, 5) AS median, top AS max, round(sd, 5) AS std,
  round(CASE WHEN n >= 3 AND sd > 0 THEN n / ((n - 1) * (n - 2)) * z3 ELSE 0 END, 5) AS skewness,
  round(CASE WHEN n >= 4 AND sd > 0 THEN n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * z4 - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)) ELSE 0 END, 5) AS kurtosis,
  h1 AS hapax, h2 AS dis_legomena, h10 AS frequent FROM z""",
    "lexical_density": f"WITH {_corpus()} SELECT corpus, round(sum(CASE WHEN length(tok) >= 4 THEN c ELSE 0 END) / sum(c)::DOUBLE, 6) AS density FROM freq GROUP BY corpus",
    "lexical_density_content_words": f"""WITH {_corpus()} SELECT corpus, round(sum(CASE WHEN tok IN (SELECT lower(word) FROM common_words) THEN c ELSE 0 END) / sum(c)::DOUBLE, 6) AS density
FROM freq GROUP BY corpus""",
    "vocabulary_richness": f"""WITH {_corpus()}{_POS}{_STATS}{_MATTR} SELECT corpus, n_tokens AS total_tokens, vocab_size AS unique_tokens, round(ttr, 6) AS ttr, round(root_ttr, 6) AS root_ttr,
  round(log_ttr, 6) AS log_ttr, round(hapax_ratio, 6) AS hapax_ratio, round(yules_k, 6) AS yules_k, round(simpsons_d, 6) AS simpsons_d, round(entropy, 6) AS entropy,
  round(norm_entropy, 6) AS norm_entropy, round(avg_word_len, 6) AS avg_word_len, round(mattr, 6) AS mattr FROM stats JOIN mattr USING (corpus)""",
    "clean_text_fast": f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents",
    "text_cleaner_no_squeeze": f"""SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[^{_SPACE}]') THEN {_strip(f'''regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '(?:https?://|www\\.)[$-_a-z!]+', ' ', 'g'), '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b', ' ', 'g'),
  '@[\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g'), '#[\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g')), '[{_SPACE}]+', ' ', 'g')''')} ELSE '' END AS cleaned FROM documents""",
    "text_ascii": "SELECT doc_id, regexp_replace(strip_accents(nfc_normalize(coalesce(text, ''))), '[^\\x00-\\x7F]', '', 'g') AS cleaned FROM documents",
    "text_flattened": "SELECT doc_id, coalesce(array_to_string(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> ''), ' '), '') AS flat FROM documents",
    "language_heuristic": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS (SELECT doc_id, length(t) AS n, length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g'))::DOUBLE AS a FROM d)
SELECT doc_id, CASE WHEN n < 10 THEN 'unknown' WHEN a / n > 0.9 THEN 'en' WHEN a / n > 0.7 THEN 'mixed' ELSE 'other' END AS guess FROM r""",
    "sentence_counts": f"SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda s: regexp_matches(s, '[^{_SPACE}]'))) AS n_sentences FROM documents",
    "syllable_counts": f"""WITH {_corpus(least=1)} SELECT DISTINCT tok, greatest(1, len(regexp_extract_all(tok, '[aeiouy]+')) -
  CASE WHEN tok LIKE '%e' AND len(regexp_extract_all(tok, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)::BIGINT AS n_syllables FROM freq""",
    "cleaning_stats": f"""WITH d AS (SELECT length(coalesce(text, '')) AS a, length({_clean('text')}) AS b FROM documents)
SELECT round(avg(a), 6) AS mean_length_original, round(avg(b), 6) AS mean_length_cleaned, round(100 * (1 - sum(b) / sum(a)::DOUBLE), 6) AS length_reduction_pct,
  sum((a = 0)::INT)::BIGINT AS empty_original, sum((b = 0)::INT)::BIGINT AS empty_cleaned, sum(a - b)::BIGINT AS chars_removed FROM d""",
    "doc_stats_fast": _doc(2)
    + """SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, coalesce(v, 0)::BIGINT AS n_unique, round(coalesce(v / n, 0), 6) AS ttr, round(coalesce(l1 / n, 0), 6) AS avg_word_len,
  round(coalesce(log2(n) - clog / n, 0), 6) AS entropy, length(t) AS char_count FROM listed LEFT JOIN sums USING (doc_id)""",
    "doc_stats_full": _doc(1)
    + f"""SELECT doc_id, coalesce(n, 0)::BIGINT AS token_count, coalesce(v, 0)::BIGINT AS unique_tokens, s AS sentence_count, length(t) AS char_count, round(coalesce(v / n, 0), 6) AS ttr,
  round(coalesce(v / sqrt(n), 0), 6) AS root_ttr, round(CASE WHEN n > 1 AND v > 1 THEN ln(v) / ln(n) ELSE 0 END, 6) AS log_ttr,
  round(coalesce(CASE WHEN n < 100 THEN v / n ELSE held / (100 * (n - 99)) END, 0), 6) AS mattr_100, round(coalesce(h1 / n, 0), 6) AS hapax_ratio,
  round(CASE WHEN n >= 2 THEN 10000 * (s2 - n) / (n * n) ELSE 0 END, 6) AS yules_k, round(CASE WHEN n >= 2 THEN 1 - (s2 - n) / (n * (n - 1)) ELSE 0 END, 6) AS simpsons_d,
  round(coalesce(l1 / n, 0), 6) AS avg_word_length, round(CASE WHEN n >= 2 THEN l2 / n - (l1 / n) * (l1 / n) ELSE 0 END, 6) AS word_length_var, {_READ}
FROM listed LEFT JOIN sums USING (doc_id) LEFT JOIN syl USING (doc_id) LEFT JOIN moved USING (doc_id)""",
    "readability": _doc(1, 4) + f"SELECT doc_id, coalesce(n, 0)::BIGINT AS token_count, {_READ} FROM listed LEFT JOIN sums USING (doc_id) LEFT JOIN syl USING (doc_id)",
    "conditional_entropy": f"""WITH {_corpus()}{_POS}, two AS (SELECT corpus, tok AS w1, lead(tok) OVER (PARTITION BY corpus ORDER BY gpos) AS w2 FROM pos),
c2 AS (SELECT corpus, w1, w2, count(*) AS c FROM two WHERE w2 IS NOT NULL GROUP BY ALL), c1 AS (SELECT *, sum(c) OVER (PARTITION BY corpus, w1) AS c1, sum(c) OVER (PARTITION BY corpus) AS n FROM c2),
e AS (SELECT corpus, -sum(c / n::DOUBLE * log2(c / c1::DOUBLE)) AS h FROM c1 GROUP BY corpus)
SELECT corpus, round(coalesce(h, 0), 6) AS conditional_entropy FROM sizes LEFT JOIN e USING (corpus)""",
    "mattr": f"WITH {_corpus()}{_POS}{_MATTR} SELECT corpus, round(mattr, 6) AS mattr FROM mattr",
    "ngram_stats": f"{_NGRAMS} SELECT * FROM grams",
    "ngram_ttr_pivot": f"{_NGRAMS} SELECT corpus, max(ngram_ttr) FILTER (n = 1) AS n1, max(ngram_ttr) FILTER (n = 2) AS n2, max(ngram_ttr) FILTER (n = 3) AS n3 FROM grams GROUP BY corpus",
    "ngram_entropy_pivot": f"{_NGRAMS} SELECT corpus, max(ngram_entropy) FILTER (n = 1) AS n1, max(ngram_entropy) FILTER (n = 2) AS n2, max(ngram_entropy) FILTER (n = 3) AS n3 FROM grams GROUP BY corpus",
    "zipf_exponents": f"WITH {_corpus()}{_ZIPF} SELECT corpus, round(zipf_exponent, 6) AS zipf_exponent FROM zipf",
    "zipf_curve": f"""WITH {_corpus()}{_ZIPF}, top AS (SELECT corpus, max(c) AS top FROM freq GROUP BY corpus)
SELECT corpus, rank, c, round(top / pow(rank, zipf_exponent), 4) AS expected FROM ranks JOIN zipf USING (corpus) JOIN top USING (corpus) WHERE rank <= 500""",
    "zipf_summary": f"""WITH {_corpus()}{_ZIPF} SELECT count(*) AS n_corpora, sum((abs(zipf_exponent - 1) < 0.3)::INT)::BIGINT AS n_near_one, round(avg(zipf_exponent), 6) AS mean_exponent,
  round(stddev_pop(zipf_exponent), 6) AS std_exponent FROM zipf""",
    "heaps_curve": f"WITH {_corpus()}{_POS}{_HEAPS} SELECT corpus, corpus_size, vocab_size FROM curve",
    "heaps_theory": f"WITH {_corpus()}{_POS}{_HEAPS} SELECT corpus, corpus_size, vocab_size, round(heaps_k * pow(corpus_size, heaps_beta), 3) AS expected FROM curve JOIN heaps USING (corpus)",
    "heaps_params": f"WITH {_corpus()}{_POS}{_HEAPS} SELECT corpus, round(heaps_k, 5) AS heaps_k, round(heaps_beta, 5) AS heaps_beta, heaps_beta > 0.3 AND heaps_beta < 0.8 AS plausible FROM heaps",
    "burstiness_word": f"WITH {_corpus()}{_POS}{_BURST} SELECT corpus, tok, c, round(burstiness, 6) AS burstiness FROM burst WHERE tok IN ('the', 'und', 'que', 'brother')",
    "avg_burstiness": f"""WITH {_corpus()}{_POS}{_BURST}, m AS (SELECT corpus, avg(burstiness) AS a FROM burst WHERE c >= 5 GROUP BY corpus)
SELECT corpus, round(coalesce(a, 0), 6) AS avg_burstiness FROM sizes LEFT JOIN m USING (corpus)""",
    "pmi_pair": f"""WITH {_corpus()}{_POS}{_PMI}
SELECT s.corpus, w.w1, w.w2, round(coalesce(CASE WHEN co > 0 AND den > 0 THEN log2((co / den::DOUBLE) / ((c1 / s.n::DOUBLE) * (f.c / s.n::DOUBLE))) END, 0), 6) AS pmi
FROM sizes s JOIN wanted w ON true LEFT JOIN dens d ON d.corpus = s.corpus AND d.w1 = w.w1 AND d.w2 = w.w2 LEFT JOIN mets m ON m.corpus = s.corpus AND m.w1 = w.w1 AND m.w2 = w.w2
LEFT JOIN freq f ON f.corpus = s.corpus AND f.tok = w.w2""",
    "jaccard_pairs": f"{_BY_SOURCE}{_SHARED} SELECT c1, c2, round(similarity, 6) AS similarity FROM jac",
    "jaccard_matrix": f"""{_BY_SOURCE}{_SHARED} SELECT c1, c2, round(similarity, 6) AS similarity FROM jac UNION ALL SELECT c2, c1, round(similarity, 6) FROM jac
UNION ALL SELECT corpus, corpus, 1.0 FROM vs""",
    "top10_similar": f"{_BY_SOURCE}{_SHARED} SELECT c1, c2, round(similarity, 6) AS similarity FROM jac ORDER BY jac.similarity DESC, c1, c2 LIMIT 10",
    "vocab_overlap": f"""{_BY_SOURCE}{_SHARED} SELECT c1, c2, round(s / (v1 + v2 - s), 6) AS jaccard_similarity, round(2 * s / (v1 + v2), 6) AS dice_coefficient, round(s / least(v1, v2), 6) AS overlap_coefficient,
  round(s / v1, 6) AS vocab1_coverage, round(s / v2, 6) AS vocab2_coverage, v1 - s AS unique_to_vocab1, v2 - s AS unique_to_vocab2, s AS shared_vocab FROM over_""",
    "bow_cosine": f"""{_BY_SOURCE}{_SHARED}, nn AS (SELECT corpus, sqrt(sum(c * c)::DOUBLE) AS m FROM freq GROUP BY corpus),
dot AS (SELECT a.corpus AS c1, b.corpus AS c2, sum(a.c * b.c)::DOUBLE AS d FROM freq a JOIN freq b ON a.tok = b.tok AND a.corpus < b.corpus GROUP BY ALL)
SELECT c1, c2, round(coalesce(d, 0) / (x.m * y.m), 6) AS cosine FROM both_ LEFT JOIN dot USING (c1, c2) JOIN nn x ON x.corpus = c1 JOIN nn y ON y.corpus = c2""",
    "frequency_matrix": f"{_BY_SOURCE} SELECT corpus, tok, c FROM freq WHERE tok IN (SELECT lower(word) FROM common_words)",
    "tfidf_weights": f"{_BY_SOURCE}{_TFIDF} SELECT corpus, tok, round(w, 6) AS w FROM weights",
    "tfidf_similarity": f"""{_BY_SOURCE}{_TFIDF}, names AS (SELECT DISTINCT corpus FROM freq), every AS (SELECT a.corpus AS c1, b.corpus AS c2 FROM names a JOIN names b ON a.corpus <= b.corpus),
dot AS (SELECT a.corpus AS c1, b.corpus AS c2, sum(a.w * b.w) AS d FROM weights a JOIN weights b ON a.tok = b.tok AND a.corpus <= b.corpus GROUP BY ALL)
SELECT c1, c2, round(coalesce(d, 0), 6) AS similarity FROM every LEFT JOIN dot USING (c1, c2)""",
    "embedding_dot": """SELECT q.vec_id AS query, v.vec_id AS other, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 4) AS dot
FROM embeddings q JOIN embeddings v ON true WHERE q.vec_id % 100 = 0""",
    "pairwise_merge": _PAIRWISE,
    "collapse_entities": f"""WITH {_SETS} SELECT 'political_leaning' AS dataset, entity, 'political_leaning' AS field, political_leaning AS value, min(rid) AS first FROM pl WHERE entity IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'political_leaning', entity, 'attrs', attrs, min(rid) FROM pl WHERE entity IS NOT NULL GROUP BY ALL UNION ALL SELECT 'birth_year', entity, 'birth_year', birth_year::VARCHAR, min(rid) FROM b WHERE entity IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'nationality', entity, 'nationality', nationality, min(rid) FROM n WHERE entity IS NOT NULL GROUP BY ALL UNION ALL SELECT 'nationality', entity, 'gender', gender, min(rid) FROM n WHERE entity IS NOT NULL GROUP BY ALL""",
    "collapse_value_counts": f"""WITH {_SETS}, l AS (SELECT DISTINCT entity, 'nationality' AS field, nationality AS v FROM n WHERE entity IS NOT NULL UNION ALL SELECT DISTINCT entity, 'gender', gender FROM n WHERE entity IS NOT NULL)
SELECT entity, field, count(*) AS n_values FROM l GROUP BY entity, field""",
    "merged_fields": f"""WITH {_SETS}, l AS (SELECT 'political_leaning' AS ds, entity, 'political_leaning' AS field, political_leaning AS value, rid FROM pl UNION ALL SELECT 'political_leaning', entity, 'attrs', attrs, rid FROM pl
UNION ALL SELECT 'birth_year', entity, 'birth_year', birth_year::VARCHAR, rid FROM b UNION ALL SELECT 'nationality', entity, 'nationality', nationality, rid FROM n UNION ALL SELECT 'nationality', entity, 'gender', gender, rid FROM n)
SELECT corpus, p.entity, field, value, min(rid) AS first FROM pairs p JOIN l ON l.entity = p.entity AND ds IN (df1, df2) GROUP BY corpus, p.entity, ds, field, value""",
    "collapse_entities_all": f"WITH {_SETS}{_CELLS} SELECT ds AS dataset, entity, field, value, min(rid) AS first FROM cells GROUP BY ALL",
    "collapse_value_counts_all": f"WITH {_SETS}{_CELLS} SELECT ds AS dataset, entity, field, count(*) AS n_values FROM (SELECT DISTINCT ds, entity, field, value FROM cells) GROUP BY ALL",
    "merged_fields_all": f"""WITH {_SETS}{_CELLS} SELECT corpus, p.entity, CASE WHEN field = 'posted_at' THEN CASE WHEN ds = df1 THEN 'posted_at_x' ELSE 'posted_at_y' END ELSE field END AS field, value, min(rid) AS first
FROM pairs p JOIN cells l ON l.entity = p.entity AND ds IN (df1, df2) WHERE field <> 'post' GROUP BY corpus, p.entity, ds, df1, field, value""",
    "merged_posts": f"WITH {_SETS} SELECT corpus, entity, post FROM mposts",
    "extracted_texts": f"WITH {_SETS}{_TEXTS} SELECT corpus, entity, n_posts, n_chars FROM texts",
    "extraction_stats": f"WITH {_SETS}{_TEXTS} SELECT corpus, count(*) AS n_texts FROM texts GROUP BY corpus",
    "sampled_texts": f"WITH {_corpus()} SELECT corpus, doc_ord FROM docs QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY md5(text), doc_ord) <= 100",
    "first_texts": f"WITH {_corpus()} SELECT corpus, doc_ord FROM docs QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY doc_ord) <= 100",
    "merge_stats": f"""WITH {_SETS} SELECT (SELECT count(*) FROM rows) AS n_original, count(*) AS n_merged, (SELECT sum(n_rows)::BIGINT FROM rows) AS original_rows, sum(merged_rows)::BIGINT AS merged_rows FROM merged""",
    "merge_matrix": f"""WITH {_SETS}, m AS (SELECT df1, df2, merged_rows FROM merged UNION ALL SELECT df2, df1, merged_rows FROM merged UNION ALL SELECT dataset, dataset, NULL FROM rows)
SELECT df1, df2, merged_rows, round(log10(merged_rows + 1.0::DOUBLE), 6) AS log_merged_rows FROM m""",
    "merge_size_summary": f"WITH {_SETS} SELECT sum(merged_rows)::BIGINT AS total, round(avg(merged_rows), 6) AS mean, median(merged_rows) AS median, max(merged_rows) AS max, min(merged_rows) AS min FROM merged",
    "top5_merged": f"WITH {_SETS} SELECT * FROM merged ORDER BY merged_rows DESC, corpus LIMIT 5",
    "cumulative_sizes": f"WITH {_SETS} SELECT corpus, merged_rows, round(row_number() OVER (ORDER BY merged_rows, corpus) / count(*) OVER (), 6) AS share FROM merged",
    "size_quartiles": f"""WITH {_SETS} SELECT 'original' AS kind, quantile_cont(n_rows, 0.25) AS q1, quantile_cont(n_rows, 0.5) AS median, quantile_cont(n_rows, 0.75) AS q3 FROM rows
UNION ALL SELECT 'merged', quantile_cont(merged_rows, 0.25), quantile_cont(merged_rows, 0.5), quantile_cont(merged_rows, 0.75) FROM merged""",
    "contributions": f"WITH {_SETS} SELECT dataset, sum(merged_rows)::BIGINT AS contribution FROM rows JOIN merged ON dataset IN (df1, df2) GROUP BY dataset",
    "network_layout": f"""WITH {_SETS}, a AS (SELECT dataset, n_rows, 2 * pi() * (row_number() OVER (ORDER BY dataset) - 1) / count(*) OVER () AS t, max(n_rows) OVER () AS top FROM rows)
SELECT dataset, round(cos(any_value(t)), 6) AS x, round(sin(any_value(t)), 6) AS y, round(30 + 40 * any_value(n_rows / top), 6) AS node_size, count(*) AS degree,
  round(max(CASE WHEN merged_rows > 0 THEN 1 + 10 * log10(merged_rows::DOUBLE) / 7 ELSE 1 END), 6) AS edge_width FROM a JOIN merged ON dataset IN (df1, df2) GROUP BY dataset""",
    "enhanced_stats": f"{_ENHANCED} SELECT corpus, df1, df2, merged_rows, {_ROUNDED}, round(log10(merged_rows + 1.0::DOUBLE), 6) AS log_merged_rows FROM enhanced",
    "stats_by_dataset": f"""{_ENHANCED} SELECT dataset, any_value(n_rows) AS original_size, count(*) AS n_merged_corpora, round(avg(ttr), 6) AS mean_ttr, round(avg(entropy), 6) AS mean_entropy,
  round(avg(perplexity), 6) AS mean_perplexity, round(avg(yules_k), 6) AS mean_yules_k FROM rows JOIN enhanced ON dataset IN (df1, df2) GROUP BY dataset""",
    "metric_correlation": f"{_BY_SOURCE}{_STATS} {_corr(_MEASURES, 'stats')}",
    "size_correlation_ranked": f"""{_BY_SOURCE}{_STATS}, x AS (SELECT *, log10(n_tokens + 1.0::DOUBLE) AS log_rows FROM stats), r AS ({' UNION ALL '.join(
        f"SELECT '{m}' AS measure, covar_pop({m}, log_rows) / nullif(stddev_pop({m}) * stddev_pop(log_rows), 0) AS r FROM x" for m in _MEASURES)})
SELECT measure, round(r, 5) AS r, CASE WHEN abs(r) > 0.5 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM r""",
    "final_summary": f"""{_ENHANCED} SELECT corpus AS "Corpus", df1 AS "Dataset_1", df2 AS "Dataset_2", merged_rows AS "Merged_Rows", n_tokens AS "Tokens", vocab_size AS "Vocabulary", round(ttr, 4) AS "TTR",
  round(entropy, 4) AS "Entropy", round(norm_entropy, 4) AS "Norm_Entropy", round(perplexity, 4) AS "Perplexity", round(yules_k, 4) AS "Yules_K", round(hapax_ratio, 4) AS "Hapax_Ratio" FROM enhanced""",
}
