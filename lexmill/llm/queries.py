"""The queries of this folder's operators and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collapse_copies import collapse_copies, copy_members
from .distinctive_terms import distinctive_terms
from .languages import document_languages, language_segments
from .markup import clean_markup, markup_kinds
from .mixing import mix, mix_report
from .personal_info import mask_personal, personal_mentions
from .reading_level import reading_levels
from .tables import documents, one_delivery, one_per_key, posts, table
from .text_quality import line_labels, text_statistics
from .tokenize import count_tokens, encode_texts


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = distinctive_terms(table(spark, sf_dir, "political_leaning"), min_len=7, min_tf=3, df_range=(3, 12))
    return scored.where(F.col("score") > 0).select("rid", "term")


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = distinctive_terms(table(spark, sf_dir, "political_leaning"))
    return scored.select("rid", "term", F.round("score", 6).alias("score"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = personal_mentions(posts(spark, sf_dir), table(spark, sf_dir, "name_list"))
    return mentions.select("rid", "kind", "start_pos").distinct()


def p2_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = one_delivery(posts(spark, sf_dir), "rid", "post")
    return mask_personal(texts, table(spark, sf_dir, "name_list"), table(spark, sf_dir, "pii_types"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = reading_levels(posts(spark, sf_dir), table(spark, sf_dir, "reading_samples"))
    return levels.where(F.col("level") >= 5).select("rid").distinct()


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = one_per_key(reading_levels(posts(spark, sf_dir), table(spark, sf_dir, "reading_samples")), "rid", "level", "mark", "estimate", "confidence")
    return levels.groupBy(F.col("estimate").alias("level")).agg(
        F.count(F.lit(1)).alias("n_posts"), F.round(F.avg("mark"), 4).alias("mean_mark"), F.count("level").alias("n_sure"), F.round(F.avg("confidence"), 4).alias("mean_confidence")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup_kinds(posts(spark, sf_dir)).distinct()


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_markup(one_delivery(posts(spark, sf_dir), "rid", "post"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = copy_members(table(spark, sf_dir, "political_leaning"))
    return members.select(F.col("first").alias("rid_first"), F.col("copy").alias("rid_copy"))


def p6_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = collapse_copies(table(spark, sf_dir, "political_leaning"))
    return groups.select(F.col("first").alias("rid_first"), "author", "text", "copies")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = line_labels(posts(spark, sf_dir), table(spark, sf_dir, "common_words"))
    return labels.where(F.col("kind") != "prose").select("rid", "kind").distinct()


def p7_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = text_statistics(posts(spark, sf_dir), table(spark, sf_dir, "common_words"))
    stats = one_per_key(stats, "rid", *(c for c in stats.columns if c != "rid"))
    ratios = ("mean_word_len", "symbol_ratio", "end_punct_share", "common_share", "distinct_share")
    return stats.withColumns({c: F.round(c, 6) for c in ratios})


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(documents(spark, sf_dir))


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(documents(spark, sf_dir), "doc_id", "source")
    return counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_languages(documents(spark, sf_dir))
    wrong = F.col("label_lang").isNull() | (F.col("label_lang") != F.col("lang")) | (F.col("n_languages") > 1)
    return found.where(wrong).select("doc_id", "lang").distinct()


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_segments(documents(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_scores": p1_scores,
    "p2_found": p2_found,
    "p2_masked": p2_masked,
    "p4_found": p4_found,
    "p4_profile": p4_profile,
    "p5_found": p5_found,
    "p5_clean": p5_clean,
    "p6_found": p6_found,
    "p6_collapsed": p6_collapsed,
    "p7_found": p7_found,
    "p7_stats": p7_stats,
    "p8_ids": p8_ids,
    "p8_counts": p8_counts,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_segments": p10_segments,
}

_TERMS = """
WITH once AS (SELECT rid, max(post) AS post FROM political_leaning WHERE rid IS NOT NULL GROUP BY rid),
tokens AS (SELECT rid, unnest(string_split_regex(lower(coalesce(post, '')), '[^\\p{L}\\p{N}_]+')) AS term FROM once),
counts AS (SELECT rid, term, count(*) AS tf FROM tokens WHERE regexp_full_match(term, '[a-z]{2,}') GROUP BY rid, term),
stats AS (SELECT term, sum(tf)::DOUBLE AS gf, count(*) AS df, ln(sum(tf)::DOUBLE) - sum(tf * ln(tf)) / sum(tf)::DOUBLE AS spread FROM counts GROUP BY term),
scored AS (SELECT rid, term, tf, df, ln(1 + tf) * (1 - spread / ln((SELECT count(*) FROM once))) AS score FROM counts JOIN stats USING (term))
"""

_COPIES = """
WITH rows AS (
  SELECT rid, regexp_replace(lower(author_ID), '[^\\p{L}\\p{Nd}]+', '', 'g') AS author, regexp_replace(lower(post), '[^\\p{L}\\p{Nd}]+', '', 'g') AS text,
    CASE WHEN attrs IS NULL THEN NULL ELSE (SELECT string_agg(key || '=' || value::VARCHAR, ',' ORDER BY key) FROM json_each(attrs::JSON)) END AS fields
  FROM political_leaning WHERE rid IS NOT NULL AND author_ID IS NOT NULL AND post IS NOT NULL),
groups AS (
  SELECT author, text, fields, min(rid) AS rid_first, count(DISTINCT rid) AS copies FROM rows
  WHERE author <> '' AND text <> '' GROUP BY author, text, fields)
"""

_POSTS = """
WITH posts AS (
  SELECT rid, max(post) AS post FROM (
    SELECT rid, post FROM political_leaning UNION ALL SELECT rid, post FROM birth_year UNION ALL SELECT rid, post FROM nationality)
  WHERE rid IS NOT NULL GROUP BY rid)
"""

_STATS = _POSTS + """,
parts AS (
  SELECT rid, coalesce(post, '') AS t,
    list_filter(string_split_regex(lower(coalesce(post, '')), '[^\\p{L}]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(post, ''), chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM posts),
known AS (SELECT list(DISTINCT lower(word)) AS words FROM common_words)
SELECT rid, length(t) AS n_chars, len(w) AS n_words,
  round(coalesce(length(array_to_string(w, ''))::DOUBLE / nullif(len(w), 0), 0), 6) AS mean_word_len,
  round(coalesce(length(regexp_replace(t, '[\\p{L}\\p{Nd}\\s]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(t, '\\s', '', 'g')), 0), 0), 6) AS symbol_ratio,
  len(l) AS n_lines,
  round(coalesce(len(list_filter(l, lambda s: regexp_matches(s, '[.!?…]\\s*$')))::DOUBLE / nullif(len(l), 0), 0), 6) AS end_punct_share,
  round(coalesce(len(list_filter(w, lambda s: list_contains(words, s)))::DOUBLE / nullif(len(w), 0), 0), 6) AS common_share,
  round(coalesce(len(list_distinct(w))::DOUBLE / nullif(len(w), 0), 0), 6) AS distinct_share
FROM parts, known
"""

ORACLE_SQL = {
    "p7_stats": _STATS,
    "p1_found": _TERMS + "SELECT rid, term FROM scored WHERE length(term) >= 7 AND tf >= 3 AND df BETWEEN 3 AND 12",
    "p1_scores": _TERMS + "SELECT rid, term, round(score, 6) AS score FROM scored",
    "p6_found": _COPIES
    + """SELECT DISTINCT rid_first, rid AS rid_copy FROM rows JOIN groups
  ON rows.author = groups.author AND rows.text = groups.text AND rows.fields IS NOT DISTINCT FROM groups.fields WHERE rid <> rid_first""",
    "p6_collapsed": _COPIES + "SELECT rid_first, author, text, copies FROM groups",
}
