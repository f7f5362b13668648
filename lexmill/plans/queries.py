"""The queries of the core operators. The same in SQL is in `oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import collapse as J
from lexmill.operators import corpora as B
from lexmill.operators import docstats as D
from lexmill.operators import lexical as C
from lexmill.operators import rollup as R
from lexmill.operators import sequence as M
from lexmill.operators import similarity as X
from lexmill.operators.schema_drift import one_table, schema_changes
from lexmill.sources.datasets import read_all
from lexmill.sources.tables import spread, table

from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

DATASETS = ("birth_year", "nationality", "political_leaning")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: sums of doubles depend on the order they are taken in."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def docs(spark: SparkSession, sf_dir: str, corpus: str = "corpus") -> DataFrame:
    return spread(B.documents(table(spark, sf_dir, "documents"), corpus, "doc_id", "text"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def freq(spark: SparkSession, sf_dir: str, corpus: str = "corpus", least: int = 2) -> DataFrame:
    return B.frequencies(B.token_table(docs(spark, sf_dir, corpus), least))


def pos(spark: SparkSession, sf_dir: str, corpus: str = "corpus") -> DataFrame:
    return B.positions(docs(spark, sf_dir, corpus))


def datasets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The datasets, one row per record."""
    return read_all(spark, DATASETS, lambda n: table(spark, sf_dir, n))


# corpora: size, diversity, information


@query
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.with_empty(C.corpus_stats(freq(spark, sf_dir)), docs(spark, sf_dir)))


@query
def corpus_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.with_empty(C.corpus_stats(freq(spark, sf_dir, "lang")), docs(spark, sf_dir, "lang")))


@query
def corpus_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.with_empty(C.corpus_stats(freq(spark, sf_dir, "source")), docs(spark, sf_dir, "source")))


@query
def merged_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: datasets, pairs, merged posts, cleaned tokens, statistics."""
    return rounded(C.corpus_stats(_merged_freq(spark, sf_dir)))


def _merged_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = J.merged_posts(datasets(spark, sf_dir))
    toks = posts.select("corpus", F.explode(T.tokens(T.clean(F.col("post")))).alias("tok"))
    return B.frequencies(toks)


@query
def tokenization_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tokenization_summary(freq(spark, sf_dir))


@query
def word_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.word_lengths(freq(spark, sf_dir)))


@query
def freq_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.distribution(freq(spark, sf_dir)), 5)


@query
def lexical_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.lexical_density(freq(spark, sf_dir)))


@query
def lexical_density_content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "common_words").select(F.lower("word").alias("tok"))
    return rounded(C.lexical_density(freq(spark, sf_dir), words))


@query
def vocabulary_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.richness(freq(spark, sf_dir), M.moving_ttr(docs(spark, sf_dir))))


# text functions


@query
def clean_text_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query
def text_cleaner_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", T.Cleaner()(F.col("text")).alias("cleaned"))


@query
def text_cleaner_no_squeeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", T.Cleaner(ascii=False, repeats=False, hashtags=True)(F.col("text")).alias("cleaned"))


@query
def text_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts taken apart into lines of words, empty words null, and put together again."""
    lines = F.transform(F.split(F.col("text"), "\n"), lambda x: F.transform(F.split(x, " "), lambda w: F.nullif(w, F.lit(""))))
    return texts(spark, sf_dir).select("doc_id", T.flattened(lines).alias("flat"))


@query
def text_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", T.ascii_only(T.full(F.col("text"))).alias("cleaned"))


@query
def language_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", T.language_guess(F.col("text")).alias("guess"))


@query
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", T.sentence_count(F.col("text")).cast("bigint").alias("n_sentences"))


@query
def syllable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = freq(spark, sf_dir, least=1).select("tok").distinct()
    return words.select("tok", T.syllables(F.col("tok")).cast("bigint").alias("n_syllables"))


@query
def cleaning_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.cleaning_stats(texts(spark, sf_dir), F.col("text"), T.clean(F.col("text"))))


# documents


@query
def doc_stats_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.fast_stats(texts(spark, sf_dir), "doc_id", "text"))


@query
def doc_stats_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.full_stats(texts(spark, sf_dir), "doc_id", "text"))


@query
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = D.full_stats(texts(spark, sf_dir), "doc_id", "text", least=4)
    return rounded(stats.select("doc_id", "token_count", "flesch_reading_ease", "ari", "avg_sentence_length"))


# order of tokens


@query
def conditional_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.conditional_entropy(docs(spark, sf_dir)))


@query
def mattr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.moving_ttr(docs(spark, sf_dir)))


@query
def ngram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.ngram_stats(docs(spark, sf_dir)))


@query
def ngram_ttr_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.ngram_pivot(M.ngram_stats(docs(spark, sf_dir)), "ngram_ttr"))


@query
def ngram_entropy_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.ngram_pivot(M.ngram_stats(docs(spark, sf_dir)), "ngram_entropy"))


@query
def zipf_exponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.zipf_exponents(freq(spark, sf_dir)))


@query
def zipf_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.zipf_curve(freq(spark, sf_dir)), 4)


@query
def zipf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.zipf_summary(freq(spark, sf_dir)))


@query
def heaps_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.heaps_curve(pos(spark, sf_dir), step=200).drop("chunk")


@query
def heaps_theory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.heaps_theory(M.heaps_curve(pos(spark, sf_dir), step=200)).drop("chunk"), 3)


@query
def heaps_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = M.heaps_fit(M.heaps_curve(pos(spark, sf_dir), step=200))
    return rounded(fitted.withColumn("plausible", (F.col("heaps_beta") > 0.3) & (F.col("heaps_beta") < 0.8)), 5)


@query
def burstiness_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = M.burstiness(pos(spark, sf_dir)).where(F.col("tok").isin("the", "und", "que", "brother"))
    return rounded(some)


@query
def avg_burstiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.average_burstiness(pos(spark, sf_dir)))


PMI_PAIRS = [("the", "best"), ("best", "part"), ("my", "brother"), ("the", "the"), ("part", "nowhereword")]


@query
def pmi_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame(PMI_PAIRS, "w1 string, w2 string")
    return rounded(M.pmi(docs(spark, sf_dir), pairs))


# likeness of corpora


@query
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.jaccard_pairs(freq(spark, sf_dir, "source")))


@query
def jaccard_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.jaccard_matrix(freq(spark, sf_dir, "source")))


@query
def top10_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.most_similar(X.jaccard_pairs(freq(spark, sf_dir, "source"))))


@query
def vocab_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.vocabulary_overlap(freq(spark, sf_dir, "source")))


@query
def bow_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.bow_cosine(freq(spark, sf_dir, "source")))


@query
def frequency_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "common_words").select(F.lower("word").alias("tok"))
    return X.frequency_matrix(freq(spark, sf_dir, "source"), words)


@query
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.tfidf(freq(spark, sf_dir, "source")))


@query
def tfidf_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.tfidf_similarity(freq(spark, sf_dir, "source")))


@query
def embedding_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return rounded(X.dense_dots(vectors, "vec_id", "embedding", vectors.where("vec_id % 100 = 0")), 4)


# datasets, pairs, texts


@query
def pairwise_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.entity_pairs(datasets(spark, sf_dir)).select("corpus", "df1", "df2", "entity")


FIELDS = {"political_leaning": ["political_leaning", "attrs"], "birth_year": ["birth_year"], "nationality": ["nationality", "gender"]}


@query
def collapse_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = datasets(spark, sf_dir)
    parts = [J.collapse(sets[n], fields=f).withColumn("dataset", F.lit(n)) for n, f in FIELDS.items()]
    return J._all(parts)


@query
def collapse_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.value_counts(J.collapse(datasets(spark, sf_dir)["nationality"], fields=["nationality", "gender"]))


@query
def merged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = {n: df.select("entity", "rid", "post", *FIELDS[n]) for n, df in datasets(spark, sf_dir).items()}
    return J.merged_fields(sets)


@query
def collapse_entities_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column but the key and the record's number, posts and times included."""
    return J._all([J.collapse(df).withColumn("dataset", F.lit(n)) for n, df in datasets(spark, sf_dir).items()])


@query
def collapse_value_counts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J._all([J.value_counts(J.collapse(df)).withColumn("dataset", F.lit(n)) for n, df in datasets(spark, sf_dir).items()])


@query
def merged_fields_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields; `posted_at`, which every dataset has, comes as _x and _y."""
    return J.merged_fields(datasets(spark, sf_dir))


@query
def merged_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.merged_posts(datasets(spark, sf_dir)).select("corpus", "entity", "post")


@query
def extracted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.extracted_texts(J.merged_posts(datasets(spark, sf_dir)))


@query
def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.extracted_texts(J.merged_posts(datasets(spark, sf_dir))).groupBy("corpus").agg(F.count(F.lit(1)).alias("n_texts"))


@query
def sampled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.sample(docs(spark, sf_dir), 100).select("corpus", "doc_ord")


@query
def first_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.head(docs(spark, sf_dir), 100).select("corpus", "doc_ord")


# sizes and roll-ups


def _sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sets = datasets(spark, sf_dir)
    return R.dataset_sizes(sets), R.merged_sizes(sets)


def _enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.enriched(C.corpus_stats(_merged_freq(spark, sf_dir)), _sizes(spark, sf_dir)[1])


@query
def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_stats(*_sizes(spark, sf_dir))


@query
def merge_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.size_matrix(_sizes(spark, sf_dir)[1]))


@query
def merge_size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.size_summary(_sizes(spark, sf_dir)[1]))


@query
def top5_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.largest(_sizes(spark, sf_dir)[1])


@query
def cumulative_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.cumulative_sizes(_sizes(spark, sf_dir)[1]))


@query
def size_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.size_quartiles(*_sizes(spark, sf_dir)))


@query
def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contributions(_sizes(spark, sf_dir)[1])


@query
def network_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.network_layout(*_sizes(spark, sf_dir)))


@query
def enhanced_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_enhanced(spark, sf_dir))


@query
def stats_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.by_dataset(_enhanced(spark, sf_dir), _sizes(spark, sf_dir)[0]))


@query
def metric_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.correlations(C.corpus_stats(freq(spark, sf_dir, "source")), R.MEASURES), 5)


@query
def size_correlation_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = C.corpus_stats(freq(spark, sf_dir, "source")).withColumn("log_rows", F.log10(F.col("n_tokens") + 1.0))
    return rounded(R.correlated_with(stats, "log_rows", R.MEASURES), 5)


@query
def final_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.final_summary(_enhanced(spark, sf_dir))


# drifting schemas


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "feed_files"), table(spark, sf_dir, "feed_rows"))


@query
def p3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_table(table(spark, sf_dir, "feed_files"), table(spark, sf_dir, "feed_rows"))
