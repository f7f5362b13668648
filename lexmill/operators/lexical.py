"""Lexical diversity and information measures of corpora: aggregates of the frequency table.

All take (corpus, tok, c) and give a row per corpus. Corpora without tokens have no row of
frequencies; `with_empty` brings them back with zeros.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.numeric import ratio


def _x(c: Column) -> Column:
    return c.cast("double")


def _sums() -> SimpleNamespace:
    """The aggregates the measures are made of."""
    c, n, v = F.col("c"), F.sum("c"), F.count(F.lit(1))
    return SimpleNamespace(
        c=c,
        n=n,
        v=v,
        entropy=F.greatest(F.lit(0.0), F.log2(_x(n)) - F.sum(c * F.log2(_x(c))) / n),
        log_ttr=F.when((n > 1) & (v > 1), F.try_divide(F.log(_x(v)), F.log(_x(n)))).otherwise(0.0),
        hapax=ratio(F.sum((c == 1).cast("bigint")), n),
        yule=F.when(n >= 2, ratio(10000 * (F.sum(c * c) - n), n * n)).otherwise(0.0),
        simpson=F.when(n >= 2, 1 - ratio(F.sum(c * (c - 1)), n * (n - 1))).otherwise(0.0),
        word_len=ratio(F.sum(c * F.length("tok")), n),
    )


def corpus_stats(freq: DataFrame) -> DataFrame:
    """(corpus, n_tokens, vocab_size, ttr, root_ttr, log_ttr, hapax_ratio, yules_k, simpsons_d, entropy,
    norm_entropy, perplexity, avg_word_len)."""
    m = _sums()
    return freq.groupBy("corpus").agg(
        m.n.alias("n_tokens"),
        m.v.alias("vocab_size"),
        ratio(m.v, m.n).alias("ttr"),
        ratio(m.v, F.sqrt(_x(m.n))).alias("root_ttr"),
        m.log_ttr.alias("log_ttr"),
        m.hapax.alias("hapax_ratio"),
        m.yule.alias("yules_k"),
        m.simpson.alias("simpsons_d"),
        m.entropy.alias("entropy"),
        F.when(m.v > 1, F.try_divide(m.entropy, F.log2(_x(m.v)))).otherwise(0.0).alias("norm_entropy"),
        F.pow(F.lit(2.0), m.entropy).alias("perplexity"),
        m.word_len.alias("avg_word_len"),
    )


def with_empty(stats: DataFrame, docs: DataFrame) -> DataFrame:
    """`stats` with a row of zeros for every corpus of `docs` that has no tokens (its perplexity is 0 too)."""
    return docs.select("corpus").distinct().join(stats, "corpus", "left").na.fill(0)


def tokenization_summary(freq: DataFrame) -> DataFrame:
    m = _sums()
    return freq.groupBy("corpus").agg(m.n.alias("n_tokens"), m.v.alias("vocab_size"))


def word_lengths(freq: DataFrame) -> DataFrame:
    """(corpus, avg_word_len, word_len_var): population variance, 0 for fewer than two tokens."""
    m = _sums()
    squares = ratio(F.sum(m.c * F.length("tok") * F.length("tok")), m.n)
    return freq.groupBy("corpus").agg(m.word_len.alias("avg_word_len"), F.when(m.n >= 2, squares - m.word_len * m.word_len).otherwise(0.0).alias("word_len_var"))


def lexical_density(freq: DataFrame, content: DataFrame | None = None, least: int = 4) -> DataFrame:
    """(corpus, density): the share of tokens of `least` letters or more, or of those in `content` (tok)."""
    m = _sums()
    if content is None:
        return freq.groupBy("corpus").agg(ratio(F.sum(F.when(F.length("tok") >= least, m.c).otherwise(0)), m.n).alias("density"))
    marked = freq.join(content.select("tok").distinct().withColumn("in", F.lit(1)), "tok", "left")
    return marked.groupBy("corpus").agg(ratio(F.sum(F.when(F.col("in") == 1, m.c).otherwise(0)), m.n).alias("density"))


def distribution(freq: DataFrame) -> DataFrame:
    """(corpus, mean, median, max, std, skewness, kurtosis, hapax, dis_legomena, frequent) of the counts.

    std is the population's; skewness and kurtosis carry the usual factors for small samples and are 0
    for constant counts and fewer than 3 or 4 types."""
    m = _sums()
    n = _x(m.v)
    skew = n * n / F.nullif((n - 1) * (n - 2), F.lit(0.0)) * F.skewness("c")
    bent = n * (n + 1) / F.nullif((n - 1) * (n - 2) * (n - 3), F.lit(0.0)) * n * (F.kurtosis("c") + 3)
    kurt = bent - 3 * (n - 1) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    varied = F.stddev_pop("c") > 0
    return freq.groupBy("corpus").agg(
        F.avg("c").alias("mean"),
        F.percentile("c", F.lit(0.5)).alias("median"),
        F.max("c").alias("max"),
        F.stddev_pop("c").alias("std"),
        F.coalesce(F.when((m.v >= 3) & varied, skew), F.lit(0.0)).alias("skewness"),
        F.coalesce(F.when((m.v >= 4) & varied, kurt), F.lit(0.0)).alias("kurtosis"),
        F.sum((m.c == 1).cast("bigint")).alias("hapax"),
        F.sum((m.c == 2).cast("bigint")).alias("dis_legomena"),
        F.sum((m.c >= 10).cast("bigint")).alias("frequent"),
    )


def richness(freq: DataFrame, mattr: DataFrame) -> DataFrame:
    """The measures of vocabulary richness side by side; `mattr` has (corpus, mattr)."""
    own = corpus_stats(freq).select(
        "corpus", F.col("n_tokens").alias("total_tokens"), F.col("vocab_size").alias("unique_tokens"), "ttr", "root_ttr", "log_ttr",
        "hapax_ratio", "yules_k", "simpsons_d", "entropy", "norm_entropy", "avg_word_len",
    )
    return own.join(mattr, "corpus")
