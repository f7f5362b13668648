"""How distinctive a term is for a record: log-entropy weighting.

The weight of term t in record r is ln(1 + tf(t, r)) * (1 - H(t) / ln N). H(t) is the entropy of the
term's spread over the N records, H(t) = ln gf - (sum over records of tf ln tf) / gf, so one pass
that sums tf, tf ln tf and 1 per term suffices. A term spread evenly over all records weighs 0,
one that sits in a single record weighs its full log frequency.

Plan: records -> one row per key (the only shuffle of text) -> aggregation 1 counts (key, term)
without another shuffle, as rows are already placed by key -> aggregation 2 sums per term with
map-side combination -> shuffle join back on the term (AQE splits the partitions of hot terms).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import one_per_key

#: What separates tokens, and what a token may hold.
NON_WORD = r"[^\p{L}\p{N}_]+"


def ascii_terms(text: Column, min_len: int) -> Column:
    """Lower-cased word-character runs made of ASCII letters only, of `min_len` or more letters."""
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), NON_WORD)
    return F.filter(runs, lambda w: w.rlike(f"^[a-z]{{{min_len},}}$"))


def term_counts(records: DataFrame, key: str = "rid", text: str = "post", min_len: int = 2) -> DataFrame:
    """(key, term, tf) of every record: aggregation 1."""
    once = one_per_key(records.select(key, text), key, text)
    return (
        once.select(key, F.explode(ascii_terms(F.col(text), min_len)).alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def term_stats(counts: DataFrame) -> DataFrame:
    """(term, gf, df, spread): occurrences, records and entropy of each term: aggregation 2."""
    gf = F.sum("tf")
    return counts.groupBy("term").agg(
        gf.alias("gf"),
        F.count(F.lit(1)).alias("df"),
        (F.log(gf) - F.sum(F.col("tf") * F.log("tf")) / gf).alias("spread"),
    )


def distinctive_terms(
    records: DataFrame,
    key: str = "rid",
    text: str = "post",
    min_len: int = 2,
    min_tf: int = 1,
    df_range: tuple[int, int | None] = (1, None),
) -> DataFrame:
    """(key, term, tf, df, score) for every term of every record.

    `min_tf` and `df_range` restrict what is returned, not what is counted: weights always come from
    all records. Rows without a key are left out; a null, blank or term-less text yields no row but
    its record counts in N; repeated deliveries of a key count once; with fewer than two records
    every global weight is 1. Other columns of `records` are ignored.
    """
    n = records.agg(F.count_distinct(key).alias("n")).scalar()
    counts = term_counts(records, key, text, min_len)
    low, high = df_range
    stats = term_stats(counts).where(F.col("df") >= low)
    if high is not None:
        stats = stats.where(F.col("df") <= high)
    weight = F.when(n < 2, F.lit(1.0)).otherwise(1 - F.try_divide(F.col("spread"), F.log(n.cast("double"))))
    return (
        counts.where(F.col("tf") >= min_tf)
        .join(stats, "term")
        .select(key, "term", "tf", "df", (F.log1p(F.col("tf").cast("double")) * weight).alias("score"))
    )
