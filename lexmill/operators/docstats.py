"""Statistics of single documents, as column expressions: no shuffle, and a document's tokens never
leave its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.numeric import ratio
from lexmill.functions.text import full, sentence_count, syllables, tokens

WINDOW = 100


def _runs(toks: Column) -> Column:
    """(types, once, squares, pairs, weighted) of a token array: a fold over its sorted tokens that closes
    a run whenever the token changes."""
    state = F.struct(
        F.lit("").alias("tok"), F.lit(0).cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("types"), F.lit(0).cast("bigint").alias("once"),
        F.lit(0).cast("bigint").alias("squares"), F.lit(0.0).alias("weighted"),
    )

    def close(s: Column) -> dict[str, Column]:
        r = s["run"]
        return {
            "types": s["types"] + (r > 0).cast("bigint"),
            "once": s["once"] + (r == 1).cast("bigint"),
            "squares": s["squares"] + r * r,
            "weighted": s["weighted"] + F.when(r > 1, r * F.log2(r.cast("double"))).otherwise(0.0),
        }

    def step(s: Column, t: Column) -> Column:
        done = close(s)
        same = s["tok"] == t
        return F.struct(
            t.alias("tok"), F.when(same, s["run"] + 1).otherwise(F.lit(1).cast("bigint")).alias("run"), *(F.when(same, s[k]).otherwise(v).alias(k) for k, v in done.items())
        )

    return F.aggregate(F.array_sort(toks), state, step, lambda s: F.struct(*(v.alias(k) for k, v in close(s).items())))


def _window_types(toks: Column, w: int) -> Column:
    """Sum over all windows of w tokens of their numbers of types: each token counts in the windows that
    hold it but not the same token before it."""
    n = F.size(toks)
    placed = F.array_sort(F.transform(toks, lambda t, i: F.struct(t.alias("tok"), i.alias("at"))))
    state = F.struct(F.lit("").alias("tok"), F.lit(-1).alias("at"), F.lit(0).cast("bigint").alias("sum"))

    def step(s: Column, x: Column) -> Column:
        last = F.when(s["tok"] == x["tok"], s["at"]).otherwise(-1)
        first = F.greatest(last + 1, x["at"] - (w - 1), F.lit(0))
        return F.struct(x["tok"].alias("tok"), x["at"].alias("at"), (s["sum"] + F.greatest(F.lit(0), F.least(x["at"], n - w) - first + 1)).alias("sum"))

    return F.aggregate(placed, state, step, lambda s: s["sum"])


def fast_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_tokens, n_unique, ttr, avg_word_len, entropy, char_count); texts without tokens have zeros."""
    t = full(F.col(text))
    held = docs.select(key, F.length(t).cast("bigint").alias("char_count"), tokens(t).alias("_t"))
    n = F.size("_t").cast("bigint")
    return held.withColumn("_r", _runs(F.col("_t"))).select(
        key,
        n.alias("n_tokens"),
        F.col("_r.types").alias("n_unique"),
        ratio(F.col("_r.types"), n).alias("ttr"),
        ratio(F.length(F.array_join("_t", "")), n).alias("avg_word_len"),
        F.when(n > 0, F.log2(n.cast("double")) - F.col("_r.weighted") / n).otherwise(0.0).alias("entropy"),
        "char_count",
    )


def full_stats(docs: DataFrame, key: str, text: str, least: int = 1) -> DataFrame:
    """The sixteen statistics of each document: size, lexical diversity, word length and readability.

    Readability takes all tokens, the others those of `least` letters or more. Texts without tokens
    have zeros apart from their characters and sentences.
    """
    t = full(F.col(text))
    held = docs.select(key, F.length(t).cast("bigint").alias("char_count"), sentence_count(t).cast("bigint").alias("sentence_count"), tokens(t, 1).alias("_all"))
    held = held.withColumn("_t", F.filter("_all", lambda w: F.length(w) >= least) if least > 1 else F.col("_all"))
    held = held.withColumns({"_r": _runs(F.col("_t")), "_n": F.size("_t").cast("bigint"), "_a": F.size("_all").cast("bigint")})
    n, v, s = F.col("_n"), F.col("_r.types"), F.col("sentence_count")
    x = n.cast("double")
    zero = F.lit(0.0)
    length = ratio(F.length(F.array_join("_t", "")), n)
    squares = F.aggregate("_t", F.lit(0).cast("bigint"), lambda acc, w: acc + F.length(w) * F.length(w))
    spoken = F.aggregate("_all", F.lit(0).cast("bigint"), lambda acc, w: acc + syllables(w))
    heard, per_word, per_sentence = F.col("_a"), ratio(spoken, F.col("_a")), ratio(F.col("_a"), s)
    flesch = F.greatest(zero, F.least(F.lit(100.0), 206.835 - 1.015 * per_sentence - 84.6 * per_word))
    ari = F.greatest(zero, 4.71 * ratio(F.length(F.array_join("_all", "")), heard) + 0.5 * per_sentence - 21.43)
    readable = (heard > 0) & (s > 0)
    return held.select(
        key,
        n.alias("token_count"),
        v.alias("unique_tokens"),
        s.alias("sentence_count"),
        "char_count",
        ratio(v, n).alias("ttr"),
        ratio(v, F.sqrt(x)).alias("root_ttr"),
        F.when((n > 1) & (v > 1), F.try_divide(F.log(v.cast("double")), F.log(x))).otherwise(zero).alias("log_ttr"),
        F.when(n < WINDOW, ratio(v, n)).otherwise(ratio(_window_types(F.col("_t"), WINDOW), WINDOW * (n - WINDOW + 1))).alias("mattr_100"),
        ratio(F.col("_r.once"), n).alias("hapax_ratio"),
        F.when(n >= 2, ratio(10000 * (F.col("_r.squares") - n), n * n)).otherwise(zero).alias("yules_k"),
        F.when(n >= 2, 1 - ratio(F.col("_r.squares") - n, n * (n - 1))).otherwise(zero).alias("simpsons_d"),
        length.alias("avg_word_length"),
        F.when(n >= 2, ratio(squares, n) - length * length).otherwise(zero).alias("word_length_var"),
        F.when(readable, flesch).otherwise(zero).alias("flesch_reading_ease"),
        F.when(readable, ari).otherwise(zero).alias("ari"),
        ratio(n, F.greatest(s, F.lit(1))).alias("avg_sentence_length"),
    )


def cleaning_stats(docs: DataFrame, original: Column, cleaned: Column) -> DataFrame:
    """One row on what a cleaner took away; null texts count as empty."""
    a, b = F.length(full(original)), F.length(full(cleaned))
    lost = 100 * (1 - F.try_divide(F.sum(b).cast("double"), F.sum(a).cast("double")))
    return docs.agg(
        F.avg(a).alias("mean_length_original"),
        F.avg(b).alias("mean_length_cleaned"),
        F.coalesce(lost, F.lit(0.0)).alias("length_reduction_pct"),
        F.sum((a == 0).cast("bigint")).alias("empty_original"),
        F.sum((b == 0).cast("bigint")).alias("empty_cleaned"),
        F.sum(a - b).alias("chars_removed"),
    )
