"""Measures that depend on where tokens stand: n-grams, moving windows, gaps, growth and rank laws.

Those that look back a bounded number of tokens take the documents (corpus, doc_ord, text) and work
inside their rows; the others take the position table (corpus, n, gpos, tok). Nothing orders a whole
corpus, or all places of a frequent token, in one task: windows run inside stretches, or inside
ranges whose totals are put together afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.numeric import ratio

from lexmill.session import cut

from .corpora import STRETCH, ngram_counts, placed, running_total


def ngram_stats(docs: DataFrame, orders: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(corpus, n, ngram_count, unique_ngrams, ngram_ttr, ngram_hapax_ratio, ngram_entropy,
    most_common_ngram_freq). A corpus shorter than n has zeros and nulls, one without tokens no row."""
    total, c = F.sum("c"), F.col("c").cast("double")
    stats = ngram_counts(docs, orders).groupBy("corpus", "n").agg(
        total.alias("ngram_count"),
        F.count(F.lit(1)).alias("unique_ngrams"),
        ratio(F.count(F.lit(1)), total).alias("ngram_ttr"),
        ratio(F.sum((F.col("c") == 1).cast("bigint")), total).alias("ngram_hapax_ratio"),
        F.greatest(F.lit(0.0), F.log2(total.cast("double")) - F.sum(F.when(c > 0, c * F.log2(c))) / F.nullif(total, F.lit(0))).alias("ngram_entropy"),
        ratio(F.max("c"), total).alias("most_common_ngram_freq"),
    )
    # a corpus has a row for each order: a handful of rows, put side by side
    names = [x for x in stats.columns if x not in ("corpus", "n")]
    held = stats.groupBy("corpus").agg(F.collect_list(F.struct("n", *names)).alias("s"))
    every = held.select("corpus", "s", F.explode(F.array(*map(F.lit, orders))).alias("n")).withColumn("x", F.get(F.filter("s", lambda s: s["n"] == F.col("n")), F.lit(0)))
    return every.select("corpus", *(F.col(f"x.{x}").alias(x) for x in names), "n").na.fill({"ngram_count": 0, "unique_ngrams": 0, "ngram_ttr": 0.0})


def ngram_pivot(stats: DataFrame, measure: str, orders: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """A row per corpus and a column n1, n2 … per order."""
    wide = stats.groupBy("corpus").pivot("n", list(orders)).agg(F.first(measure))
    return wide.select("corpus", *(F.col(str(n)).alias(f"n{n}") for n in orders))


def conditional_entropy(docs: DataFrame) -> DataFrame:
    """(corpus, conditional_entropy) of a token given the one before it; 0 for fewer than two tokens."""
    c = F.col("c").cast("double")
    # H(pair) - H(first) over the pairs, each a sum that partial aggregation takes
    firsts = ngram_counts(docs, (2,)).groupBy("corpus", F.substring_index("gram", " ", 1).alias("w1")).agg(F.sum("c").alias("c1"), F.sum(F.when(c > 0, c * F.log2(c)).otherwise(0.0)).alias("own"))
    c1 = F.col("c1").cast("double")
    return firsts.groupBy("corpus").agg(F.greatest(F.lit(0.0), ratio(F.sum(F.when(c1 > 0, c1 * F.log2(c1)).otherwise(0.0) - F.col("own")), F.sum("c1"))).alias("conditional_entropy"))


def moving_ttr(docs: DataFrame, window: int = 100) -> DataFrame:
    """(corpus, mattr): the mean share of types in all windows of `window` tokens, the plain share for a
    shorter corpus. Each token counts in those windows that hold it but not its last occurrence, so a
    document needs the window - 1 tokens before it and nothing else."""
    n, b = F.col("n"), F.size("before")
    entries = F.transform(F.concat("before", "toks"), lambda t, i: F.struct(t.alias("tok"), i.alias("i")))
    state = F.struct(F.lit("").alias("tok"), F.lit(-1).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("held"), F.lit(0).cast("bigint").alias("fresh"))

    def step(s: Column, x: Column) -> Column:
        at = F.col("offset") - b + x["i"]
        last = F.when(s["tok"] == x["tok"], s["last"]).otherwise(F.lit(-1).cast("bigint"))
        first = F.greatest(last + 1, at - (window - 1), F.lit(0))
        windows = F.greatest(F.lit(0), F.least(at, n - window) - first + 1)
        own = x["i"] >= b
        return F.struct(
            x["tok"].alias("tok"), at.alias("last"), F.when(own, s["held"] + windows).otherwise(s["held"]).alias("held"),
            F.when(own & (last < 0), s["fresh"] + 1).otherwise(s["fresh"]).alias("fresh"),
        )

    moved = placed(docs, behind=window - 1).select("corpus", "n", F.aggregate(F.array_sort(entries), state, step).alias("s"))
    sums = moved.groupBy("corpus", "n").agg(F.sum("s.held").alias("held"), F.sum("s.fresh").alias("fresh"))
    return sums.select("corpus", F.when(n < window, ratio(F.col("fresh"), n)).otherwise(ratio(F.col("held"), window * (n - window + 1))).alias("mattr"))


def ranked(freq: DataFrame) -> DataFrame:
    """`freq` with `rank` from 1 on by falling count; equal counts have different ranks, in no set order.

    Ranks are put together from the number of types of each count, of each of 64 parts of a count's
    types, and the place in a part, so a large vocabulary is never ordered in one task."""
    part = freq.withColumn("part", F.pmod(F.xxhash64("tok"), F.lit(64)))
    counts = part.groupBy("corpus", "c", "part").agg(F.count(F.lit(1)).alias("types"))
    before = W.partitionBy("corpus").orderBy(F.desc("c"), "part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("types").over(before), F.lit(0))).drop("types")
    inside = W.partitionBy("corpus", "c", "part").orderBy("tok")
    return part.join(bases, ["corpus", "c", "part"]).withColumn("rank", F.col("base") + F.row_number().over(inside)).drop("part", "base")


def zipf_exponents(freq: DataFrame) -> DataFrame:
    """(corpus, zipf_exponent): minus the slope of log count on log rank; 0 for a single type."""
    slope = F.regr_slope(F.log(F.col("c").cast("double")), F.log(F.col("rank").cast("double")))
    return ranked(freq).groupBy("corpus").agg(F.coalesce(-slope, F.lit(0.0)).alias("zipf_exponent"))


def zipf_curve(freq: DataFrame, limit: int = 500) -> DataFrame:
    """(corpus, rank, c, expected) of the first ranks; expected is the top count over rank^exponent."""
    top = freq.groupBy("corpus").agg(F.max("c").alias("top"))
    curve = ranked(freq).where(F.col("rank") <= limit).join(top, "corpus").join(zipf_exponents(freq), "corpus")
    return curve.select("corpus", "rank", "c", (F.col("top") / F.pow(F.col("rank").cast("double"), "zipf_exponent")).alias("expected"))


def zipf_summary(freq: DataFrame) -> DataFrame:
    """One row: how many corpora, how many of them near an exponent of 1, mean and deviation."""
    a = F.col("zipf_exponent")
    return zipf_exponents(freq).agg(
        F.count(F.lit(1)).alias("n_corpora"), F.sum((F.abs(a - 1) < 0.3).cast("bigint")).alias("n_near_one"), F.avg(a).alias("mean_exponent"), F.stddev_pop(a).alias("std_exponent")
    )


def heaps_curve(pos: DataFrame, step: int = 100) -> DataFrame:
    """(corpus, chunk, corpus_size, vocab_size) after every `step` tokens and at the end; a corpus of
    fewer tokens has its one point."""
    first = pos.groupBy("corpus", "n", "tok").agg(F.min("gpos").alias("at"))
    # narrow and used twice: written once to the shared folder
    fresh = cut(first.groupBy("corpus", "n", F.expr(f"at div {step} + 1").alias("chunk")).agg(F.count(F.lit(1)).alias("new")))
    n = F.col("n")
    # chunks with nothing new have a point too; made in blocks, so that no row holds all of a corpus' chunks
    chunks = (
        fresh.select("corpus", "n", F.expr(f"cast(greatest(1, (n + {step} - 1) div {step}) as bigint)").alias("k")).distinct()
        .select("corpus", "n", "k", F.explode(F.expr("sequence(0, (k - 1) div 10000)")).alias("block"))
        .select("corpus", "n", F.explode(F.expr("sequence(block * 10000 + 1, least(k, (block + 1) * 10000))")).alias("chunk"))
    )
    counted = chunks.join(fresh, ["corpus", "n", "chunk"], "left").na.fill(0, ["new"])
    grown = running_total(counted, ["corpus"], "chunk", F.col("new"), "before", fresh)
    return grown.select("corpus", "chunk", F.least(F.col("chunk") * step, n).alias("corpus_size"), (F.col("before") + F.col("new")).alias("vocab_size"))


def heaps_fit(curve: DataFrame) -> DataFrame:
    """(corpus, heaps_k, heaps_beta) by least squares on logarithms; zeros for a single point."""
    y, x = F.log(F.col("vocab_size").cast("double")), F.log(F.col("corpus_size").cast("double"))
    many = F.count(F.lit(1)) > 1
    return curve.groupBy("corpus").agg(
        F.coalesce(F.when(many, F.exp(F.regr_intercept(y, x))), F.lit(0.0)).alias("heaps_k"), F.coalesce(F.when(many, F.regr_slope(y, x)), F.lit(0.0)).alias("heaps_beta")
    )


def heaps_theory(curve: DataFrame) -> DataFrame:
    """`curve` with `expected`, the size of the vocabulary by Heaps' law with the fitted parameters."""
    fitted = heaps_fit(curve)
    return curve.join(fitted, "corpus").withColumn("expected", F.col("heaps_k") * F.pow(F.col("corpus_size").cast("double"), "heaps_beta")).drop("heaps_k", "heaps_beta")


def gap_moments(pos: DataFrame) -> DataFrame:
    """(corpus, tok, c, gaps, squares): sums of the gaps between a token's occurrences and of their
    squares. Gaps are taken inside stretches; those across seams come from each stretch's ends."""
    last = F.lag("gpos").over(W.partitionBy("corpus", "tok", "stretch").orderBy("gpos"))
    gap = F.col("gpos") - F.col("last")
    inside = (
        pos.withColumn("stretch", F.expr(f"gpos div {STRETCH}"))
        .withColumn("last", last)
        .groupBy("corpus", "tok", "stretch")
        .agg(F.count(F.lit(1)).alias("c"), F.min("gpos").alias("low"), F.max("gpos").alias("high"), F.coalesce(F.sum(gap * gap), F.lit(0)).alias("squares"))
    )
    seam = F.col("low") - F.lag("high").over(W.partitionBy("corpus", "tok").orderBy("stretch"))
    return (
        inside.withColumn("seam", F.coalesce(seam, F.lit(0)))
        .groupBy("corpus", "tok")
        .agg(F.sum("c").alias("c"), (F.max("high") - F.min("low")).alias("gaps"), F.sum(F.col("squares") + F.col("seam") * F.col("seam")).alias("squares"))
    )


def burstiness(pos: DataFrame) -> DataFrame:
    """(corpus, tok, c, burstiness) = (sd - mean) / (sd + mean) of the gaps; 0 for a single occurrence."""
    k = F.col("c") - 1
    mean = ratio(F.col("gaps"), k)
    sd = F.sqrt(F.greatest(F.lit(0.0), ratio(F.col("squares"), k) - mean * mean))
    return gap_moments(pos).select("corpus", "tok", "c", ratio(sd - mean, sd + mean).alias("burstiness"))


def average_burstiness(pos: DataFrame, least: int = 5) -> DataFrame:
    """(corpus, avg_burstiness) over the tokens that occur `least` times or more; 0 without any."""
    return burstiness(pos).groupBy("corpus").agg(F.coalesce(F.avg(F.when(F.col("c") >= least, F.col("burstiness"))), F.lit(0.0)).alias("avg_burstiness"))


#: Word pairs that are measured at once.
MAX_PAIRS = 1000


def pmi(docs: DataFrame, pairs: DataFrame, window: int = 5) -> DataFrame:
    """(corpus, w1, w2, pmi) of the given (w1, w2): how much likelier w2 is within `window` places of w1
    than anywhere. Windows stand around w1 only, so the measure isn't symmetric; 0 if either word is
    absent or they never meet. `pairs` is a small table by contract.

    A document needs the `window` tokens before it: of two words that meet, the later sees the earlier.
    Only places of wanted words leave their row."""
    listed = sorted({(r[0], r[1]) for r in pairs.select("w1", "w2").dropna().distinct().limit(MAX_PAIRS + 1).collect()})
    if len(listed) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs at once")
    words, keys = sorted({w for p in listed for w in p}), [" ".join(p) for p in listed]
    n, b, seq = F.col("n"), F.size("before"), F.col("seq")
    texts = placed(docs, behind=window).withColumn("seq", F.concat("before", "toks"))
    places = F.filter(F.transform(seq, lambda t, j: F.struct(t.alias("t"), j.alias("j"))), lambda x: (x["j"] >= b) & x["t"].isin(words))
    at = texts.select("corpus", "n", "offset", "seq", b.alias("b"), F.explode_outer(places).alias("x"))
    j, t, place = F.col("x.j"), F.col("x.t"), F.col("offset") - F.col("b") + F.col("x.j")
    wide = (F.least(n, place + window + 1) - F.greatest(F.lit(0), place - window) - 1).cast("bigint")
    entry = lambda key, co, c, den: F.struct(key.alias("key"), F.lit(co).cast("bigint").alias("co"), F.lit(c).cast("bigint").alias("c"), den.alias("den"))
    left = F.filter(F.slice(seq, F.greatest(j - window, F.lit(0)) + 1, F.least(j, F.lit(window))), lambda w: w.isin(words))
    none = F.lit(0).cast("bigint")
    met = F.concat(F.transform(left, lambda w: entry(F.concat_ws(" ", w, t), 1, 0, none)), F.transform(left, lambda w: entry(F.concat_ws(" ", t, w), 1, 0, none)))
    entries = F.concat(F.array(entry(t, 0, 1, wide)), F.filter(met, lambda e: e["key"].isin(keys)))
    found = at.select("corpus", "n", F.explode(F.when(F.col("x").isNull(), F.array(entry(F.lit(""), 0, 0, none))).otherwise(entries)).alias("e"))
    sums = found.groupBy("corpus", "n", "e.key").agg(F.sum("e.co").alias("co"), F.sum("e.c").alias("c"), F.sum("e.den").alias("den"))
    # at most a row for each wanted word and pair: put side by side in one row a corpus
    held = sums.groupBy("corpus", "n").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("co", "c", "den")))).alias("m"))
    wanted = F.array(*(F.struct(F.lit(a).alias("w1"), F.lit(z).alias("w2")) for a, z in listed)) if listed else F.array().cast("array<struct<w1:string,w2:string>>")
    full = held.select("corpus", "n", "m", F.explode(wanted).alias("p")).select("corpus", "n", "p.w1", "p.w2", "m")
    one, two, co = F.try_element_at("m", F.col("w1")), F.try_element_at("m", F.col("w2")), F.try_element_at("m", F.concat_ws(" ", "w1", "w2"))["co"]
    score = F.log2(co / one["den"] / (one["c"] / n) / (two["c"] / n))
    return full.select("corpus", "w1", "w2", F.coalesce(F.when((co > 0) & (one["den"] > 0), score), F.lit(0.0)).alias("pmi"))
