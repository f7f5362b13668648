"""The long tables everything is computed from: documents, tokens, frequencies and positions.

A corpus is a value of a column, never a table of its own. Positions run through a corpus from its
first document to its last. They are found without sorting a corpus in one task: documents are put
in ranges of their order, borders at quantiles, as many as their size asks for; range totals are
summed up, and only inside a range are rows ordered. A document's tokens stay in one array all the
way, with the few tokens that come before it, so that whatever looks back no further than those is
worked out inside the row. The arrays move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.text import full, tokens

#: Bytes of a range, and ranges at least and at most.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 32 << 20, 8, 16384
#: Tokens of a corpus that are ordered in one task.
STRETCH = 1 << 20


def documents(df: DataFrame, corpus: str, order: str, text: str) -> DataFrame:
    """(corpus, doc_ord, text); rows without a corpus or order are left out, null texts are empty."""
    return df.where(F.col(corpus).isNotNull() & F.col(order).isNotNull()).select(
        F.col(corpus).alias("corpus"), F.col(order).cast("bigint").alias("doc_ord"), full(F.col(text)).alias("text")
    )


def token_table(docs: DataFrame, least: int = 2) -> DataFrame:
    """(corpus, doc_ord, pos, tok), pos from 0 on."""
    return docs.select("corpus", "doc_ord", F.posexplode(tokens(F.col("text"), least)).alias("pos", "tok"))


def frequencies(toks: DataFrame) -> DataFrame:
    """(corpus, tok, c)."""
    return toks.groupBy("corpus", "tok").agg(F.count(F.lit(1)).alias("c"))


def ranged(df: DataFrame, order: str, like: DataFrame | None = None) -> DataFrame:
    """`df` with `_range`, the number of the range its row's `order` (a whole number) lies in: about as many
    rows in each, the borders being quantiles over all rows, however the values are spread. The number of
    ranges follows from the size Spark expects of `like`, which is `df` unless given."""
    size = int((df if like is None else like)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 60  # what Spark can't size counts as endless
    k = min(MOST_RANGES, max(LEAST_RANGES, -(-size // RANGE_BYTES) if known else 0))
    borders = df.agg(F.percentile_approx(order, [i / k for i in range(1, k)], 10 * k + 1000)).first()[0] if k > 1 else []
    if not borders:
        return df.withColumn("_range", F.lit(0))
    held = F.expr(f"array({','.join(f'{b}L' for b in borders)})")
    # binary search: how many borders lie below
    bounds = F.struct(F.lit(0).alias("low"), F.lit(k - 1).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = F.get(held, middle) < F.col(order)
        done = s["low"] >= s["high"]
        return F.struct(F.when(~done & right, middle + 1).otherwise(s["low"]).alias("low"), F.when(~done & ~right, middle).otherwise(s["high"]).alias("high"))

    place = F.aggregate(F.sequence(F.lit(1), F.lit(k.bit_length() + 1)), bounds, halve, lambda s: s["low"])
    return df.withColumn("_range", F.coalesce(place, F.lit(0)))


def running_total(df: DataFrame, group: list[str], order: str, size: Column, name: str, like: DataFrame | None = None) -> DataFrame:
    """`df` with the sum of `size` over the rows of its group that come before in `order` (a whole number;
    rows that share it are taken in any order); `like` as in `ranged`."""
    sized = ranged(df.withColumn("_size", size), order, like)
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = sized.groupBy(*group, "_range").agg(F.sum("_size").alias("_total")).withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    inside = W.partitionBy(*group, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        sized.join(totals.drop("_total"), [*group, "_range"])
        .withColumn(name, F.col("_base") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
        .drop("_size", "_range", "_base")
    )


def _last(toks: Column, k: int) -> Column:
    return F.slice(toks, F.greatest(F.size(toks) - k, F.lit(0)) + 1, k)


def _before(group: list[str], at: str, toks: Column, k: int) -> Column:
    """The last k tokens of the rows of `group` before this one; `at` is where a row begins. Rows hold one token
    at least, so they are those that begin in the last k places and the one before these."""
    w = W.partitionBy(*group).orderBy(at)
    near = F.flatten(F.collect_list(_last(toks, k)).over(w.rangeBetween(-k, -1)))
    far = F.last(_last(toks, k)).over(w.rangeBetween(W.unboundedPreceding, -k - 1))
    return _last(F.concat(F.coalesce(far, F.array().cast("array<string>")), near), k)


def placed(docs: DataFrame, least: int = 2, behind: int = 0) -> DataFrame:
    """(corpus, n, offset, before, toks): every document that has tokens, with its tokens, the place of the
    first of them in its corpus, the `behind` tokens that come before it (fewer at the corpus' beginning)
    and the number of tokens of the corpus. Documents that share an order are taken in order of their
    tokens' digest."""
    held = ranged(docs, "doc_ord").select("corpus", "_range", "doc_ord", tokens(F.col("text"), least).alias("toks"))
    group = ["corpus", "_range"]
    inside = W.partitionBy(*group).orderBy("doc_ord", F.xxhash64("toks")).rowsBetween(W.unboundedPreceding, -1)
    size, none = F.size("toks").cast("bigint"), F.array().cast("array<string>")
    # one exchange: ranges are summed up from the same placing of the arrays, hence from the same columns
    local = held.repartition(*group).withColumn("at", F.coalesce(F.sum(size).over(inside), F.lit(0))).where(F.size("toks") > 0)
    near = _before(group, "at", F.col("toks"), behind) if behind else none
    local = local.withColumn("near", near)
    tail = F.max_by(_last(F.concat("near", "toks"), behind), "at") if behind else F.max(none)
    ranges = local.groupBy(*group).agg(F.max(F.col("at") + size).alias("total"), tail.alias("tail"))
    whole = W.partitionBy("corpus")
    ranges = ranges.withColumns({"base": F.coalesce(F.sum("total").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("total").over(whole)})
    ranges = ranges.select(*group, "base", "n", (_before(["corpus"], "base", F.col("tail"), behind) if behind else none).alias("left"))
    before = _last(F.concat("left", "near"), behind) if behind else none
    return local.join(ranges, group).select("corpus", "n", (F.col("base") + F.col("at")).alias("offset"), before.alias("before"), "toks")


def positions(docs: DataFrame, least: int = 2) -> DataFrame:
    """(corpus, n, gpos, tok): every token with its place in its corpus, documents in order, and the number of
    tokens of the corpus."""
    at = placed(docs, least).select("corpus", "n", "offset", F.posexplode("toks").alias("pos", "tok"))
    return at.select("corpus", "n", (F.col("offset") + F.col("pos")).alias("gpos"), "tok")


def ngram_counts(docs: DataFrame, orders: tuple[int, ...], least: int = 2) -> DataFrame:
    """(corpus, n, gram, c) of every run of n tokens for every n of `orders`, across document borders; gram has
    the tokens parted by blanks. All orders come from one pass. A corpus with fewer tokens than every n has
    one row with a null gram."""
    seq, b = F.col("seq"), F.size("before")

    def runs(n: int) -> Column:
        first = F.greatest(b, F.lit(n - 1))
        gram = lambda j: F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *(F.get(seq, j - k) for k in range(n - 1, -1, -1))).alias("gram"))
        return F.when(first < F.size(seq), F.transform(F.sequence(first, F.size(seq) - 1), gram)).otherwise(F.array().cast("array<struct<n:int,gram:string>>"))

    texts = placed(docs, least, max(orders) - 1).withColumn("seq", F.concat("before", "toks"))
    grams = texts.select("corpus", F.explode_outer(F.concat(*map(runs, orders))).alias("g"))
    return grams.groupBy("corpus", F.col("g.n").alias("n"), F.col("g.gram").alias("gram")).agg(F.count("g").alias("c"))
