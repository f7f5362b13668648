"""How alike corpora are: overlaps of vocabulary and cosines over the sparse frequency table.

Corpora meet on shared tokens (an equi-join in which a token has at most one row per corpus and
side); nothing dense is built. Every unordered pair has a row, those without a shared token too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.numeric import ratio

#: Parts (a power of 2) the names are dealt into when pairs are listed. A row then holds one part of them, never all.
BLOCKS = 64


def _pairs(freq: DataFrame, same: bool = False) -> DataFrame:
    """(c1, c2) of all corpora, c1 before c2. Every name meets the other names block by block, an equi-join on
    the block's number, so no cross join is needed and the number of corpora has no bound."""
    names = freq.where("corpus is not null").select("corpus").distinct()
    block = F.xxhash64("corpus").bitwiseAND(F.lit(BLOCKS - 1).cast("bigint"))  # never null, so both sides share one shuffle
    packed = names.groupBy(block.alias("block")).agg(F.collect_list("corpus").alias("others"))
    spread = names.select(F.col("corpus").alias("c1"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BLOCKS - 1).cast("bigint"))).alias("block"))
    listed = spread.join(packed, "block").select("c1", F.explode("others").alias("c2"))
    return listed.where("c1 <= c2" if same else "c1 < c2")


def overlaps(freq: DataFrame) -> DataFrame:
    """(c1, c2, v1, v2, shared) of every pair."""
    vocab = freq.select("corpus", "tok").distinct()
    left, right = vocab.select("tok", F.col("corpus").alias("c1")), vocab.select("tok", F.col("corpus").alias("c2"))
    shared = left.join(right, "tok").where("c1 < c2").groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("shared"))
    size = vocab.groupBy("corpus").agg(F.count(F.lit(1)).alias("v"))
    return (
        _pairs(freq)
        .join(shared, ["c1", "c2"], "left")
        .na.fill(0, ["shared"])
        .join(size.select(F.col("corpus").alias("c1"), F.col("v").alias("v1")), "c1")
        .join(size.select(F.col("corpus").alias("c2"), F.col("v").alias("v2")), "c2")
    )


def jaccard_pairs(freq: DataFrame) -> DataFrame:
    """(c1, c2, similarity)."""
    return overlaps(freq).select("c1", "c2", ratio(F.col("shared"), F.col("v1") + F.col("v2") - F.col("shared")).alias("similarity"))


def jaccard_matrix(freq: DataFrame) -> DataFrame:
    """(c1, c2, similarity) in both directions, with 1 on the diagonal."""
    pairs = jaccard_pairs(freq)
    back = pairs.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), "similarity")
    own = freq.select(F.col("corpus").alias("c1"), F.col("corpus").alias("c2"), F.lit(1.0).alias("similarity")).distinct()
    return pairs.unionByName(back).unionByName(own)


def most_similar(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The k most similar pairs."""
    return pairs.orderBy(F.desc("similarity"), "c1", "c2").limit(k)


def vocabulary_overlap(freq: DataFrame) -> DataFrame:
    """Jaccard, Dice and overlap coefficients, coverages and set sizes of every pair."""
    s, a, b = F.col("shared"), F.col("v1"), F.col("v2")
    return overlaps(freq).select(
        "c1",
        "c2",
        ratio(s, a + b - s).alias("jaccard_similarity"),
        ratio(2 * s, a + b).alias("dice_coefficient"),
        ratio(s, F.least(a, b)).alias("overlap_coefficient"),
        ratio(s, a).alias("vocab1_coverage"),
        ratio(s, b).alias("vocab2_coverage"),
        (a - s).alias("unique_to_vocab1"),
        (b - s).alias("unique_to_vocab2"),
        s.alias("shared_vocab"),
    )


def _dots(weights: DataFrame, same: bool) -> DataFrame:
    """(c1, c2, dot) over (corpus, tok, w), 0 for pairs that share nothing."""
    left, right = (weights.select("tok", F.col("corpus").alias(c), F.col("w").alias(w)) for c, w in (("c1", "w1"), ("c2", "w2")))
    met = left.join(right, "tok").where("c1 <= c2" if same else "c1 < c2").groupBy("c1", "c2").agg(F.sum(F.col("w1") * F.col("w2")).alias("dot"))
    return _pairs(weights, same).join(met, ["c1", "c2"], "left").na.fill(0.0, ["dot"])


def bow_cosine(freq: DataFrame) -> DataFrame:
    """(c1, c2, cosine) of the raw counts of every pair."""
    norms = freq.groupBy("corpus").agg(F.sqrt(F.sum(F.col("c").cast("double") * F.col("c"))).alias("norm"))
    unit = freq.join(norms, "corpus").select("corpus", "tok", ratio(F.col("c"), F.col("norm")).alias("w"))
    return _dots(unit, False).withColumnRenamed("dot", "cosine")


def frequency_matrix(freq: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """(corpus, tok, c), of the tokens in `vocab` (tok) only where that is given."""
    return freq if vocab is None else freq.join(vocab.select("tok").distinct(), "tok", "left_semi").select("corpus", "tok", "c")


def tfidf(freq: DataFrame) -> DataFrame:
    """(corpus, tok, w): counts times ln(D / (df + 1)) + 1, scaled to length 1 within a corpus."""
    held = freq.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    n = freq.agg(F.count_distinct("corpus").cast("double").alias("d")).scalar()
    raw = freq.join(held, "tok").select("corpus", "tok", (F.col("c") * (F.log(n / (F.col("df") + 1)) + 1)).alias("x"))
    norms = raw.groupBy("corpus").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norms, "corpus").select("corpus", "tok", (F.col("x") / (F.col("norm") + 1e-8)).alias("w"))


def tfidf_similarity(freq: DataFrame) -> DataFrame:
    """(c1, c2, similarity) of every pair, each corpus with itself included."""
    return _dots(tfidf(freq), True).withColumnRenamed("dot", "similarity")


def dense_dots(vectors: DataFrame, key: str, vector: str, queries: DataFrame, block: int = 1024) -> DataFrame:
    """(query, other, dot): every vector of `queries` with every vector of `vectors`, as they are.

    Queries are packed in blocks of about `block` rows; vectors meet each block by an equi-join on the
    block's number in groups of rows, and a group's products are one matrix product in an Arrow batch.
    Rows whose key or vector is null meet nothing; vectors of a query set are of one length, vectors of
    another length meet nothing either."""
    held = lambda df: df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    asked = held(queries).select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("q"))
    blocks = max(1, -(-asked.count() // block))
    packed = asked.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query", "q")).alias("qs"))
    # vectors travel in groups too, so that a block is attached once a group and not once a row
    others = held(vectors).select(F.col(key).alias("other"), F.col(vector).cast("array<double>").alias("v"), F.expr("monotonically_increasing_id() div 1024").alias("group"))
    grouped = others.groupBy("group").agg(F.collect_list(F.struct("other", "v")).alias("vs"))
    met = grouped.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).join(packed, "block")
    kinds = [df.schema[key].dataType.simpleString() for df in (queries, vectors)]
    return met.select("qs", "vs").mapInArrow(_products, f"query {kinds[0]}, other {kinds[1]}, dot double")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            (query, q), (other, v) = (_matrix(batch.column(c)[i].values) for c in (0, 1))
            for at in {len(x) for x in q} & {len(x) for x in v}:
                a, b = ([k for k, x in enumerate(m) if len(x) == at] for m in (q, v))
                dots = np.array([q[k] for k in a]).reshape(-1, at) @ np.array([v[k] for k in b]).reshape(-1, at).T
                names = [query.take(pa.array(np.repeat(a, len(b)))), other.take(pa.array(np.tile(b, len(a))))]
                yield pa.RecordBatch.from_arrays([*names, pa.array(dots.ravel())], names=["query", "other", "dot"])


def _matrix(rows: pa.StructArray) -> tuple[pa.Array, list[np.ndarray]]:
    """Keys and vectors; a null in a vector counts as nan."""
    lists = rows.field(1)
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return rows.field(0), [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def size_matrix(sizes: DataFrame) -> DataFrame:
    """(df1, df2, merged_rows, log_merged_rows) both ways, null on the diagonal."""
    both = sizes.select("df1", "df2", "merged_rows").unionByName(sizes.select(F.col("df2").alias("df1"), F.col("df1").alias("df2"), "merged_rows"))
    names = both.select(F.col("df1").alias("df1"), F.col("df1").alias("df2"), F.lit(None).cast("bigint").alias("merged_rows")).distinct()
    return both.unionByName(names).withColumn("log_merged_rows", F.log10(F.col("merged_rows") + 1.0))
