"""Figures about the merged corpora, rolled up and set against each other."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.numeric import pearson

from .collapse import _all, entity_pairs

MEASURES = ("n_tokens", "vocab_size", "ttr", "root_ttr", "log_ttr", "hapax_ratio", "yules_k", "simpsons_d", "entropy", "norm_entropy", "perplexity", "avg_word_len")


def dataset_sizes(datasets: dict[str, DataFrame]) -> DataFrame:
    """(dataset, n_rows)."""
    return _all([df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("dataset"), "n_rows") for n, df in datasets.items()])


def merged_sizes(datasets: dict[str, DataFrame]) -> DataFrame:
    """(corpus, df1, df2, merged_rows): rows after collapsing, an entity each."""
    return entity_pairs(datasets).groupBy("corpus", "df1", "df2").agg(F.count(F.lit(1)).alias("merged_rows"))


def merge_stats(sizes: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: (n_original, n_merged, original_rows, merged_rows)."""
    a = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("r"))
    b = merged.agg(F.count(F.lit(1)).alias("n"), F.sum("merged_rows").alias("r"))
    return a.select(F.col("n").alias("n_original"), b.select("n").scalar().alias("n_merged"), F.col("r").alias("original_rows"), b.select("r").scalar().alias("merged_rows"))


def size_summary(merged: DataFrame) -> DataFrame:
    x = F.col("merged_rows")
    return merged.agg(F.sum(x).alias("total"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.max(x).alias("max"), F.min(x).alias("min"))


def largest(merged: DataFrame, k: int = 5) -> DataFrame:
    return merged.orderBy(F.desc("merged_rows"), "corpus").limit(k)


def cumulative_sizes(merged: DataFrame) -> DataFrame:
    """(corpus, merged_rows, share): i / n over rising sizes; a row per corpus, so few."""
    w = W.orderBy("merged_rows", "corpus")
    return merged.select("corpus", "merged_rows", (F.row_number().over(w) / F.count(F.lit(1)).over(W.partitionBy())).alias("share"))


def size_quartiles(sizes: DataFrame, merged: DataFrame) -> DataFrame:
    """(kind, q1, median, q3) of original and merged sizes."""

    def one(df: DataFrame, kind: str, column: str) -> DataFrame:
        q = df.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
        return q.select(F.lit(kind).alias("kind"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))

    return one(sizes, "original", "n_rows").unionByName(one(merged, "merged", "merged_rows"))


def _involved(df: DataFrame) -> DataFrame:
    return df.withColumn("dataset", F.explode(F.array_distinct(F.array("df1", "df2"))))


def contributions(merged: DataFrame) -> DataFrame:
    """(dataset, contribution): rows of the corpora it takes part in."""
    return _involved(merged).groupBy("dataset").agg(F.sum("merged_rows").alias("contribution"))


def network_layout(sizes: DataFrame, merged: DataFrame) -> DataFrame:
    """(dataset, x, y, node_size, degree, edge_width): datasets on a circle; width of the thickest edge."""
    total = F.count(F.lit(1)).over(W.partitionBy())
    angle = 2 * F.pi() * (F.row_number().over(W.orderBy("dataset")) - 1) / total
    top = F.greatest(F.max("n_rows").over(W.partitionBy()), F.lit(1))
    nodes = sizes.select("dataset", F.cos(angle).alias("x"), F.sin(angle).alias("y"), (30 + 40 * F.col("n_rows") / top).alias("node_size"))
    width = F.max(F.when(F.col("merged_rows") > 0, 1 + 10 * F.log10(F.col("merged_rows").cast("double")) / 7).otherwise(1.0))
    edges = _involved(merged).groupBy("dataset").agg(F.count(F.lit(1)).alias("degree"), width.alias("edge_width"))
    return nodes.join(edges, "dataset", "left").na.fill(0)


def enriched(stats: DataFrame, merged: DataFrame) -> DataFrame:
    """Corpus statistics with where the corpus comes from and log10 of its size."""
    return stats.join(merged, "corpus").withColumn("log_merged_rows", F.log10(F.col("merged_rows") + 1.0))


def by_dataset(enhanced: DataFrame, sizes: DataFrame) -> DataFrame:
    """Means of the corpora each dataset takes part in; datasets in none are left out."""
    means = _involved(enhanced).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_merged_corpora"),
        *(F.avg(c).alias(f"mean_{c}") for c in ("ttr", "entropy", "perplexity", "yules_k")),
    )
    return sizes.select("dataset", F.col("n_rows").alias("original_size")).join(means, "dataset")


def correlations(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(a, b, r) of every two columns, both ways and with themselves; null where a column is constant.
    One pass over `df` takes all moments."""
    names = [(a, b) for a, b in combinations(columns, 2)] + [(a, a) for a in columns]
    wide = df.agg(*(pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(names)))
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(names) for x, y in ({(a, b), (b, a)})]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.a", "c.b", "c.r")


def correlated_with(df: DataFrame, column: str, columns: tuple[str, ...]) -> DataFrame:
    """(measure, r, strength, direction) of `columns` with `column`, the strongest first."""
    r = F.col("r")
    own = correlations(df, (column, *columns)).where((F.col("a") == column) & (F.col("b") != column))
    strength = F.when(F.abs(r) > 0.5, "strong").when(F.abs(r) > 0.3, "moderate").otherwise("weak")
    return own.select(F.col("b").alias("measure"), "r", strength.alias("strength"), F.when(r > 0, "positive").otherwise("negative").alias("direction")).orderBy(F.desc(F.abs(r)), "measure")


def final_summary(enhanced: DataFrame) -> DataFrame:
    """The main figures under plain names, rounded, by falling entropy."""
    names = {
        "corpus": "Corpus", "df1": "Dataset_1", "df2": "Dataset_2", "merged_rows": "Merged_Rows", "n_tokens": "Tokens", "vocab_size": "Vocabulary",
        "ttr": "TTR", "entropy": "Entropy", "norm_entropy": "Norm_Entropy", "perplexity": "Perplexity", "yules_k": "Yules_K", "hapax_ratio": "Hapax_Ratio",
    }
    plain = {"corpus", "df1", "df2", "merged_rows", "n_tokens", "vocab_size"}
    return enhanced.orderBy(F.desc("entropy"), "corpus").select(*((F.col(k) if k in plain else F.round(k, 4)).alias(v) for k, v in names.items()))
