"""The input tables in the form the operators of this folder take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.tables import spread, table

DATASETS = ("political_leaning", "birth_year", "nationality")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, post) of the three datasets, every delivery. A record delivered twice is here twice;
    operators that report per record drop repeats from their (much smaller) results."""
    return spread(reduce(DataFrame.unionByName, (table(spark, sf_dir, n).select("rid", "post") for n in DATASETS)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


#: Words of 64 bits in the filter of repeated keys (512 KB).
FILTER_WORDS = 1 << 16


def _largest(records: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    return records.groupBy(key).agg(*(F.max(c).alias(c) for c in columns))


def _by_repeats(some: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key occurs once, the others and a few of the first): the keys alone are counted; each that
    repeats sets a bit in a filter of `FILTER_WORDS` words, and rows whose bit is set are the others. A bit
    may be set by another key, never missing; with more repeated keys than the filter has room for, more
    rows are among the others."""
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS * 64))
    repeated = some.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(place.alias("p"))
    words = repeated.select(F.expr("p div 64").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    every = words.union(some.sparkSession.range(FILTER_WORDS).selectExpr("id", "0L"))
    bits = every.groupBy("w").agg(F.bit_or("b").alias("b")).agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("held")).select("held.b").scalar()
    bit = F.expr("shiftleft(1L, cast(_place % 64 as int))").bitwiseAND(F.get(bits, F.expr("cast(_place div 64 as int)")))
    marked = some.withColumn("_place", place).withColumn("_again", bit != 0)
    return marked.where("not _again").select(some.columns), marked.where("_again").select(some.columns)


def one_delivery(records: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per key; deliveries of a record agree in `columns`, so the largest value is any of them.
    Rows without a key are no records and are left out. Texts of keys that occur once, nearly all, are not
    shuffled."""
    alone, again = _by_repeats(records.where(F.col(key).isNotNull()).select(key, *columns), key)
    return alone.unionByName(_largest(again, key, columns))


def distinct_deliveries(records: DataFrame, key: str) -> DataFrame:
    """The different rows of each key that isn't null; rows of keys that occur once are not shuffled."""
    alone, again = _by_repeats(records.where(F.col(key).isNotNull()), key)
    return alone.unionByName(again.distinct())


def one_per_key(records: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per key by grouping all rows: for narrow results that were worked out row by row before repeats
    are dropped, so that no text moves, and for rows that have to be placed by key anyway."""
    return _largest(records.where(F.col(key).isNotNull()), key, columns)
