"""Keyed datasets: CSV folders and tables, their headers and keys put right; result sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands for a missing value in CSV files, and the key's known misspelling.
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None")
KEY, MISSPELT = "author_ID", "auhtor_ID"


#: What numbers and truth values look like in CSV files.
WHOLE, NUMBER, TRUTH = r"^\s*[+-]?\d{1,18}\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", r"^(True|False|TRUE|FALSE|true|false)$"


def typed(df: DataFrame) -> DataFrame:
    """Text columns in the narrowest type that all their values fit: bigint, double, boolean or string; columns
    without values stay text. One pass over the data for all columns."""
    names = [c for c, t in df.dtypes if t == "string"]
    if not names:
        return df
    kinds = (("bigint", WHOLE), ("double", NUMBER), ("boolean", TRUTH))
    fits = df.agg(*(F.every(F.col(f"`{c}`").rlike(p)).alias(f"{i}_{k}") for i, c in enumerate(names) for k, p in kinds)).first()
    found = {c: next((k for k, _ in kinds if fits[f"{i}_{k}"]), "string") for i, c in enumerate(names)}
    return df.select(*(F.trim(F.col(f"`{c}`")).cast(found[c]).alias(c) if found.get(c, "string") != "string" else F.col(f"`{c}`") for c in df.columns))


def csv_folder(spark: SparkSession, folder: str, infer: bool = False) -> dict[str, DataFrame]:
    """Every `*.csv` file directly in `folder` by its name without the ending, in order of name. Missing
    values are null. All columns are text, with `infer` they have the types their values fit (`typed`)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(s.getPath().toString() for s in listed if s.isFile() and s.getPath().getName().endswith(".csv"))
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
    out = {}
    for name in names:
        df = normalise_header(spark.read.options(**options).csv(name))
        text = df.select(*(F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns))
        out[name.rsplit("/", 1)[1][:-4]] = typed(text) if infer else text
    return out


def normalise_header(df: DataFrame) -> DataFrame:
    """Names without blanks at their ends; the misspelt key renamed where the right one is absent."""
    names = [c.strip() for c in df.columns]
    if KEY not in names:
        names = [KEY if c == MISSPELT else c for c in names]
    return df.toDF(*names)


def key_number(key: Column) -> Column:
    """The whole number an author key holds, however it is written; null if it holds none."""
    digits = F.regexp_replace(F.regexp_replace(key.cast("string"), r"\.0+\s*$", ""), r"\D", "")
    return digits.try_cast("bigint")


def keyed(df: DataFrame, order: str = "rid") -> DataFrame:
    """A dataset with a numeric `entity` in place of its key, one row per `order`: deliveries of a
    record agree in everything but the time they were loaded."""
    df = normalise_header(df).drop("loaded_at")
    rest = [c for c in df.columns if c not in (KEY, order)]
    once = df.where(F.col(order).isNotNull()).groupBy(order).agg(F.max(KEY).alias(KEY), *(F.max(c).alias(c) for c in rest))
    return once.select(key_number(F.col(KEY)).alias("entity"), order, *rest)


def initials(name: str) -> str:
    """`political_leaning` -> `p_l`."""
    return "_".join(part[0] for part in name.split("_") if part)


def read_all(spark: SparkSession, names: tuple[str, ...], read: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    return {n: keyed(read(n)) for n in sorted(names)}


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)
