"""Records that differ only in spacing, case, punctuation or field order, collapsed into one each.

Repeated deliveries of a record are dropped first, without moving the others. Stage 1 groups
byte-identical raw rows (map-side combination takes hot copies down to one row per task). Stage 2 canonicalises only the distinct survivors and groups them on the full canonical
text. Who belongs to which group is then carried by digests of the same texts, so that the joins
back move 32 bytes a row instead of texts; AQE splits the partitions of hot groups, whose other
side is one row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import distinct_deliveries

LETTER_OR_DIGIT = r"[\p{L}\p{Nd}]"


def squeezed(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", "")


def canonical_json(text: Column) -> Column:
    """A JSON text with sorted fields and no spacing; a text that is no JSON keeps its characters
    apart from white space, marked so that it never equals a JSON text; null stays null."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.concat(F.lit("?"), F.regexp_replace(text, r"\s+", "")))


def _digest(*columns: Column) -> Column:
    """256 bits over the columns, nulls and borders included."""
    marked = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns]
    return F.coalesce(F.unhex(F.sha2(F.concat(*marked), 256)), F.lit(b""))


def _rows(records: DataFrame, key: str, author: str, text: str, attrs: str) -> DataFrame:
    usable = F.col(key).isNotNull() & F.col(author).rlike(LETTER_OR_DIGIT) & F.col(text).rlike(LETTER_OR_DIGIT)
    return records.where(usable).select(F.col(key).alias("_id"), F.col(author).alias("_a"), F.col(text).alias("_t"), F.col(attrs).alias("_j"))


def _survivors(raw: DataFrame) -> DataFrame:
    """Distinct raw rows with their canonical texts."""
    return raw.select("*", squeezed(F.col("_a")).alias("ca"), squeezed(F.col("_t")).alias("ct"), canonical_json(F.col("_j")).alias("cj"))


def collapse_copies(records: DataFrame, key: str = "rid", author: str = "author_ID", text: str = "post", attrs: str = "attrs") -> DataFrame:
    """One row per group of equal records: (first, author, text, attrs, copies, variants).

    `first` is the smallest key of the group, `copies` its number of distinct keys, `variants` its
    number of different raw rows; author, text and attrs are canonical. Rows whose key, author or
    text is null, or whose author or text has no letter or digit, are no records and are left out.
    Null attrs equal only null attrs. Repeated deliveries of a key count once.
    """
    rows = distinct_deliveries(_rows(records, key, author, text, attrs), "_id")
    raw = rows.groupBy("_a", "_t", "_j").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return (
        _survivors(raw)
        .groupBy("ca", "ct", "cj")
        .agg(F.min("first").alias("first"), F.sum("n").alias("copies"), F.count(F.lit(1)).alias("variants"))
        .select("first", F.col("ca").alias("author"), F.col("ct").alias("text"), F.col("cj").alias("attrs"), "copies", "variants")
    )


def copy_members(records: DataFrame, key: str = "rid", author: str = "author_ID", text: str = "post", attrs: str = "attrs") -> DataFrame:
    """(first, copy): every record that is not the one with the smallest key of its group, with that key.

    Same rules as `collapse_copies`; one row per record, none for groups of one.
    """
    rows = _rows(records, key, author, text, attrs)
    raw = rows.groupBy("_a", "_t", "_j").agg(F.min("_id").alias("raw_first"), F.count(F.lit(1)).alias("n"))
    survivors = _survivors(raw)
    groups = (
        survivors.groupBy("ca", "ct", "cj")
        .agg(F.min("raw_first").alias("first"), F.sum("n").alias("n"))
        .where(F.col("n") > 1)
        .select(_digest(F.col("ca"), F.col("ct"), F.col("cj")).alias("group"), "first")
    )
    # raw_first and n stay in use here, so that both branches read one and the same exchange of texts
    variants = survivors.where(F.col("n") > 0).select(
        _digest(F.col("_a"), F.col("_t"), F.col("_j")).alias("row"), _digest(F.col("ca"), F.col("ct"), F.col("cj")).alias("group"), "raw_first"
    )
    owner = variants.join(groups, "group").where(F.col("raw_first") >= F.col("first")).select("row", "first")
    members = rows.select("_id", _digest(F.col("_a"), F.col("_t"), F.col("_j")).alias("row"))
    return members.join(owner, "row").where(F.col("_id") != F.col("first")).select("first", F.col("_id").alias("copy")).distinct()
