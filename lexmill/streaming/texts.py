"""Text functions on streams. They are stateless row expressions, so the plans of the batch side run
unchanged; nothing is kept between batches and late rows need no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from lexmill.functions.text import clean, tokens
from lexmill.operators.docstats import fast_stats


def read_parquet_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def cleaned(stream: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, toks): cleaned texts and their tokens."""
    return stream.select(key, clean(F.col(text)).alias(text)).withColumn("toks", tokens(F.col(text)))


def document_stats(stream: DataFrame, key: str, text: str) -> DataFrame:
    """The fast statistics of every document that comes by."""
    return fast_stats(stream, key, text)


def append_parquet(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Each row written once; `checkpoint` is a folder all executors share."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
