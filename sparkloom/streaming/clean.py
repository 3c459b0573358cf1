"""The cleaning expressions over a stream: the same columns, incrementally (an addition; the batch form is the
one that reports are made from)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.adapters import adapted
from ..operators.clean import cleaned


def clean_stream(spark: SparkSession, path: str, schema: str, adapter: str = "plain_text") -> DataFrame:
    """New Parquet files under path, adapted and cleaned: text and reason."""
    stream = spark.readStream.schema(schema).parquet(path)
    return cleaned(stream.withColumn("__raw", adapted(stream, adapter)), F.col("__raw")).select("text", "reason")
