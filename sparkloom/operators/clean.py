"""Cleaning: records to text, a reason for each that goes, a report that balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def cleaned(df: DataFrame, raw: Column, max_repetition: float = 0.8, repair: bool = False, simplify: bool = False, nfc: bool = True) -> DataFrame:
    """df with text (null where it goes) and reason (null where it stays): the first of REASONS that holds."""
    given = T.plug("repair")(raw) if repair else raw
    df = df.withColumn("__t", T.normalise(given, nfc))
    if simplify:
        df = df.withColumn("__t", T.plug("simplify")(F.col("__t")))
    df = df.withColumn("__c", T.compact(F.col("__t"))).withColumn("__s", T.sample(F.col("__t")))
    t, c, s = F.col("__t"), F.col("__c"), F.col("__s")
    bad = F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))
    repetitive = (F.length(s) >= T.LEAST_SAMPLE) & ((T.dominant(s) > max_repetition * F.length(s)) | T.periodic(s))
    reason = (
        F.when(t.isNull() | (c == ""), T.REASONS[0])
        .when(t.rlike(T.URL), T.REASONS[1])
        .when(~t.rlike(r"\p{L}"), T.REASONS[2])
        .when(bad > 0.02 * F.length(c), T.REASONS[3])
        .when(repetitive, T.REASONS[4])
    )
    df = df.withColumn("reason", reason)
    return df.withColumn("text", F.when(F.col("reason").isNull(), t)).drop("__t", "__c", "__s")


def report(df: DataFrame) -> DataFrame:
    """Long form: metric, value. Input, accepted and filtered records and each reason's, zeros included."""
    counts = [F.count(F.lit(1)).alias("input_records"), F.count_if(F.col("reason").isNull()).alias("accepted_records"), F.count("reason").alias("filtered_records")]
    counts += [F.count_if(F.col("reason") == r).alias(r) for r in T.REASONS]
    one = df.agg(*counts)
    return one.unpivot([], one.columns, "metric", "value")


def balanced(rows: dict[str, int]) -> dict[str, int]:
    """The report as a dict; an error if accepted and filtered records don't make up the input."""
    reasons = sum(rows[r] for r in T.REASONS)
    if rows["accepted_records"] + rows["filtered_records"] != rows["input_records"] or reasons != rows["filtered_records"]:
        raise ValueError(f"report doesn't balance: {rows}")
    return rows
