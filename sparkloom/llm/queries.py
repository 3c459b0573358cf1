"""The queries of this subpackage: one opN_<name> per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, lines, quality_sql, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed package of public tokenizers has this file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"), exact_chars=1)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rollup import rolled_up

    return rolled_up(table(spark, sf_dir, "documents"), tokenizer_file())


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import linked

    return linked(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    found = quality(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc": op5_warc,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_packing": op7_packing,
    "op8_lm_score": op8_lm_score,
    "op9_bpe": op9_bpe,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE_SQL: dict[str, str] = {"op4_exact_dedup": exact.ORACLE, "op5_warc": warc.ORACLE, "op10_quality_rules": quality_sql.ORACLE}
