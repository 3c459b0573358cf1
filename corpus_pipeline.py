"""From raw documents to packed sequences: the stages, each a function of (spark, docs, sf_dir).

Defined cases: stages decide on rows, not on ids. A row with a null doc_id is
judged as any other, and rows that share a doc_id are judged one by one. Ids
only order rows where one of several stays. A null text is rejected by the
first stage, and by itself each later stage treats it as an empty one; texts
of any length are judged and packed whole; other columns stay as they are, and
an empty table gives an empty one. Of rows that tie (one id and equal texts)
the first by row number stays. A row whose lines all went has an empty text,
is near no other row, and stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import free, remove, written
from sparkloom.llm.jaccard import Similarity, linked
from sparkloom.llm.langid import UNKNOWN, identify
from sparkloom.llm.lines import drop_lines
from sparkloom.llm.packing import pack
from sparkloom.llm.quality import quality
from sparkloom.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The column of row numbers; each stage numbers its rows and drops it.
ROW = "__row"
#: Of the language stage, neither grows with length: the share of words in stretches that agree with the text's
#: language (about half where two are mixed), and nats a character below the language's own level (2 and more for
#: most languages that weren't learnt, 5 for random letters).
MIN_AGREE = 0.67
MAX_BELOW = 1.5


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a row number that stays the same each time they are read: of rows in files, by the file's place
    among all and the row's place in it; of others, by a written copy."""
    if ROW in docs.columns:
        return docs
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    except AnalysisException:
        return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    files = sorted(r[0] for r in placed.select("__file").distinct().collect())  # a row a file, as the driver's listing has them
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "__number long, __file string")
    row = F.shiftleft(F.col("__number"), 40) + F.col("__place")
    return placed.join(F.broadcast(numbers), "__file").select(*docs.columns, row.alias(ROW))


def _by_row(rows: DataFrame) -> DataFrame:
    """Numbered rows with their number as id."""
    return rows.withColumn("doc_id", F.col(ROW))


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose numbers are in kept's doc_id; numbers are broadcast if they are few."""
    numbers = written(kept.select(F.col("doc_id").alias(ROW)), "kept-rows")
    return rows.join(F.broadcast(numbers) if numbers.count() <= 500_000 else numbers, ROW, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows = _numbered(docs)
    return _only(rows, quality(_by_row(rows)).where("kept")).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one known language: it has more than half of the probability, MIN_AGREE of the words lie in
    stretches most likely in it, and characters are as likely as its own, but for MAX_BELOW."""
    rows = _numbered(docs)
    named = rows.withColumn("doc_id", F.coalesce("doc_id", ROW))  # rows without an id are learnt from, too
    found = identify(named, tokenizer_file("piece_bpe_32k.model"), row=ROW, measures=True)
    one = (F.col("lang_pred") != UNKNOWN) & (F.col("score") > 0.5) & (F.col("agree") >= MIN_AGREE) & (F.col("below") <= MAX_BELOW)
    return _only(rows, found.where(one)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one has within an edit (short ones: exactly); n_chars follows the text."""
    return drop_lines(_numbered(docs), row=ROW, exact_chars=1).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, that with the smallest id (null ids last, then by row number): shingles of
    five words, a similarity of 0.8."""
    rows = _numbered(docs)
    found = linked(_by_row(rows), Similarity(percent=80, width=5)).select(F.col("doc_id").alias(ROW), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", ROW)
    first = found.join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(order).alias("first"))
    return _only(rows, first.select(F.col("first")[ROW].alias("doc_id"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return pack(docs, tokenizer_file())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: Two stages need a model and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
            if k:
                remove(before)
            free(spark)
    return docs
