"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than these six.
SPACE = r"[\x20\x09-\x0D]+"
#: Whether Spark deletes a query's shuffles as soon as it has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, a local one for a single machine, and an
    error on a cluster."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or "/tmp/checkpoints/sparkloom"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet; Hadoop removes it when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and a lost executor takes no rows with it. The job's
    shuffles go as soon as the table is written, not when the driver's garbage happens to be collected."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def fewer(df: DataFrame) -> DataFrame:
    """df with a quarter of the shuffle's partitions, 8 at least: for what is much less than was shuffled."""
    return df.coalesce(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))


def remove(*tables: DataFrame) -> None:
    """Delete tables of written() that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffles and broadcasts that no plan needs any more: it does so once the driver's
    garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is in no held-out fold."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold, F.lit(False)) & doc_id.isNotNull()


def columns_of(batch, *names: str) -> Iterator[list]:
    """The named columns of an Arrow batch as Python lists."""
    for name in names:
        yield batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(texts: list[str | None], chars: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts that have about so many characters together; a longer text is one by itself."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if k > start and held + len(t or "") > chars:
            yield start, k
            start, held = k, 0
        held += len(t or "")
    if start < len(texts):
        yield start, len(texts)
