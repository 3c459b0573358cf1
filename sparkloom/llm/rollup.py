"""Token counts by source, language and tokenizer version, kept up to date by deltas.

A change inserts a document's count, deletes it or revises it. A batch of
changes becomes signed sums, one row a group, which are added to the totals
kept so far: a commit costs as much as its batch and the groups there are, not
the documents or batches before it. A batch is committed once: totals and the
ids of the batches in them are one version, a folder that is renamed into
place and never overwritten. A batch whose id is in the latest version changes
nothing, so one that was tried again, or arrives twice, counts once; of two
commits at once, the one that finds its version taken starts again from that.

Defined cases: a null source, language or version is a group of its own; a
null count is 0; a null text has no tokens and counts as a document, and texts
of any length are counted whole; repeated rows and changes count each; a batch
without changes is committed too, so empty tables are; groups whose documents
and tokens are both 0 are left out of totals; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import RankBpe, load
from .common import columns_of, new_path, written

GROUP = ("source", "lang", "version")
SUMS = "source string, lang string, version string, docs long, tokens long"
#: Versions that stay for readers that began before the latest.
READABLE = 3


def version_of(file: str) -> str:
    """A tokenizer file's name and a digest of what it holds."""
    with open(file, "rb") as f:
        return f"{os.path.basename(file)}-{hashlib.sha256(f.read()).hexdigest()[:12]}"


def count_tokens(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, source, lang, version (version_of the file) and n_tokens of each document; none for a null text."""
    version = version_of(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file, RankBpe)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                (texts,) = columns_of(part, "text")
                counts = pa.array([len(p) // 4 for p in bpe.encode_packed([t or "" for t in texts])], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), counts], names=["doc_id", "source", "lang", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long").withColumn("version", F.lit(version))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(1).alias("docs"), F.col("n_tokens").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(-1).alias("docs"), (-F.col("n_tokens")).alias("tokens"))


def revisions(counts: DataFrame, new: str = "new_tokens") -> DataFrame:
    """Changes of counts from n_tokens to another column."""
    return counts.select(*GROUP, F.lit(0).alias("docs"), (F.col(new) - F.col("n_tokens")).alias("tokens"))


class Rollup:
    """Totals in a folder that driver and executors share, on a file system that renames folders at once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._hadoop = jvm.org.apache.hadoop.fs
        at = self._hadoop.Path(self.path)
        self._fs = at.getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.makeQualified(at).toUri(), conf)
        self._plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join((self.path, *parts)))

    def _versions(self) -> list[str]:
        """Names of versions, the latest last."""
        if not self._fs.exists(self._at()):
            return []
        return sorted(n for s in self._fs.listStatus(self._at()) if (n := s.getPath().getName()).startswith("version-"))

    def batches(self) -> list[str]:
        """The ids of committed batches."""
        latest = self._versions()[-1:]
        return sorted(r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/{latest[0]}/batches").collect()) if latest else []

    def _publish(self, staged: str, version: str) -> bool:
        """Rename a staged folder; False if the version is there already."""
        try:
            self._context.rename(self._fs.makeQualified(self._hadoop.Path(staged)), self._fs.makeQualified(self._at(version)), self._plain)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the sums of changes (docs and tokens by group) under this id; False if the id is committed."""
        if not batch or "/" in batch or batch.startswith("."):
            raise ValueError(f"not a batch id: {batch!r}")
        sums = changes.groupBy(*(F.col(c).cast("string").alias(c) for c in GROUP)).agg(F.sum(F.coalesce("docs", F.lit(0))).cast("long").alias("docs"), F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))
        added = None
        while True:
            done = self.batches()
            if batch in done:
                return False
            added = written(sums, "rollup-sums") if added is None else added
            before = self._versions()[-1:]
            totals = added.unionByName(self._totals(before[0])) if before else added
            staged = new_path(self.spark, "rollup-staged")
            totals.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{staged}/totals")
            self.spark.createDataFrame([(x,) for x in [*done, batch]], "batch string").coalesce(1).write.parquet(f"{staged}/batches")
            self._fs.mkdirs(self._at())
            number = int(before[0].removeprefix("version-")) + 1 if before else 0
            if self._publish(staged, f"version-{number:012d}"):
                for old in self._versions()[:-READABLE]:
                    self._fs.delete(self._at(old), True)
                return True

    def _totals(self, version: str) -> DataFrame:
        return self.spark.read.schema(SUMS).parquet(f"{self.path}/{version}/totals")

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens as of the latest version."""
        latest = self._versions()[-1:]
        return (self._totals(latest[0]) if latest else self.spark.createDataFrame([], SUMS)).where("docs <> 0 OR tokens <> 0")


def rolled_up(docs: DataFrame, file: str) -> DataFrame:
    """The totals after a batch that inserts every document, one that revises each count by the end token that
    follows a text, and one that deletes documents without text; the first arrives twice."""
    spark = docs.sparkSession
    counts = written(count_tokens(docs, file), "token-counts")
    store = Rollup(spark, new_path(spark, "rollup"))
    store.commit("1-insert", inserts(counts))
    store.commit("2-revise", revisions(counts.withColumn("new_tokens", F.col("n_tokens") + 1)))
    store.commit("1-insert", inserts(counts))
    store.commit("3-delete", deletes(counts.where("n_tokens = 0").withColumn("n_tokens", F.lit(1).cast("long"))))
    return store.totals()
