"""Sources and sinks: datasets, token files, sidecars, atomic publishing, keyed caches."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y


#: Folders that ** in a glob passes through at most.
MAX_DEPTH = 12


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, at, _ = _fs(spark, path)
    return fs.exists(at)


def read_dataset(spark: SparkSession, path: str, missing: str = "error") -> DataFrame | None:
    """A saved dataset; where it isn't there, an error or (missing="skip") None."""
    if missing not in ("error", "skip"):
        raise ValueError(f"missing must be error or skip, not {missing!r}")
    if exists(spark, path):
        return spark.read.parquet(path)
    if missing == "skip":
        return None
    raise FileNotFoundError(path)


def find_datasets(spark: SparkSession, root: str, mark: str = "_SUCCESS") -> list[str]:
    """Folders under root that hold the mark, sorted; nothing below such a folder is looked at."""
    fs, at, hadoop = _fs(spark, root)
    found, todo = set(), [at]
    while todo:
        here = todo.pop()
        if fs.exists(hadoop.Path(here, mark)):
            found.add(here.toString())
        else:
            todo += [s.getPath() for s in fs.listStatus(here) if s.isDirectory()]
    return sorted(found)


def read_splits(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """The splits of a dataset with a split column: the named ones in their order, else all that are there by name, or the root as `selected`."""
    fs, at, hadoop = _fs(spark, root)
    there = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))
    wanted = names or there
    if not wanted:
        return spark.read.parquet(root).withColumn("split", F.lit("selected"))
    parts = [spark.read.parquet(f"{root}/{n}").withColumn("split", F.lit(n)) for n in wanted]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_texts(spark: SparkSession, pattern: str, whole: bool = False) -> DataFrame:
    """Lines (or whole texts) of the files under a glob, with their path; **/ stands for any folders, MAX_DEPTH
    deep at most; an error if there are none."""
    fs, _, hadoop = _fs(spark, pattern)
    patterns = [pattern.replace("**/", "*/" * depth) for depth in range(MAX_DEPTH + 1)] if "**/" in pattern else [pattern]
    found = sorted({s.getPath().toString() for p in patterns for s in (fs.globStatus(hadoop.Path(p)) or []) if s.isFile()})
    if not found:
        raise FileNotFoundError(pattern)
    return spark.read.text(found, wholetext=whole).withColumn("path", F.col("_metadata.file_path"))


def publish(df: DataFrame, path: str, overwrite: bool = False, check: Callable[[DataFrame], Any] | None = None) -> None:
    """Write aside, check what was written, rename into place; nothing is left behind on an error."""
    spark = df.sparkSession
    fs, at, hadoop = _fs(spark, path)
    if fs.exists(at) and not overwrite:
        raise FileExistsError(path)
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.staged"
    try:
        df.write.mode("overwrite").parquet(aside)
        if check is not None:
            check(spark.read.schema(df.schema).parquet(aside))
        fs.delete(at, True)
        if not fs.rename(hadoop.Path(aside), at):
            raise OSError(f"can't rename {aside}")
    finally:
        fs.delete(hadoop.Path(aside), True)


def write_json(spark: SparkSession, path: str, value: dict[str, Any]) -> None:
    fs, at, _ = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    fs, at, _ = _fs(spark, path)
    stream = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def cached(spark: SparkSession, path: str, key: dict[str, Any], make: Callable[[], DataFrame]) -> DataFrame:
    """The table under path if it was made for this key, else made and kept."""
    mark = f"{path}/_cache_key.json"
    if not (exists(spark, mark) and read_json(spark, mark) == json.loads(json.dumps(key))):
        made = make()
        made.write.mode("overwrite").parquet(path)
        write_json(spark, mark, key)
    return spark.read.parquet(path)


#: The columns of the three kinds of metrics files.
METRICS = {
    "metrics": ["step", "tokens_seen", "train_loss", "val_loss", "lr"],
    "train_metrics": ["step", "tokens_seen", "train_position", "loss", "lr", "grad_norm", "ms_per_step", "tokens_per_second"],
    "samples": ["step", "tokens_seen", "prompt", "completion", "full_text", "temperature", "top_p", "max_new_tokens"],
}


def append_metrics(df: DataFrame, path: str, kind: str | None = None) -> None:
    """Add rows to a folder of CSV files; of a kind in METRICS, its columns in their order."""
    df = df.select(*METRICS[kind]) if kind else df
    df.write.mode("append").option("quoteAll", "false").option("escape", '"').csv(path, header=True)


def _streamed(parts: DataFrame, path: str, overwrite: bool = False) -> str:
    """One file of the data of parts (part, k, data) in order, written aside and renamed; its SHA-256. Executors
    make the parts; they pass through the driver one after another, as a single file must."""
    spark = parts.sparkSession
    fs, at, hadoop = _fs(spark, path)
    if fs.exists(at) and not overwrite:
        raise FileExistsError(path)
    aside, h = hadoop.Path(f"{path}.{uuid.uuid4().hex}.staged"), hashlib.sha256()
    try:
        out = fs.create(aside, True)
        try:
            for r in parts.orderBy("part", "k").select("data").toLocalIterator():
                h.update(r["data"])
                out.write(r["data"])
        finally:
            out.close()
        fs.delete(at, False)
        if not fs.rename(aside, at):
            raise OSError(f"can't rename {aside.toString()}")
    finally:
        fs.delete(aside, False)
    return h.hexdigest()


def write_text(df: DataFrame, path: str, text: str, order: str, separator: str = "\n", overwrite: bool = False) -> str:
    """One file of the texts in order, the separator between them and nothing else; its SHA-256. A null text is
    left out."""
    mark = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            data = b"".join(mark + t.encode() for t in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "data": pa.array([data], pa.binary())})
            k += 1

    ordered = df.where(F.col(text).isNotNull()).select(order, text).repartitionByRange(F.col(order)).sortWithinPartitions(order).select(text)
    aside = f"{path}.{uuid.uuid4().hex}.parts"
    spark = df.sparkSession
    try:
        ordered.mapInArrow(run, "part int, k int, data binary").write.parquet(aside)
        parts = spark.read.parquet(aside)
        first = parts.select(F.min(F.struct("part", "k")).alias("at")).first()["at"]  # the only one with a separator too many
        if first is not None:
            lead = (F.col("part") == first["part"]) & (F.col("k") == first["k"])
            parts = parts.withColumn("data", F.when(lead, F.expr(f"substring(data, {len(mark) + 1})")).otherwise(F.col("data")))
        return _streamed(parts, path, overwrite)
    finally:
        fs, at, _ = _fs(spark, aside)
        fs.delete(at, True)


def write_bin(spark: SparkSession, table: str, path: str, overwrite: bool = False) -> str:
    """A token table (write_tokens()) as one headerless file of little-endian ids; its SHA-256."""
    return _streamed(spark.read.parquet(table).select("part", "k", "data"), path, overwrite)


def write_bins(df: DataFrame, folder: str, ids: str, order: list[Column | str], dtype: str, targets: dict[str, int], info: dict[str, Any], overwrite: bool = False) -> dict[str, dict[str, Any]]:
    """The splits (column split) that targets names, each as <split>.bin and <split>.meta.json; what the sidecars
    hold. An error, and no file, where a split has other records than its target or no token."""
    spark, made = df.sparkSession, {}
    root, aside = folder.rstrip("/"), f"{folder.rstrip('/')}/.{uuid.uuid4().hex}"
    fs, at, _ = _fs(spark, aside)
    if not overwrite and (there := [n for n in targets if exists(spark, f"{root}/{n}.bin")]):
        raise FileExistsError(f"{root}: {there}")
    try:
        for name in targets:
            made[name] = write_tokens(df.where(F.col("split") == name), f"{aside}/{name}", ids, order, dtype, info | {"split": name})
        if wrong := {n: made[n]["records"] for n in targets if made[n]["records"] != targets[n]}:
            raise ValueError(f"records differ from the split asked for: {wrong}, not {targets}")
        if empty := [n for n in targets if not made[n]["tokens"]]:
            raise ValueError(f"no token in {empty}")
        for name in targets:
            made[name] |= {"output_bin": f"{root}/{name}.bin", "sha256": write_bin(spark, f"{aside}/{name}", f"{root}/{name}.bin", overwrite)}
            write_json(spark, f"{root}/{name}.meta.json", made[name])
    finally:
        fs.delete(at, True)
    return made


def read_bin(spark: SparkSession, path: str, expected: dict[str, Any] | None = None, most: int = 1 << 16) -> DataFrame:
    """start and tokens of a headerless file of ids, read in blocks of one length; what its sidecar says must hold."""
    meta = read_json(spark, f"{path.removesuffix('.bin')}.meta.json")
    if meta.get("dtype") not in ("uint16", "uint32"):
        raise ValueError(f"dtype {meta.get('dtype')!r}")
    if wrong := {k: v for k, v in (expected or {}).items() if meta.get(k) != v}:
        raise ValueError(f"sidecar differs: {wrong}")
    width, (fs, at, _) = np.dtype(meta["dtype"]), _fs(spark, path)
    n, rest = divmod(fs.getFileStatus(at).getLen(), width.itemsize)
    if rest or n != meta["tokens"]:
        raise ValueError(f"{n} ids in {path}, {meta['tokens']} in its sidecar")
    block = next(d for d in range(max(1, min(n, most)), 0, -1) if n % d == 0)
    rows = spark.sparkContext.binaryRecords(path, block * width.itemsize).zipWithIndex().map(lambda x: (x[1] * block, bytearray(x[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.frombuffer(x, width).astype(np.int64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["start", "tokens"])

    return spark.createDataFrame(rows, "start long, data binary").mapInArrow(run, "start long, tokens array<bigint>")


def write_tokens(df: DataFrame, path: str, ids: str, order: list[Column | str], dtype: str, info: dict[str, Any]) -> dict[str, Any]:
    """Token arrays as headerless binary parts in order, with a sidecar. Part files are rows of a Parquet table, so
    any store holds them; token_bytes() gives the stream."""
    spark, width = df.sparkSession, np.dtype(dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() > np.iinfo(width).max):
                raise ValueError(f"an id doesn't fit {dtype}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "records": pa.array([len(lists)], pa.int64()), "n": pa.array([len(flat)], pa.int64()), "data": pa.array([flat.astype(width).tobytes()], pa.binary())})
            k += 1

    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).select(ids)
    publish(ordered.mapInArrow(run, "part int, k int, records long, n long, data binary"), path)
    sums = spark.read.parquet(path).agg(F.sum("n").alias("tokens"), F.sum("records").alias("records")).first()
    meta = info | {"dtype": dtype, "tokens": sums["tokens"] or 0, "records": sums["records"] or 0}
    write_json(spark, f"{path}.meta.json", meta)
    return meta


def read_tokens(spark: SparkSession, path: str, expected: dict[str, Any]) -> DataFrame:
    """part, k and tokens of a token table; what its sidecar says must match."""
    meta = read_json(spark, f"{path}.meta.json")
    if meta.get("dtype") not in ("uint16", "uint32"):
        raise ValueError(f"dtype {meta.get('dtype')!r}")
    if wrong := {k: v for k, v in expected.items() if meta.get(k) != v}:
        raise ValueError(f"sidecar differs: {wrong}")
    width = np.dtype(meta["dtype"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.frombuffer(x, width).astype(np.int64) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["part", "k", "tokens"])

    return spark.read.parquet(path).select("part", "k", "data").mapInArrow(run, "part int, k int, tokens array<bigint>")


def digest(chunks: Iterator[bytes]) -> str:
    """SHA-256 of a stream."""
    h = hashlib.sha256()
    for c in chunks:
        h.update(c)
    return h.hexdigest()


def settings(value: dict[str, Any], name: str, required: bool = False) -> Any:
    """A dotted entry of a configuration; empty strings count as none."""
    at: Any = value
    for part in name.split("."):
        at = at.get(part) if isinstance(at, dict) else None
    if at == "":
        at = None
    if at is None and required:
        raise KeyError(name)
    return at


def head_samples(df: DataFrame, n: int = 2, max_chars: int = 500, max_items: int = 20, split: str | None = None) -> DataFrame:
    """The first rows (of each split, if a column names them) with strings cut (and marked) and lists capped,
    however deep they lie."""

    def short(c: Column, kind: Y.DataType) -> Column:
        if isinstance(kind, Y.StringType):
            return F.when(F.char_length(c) > max_chars, F.concat(F.left(c, F.lit(max_chars)), F.lit("...<truncated>"))).otherwise(c)
        if isinstance(kind, Y.ArrayType):
            return F.transform(F.slice(c, 1, max_items), lambda x: short(x, kind.elementType))
        if isinstance(kind, Y.StructType):
            return F.when(c.isNotNull(), F.struct(*(short(c[f.name], f.dataType).alias(f.name) for f in kind)))
        if isinstance(kind, Y.MapType):
            return F.transform_values(c, lambda k, v: short(v, kind.valueType))
        return c

    rows = df.limit(n)
    if split:
        names = [r[0] for r in df.select(split).distinct().orderBy(split).collect()]  # a row a split
        parts = [df.where(F.col(split).eqNullSafe(F.lit(x))).limit(n) for x in names]
        rows = parts[0] if parts else rows
        for p in parts[1:]:
            rows = rows.unionByName(p)
    return rows.select(*(short(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))
