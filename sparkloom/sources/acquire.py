"""Acquisition: a catalog of sources to datasets, samples and a manifest.

A source is read by a reader of its type, a function of (spark, source) that
returns a DataFrame; `hub` has none here, where there is no network, until one
is registered. Everything goes through Spark's file systems."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import _fs, exists, head_samples, publish, write_json

Source = dict[str, Any]
Reader = Callable[[SparkSession, Source], DataFrame]

#: What a record of a source tells.
ATTRIBUTES = ("source_id", "enabled", "source_type", "purpose", "description", "source_url", "dataset", "config", "split", "revision", "license", "format", "expected_columns", "adapter", "size_note", "safety_note", "source_path", "output", "status", "notes")
#: Datasets of which only one configuration and split may be fetched.
ONLY = {"wikimedia/wikipedia": {"config": "20231101.zh", "split": "train"}}

READERS: dict[str, Reader] = {
    "parquet": lambda spark, s: spark.read.parquet(s["source_path"]),
    "json": lambda spark, s: spark.read.json(s["source_path"]),
    "text": lambda spark, s: spark.read.text(s["source_path"]),
}


@dataclass(frozen=True)
class Samples:
    folder: str
    rows: int = 2
    max_chars: int = 1000


def now() -> str:
    return datetime.now(UTC).isoformat()


def source_record(source: Source, status: str, **more: Any) -> dict[str, Any]:
    """A source's attributes, missing ones null, with a status."""
    given = {"enabled": False, "source_type": "huggingface"} | {k: v for k, v in source.items() if k in ATTRIBUTES} | {"status": status}
    return {k: given.get(k) for k in ATTRIBUTES} | more


def guard(source: Source) -> None:
    """ValueError for a dataset that would be fetched in another configuration or split than the one meant."""
    for key, wanted in ONLY.get(source.get("dataset", ""), {}).items():
        if source.get(key) != wanted:
            raise ValueError(f"{source['dataset']} needs {key}={wanted!r}, not {source.get(key)!r}")


def summary(df: DataFrame) -> dict[str, Any]:
    return {"rows": df.count(), "columns": df.columns, "features": dict(df.dtypes)}


def write_sample(df: DataFrame, source: Source, how: Samples) -> str:
    """The first rows, shortened, with a summary, as JSON; its path."""
    path = f"{how.folder.rstrip('/')}/{source['source_id']}.sample.json"
    told = {k: source.get(k) for k in ("source_id", "dataset", "config", "split", "adapter", "expected_columns")}
    rows = [r.asDict(recursive=True) for r in head_samples(df, how.rows, how.max_chars).collect()]
    write_json(df.sparkSession, path, {"generated_at": now(), **told, "summary": summary(df), "sample_rows": rows})
    return path


def probe(spark: SparkSession, source: Source) -> dict[str, Any]:
    """A source that people put in place by hand: whether it is there."""
    found = {f"{k}_exists": bool(source.get(n)) and exists(spark, source[n]) for k, n in (("source", "source_path"), ("output", "output"))}
    return source_record(source, "manual_available" if any(found.values()) else "manual_missing", **found)


def acquire_one(spark: SparkSession, source: Source, how: Samples) -> dict[str, Any]:
    if not source.get("output"):
        raise ValueError(f"source {source.get('source_id')} has no output")
    if "manual" in (source.get("source_type"), source.get("format")):
        return probe(spark, source)
    if exists(spark, source["output"]):
        more: dict[str, Any] = {"download_skipped": True}
        try:
            there = spark.read.parquet(source["output"])
            more |= {"sample_path": write_sample(there, source, how), "summary": summary(there)}
        except Exception as e:  # a broken sample is told, not raised
            more["sample_error"] = f"{type(e).__name__}: {e}"
        return source_record(source, "already_downloaded", **more)
    kind = source.get("source_type", "hub")
    if kind not in READERS:
        raise ValueError(f"no reader for source type {kind!r}")
    guard(source)
    publish(READERS[kind](spark, source), source["output"])
    written = spark.read.parquet(source["output"])
    told = source_record(source, "downloaded", sample_path=write_sample(written, source, how), summary=summary(written))
    write_json(spark, f"{source['output']}/_download_meta.json", told)
    return told


def acquire(spark: SparkSession, sources: list[Source], manifest: str, how: Samples) -> list[dict[str, Any]]:
    """All sources in order; the manifest is written in any case, a failure with its error, which is then raised."""
    records: list[dict[str, Any]] = []
    try:
        for s in sources:
            records.append(acquire_one(spark, s, how) if s.get("enabled") else source_record(s, "disabled"))
    except Exception as e:
        records.append({"status": "failed", "error_type": type(e).__name__, "error": str(e)})
        raise
    finally:
        write_json(spark, manifest, {"generated_at": now(), "sources": records})
    return records


def fingerprint(spark: SparkSession, path: str) -> list[dict[str, Any]]:
    """Path, size and modification time of each file under path, sorted: the key of what is made from them."""
    fs, at, _ = _fs(spark, path)
    files, found = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        found.append({"path": f.getPath().toString().removeprefix(at.toString()).lstrip("/"), "size": f.getLen(), "modified": f.getModificationTime()})
    return sorted(found, key=lambda x: x["path"])


def sampling_metadata(chosen: DataFrame, available: int, target: int, seed: int, source: str, category: str, skipped: int = 0, separator_bytes: int = 1) -> dict[str, Any]:
    """What a byte-budgeted sample holds: bytes (with separators between records), records, counts by source and
    category."""
    totals = chosen.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()

    def counts(c: str) -> dict[str, int]:
        key: Column = F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("<missing>"))
        return {r["k"]: r["count"] for r in chosen.groupBy(key.alias("k")).count().collect()}

    n = totals["n"]
    return {"target_bytes": target, "actual_bytes": (totals["bytes"] or 0) + max(0, n - 1) * separator_bytes, "records_written": n, "records_skipped": skipped, "available_records": available, "seed": seed, "by_source": counts(source), "by_category": counts(category)}


def epochs(examples: int, batch: int, accumulation: int, passes: int) -> dict[str, int]:
    """Batches and updates of an epoch, and updates in all."""
    batches = math.ceil(examples / batch)
    updates = math.ceil(batches / accumulation)
    return {"batches": batches, "updates": updates, "total_updates": updates * passes}
