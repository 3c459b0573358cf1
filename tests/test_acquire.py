"""Acquisition by hand-made sources in a temporary folder."""

from __future__ import annotations

import pytest
from sparkloom.operators import sampling
from sparkloom.sources import acquire, store


def test_catalog_to_manifest(spark, tmp_path):
    spark.createDataFrame([("a" * 20, [1] * 30)], "text string, xs array<int>").write.parquet(str(tmp_path / "raw"))
    source = {"source_id": "s", "enabled": True, "source_type": "parquet", "source_path": str(tmp_path / "raw"), "output": str(tmp_path / "out" / "s")}
    manual = {"source_id": "m", "enabled": True, "source_type": "manual", "source_path": str(tmp_path / "none"), "output": str(tmp_path / "none2")}
    how = acquire.Samples(str(tmp_path / "samples"), 2, 5)
    run = lambda *s: [r["status"] for r in acquire.acquire(spark, list(s), str(tmp_path / "manifest.json"), how)]
    assert run(source, manual, {"source_id": "off"}) == ["downloaded", "manual_missing", "disabled"]
    assert run(source) == ["already_downloaded"]
    sample = store.read_json(spark, str(tmp_path / "samples/s.sample.json"))
    assert sample["sample_rows"] == [{"text": "aaaaa...<truncated>", "xs": [1] * 20}] and sample["summary"]["rows"] == 1
    assert store.read_json(spark, str(tmp_path / "out/s/_download_meta.json"))["status"] == "downloaded"
    with pytest.raises(ValueError):
        run({"source_id": "h", "enabled": True, "output": str(tmp_path / "h")})
    assert store.read_json(spark, str(tmp_path / "manifest.json"))["sources"][-1]["status"] == "failed"
    assert acquire.fingerprint(spark, str(tmp_path / "raw")) == acquire.fingerprint(spark, str(tmp_path / "raw")) != []


def test_guard():
    acquire.guard({"dataset": "wikimedia/wikipedia", "config": "20231101.zh", "split": "train"})
    with pytest.raises(ValueError):
        acquire.guard({"dataset": "wikimedia/wikipedia", "config": "20231101.en", "split": "train"})


def test_sample_metadata_keeps_the_record_that_crosses(spark):
    df = spark.createDataFrame([(k, "x" * 10, "s", "" if k % 2 else "c") for k in range(30)], "k long, text string, source string, category string")
    chosen = sampling.byte_budget(df, "text", ["k"], 100)
    told = acquire.sampling_metadata(chosen, 30, 100, 42, "source", "category")
    assert told["actual_bytes"] >= 100 > told["actual_bytes"] - 11 and told["records_written"] == sum(told["by_category"].values()) and "<missing>" in told["by_category"]
    assert acquire.epochs(10, 4, 2, 3) == {"batches": 3, "updates": 2, "total_updates": 6}
