"""Cases that the fixture tables don't reach, and specifications in plain Python."""

from __future__ import annotations

import hashlib
import json
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkloom.functions import numeric, text
from sparkloom.operators import adapters, chat, clean, sampling, tokens
from sparkloom.sources import store

NASTY = "ab ßİ\u0085 　\x1c�éé\t\r\n1٣-😀"


def judged(raw: str | None) -> tuple[str | None, str | None]:
    """What cleaning does, a character at a time."""
    if not raw:
        return None, "empty_or_invalid"
    t = unicodedata.normalize("NFC", raw.replace("\r\n", "\n").replace("\r", "\n")).replace("﻿", "")
    t = "".join(c for c in t if c in "\t\n" or not (ord(c) < 32 or 127 <= ord(c) < 160)).strip()
    full = [c for c in t if not c.isspace()]
    if not full:
        return None, "empty_or_invalid"
    if not any(c.isalpha() for c in t):
        return None, "no_letters"
    if full.count("�") / len(full) > 0.02:
        return None, "corrupted"
    s = "".join(c for c in t if c.isalnum())[:4096].lower()
    if len(s) >= 20:
        if max(Counter(s).values()) / len(s) > 0.8 or any(s[p:] == s[:-p] for p in range(2, min(16, len(s) // 4) + 1)):
            return None, "repetitive"
    return t, None


def test_cleaning_as_specified(spark):
    rng = random.Random(1)
    alphabet = NASTY.replace("İ", "")  # its lower case has two characters in one engine only
    raws = [None, ""] + ["".join(rng.choice(alphabet[: rng.choice([3, 9, 99])]) for _ in range(rng.choice([0, 1, 5, 30, 60]))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(raws)), "id long, raw string")
    got = {r.id: (r.text, r.reason) for r in clean.cleaned(df, F.col("raw")).collect()}
    assert got == {k: judged(r) for k, r in enumerate(raws)}


def test_strip_is_pythons(spark):
    every = [chr(c) + "x" + chr(c) for c in range(0x3100)]
    got = spark.createDataFrame([(x,) for x in every], "x string").select(text.strip(F.col("x"))).collect()
    assert [r[0] for r in got] == [x.strip() for x in every]


def test_adapter_errors_and_fallback(spark):
    df = spark.createDataFrame([([], [("x",)]), (None, [("y",)])], "conversations array<struct<content:string>>, conversation array<struct<content:string>>")
    assert [r[0] for r in df.select(adapters.adapted(df, "sharegpt_conversations")).collect()] == [None, "y"]
    with pytest.raises(KeyError):
        adapters.adapted(df, "plain_text")
    with pytest.raises(KeyError):
        adapters.adapted(df, "none such")


def test_report_balances():
    good = dict.fromkeys(text.REASONS, 0) | {"input_records": 3, "accepted_records": 2, "filtered_records": 1, "link_only": 1}
    assert clean.balanced(good) is good
    with pytest.raises(ValueError):
        clean.balanced(good | {"accepted_records": 3})


def test_split_sizes():
    assert sampling.split_sizes(2, 0.95) == (1, 1)
    assert sampling.split_sizes(10, 0.95) == (9, 1)
    with pytest.raises(ValueError):
        sampling.split_sizes(1, 0.95)
    assert sampling.validation_size(100, 1000) == 5


def test_catalog_lacks_a_source(spark):
    s = spark.createDataFrame([("a", "x")], "source_id string, category string")
    with pytest.raises(KeyError):
        sampling.merged_catalog(s, s.where("false"))


def test_messages_and_labels(spark):
    df = spark.createDataFrame([("q", "", "a"), ("", "", "a"), ("q", "more", "a")], "instruction string, input string, output string")
    got = [r[0] for r in df.select(chat.render(chat.instruction_messages(df), True)).collect()]
    assert got[1] is None and got[0].endswith("<|im_start|>assistant\na<|im_end|>\n<|im_start|>assistant\n") and "q\n\n输入：\nmore" in got[2]
    p = spark.createDataFrame([("q", "a", "b", s) for s in ("None", "NULL", "", "be kind")], "prompt string, chosen string, rejected string, system string")
    assert [r[0] for r in p.select(F.size(chat.preference_messages(p)[0])).collect()] == [2, 2, 2, 3]
    with pytest.raises(KeyError):
        chat.instruction_messages(p)
    x = spark.createDataFrame([([1, 2, 3], [0, 1, 1])], "ids array<int>, mask array<int>")
    assert x.select(chat.labels(F.col("ids"), F.col("mask")), chat.fitted(F.col("ids"), F.col("mask"), 2), chat.fitted(F.col("ids"), F.col("mask"), 3)).first()[:] == ([-100, 2, 3], None, 3)


def test_top_p_keeps_the_one_that_passes(spark):
    rows = [(k, t, float(np.log(p))) for k, ps in enumerate([(0.6, 0.3, 0.1), (0.4, 0.3, 0.3)]) for t, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "r long, t long, x double")
    kept = numeric.top_p(df, "r", "t", "x", 0.5).groupBy("r").agg(F.count_if("kept").alias("n")).orderBy("r").collect()
    assert [r.n for r in kept] == [1, 2]


def test_schedule_and_types():
    with pytest.raises(ValueError):
        numeric.learning_rate(F.lit(1), 1.0, 2.0, 1, 10)
    assert numeric.dtype_for(65536) == "uint16" and numeric.dtype_for(65537) == "uint32"
    with pytest.raises(ValueError):
        numeric.dtype_for(70000, "uint16")
    assert numeric.training_plan(1000, 2, 8, 64, 10)["updates"] == 16


def test_trained_tokenizer_round_trips(spark):
    from tokenizers import Tokenizer

    texts = ["hello world hello world 12 hello", "你好，世界。你好", "  tabs\tand\n\nlines  "] * 6
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    spec = tokens.train(df, "text", 300, 2)
    t = Tokenizer.from_str(json.dumps(spec))
    assert all(t.decode(t.encode(x, add_special_tokens=False).ids, skip_special_tokens=False) == x for x in texts)
    pieces = [r[0] for r in df.select(tokens.pretokens(F.col("text"))).collect()]
    assert ["".join(p) for p in pieces] == texts
    assert isinstance(tokens.merges_as_lines(spec)["model"]["merges"][0], str)
    with pytest.raises(KeyError):
        tokens.special_id(spec, "none such")


def test_token_files(spark, tmp_path):
    df = spark.createDataFrame([(k, [k, k + 1, 65535]) for k in range(20)], "k long, ids array<int>")
    path = str(tmp_path / "bin")
    meta = store.write_tokens(df, path, "ids", ["k"], "uint16", {"sha": "x"})
    assert meta["tokens"] == 60 and meta["records"] == 20
    got = [t for r in store.read_tokens(spark, path, {"sha": "x"}).orderBy("part", "k").collect() for t in r.tokens]
    assert got == [t for k in range(20) for t in (k, k + 1, 65535)]
    with pytest.raises(ValueError):
        store.read_tokens(spark, path, {"sha": "y"})


def test_publish_leaves_nothing_behind(spark, tmp_path):
    path = str(tmp_path / "out")
    store.publish(spark.range(3), path)
    with pytest.raises(FileExistsError):
        store.publish(spark.range(3), path)

    def refuse(df):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        store.publish(spark.range(5), path, True, refuse)
    assert store.read_dataset(spark, path).count() == 3 and not store.exists(spark, path + ".staged")
    assert store.read_dataset(spark, path + "-none", "skip") is None
    with pytest.raises(FileNotFoundError):
        store.read_dataset(spark, path + "-none")
    assert store.find_datasets(spark, str(tmp_path)) == [f"file:{path}"]


def test_cache_follows_its_key(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(2)

    for key in ({"a": 1}, {"a": 1}, {"a": 2}):
        store.cached(spark, str(tmp_path / "c"), key, make)
    assert len(made) == 2


def test_text_file_is_exact(spark, tmp_path):
    rows = [(k // 2, t) for k, t in enumerate(["t0", "", "a\nb", "ü", None, "t5", "end"])]
    path = str(tmp_path / "t.txt")
    sha = store.write_text(spark.createDataFrame(rows[::-1], "k long, text string").repartition(3), path, "text", "k", "\n--\n")
    data = (tmp_path / "t.txt").read_bytes()
    parts = data.decode().split("\n--\n")
    assert sorted(parts[:2]) == ["", "t0"] and sorted(parts[2:4]) == ["a\nb", "ü"] and parts[4:] == ["t5", "end"]
    assert sha == hashlib.sha256(data).hexdigest() and [x.name for x in tmp_path.iterdir() if "staged" in x.name or "parts" in x.name] == []
    with pytest.raises(FileExistsError):
        store.write_text(spark.createDataFrame(rows, "k long, text string"), path, "text", "k")
    store.write_text(spark.createDataFrame([], "k long, text string"), str(tmp_path / "none"), "text", "k")
    assert (tmp_path / "none").read_bytes() == b""


def test_bins_are_headerless_streams(spark, tmp_path):
    import numpy as np

    rows = [(k, "validation" if k % 5 == 0 else "train", [k, 300 + k] * (k % 4)) for k in range(40)]
    df = spark.createDataFrame(rows, "k long, split string, ids array<int>")
    targets = {"train": 32, "validation": 8}
    made = store.write_bins(df, str(tmp_path / "bins"), "ids", ["k"], "uint16", targets, {"eos_id": 0})
    for name in targets:
        want = [i for _, s, ids in rows if s == name for i in ids]
        file = tmp_path / "bins" / f"{name}.bin"
        assert np.fromfile(file, "<u2").tolist() == want
        assert made[name]["tokens"] == len(want) and made[name]["records"] == targets[name] and made[name]["sha256"] == hashlib.sha256(file.read_bytes()).hexdigest()
        back = store.read_bin(spark, str(file), {"eos_id": 0, "split": name}, most=7).orderBy("start").collect()
        assert [t for r in back for t in r.tokens] == want and max(len(r.tokens) for r in back) <= 7
    with pytest.raises(ValueError):
        store.write_bins(df, str(tmp_path / "other"), "ids", ["k"], "uint16", {"train": 31, "validation": 9}, {})
    assert not list((tmp_path / "other").glob("*.bin"))
    with pytest.raises(ValueError):
        store.read_bin(spark, str(tmp_path / "bins" / "train.bin"), {"eos_id": 1})


def test_windows_wrap_and_refuse(spark):
    from sparkloom.operators import windows

    ids = list(range(103))
    df = spark.createDataFrame([(0, ids[:1]), (1, []), (2, ids[1:50]), (3, ids[50:])], "k long, ids array<int>")
    got = windows.token_windows(windows.placed(df, "ids", "k"), 2, 5).orderBy("window_id").collect()
    assert [(r.window_id, r.x, r.y) for r in got] == [(w, ids[10 * w : 10 * w + 10], ids[10 * w + 1 : 10 * w + 11]) for w in range(10)]
    position, want = 95, []
    for _ in range(25):
        position = 0 if position > 103 - 11 else position
        want.append((position, position + 10))
        position += 10
    assert [(r.start, r.next_position) for r in windows.batch_starts(spark, 103, 2, 5, 25, 95).orderBy("step").collect()] == want
    with pytest.raises(ValueError):
        windows.batch_starts(spark, 10, 2, 5, 1)


def test_pairs_survive_together(spark):
    side = "struct<ids:array<int>,mask:array<int>>"
    rows = [(0, ([1, 2, 3], [0, 1, 1]), ([4, 5], [0, 1])), (1, ([1, 2, 3, 4], [0, 1, 1, 1]), ([4, 5], [0, 1])), (2, ([1, 2, 3, 4], [0, 1, 1, 0]), ([4, 5], [0, 0]))]
    got = chat.surviving_pairs(spark.createDataFrame(rows, f"k long, c {side}, r {side}"), "c", "r", 3).collect()
    assert [tuple(r) for r in got] == [(0, [1, 2, 3], [-100, 2, 3], [1, 1, 1], [4, 5], [-100, 5], [1, 1])]


def test_draw_takes_the_last_where_sums_fall_short(spark):
    from sparkloom.functions import numeric

    df = spark.createDataFrame([(r, t, 1e-320, True) for r in range(20) for t in (1, 2)], "row long, token long, prob double, kept boolean")
    assert numeric.draws(df, "row", "token", 1).count() == 20


def test_last_row_of_an_id_wins(spark):
    settings = spark.createDataFrame([("a", "x", 0), ("a", "y", 1)], "source_id string, category string, position int")
    catalog = spark.createDataFrame([("a", "old", "p")], "source_id string, category string, kind string")
    assert [(r.source_id, r.category, r.kind) for r in sampling.merged_catalog(settings, catalog, position="position").collect()] == [("a", "y", "p")]
    with pytest.raises(ValueError):
        sampling.merged_catalog(settings.drop("position"), catalog)
    with pytest.raises(ValueError):
        sampling.not_empty(settings.limit(0), "record")


def test_samples_are_cut_at_any_depth(spark):
    df = spark.range(3).selectExpr("id", "CASE WHEN id = 2 THEN 'v' ELSE 't' END AS split", "array(named_struct('a', 'long text', 'b', map('k', 'long text')), null) AS deep")
    rows = store.head_samples(df, 1, 4, 1, split="split").collect()
    assert [r.split for r in rows] == ["t", "v"]
    assert all(len(r.deep) == 1 and r.deep[0].a == r.deep[0].b["k"] == "long...<truncated>" for r in rows)


def test_settings():
    assert store.settings({"a": {"b": ""}}, "a.b") is None
    with pytest.raises(KeyError):
        store.settings({}, "a.b", True)


def test_stream_has_the_same_columns(spark, tmp_path):
    from sparkloom.streaming.clean import clean_stream

    spark.createDataFrame([("ok text",), ("www.x.y",)], "text string").write.parquet(str(tmp_path / "in"))
    q = clean_stream(spark, str(tmp_path / "in"), "text string").writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("cleaned").collect()), key=repr) == sorted([("ok text", None), (None, "link_only")], key=repr)
