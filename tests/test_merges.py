"""Merges over all pieces, rare ones included, on the driver and in Spark."""

from __future__ import annotations

import json
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from sparkloom.operators import tokens


def by_force(words, room, least, longest):
    words, merges = {tuple(w): n for w, n in words.items()}, []
    while len(merges) < room:
        pairs = Counter()
        for w, n in words.items():
            for p in zip(w, w[1:], strict=False):
                if len(p[0]) + len(p[1]) <= longest:
                    pairs[p] += n
        if not pairs or (best := min(pairs, key=lambda p: (-pairs[p], p))) and pairs[best] < least:
            break
        merges.append(best)
        after = Counter()
        for w, n in words.items():
            new, at = [], 0
            while at < len(w):
                both = w[at : at + 2] == best
                new.append(w[at] + w[at + 1] if both else w[at])
                at += 1 + both
            after[tuple(new)] += n
        words = after
    return merges


def test_merges_cover_all_pieces(spark):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("aabcdé") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    to = tokens.alphabet()
    counts = tokens.pretoken_counts(df, "text").collect()
    assert sum(r.n == 1 for r in counts) > 500
    wanted = by_force({"".join(to[b] for b in r.piece.encode()): r.n for r in counts}, 40, 3, 6)
    for most in (10**6, 10):
        got = tokens.train(df, "text", 256 + 3 + 40, 3, 6, most)["model"]["merges"]
        assert [tuple(m) for m in got] == wanted and len(got) == 40


def test_many_pieces_are_merged_in_one_array(spark, monkeypatch):
    def never(*_):
        raise AssertionError("merged by Spark, a job for a few merges")

    monkeypatch.setattr(tokens, "merges_by_spark", never)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("aabcdé") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [tokens.train(df, "text", 256 + 3 + 40, 3, 6, most)["model"]["merges"] for most in (10**6, 200)]
    assert tokens.pretoken_counts(df, "text").count() > 200
    assert got[0] == got[1] and len(got[0]) == 40


def test_array_of_pieces_merges_as_words_do():
    for seed in range(60):
        rng = random.Random(seed)
        words = Counter("".join(rng.choice("aabcé漢") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 60)))
        to = tokens.alphabet()
        chars = Counter({"".join(to[b] for b in w.encode()): n for w, n in words.items()})
        limits = 259 + rng.randint(1, 80), rng.randint(1, 4), rng.randint(3, 20)
        table = tokens.Pieces(pa.array([w.encode() for w in words], pa.binary()), np.array(list(words.values()), np.int64), seed % 2 == 0)
        assert tokens.merges_of_many(table, *limits) == tokens.merges_of(chars, *limits)


def test_pieces_counted_by_units(spark):
    rng = random.Random(6)
    parts = [" ", " ", "  ", "\n", "\r\n", "\t", "\xa0", "　", "a", "B", "é", "é", "12", ".", "'s", "漢", "́", "\x85", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(800)] + [None, "", " ", "a "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = Counter(p for r in df.select(tokens.pretokens(F.col("text"))).collect() for p in r[0] or [])
    assert {r.piece: r.n for r in tokens.pretoken_counts(df, "text").collect()} == whole
    assert dict(tokens.pretoken_counts(df, "text").dtypes)["n"] == "bigint"


ODD_PARTS = [" ", " ", "  ", "\n", "\r\n", "\t", "\xa0", "　", "a", "B", "é", "é", "the", "12", ".", "'s", "'ſ", "漢", "́", "\x85", "\x1c", "<|im_end|>"]


def _spec():
    rng = random.Random(7)
    to = tokens.alphabet()
    words = Counter("".join(to[b] for b in (rng.choice([" ", ""]) + "".join(rng.choice("thea12é.") for _ in range(rng.randint(1, 6)))).encode()) for _ in range(300))
    return tokens.content_of(tokens.merges_of(words, 330, 2, 20))


def _odd_texts():
    rng = random.Random(8)
    return ["".join(rng.choice(ODD_PARTS) for _ in range(rng.randint(0, 12))) for _ in range(3000)]


def test_encoder_has_the_librarys_ids():
    encoder, texts = tokens.Encoder(json.dumps(_spec())), _odd_texts()
    wanted = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.by_unit and encoder.quick is not None
    assert [e.tolist() for e in map(encoder.encode, texts)] == wanted
    encoder.quick = None
    assert [e.tolist() for e in map(encoder.encode, texts)] == wanted
    asked = []
    encoder._ids = lambda new: asked.extend(new) or [b""] * len(new)
    assert [e.tolist() for e in map(encoder.encode, texts)] == wanted and not asked  # all units are known


def test_decoder_has_the_librarys_texts():
    encoder, rng = tokens.Encoder(json.dumps(_spec())), random.Random(9)
    for _ in range(3000):
        ids = [rng.randrange(340) for _ in range(rng.randint(0, 9))]
        assert encoder.decode(np.array(ids, np.int32)) == encoder.tokenizer.decode(ids, skip_special_tokens=False)
    assert encoder.bytes_of is not None


def test_masked_segments_have_the_librarys_ids(spark):
    spec, texts = _spec(), _odd_texts()[:400]
    rows = [([(t, k % 2 == 0) for k, t in enumerate(texts[j : j + 4])],) for j in range(0, 400, 4)] + [(None,), ([],)]
    df = spark.createDataFrame(rows, "s array<struct<text:string,assistant:boolean>>").withColumn("t", tokens.masked_encoder(spec)(F.col("s")))
    encoder = tokens.Encoder(json.dumps(spec))
    for r in df.collect():
        each = [(encoder.tokenizer.encode(x["text"], add_special_tokens=False).ids, int(x["assistant"])) for x in r.s or []]
        assert list(r.t.ids) == [i for ids, _ in each for i in ids]
        assert list(r.t["mask"]) == [m for ids, m in each for _ in ids]
