"""The pipeline's stages against brute force over rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from sparkloom.llm import lines, quality
from test_ops import components_by_force, within_one

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def mixed(spark, sf_dir):
    """Null ids, ids that several rows share, rows that are repeated, bad rows under the ids of good ones."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    good = [(None if k % 5 == 0 else k // 2, *r[1:]) for k, r in enumerate(docs)]
    bad = [(i, "too short", "en", "x", 9) for i in (1, 2, None)]
    numbers = [(i, "12345 67890 " * 60, "en", "x", 720) for i in (3, None)]
    near = [(i, t + " and one more", lang, s, n + 13) for i, t, lang, s, n in good[20:30]]
    return good + good[7:12] + bad + numbers + near


def test_rows_are_decided_one_by_one(spark, sf_dir, mixed):
    docs = spark.createDataFrame(mixed, COLUMNS)
    single = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(mixed)], COLUMNS)
    kept = {r.doc_id for r in quality.quality(single).where("kept").collect()}
    got = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert rows_of(got) == Counter(mixed[k][:2] for k in kept)
    assert sum(mixed[k][0] is None for k in kept) > 20 and got.columns == docs.columns

    texts = [mixed[k] for k in sorted(kept)] + [(i, "!? 123 " * 20, "en", "x", 140) for i in (4, None)]
    got = corpus_pipeline.language_id(spark, spark.createDataFrame(texts, COLUMNS), sf_dir)
    assert rows_of(got) == Counter(r[:2] for r in texts[:-2])

    few = [r for k, r in enumerate(texts[:-2]) if k % 2 or r[0] is None][:60]
    order = sorted(range(len(few)), key=lambda k: (few[k][0] is None, few[k][0] or 0, k))
    wanted, seen = Counter(), []
    for k in order:
        left = []
        for line in few[k][1].split("\n"):
            x = line.strip(lines.BLANK)
            alike = any(within_one(x, s) for s in seen if len(s) >= lines.MIN_CHARS) if len(x) >= lines.MIN_CHARS else x in seen
            if not x or not alike:
                left.append(line)
            seen.append(x)
        wanted[few[k][0], "\n".join(left)] += 1
    got = corpus_pipeline.line_dedup(spark, spark.createDataFrame(few, COLUMNS).coalesce(1), sf_dir)
    assert rows_of(got) == wanted

    ids = components_by_force([(k, r[1]) for k, r in enumerate(mixed)], 80, 5)
    groups = {}
    for (k, _, component) in ids:
        groups.setdefault(component, []).append(k)
    least = [min(ks, key=lambda k: (mixed[k][0] is None, mixed[k][0] or 0, k)) for ks in groups.values()]
    got = corpus_pipeline.near_duplicates(spark, docs.coalesce(1), sf_dir)
    assert rows_of(got) == Counter(mixed[k][:2] for k in least)


def test_a_source_without_ids_passes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = docs.withColumn("doc_id", F.lit(None).cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, none = (corpus_pipeline.written(stage(spark, d, sf_dir), "test") for d in (docs, none))
        assert none.count() == docs.count() > 0, name


def test_only_one_known_language_passes(spark):
    """Random letters, halves of two languages and languages that weren't learnt go, whatever their length."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng, by = random.Random(1), defaultdict(list)
    for r in docs.orderBy("doc_id").collect():
        if r.n_chars >= 400:
            by[r.lang].append(r.text.split())
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    bad = [" ".join(word() for _ in range(60 * 4 ** (k % 3))) for k in range(60)]
    strange = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. ", "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. ", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. "]
    bad += [s * n for s in strange for n in (5, 50)]
    mixed = []
    for _ in range(100):
        a, b = (rng.choice(by[k]) for k in rng.sample(sorted(by), 2))
        n = min(len(a), len(b))
        mixed.append(" ".join(a[:n] + b[:n]))
    rows = [(10**6 + k, t, None, "x", len(t)) for k, t in enumerate(bad + mixed)]
    kept = [r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(rows, COLUMNS)), "").select("doc_id").collect()]
    assert sum(k < 10**6 for k in kept) >= 0.98 * docs.count()
    assert not [k for k in kept if 10**6 <= k < 10**6 + len(bad)]
    assert sum(k >= 10**6 + len(bad) for k in kept) <= 0.03 * len(mixed)
