"""Each operator against brute force or a library, and its defined cases."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

from fractions import Fraction
import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkloom.llm import bpe, exact, jaccard, langid, lines, lm, packing, quality, queries, rollup, warc

WORDS = [f"w{k}" for k in range(200)]
EXTRA = "doc_id long, text string, lang string, source string, words string, digit string, node long, block long, at string, line string"


def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing names."""
    rows = [(1, "a b", "en"), (2, "a  b", None), (None, "a\tb", "en"), (3, None, "de"), (4, "", "de"), (5, "q" * 5000 + "1", "de"), (6, "q" * 5000 + "2", "en"), (7, "word " * 9000, None), (7, "word " * 9000, None), (7, "other text here", "en")]
    return spark.createDataFrame([(*r, "s", "x", "y", 1, 2, "z", "l") for r in rows], EXTRA)


@pytest.fixture(scope="module")
def file():
    return queries.tokenizer_file()


def test_exact_dedup(spark):
    docs = odd_documents(spark)
    got = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(docs, 4, 2).collect())
    texts = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in texts:
        groups[t].append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert got == sorted((i or -1, least[t], len(groups[t]), i is not None and i == least[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)
    assert exact.exact_groups(docs.limit(0)).count() == 0
    assert exact.drop_copies(docs).columns == docs.columns


def test_exact_dedup_is_the_sql(spark, sf_dir):
    from compare import connect, differences

    assert differences(queries.op4_exact_dedup(spark, sf_dir), connect(sf_dir), exact.ORACLE) == []


def test_bpe_is_the_librarys(file):
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(file)
    rng = random.Random(3)
    texts = ["", " ", "a ", "  a", "a\n b", "<|endoftext|>", "x<|endoftext|> y", "it's we'll", "a b", "aaaa" * 99, " " * 300 + "x", "日本語 テスト", "\x1cx \x85"]
    texts += ["".join(rng.choice("ab tehs \n\t'.,1é日$<|>") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    wanted = [e.ids for e in hf.encode_batch(texts, add_special_tokens=False)]
    for kind in (bpe.TrieBpe, bpe.RankBpe):
        assert [list(struct.unpack(f"<{len(p) // 4}I", p)) for p in bpe.load(file, kind).encode_packed(texts)] == wanted
    trie = bpe.load(file)
    assert [trie.decode(i) for i in wanted] == [hf.decode(i, skip_special_tokens=False) for i in wanted]


def test_bpe_documents(spark, file):
    got = bpe.encode_documents(odd_documents(spark), file, True).collect()
    assert len(got) == 10 and all(r.n_tokens == len(r.ids) for r in got)
    assert bpe.encode_documents(odd_documents(spark).limit(0), file).count() == 0


def test_packing(spark, file):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(odd_documents(spark), allowMissingColumns=True)
    rows = packing.pack(docs, file, 256).collect()
    ids = Counter()
    encoder = bpe.load(file, bpe.RankBpe)
    for r, p in zip(every := docs.collect(), encoder.encode_packed([r.text or "" for r in every]), strict=True):
        p += struct.pack("<I", 1)
        for k in range(0, len(p), 1024):
            ids[r.doc_id, k // 4, len(p[k : k + 1024]) // 4, zlib.crc32(p[k : k + 1024]), len(p) // 4] += 1
    assert ids == Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r.length for r in rows) > 0.95 * 256 * len(by)
    assert packing.pack(docs.limit(0), file).count() == 0


@pytest.mark.parametrize("n", [1, 7, 5000])
def test_patterns_take_every_piece(n):
    rng = random.Random(n)
    histogram = Counter(min(128, int(rng.lognormvariate(3, 1)) + 1) for _ in range(n))
    patterns = packing.shortest_pack_first(histogram, 128)
    taken = Counter()
    for count, p in patterns:
        assert sum(k * m for k, m in p.items()) <= 128
        for k, m in p.items():
            taken[k] += count * m
    assert taken == histogram


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "u", "x", 1), (2, "u2", "x", 1), (3, None, None, 1), (4, "u", "", 1), (4, "u", "", 1), (None, "a\nb", "x", 1), (5, "v", "é" * 40000, 1), (6, "v", "é" * 40000, 1)], "page_id long, url string, html string, row int")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages).collect()}
    assert got == {(None, "revisit", 2, 1), (1, "revisit", 2, 1), (2, "response", None, 1), (3, "revisit", 4, 0), (4, "response", None, 0), (4, "revisit", 4, 0), (5, "revisit", 6, 80000), (6, "response", None, 80000)}
    whole = warc.round_trip(pages, warc.Writing(min_revisit_bytes=10))
    assert whole.where("record_type = 'revisit'").count() == 1
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_is_the_sql(spark, sf_dir):
    from compare import connect, differences

    assert differences(queries.op5_warc(spark, sf_dir), connect(sf_dir), warc.ORACLE) == []


def test_warc_files_and_faults(spark):
    pages = spark.createDataFrame([(k, f"u{k}", "p" * 20000 * k) for k in range(4)], "page_id long, url string, html string")
    archives = warc.write_archives(pages, warc.Writing(archive_bytes=30000)).collect()
    import gzip

    plain = b"".join(gzip.decompress(a.data) for a in archives)
    assert plain.count(b"WARC/1.1\r\n") == plain.count(b"WARC-Record-ID") and b"WARC-Segment-Total-Length" in plain
    got = warc.read_pages(spark.createDataFrame(archives), True).orderBy("page_id").collect()
    assert [len(r.payload) for r in got] == [0, 20000, 40000, 60000]
    assert got[1].payload_digest == base64.b32encode(hashlib.sha1(b"p" * 20000).digest()).decode()
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    broken = warc.parse(spark.createDataFrame(archives)).where("NOT (kind = 'continuation' AND segment = 2)")
    with pytest.raises(Exception, match="total length"):
        warc.reassemble(broken).collect()


def test_language_sums_all_segmentations():
    import numpy as np

    pieces = langid.Pieces(["a", "b", "ab", "▁", "▁a"])
    probs = np.array([[0.1], [0.2], [0.3], [0.05], [0.35], [0]])
    assert langid.forward(pieces, ["▁aba"], probs)[-1][0, 0] == pytest.approx((0.05 * 0.1 + 0.35) * 0.2 * 0.1 + 0.05 * 0.3 * 0.1)


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    file = queries.tokenizer_file("piece_bpe_32k.model")
    got = langid.identify(docs, file).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n == sum(zlib.crc32(str(k).encode()) % 5 == 0 for k in range(1000)) and right >= 0.98 * n
    odd = {(r.lang_pred, r.score == 0) for r in langid.identify(odd_documents(spark), file).where("doc_id in (3, 4)").collect()}
    assert odd == {("und", True)}
    assert langid.identify(odd_documents(spark).limit(0), file).count() == 0


def within_one(a, b):
    if a == b:
        return True
    a, b = sorted((a, b), key=len)
    p = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return len(b) - len(a) <= 1 and (a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :])


def test_line_dedup(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(15, 40))).strip() for _ in range(40)]
    rows = []
    for i in range(90):
        ls = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                p, o = rng.randrange(len(s)), rng.random()
                s = s[:p] + s[p + 1 :] if o < 0.3 else s[:p] + rng.choice("abcd") + s[p + (o < 0.65) :]
            ls.append(s)
        rows.append((i, "\n".join(ls) if i % 30 else None, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, at string")
    seen, wanted = [], {}
    for i, t, _ in rows:
        wanted[i] = []
        for no, x in enumerate((t or "").split("\n")):
            x = x.strip(lines.BLANK)
            if len(x) >= lines.MIN_CHARS:
                if not any(within_one(x, s) for s in seen):
                    wanted[i].append(no)
                seen.append(x)
    assert {r.doc_id: r.kept_lines for r in lines.line_report(docs).collect()} == wanted
    left = {r.doc_id: r.text for r in lines.drop_lines(docs).collect()}
    for i, t, _ in rows:
        all_lines = (t or "").split("\n")
        kept = [x for no, x in enumerate(all_lines) if len(x.strip(lines.BLANK)) < lines.MIN_CHARS or no in wanted[i]]
        assert left[i] == (None if t is None else "\n".join(kept))
    assert lines.line_report(odd_documents(spark)).count() == 10
    assert lines.line_report(docs.limit(0)).count() == 0


def components_by_force(rows, percent, width):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and None not in (rows[a][0], rows[b][0]) and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    return Counter((i, len(sets[a]), None if i is None else least[root(a)]) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("how", [jaccard.Similarity(), jaccard.Similarity(frequent=2), jaccard.Similarity(frequent=3, combination=3, rounds=1), jaccard.Similarity(percent=80, width=5, frequent=2)])
def test_jaccard_components(spark, how):
    rng = random.Random(5)
    passage = [rng.choice(WORDS) for _ in range(60)]
    bases = [[rng.choice(WORDS) for _ in range(rng.choice([3, 6, 12, 60, 200]))] for _ in range(8)]
    rows = []
    for i in range(220):
        b = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            b[rng.randrange(len(b))] = rng.choice(WORDS)
        if rng.random() < 0.3:
            b += passage
        rows.append((i, " ".join(b)))
    rows += [(500, None), (501, " "), (502, "A b"), (503, "a  B"), (None, rows[3][1]), (504, rows[3][1]), (504, rows[3][1]), (504, rows[9][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node long")
    assert Counter(map(tuple, jaccard.linked(docs, how).collect())) == components_by_force(rows, how.percent, how.width)


def test_jaccard_of_nothing(spark):
    assert jaccard.linked(odd_documents(spark).limit(0)).count() == 0


class ModelByForce:
    """Counts of n-grams in dictionaries; a state is a tuple of tokens."""

    def __init__(self, texts, order, strength):
        self.order, self.strength = order, strength
        self.seen, self.states, self.count = Counter(), Counter(), Counter()
        for ws in texts:
            self.count.update(ws)
            padded = ["start", *ws]
            for k in range(1, len(padded)):
                for c in range(1, min(order - 1, k) + 1):
                    self.seen[tuple(padded[k - c : k]), padded[k]] += 1
                    self.states[tuple(padded[k - c : k])] += 1
        self.n, self.v = sum(self.count.values()), len(self.count)

    def prob(self, state, w):
        if not state:
            return (self.count[w] + 1) / (self.n + self.v + 1)
        return (self.seen[state, w] + self.strength * self.prob(state[1:], w)) / (self.states[state] + self.strength)

    def score(self, ws):
        total, state = 0.0, ("start",)
        for w in ws:
            state = state[-(self.order - 1) :] if self.order > 1 else ()
            while state and not self.states[state]:
                state = state[1:]
            history = (*state, w)
            while state and not self.seen[state, w]:
                total += math.log10(self.strength / (self.states[state] + self.strength))
                state = state[1:]
            total += math.log10(self.prob(state, w))
            state = history
        return total


@pytest.mark.parametrize("order", [1, 3, 4])
def test_lm_scores(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 100_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd_documents(spark).select("doc_id", "text"))
    rows = docs.collect()
    split = [(r.text or "").encode().lower().split() + [None] for r in rows]
    out = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    model = ModelByForce([ws for ws, held in zip(split, out, strict=True) if not held], order, 2.0)
    wanted = sorted((r.doc_id or -1, held, len(ws), sum(model.count[w] > 0 for w in ws), model.n, sum(math.log10(model.prob((), w)) for w in ws), model.score(ws)) for r, ws, held in zip(rows, split, out, strict=True))
    got = sorted((r[0] or -1, *r[1:]) for r in map(tuple, lm.score(docs, order=order).collect()))
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-5)


def test_lm_probabilities_sum_to_one(spark):
    texts = ["a b a c a b", "b a b", "a", "", None, "c c c b"]
    types = ["a", "b", "c", None, "unknown"]
    model = ModelByForce([(t or "").split() + [None] for t in texts], 3, 2.0)
    for state in [(), ("start",), ("a",), ("a", "b"), ("start", "a"), ("c", "c")]:
        assert sum(model.prob(state, w) for w in types) == pytest.approx(1)
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert sorted(r.score for r in lm.score(docs).collect()) == pytest.approx(sorted(model.score((t or "").split() + [None]) for t in texts))
    assert lm.score(docs.limit(0)).count() == 0
    held = spark.createDataFrame([(next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2), "a b")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in lm.score(held).collect()] == [(True, 3, 0, 0, 0.0, 0.0)]


def base_counts(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
    often = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    ls = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(ls) - len(set(ls)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_base_rules(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(odd_documents(spark), allowMissingColumns=True)
    rng = random.Random(2)
    more = spark.createDataFrame([(1000 + k, "".join(rng.choice("ab \n#") for _ in range(rng.randint(0, 400)))) for k in range(60)], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect())
    assert got == Counter((r.doc_id, *base_counts(r.text)) for r in docs.collect())
    assert quality.quality(docs.limit(0)).count() == 0


def test_quality_keeps_good_and_drops_bad(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality(docs).where("NOT base_failed").join(labels, "doc_id")
    assert got.where("quality = 1 AND NOT kept").count() == 0
    assert got.where("quality = 0 AND kept").count() <= 0.05 * got.where("quality = 0").count()


def test_distance(spark):
    row = spark.range(1).select(quality.distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("far"), quality.distance(F.array(F.lit(0.3), F.lit(0.7)), F.array(F.lit(0.3), F.lit(0.7))).alias("same")).first()
    assert row.far == pytest.approx(1) and row.same == pytest.approx(0)


def test_rollup_commits_once(spark, tmp_path):
    counts = spark.createDataFrame([("a", "en", "v1", 5), ("a", None, "v1", None), ("a", "en", "v1", 7)], "source string, lang string, version string, n_tokens long")
    store = rollup.Rollup(spark, str(tmp_path / "r"))
    assert store.totals().count() == 0
    assert store.commit("1", rollup.inserts(counts)) and not store.commit("1", rollup.inserts(counts))
    assert store.commit("2", rollup.revisions(counts.where("n_tokens = 5").withColumn("new_tokens", F.lit(9))))
    assert store.commit("3", rollup.deletes(counts.where("lang is null")))
    assert store.commit("4", rollup.inserts(counts.limit(0)))
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v1", 2, 16)]
    assert store.batches() == ["1", "2", "3", "4"]
    with pytest.raises(ValueError):
        store.commit("../x", counts)


def test_token_counts(spark, sf_dir, file):
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in queries.op3_token_counts(spark, sf_dir).collect()}
    wanted = defaultdict(lambda: [0, 0])
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    for r, p in zip(rows, bpe.load(file, bpe.RankBpe).encode_packed([r.text for r in rows]), strict=True):
        wanted[r.source, r.lang][0] += 1
        wanted[r.source, r.lang][1] += len(p) // 4 + 1
    assert got == {k: tuple(v) for k, v in wanted.items()}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "packing":
            assert docs.columns == columns and docs.count() <= before
            docs = corpus_pipeline.written(docs, "test")
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before


def test_quality_is_the_sql(spark, sf_dir):
    from compare import connect, differences

    assert differences(queries.op10_quality_rules(spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL["op10_quality_rules"]) == []


def test_long_words_are_summed_whole_and_in_range():
    pieces = ["▁", "a", "b", "ab", "ba"]
    found = langid.Pieces(pieces)
    probs = np.array([[0.2, 0.2], [0.3, 0.05], [0.1, 0.1], [0.2, 0.2], [0.2, 0.2], [0.0, 0.0]])
    for word in ("▁" + "ab" * 200, "▁" + "q" * 40 + "a" * 7, "▁" + "abq" * 60):
        at, sums = {p: k for k, p in enumerate(pieces)}, []
        for language in (0, 1):
            total = [Fraction(1)]
            for end in range(1, len(word) + 1):
                x = Fraction(0)
                for length in (1, 2):
                    if length <= end:
                        k = at.get(word[end - length : end])
                        p = Fraction(probs[k][language]) if k is not None else Fraction(1e-9) if length == 1 else 0
                        x += total[end - length] * p
                total.append(x)
            sums.append(math.log(total[-1].numerator) - math.log(total[-1].denominator))
        assert langid.log_sums(found, [word, word], probs) == pytest.approx(np.array([sums, sums]), rel=1e-9)


def test_long_white_space_is_encoded(file):
    text = "a" + " " * 1_000_000 + "b"
    assert bpe.load(file, bpe.RankBpe).encode_packed([text]) == bpe.load(file).encode_packed([text])


def test_archives_by_others(spark):
    head = [("WARC-Record-ID", "<urn:x>"), ("WARC-Date", "2024-01-01T00:00:00Z")]
    made = [warc.record([("WARC-Type", "warcinfo"), *head], b"software: x"), warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:r>")], b"HTTP/1.1 200 OK\r\n\r\nhello")]
    made.append(warc.record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:v>"), ("WARC-Refers-To", "<urn:elsewhere>")], b""))
    got = warc.read_pages(spark.createDataFrame([("f", bytearray(b"".join(made)))], "name string, data binary")).collect()
    assert sorted((r.record_id, r.page_id, r.payload_bytes, r.record_type) for r in got) == [("<urn:r>", None, 5, "response"), ("<urn:v>", None, None, "revisit")]
    many = b"".join(warc.record([("WARC-Type", "resource")], b"") for _ in range(40_000))
    assert sum(1 for _ in warc.records(many)) == 40_000


def test_rows_of_one_id_keep_their_own_lines(spark):
    line = "a line that is long enough to be looked at"
    docs = spark.createDataFrame([(1, line), (7, "another line that is long enough, too"), (7, f"{line}\nown line of the second row of seven"), (None, f"{line}\nwhat the row without an id has alone")], "doc_id long, text string")
    got = lines.drop_lines(docs).collect()
    assert sorted((r.doc_id or 99, r.text) for r in got) == [(1, line), (7, "another line that is long enough, too"), (7, "own line of the second row of seven"), (99, "what the row without an id has alone")]
