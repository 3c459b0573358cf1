"""Line deduplication of short lines and by other edit bounds, against brute force."""

from __future__ import annotations

import random

import pytest
from sparkloom.llm import lines, queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_short_lines_and_edits(spark, edits):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([1, 3, 9, 15, 16, 20, 30]))).strip() for _ in range(25)]
    rows = []
    for i in range(60):
        ls = []
        for _ in range(rng.randint(0, 5)):
            s = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4]) if len(s) > 12 else 0):
                p, o = rng.randrange(len(s)), rng.random()
                s = s[:p] + s[p + 1 :] if o < 0.3 else s[:p] + rng.choice("abcd") + s[p + (o < 0.65) :]
            ls.append(s)
        rows.append((i, "\n".join(ls)))
    seen, wanted = [], {}
    for i, t in rows:
        wanted[i] = []
        for no, x in enumerate(t.split("\n")):
            x = x.strip(lines.BLANK)
            near = any(x == s or (min(len(x), len(s)) >= lines.MIN_CHARS and distance(x, s) <= edits) for s in seen)
            if x and not near:
                wanted[i].append(no)
            seen.append(x)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.kept_lines for r in lines.line_report(docs, exact_chars=1, edits=edits).collect()} == wanted
    left = {r.doc_id: r.text for r in lines.drop_lines(docs, exact_chars=1, edits=edits).collect()}
    assert left == {i: "\n".join(x for no, x in enumerate(t.split("\n")) if not x.strip(lines.BLANK) or no in wanted[i]) for i, t in rows}


def test_no_line_repeats_in_op1(spark, sf_dir):
    texts = {r.doc_id: r.text.split("\n") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = [texts[r.doc_id][no].strip(lines.BLANK) for r in queries.op1_line_dedup(spark, sf_dir).collect() for no in r.kept_lines]
    assert len(kept) == len(set(kept)) and set(kept) >= {x.strip(lines.BLANK) for t in texts.values() for x in t if 0 < len(x.strip(lines.BLANK)) < lines.MIN_CHARS}
