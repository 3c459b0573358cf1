"""Language-model scoring by a weighted backoff automaton.

States are the contexts seen in training: the empty one (the root), each word
(and the start of a text), each pair of words, and so on up to order - 1
tokens. A state has an arc for each token seen after it, which leads to the
longest state that ends in it, and a failure arc to the state of its context
without the first token, with a weight of its own. One pass from left to right
carries the state: it follows the arc of the next token if the state has one,
and else takes failure arcs until a state has it, adding up log probabilities.
Which state a token leads to depends on the arc it took only, so a block's
tokens take their steps at once, each from the state of the token before.

Probabilities. At the root a token seen c times of N has (c + 1) / (N + V + 1),
with V distinct tokens and one unknown. An arc from a state seen C times to a
token seen c times there has (c + strength * p) / (C + strength), where p is
what the token has where the failure arc leads, and the failure arc has
strength / (C + strength). So in each state, what arcs and failures lead to
sums to one.

Counts cover all training rows and the automaton is never in one place. The
texts are cut into blocks of bounded size; a block asks for the counts of the
n-grams that it holds, so the part of the automaton that its texts can pass
through comes to it. Requests are dealt out by ranges of hashes, with BLOCKS
blocks' worth of keys in a range, and carry each key once a block, so a
frequent word is no heavier than a rare one. A block sends a range one row, or
none: rows are blocks times ranges while a block has keys for every range, and
no more than there are keys beyond.

Defined cases: a null or empty text is its end token alone; a text of any
length is scored whole, a long one as a block by itself; a null doc_id is in
no held-out fold; repeated rows are scored (and counted) each; with no
training row every token is unknown; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, free, held_out, written

#: Bytes of text in a block, about; a longer text is a block of its own. Blocks whose keys make up a range.
BLOCK_BYTES, BLOCKS = 5 << 20, 4
END, START = 0, 1
BLOCK = "block long, train_tokens long, doc_ids array<bigint>, held array<boolean>, sizes array<int>, words binary, tokens binary"
REQUEST = "bucket int, block long, lengths array<int>, keys binary, counts binary"
ANSWER = "block long, bucket int, lengths array<int>, counts binary, types long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeezed(x: np.ndarray) -> bytes:
    """An array of numbers, byte planes apart (and differences first, if it is sorted keys)."""
    if x.dtype == np.uint64:
        x = np.diff(x, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def expanded(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    x = np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)
    return np.cumsum(x, dtype=np.uint64) if dtype is np.uint64 else x


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-case (A to Z) words; what bytes.split() parts at is the white space meant here."""
    return text.encode().lower().split() if text else []


def _blocks(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def start() -> tuple[dict, list, list, list]:
            return {b"": END, b" ": START}, [], [], []

        names, ids, held, parts = start()
        size = 0

        def block() -> pa.RecordBatch:
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            sizes = [len(p) for p in parts]
            tokens = rank[np.concatenate(parts)]
            row = {"block": 0, "train_tokens": sum(n for n, h in zip(sizes, held, strict=True) if not h), "doc_ids": ids, "held": held, "sizes": sizes, "words": squeezed(hashes[order]), "tokens": squeezed(tokens)}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("block", pa.int64()), ("train_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("tokens", pa.binary())])
        for batch in batches:
            for doc_id, out, text in zip(*columns_of(batch, "doc_id", "held_out", "text"), strict=True):
                if parts and size + len(text or "") > BLOCK_BYTES:
                    yield block()
                    names, ids, held, parts = start()
                    size = 0
                ws = tokens_of(text)
                for w in set(ws).difference(names):
                    names[w] = len(names)
                parts.append(np.append(np.fromiter(map(names.__getitem__, ws), np.int32, len(ws)), np.int32(END)))
                ids.append(doc_id)
                held.append(out)
                size += len(text or "")
        if parts:
            yield block()

    rows = docs.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text")
    made = rows.mapInArrow(run, BLOCK)
    return written(made.withColumn("block", F.monotonically_increasing_id()), "lm-blocks")


class Block:
    """The tokens of a block, and its distinct n-grams of each length in order of their keys."""

    def __init__(self, order: int, held: list[bool], sizes: list[int], words: bytes, tokens: bytes):
        word_keys, self.tokens = expanded(words, np.uint64), expanded(tokens, np.int32).astype(np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.held = np.array(held, bool)
        self.trained = np.repeat(~self.held, self.sizes)
        self.start = int(np.searchsorted(word_keys, np.uint64(xxhash.xxh3_64_intdigest(b" "))))
        place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.sizes)
        # by length: keys, which of them ends at each token, which of one shorter ends before it (-1: none)
        self.keys, self.at, self.context = [word_keys], [self.tokens], [np.full(len(self.tokens), -1)]
        for length in range(2, order + 1):
            before = np.concatenate([[0], self.at[-1][:-1]])
            before[self.starts] = self.start if length == 2 else -1
            before[place < length - 2] = -1
            some = before >= 0
            codes, which = np.unique(before[some] * len(word_keys) + self.tokens[some], return_inverse=True)
            with np.errstate(over="ignore"):
                x = self.keys[-1][codes // len(word_keys)] * np.uint64(0x9E3779B97F4A7C15) ^ (word_keys[codes % len(word_keys)] + np.uint64(0x632BE59BD9B4E019))
                for shift in (32, 29):
                    x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
            x >>= np.uint64(8)  # 56 bits take less room and keep n-grams apart
            by_key = np.argsort(x, kind="stable")
            rank = np.empty(len(by_key), np.int64)
            rank[by_key] = np.arange(len(by_key))
            at = np.full(len(self.tokens), -1)
            at[some] = rank[which]
            self.keys.append(x[by_key])
            self.at.append(at)
            self.context.append(before)

    def counts(self) -> list[np.ndarray]:
        """How often each n-gram ends in the training texts of the block, and how often the start does."""
        out = []
        for keys, at in zip(self.keys, self.at, strict=True):
            some = self.trained & (at >= 0)
            out.append(np.bincount(at[some], minlength=len(keys)).astype(np.uint32))
        out[0][self.start] = (~self.held).sum()
        return out

    def cuts(self, n: int) -> list[np.ndarray]:
        """Where the keys of each of n ranges start, for each length."""
        edges = np.arange(n, dtype=np.float64) / n * 2.0**32
        return [np.append(np.searchsorted((keys >> np.uint64(24 if k else 32)).astype(np.float64), edges), len(keys)) for k, keys in enumerate(self.keys)]

    def scores(self, counts: list[np.ndarray], n: int, types: int, strength: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token whether it is known, its log probability at the root, and that of its step. counts: of
        the n-grams of each length in all training texts."""
        c = counts[0][self.tokens]
        p = (c + 1) / (n + types + 1)
        root = np.log10(p)
        found = np.zeros(len(c), np.int8)  # the longest context whose state has an arc for the token
        arcs, fails = [root], [np.zeros(len(c))]
        for k in range(1, len(counts)):
            c_arc, c_state = np.append(counts[k], 0)[self.at[k]], np.append(counts[k - 1], 0)[self.context[k]]  # -1: none
            p = np.where(c_state > 0, (c_arc + strength * p) / (c_state + strength), p)
            arcs.append(np.log10(p))
            fails.append(np.log10(strength / (c_state + strength)))
            found[c_arc > 0] = k
        top = len(counts) - 1
        state = np.minimum(np.concatenate([[0], found[:-1]]) + 1, top)  # where the arc of the token before leads
        state[self.starts] = min(1, top) if counts[0][self.start] else 0
        # no arc is missed: one with k tokens of context was reached by arcs with one less each
        step = np.choose(found, arcs)
        for k in range(1, len(counts)):
            step += np.where((state >= k) & (found < k), fails[k], 0.0)
        return c > 0, root, step


def _requests(blocks: DataFrame, buckets: int, order: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary())
        for batch in batches:
            for i in range(batch.num_rows):
                (number,), *parts = columns_of(batch.slice(i, 1), "block", "held", "sizes", "words", "tokens")
                b = Block(order, *(x[0] for x in parts))
                counts, cuts = b.counts(), b.cuts(buckets)
                rows: tuple[list, ...] = ([], [], [], [], [])
                for k in range(buckets):
                    part = [slice(cut[k], cut[k + 1]) for cut in cuts]
                    lengths = [int(s.stop - s.start) for s in part]
                    if any(lengths):
                        keys = squeezed(np.concatenate([x[s] for x, s in zip(b.keys, part, strict=True)]))  # where a length begins, the difference wraps around
                        values = (k, number, lengths, keys, squeezed(np.concatenate([x[s] for x, s in zip(counts, part, strict=True)])))
                        for column, x in zip(rows, values, strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["bucket", "block", "lengths", "keys", "counts"])

    return blocks.select("block", "held", "sizes", "words", "tokens").mapInArrow(run, REQUEST)


def _split(x: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    return np.split(x, np.cumsum(lengths)[:-1])


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What equal keys count together, at each of them; the distinct keys, and what these count."""
    if not len(keys):
        return np.zeros(0, np.int64), keys, np.zeros(0, np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys = keys[first]
    sums = np.add.reduceat(counts[order], first, dtype=np.int64)
    totals = np.empty(len(order), np.int64)
    totals[order] = np.repeat(sums, np.diff(first, append=len(order)))
    return totals, keys, sums


def _answers(requests: DataFrame, order: int) -> DataFrame:
    start = np.uint64(xxhash.xxh3_64_intdigest(b" "))

    def run(rows: pa.Table) -> pa.Table:
        lengths = rows["lengths"].to_pylist()
        ends = np.cumsum(np.array(lengths, np.int64), axis=0)
        keys, counts = [np.empty(n, np.uint64) for n in ends[-1]], [np.empty(n, np.uint32) for n in ends[-1]]
        for name, into in (("keys", keys), ("counts", counts)):
            for data, n, end in zip(rows[name], lengths, ends.tolist(), strict=True):
                for x, part, stop in zip(into, _split(expanded(data.as_buffer(), into[0].dtype.type), n), end, strict=True):
                    x[stop - len(part) : stop] = part
        totals, types = [], 0
        for k in range(order):
            total, distinct, sums = _totals(keys.pop(0), counts.pop(0))
            if k == 0:
                types = int(((sums > 0) & (distinct != start)).sum())
            totals.append(np.split(total, ends[:-1, k]))
        data = [squeezed(np.concatenate(x)) for x in zip(*totals, strict=True)]
        made = (rows["block"], rows["bucket"], pa.array(lengths, pa.list_(pa.int32())), pa.array(data, pa.binary()), pa.array([types] + [0] * (len(data) - 1), pa.int64()))
        return pa.table(dict(zip(("block", "bucket", "lengths", "counts", "types"), made, strict=True)))

    return written(requests.groupBy("bucket").applyInArrow(run, ANSWER), "lm-answers")


def score(docs: DataFrame, folds: int = 7, fold: int = 2, order: int = 3, strength: float = 2.0) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (at the root), score. The
    rows whose id leaves remainder fold don't teach. order: tokens of the longest n-gram."""
    if order < 1 or strength <= 0:
        raise ValueError("order must be 1 at least and strength positive")
    blocks = _blocks(docs, folds, fold)
    size = blocks.agg(F.count(F.lit(1)).alias("blocks"), F.sum("train_tokens").alias("n")).first()
    n, buckets = size["n"] or 0, max(4, -(-size["blocks"] // BLOCKS))
    answers = _answers(_requests(blocks, buckets, order), order)
    free(docs.sparkSession)
    types = answers.agg(F.sum("types")).first()[0] or 0

    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        b = Block(order, list(row["held"]), list(row["sizes"]), row["words"], row["tokens"])
        found = answers.sort_values("bucket")
        parts = [_split(expanded(c, np.int64), list(k)) for c, k in zip(found["counts"], found["lengths"], strict=True)]
        known, root, step = b.scores([np.concatenate(x) for x in zip(*parts, strict=True)], n, types, strength)
        doc = np.repeat(np.arange(len(b.sizes)), b.sizes)
        sums = lambda x: np.bincount(doc, weights=x, minlength=len(b.sizes))
        return pd.DataFrame({"doc_id": pd.array(list(row["doc_ids"]), "Int64"), "held_out": list(row["held"]), "n_tokens": b.sizes, "n_known": sums(known).astype(np.int64), "train_tokens": n, "base_score": sums(root), "score": sums(step)})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, SCORED)
