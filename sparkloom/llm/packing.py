"""Packing by shortest-pack-first over the histogram of lengths.

Texts are cut into full sequences and one shorter rest each. The histogram of
lengths, at most one entry for each length, is packed on the driver: lengths
go longest first, each to the open pattern with the most room, and only
counts of patterns change. The patterns then meet the pieces again by rank: a
piece's rank among those of its length says which sequence of which pattern
takes it, and where.

Defined cases: a null or empty text is its end token alone; repeated rows
are pieces each; a null doc_id is kept as null; texts of any length are cut
and placed whole; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import RankBpe, load
from .common import columns_of, written

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns as (count, {length: pieces of it in each sequence}). Every step splits one pattern at most, so
    there are no more patterns than lengths times two."""
    open_by_room: dict[int, list[tuple[int, Counter]]] = {}
    full: list[tuple[int, Counter]] = []

    def keep(count: int, pattern: Counter, room: int) -> None:
        if room:
            open_by_room.setdefault(room, []).append((count, pattern))
        else:
            full.append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(open_by_room, default=0)
            if room < length:
                keep(left, Counter({length: 1}), size - length)
                break
            count, pattern = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
            # as many of this length as each sequence of the pattern can take, while they last
            fit = min(room // length, max(1, left // count))
            used = min(count, left // fit)
            if used < count:
                keep(count - used, pattern, room)
            keep(used, pattern + Counter({length: fit}), room - fit * length)
            left -= used * fit
    return full + [x for xs in open_by_room.values() for x in xs]


def places(patterns: list[tuple[int, dict[int, int]]], size: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, from_rank, to_rank, first_sequence, in_each, first_offset, sequence_length): at most 64
    lengths fit one pattern, so their number is bounded by the size alone."""
    rows, next_rank, sequence = [], Counter(), 0
    for count, pattern in patterns:
        used = sum(n * k for n, k in pattern.items())
        padded = used if used & (used - 1) == 0 else size
        offset = 0
        for length, k in sorted(pattern.items(), reverse=True):
            start = next_rank[length]
            next_rank[length] += count * k
            rows.append((length, start, next_rank[length], sequence, k, offset, padded))
            offset += length * k
        sequence += count
    return rows


def pieces(docs: DataFrame, file: str, size: int, end: int) -> DataFrame:
    """Each document's ids and the end token, cut into full sequences and a rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last = load(file, RankBpe), int(end).to_bytes(4, "little")
        for batch in batches:
            doc_ids, texts = columns_of(batch, "doc_id", "text")
            for k in range(0, len(texts), 1000):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, packed in zip(doc_ids[k : k + 1000], bpe.encode_packed([t or "" for t in texts[k : k + 1000]]), strict=True):
                    packed += last
                    n = len(packed) // 4
                    for start in range(0, n, size):
                        part = packed[4 * start : 4 * (start + size)]
                        for column, x in zip(rows, (doc_id, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def pack(docs: DataFrame, file: str, size: int = 2048, end: int = 1) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length."""
    spark = docs.sparkSession
    cut = written(pieces(docs, file, size, end), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length, size of them at most
    rows = places(shortest_pack_first(histogram, size), size)
    slots = spark.createDataFrame(
        [tuple(map(int, r)) for r in rows],
        "slot_length long, from_rank long, to_rank long, first_sequence long, in_each long, first_offset long, sequence_length long",
    )
    # Ranks among equal lengths, which may be a large part of all rows: counted in about sqrt(n) parts, ranked within them.
    parts = max(1, math.isqrt(sum(histogram.values())))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = cut.withColumn("nth", F.row_number().over(order)).join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    found = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    nth = F.col("rank") - F.col("from_rank")
    return found.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(nth / F.col("in_each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(nth, F.col("in_each")) * F.col("length")).alias("offset"),
        "sequence_length",
    )


def spread(patterns: list[tuple[int, dict[int, int]]], size: int) -> float:
    """The share of padding that patterns leave, a sequence whose length is a power of two taking none."""
    used = np.array([sum(n * k for n, k in p.items()) for _, p in patterns])
    count = np.array([c for c, _ in patterns])
    padded = np.where((used & (used - 1)) == 0, used, size)
    return float(1 - (used * count).sum() / max(1, (padded * count).sum()))
