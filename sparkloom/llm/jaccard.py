"""Similarity join of documents by Jaccard of word shingles, and its components.

Candidates come from token-combination prefixes. All tokens (hashed shingles)
are put in one order: rare ones first, then a bounded table of the most
frequent, each by hash. Two similar sets share their first common token
within prefixes that only the set's size and the threshold decide. If that is
a rare token, both index it by itself. If it is a frequent one, then all that
the two share is frequent; such sets index combinations of k adjacent
frequent tokens over a prefix so far extended that one combination must
survive all differences that the threshold allows. Which tokens count as
frequent is a matter of speed only: any table gives every link.

A key also carries what its set can be similar to: with n tokens, f of which
may be shared (all of them where a rare token is the first shared, the
frequent ones else), a partner has g = (100 + percent) * f / percent - n tokens
at most, so two sets are held together only if each one's n is within the
other's g. Copies with too many tokens of their own thus drop out unless a
copy smaller than they are exists.

Links are verified by intersecting whole sets. Within the documents of a key,
each is first held against one of them, then against another chosen by hash.
What is then still apart from the largest component of its key looks up, by
exact size, the sizes that the key has within its g, and is held against
those documents of other components that fit. So groups of near copies cost
about as many checks as they have members, and no link between components is
lost.

Defined cases: a document without words (or text) has no tokens and is linked
with nothing; one with fewer words than a shingle has the whole sequence as
its token; equal sets are one class from the start; rows that repeat an id
are placed each by its own text; a null doc_id is linked with nothing and has
a null component_id; texts of any length are hashed whole; equally similar
pairs are all links, so there are no ties; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, fewer, free, remove, written
from .components import components
from .lm import expanded, squeezed

#: Bytes of text that are hashed together, about.
GATHERED = 4 << 20
#: Tables of keys are broadcast up to this size, and joined by a shuffle beyond it.
BROADCAST_BYTES = 16 << 20
#: Members that are held against a hub in one group, and groups that a text is sent to from one row.
MEMBERS, GROUPS = 128, 1024
#: Sizes of sets are told apart exactly up to this one, and in steps of one part in so many beyond.
EXACT = 256


@dataclass(frozen=True)
class Similarity:
    """percent: of the union that the intersection must be, at least. width: words of a shingle. combination:
    tokens in a key of frequent ones. frequent: documents beyond which a token is frequent; table: the most
    tokens that are treated so. rounds: of checks after the first, the last of which is of all that is left."""

    percent: int = 85
    width: int = 4
    combination: int = 2
    frequent: int = 24
    table: int = 1 << 20
    rounds: int = 2

    def least(self, n: int) -> int:
        """The fewest tokens that a set of n shares with a similar one."""
        return -(-n * self.percent // 100)

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def extended(self, n: int) -> int:
        """So many frequent tokens are looked at: those that only this set may have, then one more whole
        combination than differences can break."""
        apart = n * (100 - self.percent) // self.percent
        return n - self.least(n) + (self.combination - 1) * apart + self.combination


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _folded(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several in their order."""
    x = np.full_like(parts[0], np.uint64(len(parts)))
    with np.errstate(over="ignore"):
        for p in parts:
            x = x * np.uint64(0x9FB21C651E98DF25) + p
    return _mixed(x)


_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of lower-case text starts, and its hash: a polynomial in its bytes, one place of all words
    at a time, the longest first."""
    buf = np.frombuffer(data, np.uint8)
    word = np.concatenate([[False], ~((buf == 32) | ((buf >= 9) & (buf <= 13))), [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], -sizes[order]
    hashes = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(int(sizes.max(initial=0))):
            m = int(np.searchsorted(left, -k))
            hashes[:m] = hashes[:m] * _BASE + _BYTES[buf[at[:m] + k]]
    out = np.empty_like(hashes)
    out[order] = hashes
    return starts, out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    starts, words = word_hashes(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    cut = np.searchsorted(starts, ends)
    grams = _folded([words[k : len(words) - width + 1 + k] for k in range(width)]) if len(words) >= width else words[:0]
    out, a = [], 0
    for b in cut.tolist():
        out.append(_distinct(grams[a : b - width + 1]) if b - a >= width else _folded([words[k : k + 1] for k in range(a, b)]) if b > a else words[:0])
        a = b
    return out


def token_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct hashed shingles of each text, worked out for some megabytes at a time."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0
    for t in texts:
        group.append((t or "").encode().lower())
        held += len(group[-1])
        if held > GATHERED:
            out += _sets(group, width)
            group, held = [], 0
    return out + (_sets(group, width) if group else [])


def mark(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def keys_of(tokens: np.ndarray, frequent: np.ndarray, how: Similarity) -> tuple[np.ndarray, int]:
    """The index keys of a set, and how many frequent tokens it has. Keys: rare tokens of its prefix (even
    numbers), and combinations of frequent ones (odd) if these alone could make it similar to another."""
    n, one = len(tokens), np.uint64(1)
    if not n:
        return tokens, 0
    if not len(frequent):
        return _folded([tokens[: how.prefix(n)]]) & ~one, 0
    often = _often(tokens, frequent)
    rare, common = tokens[~often][: how.prefix(n)], tokens[often]
    keys = _folded([rare]) & ~one
    if len(common) >= how.least(n) and len(common) >= how.combination:
        c = common[: how.extended(n)]
        k = how.combination
        keys = np.concatenate([keys, _folded([c[i : len(c) - k + 1 + i] for i in range(k)]) | one])
    return np.unique(keys), len(common)


def _texts(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """Columns of at most 250 rows at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, 250):
            yield tuple(columns_of(batch.slice(k, 250), *names))


def _often(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which tokens are in the table, which has their upper 44 bits."""
    if not len(frequent):
        return np.zeros(len(tokens), bool)
    upper = tokens >> np.uint64(20)
    return frequent[np.minimum(np.searchsorted(frequent, upper), len(frequent) - 1)] == upper


def _counted(docs: DataFrame, how: Similarity, pick) -> np.ndarray:
    """The tokens that more documents than how.frequent have, of those that pick() takes from each set; the
    most frequent, if there are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in _texts(batches, "text"):
            some = [pick(t) for t in token_sets(texts, how.width) if len(t)]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(some) >> np.uint64(20)).astype(np.int64))], names=["token"])

    counts = docs.select("text").mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") > how.frequent)
    counts = written(counts, "frequent-tokens")
    n = counts.count()
    if n > how.table:
        least = counts.agg(F.percentile_approx("count", 1 - 0.9 * how.table / n, 10_000)).first()[0]
        counts = counts.where(F.col("count") > least)
    return np.sort(counts.select("token").toArrow().column("token").to_numpy().astype(np.uint64))


def _frequent(docs: DataFrame, how: Similarity) -> np.ndarray:
    """The most frequent tokens, counted over all documents: in prefixes twice as long, then, of documents that
    are still short of rare tokens there, in all that follows."""
    zone = lambda t: 2 * how.prefix(len(t))
    first = _counted(docs, how, lambda t: t[: zone(t)])
    if not len(first):
        return first
    shared = docs.sparkSession.sparkContext.broadcast(first)
    short = lambda t: (~_often(t[: zone(t)], shared.value)).sum() < how.prefix(len(t))
    second = _counted(docs, how, lambda t: t[zone(t) :] if short(t) else t[:0])
    return np.unique(np.concatenate([first, second]))


def _classes(docs: DataFrame, how: Similarity) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles, mark), classes of equal sets (node, mark, doc_id: the smallest) and their keys
    (node, n, frequent: tokens that are, keys)."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, how))  # twice how.table numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches, "doc_id", "text"):
            sets = token_sets(texts, how.width)
            found = [keys_of(s, shared.value, how) for s in sets]
            keys = [k.astype(np.int64) if i is not None else np.zeros(0, np.int64) for i, (k, _) in zip(ids, found, strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([f for _, f in found], pa.int64()), pa.array([mark(s) for s in sets], pa.binary()), lists], names=["doc_id", "n_shingles", "n_frequent", "mark", "keys"])

    made = written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, n_frequent long, mark binary, keys array<bigint>"), "jaccard-sets")
    each = written(made.drop("keys", "n_frequent"), "jaccard-documents")
    some = made.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("n_frequent").alias("frequent"), F.first("keys").alias("keys"))
    # the smaller a node's number, the fewer of its tokens are rare: what near copies were made from comes first
    rarity = F.floor(100 * (F.col("n") - F.col("frequent")) / F.col("n")).cast("long")
    keyed = written(some.withColumn("node", F.shiftleft(rarity, 56) + F.monotonically_increasing_id()), "jaccard-keyed")
    classes = written(keyed.select("node", "mark", "doc_id"), "jaccard-classes")
    remove(made)
    return each, classes, keyed


def _small(df: DataFrame, bytes_each: int) -> DataFrame:
    return F.broadcast(df) if df.count() * bytes_each <= BROADCAST_BYTES else df


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, how: Similarity) -> DataFrame:
    """Of pairs (a, b: nodes) those that are similar. A hub's set meets its members' in groups of bounded size."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    pairs = written(pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), "jaccard-pairs")
    need = pairs.select(F.col("b").alias("node"), "a", "part", F.lit(False).alias("hub")).unionByName(pairs.select(F.col("a").alias("node"), "a", "part", F.lit(True).alias("hub")).distinct())
    need = need.groupBy("node", F.floor(F.col("part") / GROUPS).alias("chunk")).agg(F.collect_list(F.struct("a", "part", "hub")).alias("groups"))
    need = written(need.join(classes.select("node", F.col("doc_id").alias("of_doc"), "mark"), "node").drop("chunk"), "jaccard-needed")
    texts = docs.select("doc_id", "text").join(_small(need, 160), F.col("doc_id") == F.col("of_doc")).select("node", "mark", "groups", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["a", "part", "hub", "node", "tokens"])

        for nodes, marks, groups, texts in _texts(batches, "node", "mark", "groups", "text"):
            rows, held = [], 0
            for node, m, gs, s in zip(nodes, marks, groups, token_sets(texts, how.width), strict=True):
                if mark(s) != m:
                    continue  # another row of the same id
                data = squeezed(s >> np.uint64(16))  # 48 bits still tell a pair's tokens apart
                for g in gs:
                    rows.append((g["a"], g["part"], g["hub"], node, data))
                    held += len(data)
                    if held > GATHERED:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hub = None, None  # a group's rows follow each other, the hub's first
        for rows in _texts(batches, "a", "part", "hub", "node", "tokens"):
            found: tuple[list, list] = ([], [])
            for a, part, is_hub, node, data in zip(*rows, strict=True):
                tokens = expanded(data, np.uint64)
                if is_hub:
                    group, hub = (a, part), tokens
                    continue
                if group != (a, part):
                    raise ValueError(f"the hub {a} is missing")
                both = int(np.count_nonzero(hub[np.minimum(np.searchsorted(hub, tokens), len(hub) - 1)] == tokens))
                if 100 * both >= how.percent * (len(hub) + len(tokens) - both):
                    found[0].append(a)
                    found[1].append(node)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["u", "v"])

    met = texts.mapInArrow(sets, "a long, part long, hub boolean, node long, tokens binary")
    dealt = met.repartition("a", "part").sortWithinPartitions("a", "part", F.col("hub").desc())
    links = written(fewer(dealt.mapInArrow(similar, "u long, v long").distinct()), "jaccard-links")
    remove(need, pairs)
    free(docs.sparkSession)
    return links


def _size_class(n: Column) -> Column:
    return F.when(n <= EXACT, n).otherwise(EXACT + F.floor(EXACT * F.log(n / EXACT))).cast("long")


def _apart(open_: DataFrame, how: Similarity) -> DataFrame:
    """Pairs (a, b) that fit, of what is outside the largest component of its key and all of other components.
    A key's sizes are few (one row each), and only those within a set's reach are looked up."""
    sized = open_.withColumn("size", _size_class(F.col("n")))
    sizes = sized.groupBy("key", "size").agg(F.max("g").alias("reach"), F.min("root").alias("low"), F.max("root").alias("high"))
    sizes = sizes.groupBy("key").agg(F.collect_list(F.struct("size", "reach", "low", "high")).alias("sizes"))
    rest = open_.where("root <> top").select("key", F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("n").alias("a_n"), F.col("g").alias("a_g"))
    least, most = F.ceil(F.col("a_n") * how.percent / 100), F.least("a_g", F.floor(F.col("a_n") * 100 / how.percent))
    fits = lambda s: (s["size"] >= _size_class(least)) & (s["size"] <= _size_class(most)) & (s["reach"] >= F.col("a_n")) & ((s["low"] != F.col("a_root")) | (s["high"] != F.col("a_root")))
    probes = rest.where(F.col("a_g") >= least).join(sizes, "key").select("key", "a", "a_root", "a_n", "a_g", F.explode(F.filter("sizes", fits)).alias("at")).select("*", F.col("at.size").alias("size")).drop("at")
    probes = written(probes, "jaccard-probes")
    meets = (F.col("a_root") != F.col("root")) & (F.col("n") <= F.col("a_g")) & (F.col("a_n") <= F.col("g"))
    found = probes.alias("p").join(sized.select("key", "size", "node", "n", "g", "root").alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("p.size") == F.col("q.size")) & meets)
    return found.select("a", F.col("node").alias("b"))


def linked(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to)."""
    each, classes, keyed = _classes(docs, how)
    # how large a set may be that shares what is under the key: all tokens under a rare one, frequent ones else
    reach = F.when(F.col("key").bitwiseAND(1) == 0, F.floor(100 * F.col("n") / how.percent)).otherwise(F.floor((100 + how.percent) * F.col("frequent") / how.percent) - F.col("n"))
    postings = keyed.select("node", F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("frequent")).alias("packed"), F.explode("keys").alias("key"))
    met = postings.groupBy("key").count().where("count > 1").select("key")
    unpacked = {"n": F.shiftright("packed", 32), "frequent": F.col("packed").bitwiseAND((1 << 32) - 1)}
    index = written(postings.join(met, "key").withColumns(unpacked).select("key", "node", "n", reach.alias("g")), "jaccard-index")
    remove(keyed)
    free(docs.sparkSession)
    fits = (F.col("n") <= F.col("a_g")) & (F.col("a_n") <= F.col("g"))
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pivot = index.groupBy("key").agg(F.min(F.struct("node", "n", "g")).alias("p")).select("key", F.col("p.node").alias("a"), F.col("p.n").alias("a_n"), F.col("p.g").alias("a_g"))
    first = index.join(pivot, "key").where((F.col("node") != F.col("a")) & fits).select("a", F.col("node").alias("b"))
    checked = written(first.distinct(), "jaccard-checked")
    links = _verified(docs, classes, checked, how)
    roots = components(links)
    for last in [False] * (how.rounds - 1) + [True]:
        # keys whose documents are not all connected yet, and which component has most of them
        at = index.join(_small(roots, 32), "node", "left").withColumn("root", F.coalesce("root", "node"))
        spread = at.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key", F.col("top.root").alias("top"))
        open_ = written(at.join(_small(spread, 32), "key"), "jaccard-open")
        if open_.isEmpty():
            break
        if last:
            pairs = _apart(open_, how)
        else:  # against one member, another for each key
            hub = open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("h"), F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("n").alias("a_n"), F.col("g").alias("a_g"))).alias("hub")).select("key", "hub.*")
            pairs = open_.join(hub, "key").where((F.col("root") != F.col("a_root")) & fits).select("a", F.col("node").alias("b"))
        new = written(pairs.select(*ordered).distinct().join(checked, ["a", "b"], "left_anti"), "jaccard-checked")
        if not new.isEmpty():
            more = _verified(docs, classes, new, how)
            if not more.isEmpty():
                links = links.unionByName(more)
                roots = components(links)
            checked = checked.unionByName(new)
        remove(open_)
    nodes = classes.select("node", "mark", "doc_id").join(roots, "node", "left").select("mark", "doc_id", F.coalesce("root", "node").alias("root"))
    least = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    placed = nodes.join(least, "root").select(F.col("mark").alias("of_mark"), "component_id")
    own = (F.col("mark") == F.col("of_mark")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return each.join(placed, own, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
