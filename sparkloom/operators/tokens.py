"""Byte-level BPE: pre-tokens, training on their counts, encoding and decoding."""

from __future__ import annotations

import heapq
import json
import unicodedata
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compose

#: The splitting pattern and special tokens of the trained vocabulary.
PATTERN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
SPECIALS = ("<|endoftext|>", "<|im_start|>", "<|im_end|>")
ODD = regex.compile(r"\p{White_Space} ").search
#: Characters that versions of Unicode, and so libraries, may class otherwise: all but Latin, Greek, Cyrillic,
#: punctuation and unified ideographs of the first versions; and the long s, which some take for an s.
LATER = regex.compile(r"[^\u0000-\u017E\u0180-\u0233\u0391-\u03A1\u03A3-\u03C9\u0410-\u044F\u2010-\u2027\u3001-\u3003\u3041-\u3094\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3\uFF01-\uFF5E]").search
CUT = regex.compile(r"(?<=\P{White_Space})(?= )").split


def pretokens(text: Column, nfc: bool = True) -> Column:
    """The pieces of a text that merges don't cross; joined they are the text (in NFC)."""
    return F.regexp_extract_all(compose(text) if nfc else text, F.lit("(?U)" + PATTERN), F.lit(0))


#: Distinct units, and characters of them, that a task counts together before it passes the counts on.
COUNTED, COUNTED_CHARS = 500_000, 16 << 20


def _units(text: str) -> tuple[list[str], list[str]]:
    """A text cut before each space that follows something other than white space: no piece lies across such a
    place, and how a text is split after it doesn't depend on what comes before. Whole units, then those that
    have lost the space they begin with."""
    if ODD(text):
        return CUT(text), []
    first, *rest = text.split(" ")
    return [first] if first else [], rest


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of texts in NFC with their counts, added up as far as COUNTED allows."""
    whole: Counter = Counter()
    spaced: Counter = Counter()
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for counts, before in ((whole, ""), (spaced, " ")):
            keys = list(counts)
            for k in range(0, len(keys), 20_000):
                some = keys[k : k + 20_000]
                yield pa.RecordBatch.from_pydict({"unit": pa.array([before + u for u in some], pa.string()), "n": pa.array([counts[u] for u in some], pa.int64())})
            counts.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                a, b = _units(text if text.isascii() else unicodedata.normalize("NFC", text))
                whole.update(a)
                spaced.update(b)
                held += len(text)
                if held > COUNTED_CHARS or len(whole) + len(spaced) > COUNTED:
                    held = sum(map(len, whole)) + sum(map(len, spaced))
                    if held > COUNTED_CHARS // 2 or len(whole) + len(spaced) > COUNTED:
                        yield from out()
                        held = 0
    yield from out()


def pretoken_counts(df: DataFrame, text: str) -> DataFrame:
    """Pieces of all texts (in NFC) and how often each occurs. Texts are cut into units first, and only distinct
    units are split."""
    units = df.select(F.col(text).alias("text")).mapInArrow(_counted, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return units.select(F.explode(pretokens(F.col("unit"), nfc=False)).alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n"))


def alphabet() -> dict[int, str]:
    """The character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def merges_of(words: Counter, vocab_size: int, min_frequency: int, max_length: int) -> list[tuple[str, str]]:
    """Merges by falling count of pairs, ties to the pair that sorts first. words: by their characters."""
    chars = {c: c for c in alphabet().values()}  # one object a character
    parts = [[chars.setdefault(c, c) for c in w] for w in words]
    counts = list(words.values())
    pairs: Counter = Counter()
    where: dict[tuple[str, str], array] = defaultdict(lambda: array("I"))  # words that have or had the pair
    for k, p in enumerate(parts):
        for pair in zip(p, p[1:], strict=False):
            pairs[pair] += counts[k]
            where[pair].append(k)
    heap = [(-n, pair) for pair, n in pairs.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str]] = []
    room = vocab_size - 256 - len(SPECIALS)
    while heap and len(merges) < room:
        n, pair = heapq.heappop(heap)
        if -n != pairs.get(pair, 0):
            continue  # counted anew since
        if -n < min_frequency:
            break
        if len(pair[0]) + len(pair[1]) > max_length:
            continue
        merges.append(pair)
        both = pair[0] + pair[1]
        changed = set()
        for k in set(where.pop(pair)):
            old, new, at = parts[k], [], 0
            while at < len(old):
                if at + 1 < len(old) and (old[at], old[at + 1]) == pair:
                    new.append(both)
                    at += 2
                else:
                    new.append(old[at])
                    at += 1
            if len(new) == len(old):
                continue  # merged otherwise since
            for sign, p in ((-1, old), (1, new)):
                for x in zip(p, p[1:], strict=False):
                    pairs[x] += sign * counts[k]
                    changed.add(x)
                    if sign > 0 and both in x:  # of other pairs the word is known
                        where[x].append(k)
            parts[k] = new
        pairs.pop(pair, None)
        for x in changed:
            if pairs.get(x, 0) > 0:
                heapq.heappush(heap, (-pairs[x], x))
    return merges


def _written(df: DataFrame) -> DataFrame:
    """df as a table in the folder that spark.checkpoint.dir names (a local one for a single machine where none
    is named, an error on a cluster), removed when the driver's JVM ends."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(named or '/tmp/checkpoints/sparkloom').rstrip('/')}/pieces-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(table: DataFrame) -> None:
    """Delete a table of _written() that no later step reads."""
    context = table.sparkSession.sparkContext
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def _gathered(counts: DataFrame, vocab_size: int):
    """A table of pieces (piece, n) on the driver."""
    got = counts.select(F.col("piece").cast("binary").alias("piece"), "n").where(F.octet_length("piece") > 1).toArrow()
    return Pieces(pa.chunked_array(got["piece"].chunks, pa.binary()).combine_chunks(), np.asarray(got["n"]), vocab_size > 65_000)


class Pieces:
    """Pieces as one array of token numbers, 0 between them, those of one count side by side: about 2 bytes of
    memory for each of text, 10 while they are read and merged. Numbers 1 to 256 are the bytes."""

    def __init__(self, pieces: pa.Array, n: np.ndarray, wide: bool):
        """pieces: binary. wide: whether there may be more tokens than 16 bits number."""
        order = np.argsort(n, kind="stable")
        n = n[order]
        sizes = np.asarray(pc.binary_length(pieces))[order].astype(np.int64)
        ends = np.cumsum(sizes + 1)
        self.tokens = np.zeros(int(ends[-1]) + 1 if len(n) else 1, np.uint32 if wide else np.uint16)
        for k in range(0, len(n), 100_000):
            some = pieces.take(pa.array(order[k : k + 100_000])).cast(pa.large_binary())
            offsets = np.frombuffer(some.buffers()[1], np.int64, len(some) + 1, some.offset * 8)
            bytes_ = np.frombuffer(some.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.empty(0, np.uint8)
            at = np.arange(len(bytes_)) + np.repeat(np.arange(1, len(some) + 1), sizes[k : k + 100_000])
            self.tokens[at + (ends[k - 1] if k else 0)] = bytes_.astype(self.tokens.dtype) + 1
        new = np.flatnonzero(np.diff(n, prepend=-1))
        self.counts = n[new].astype(np.float64)  # sums of whole numbers up to 2^53 are exact
        self.starts = np.append(0, ends[new[1:] - 1]) if len(new) else np.empty(0, np.int64)  # where pieces of each count begin

    def _weights(self, at: np.ndarray) -> np.ndarray:
        """The counts of the pieces at rising places."""
        return np.repeat(self.counts, np.diff(np.append(np.searchsorted(at, self.starts), len(at))))

    def pairs(self) -> dict[tuple[int, int], int]:
        """How often each pair occurs."""
        found: Counter = Counter()
        for k in range(0, len(self.tokens) - 1, 1 << 20):
            x, y = (self.tokens[k + d : min(k + (1 << 20), len(self.tokens) - 1) + d].astype(np.int64) for d in (0, 1))
            at = np.flatnonzero((x > 0) & (y > 0))
            codes, which = np.unique(x[at] << 32 | y[at], return_inverse=True)
            sums = np.bincount(which, self._weights(at + k), len(codes))
            for c, w in zip(codes.tolist(), sums.tolist(), strict=True):
                found[c >> 32, c & 0xFFFFFFFF] += int(w)
        return found

    def merge(self, a: int, b: int, made: int) -> Counter:
        """Merge a pair everywhere, from the left; by how much the counts of other pairs change."""
        t = self.tokens
        hits = np.concatenate([k + np.flatnonzero((t[k : k + (1 << 20)][: len(t) - 1 - k] == a) & (t[k + 1 : k + 1 + (1 << 20)] == b)) for k in range(0, len(t) - 1, 1 << 20)] or [np.empty(0, np.int64)])
        if a == b and len(hits):  # of a run, every other
            first = np.flatnonzero(np.diff(hits, prepend=-2) != 1)
            hits = hits[(np.arange(len(hits)) - np.repeat(first, np.diff(np.append(first, len(hits))))) % 2 == 0]
        change: Counter = Counter()
        if not len(hits):
            return change
        weights = self._weights(hits)
        alone = np.append(np.diff(hits) != 2, True)  # not beside the next one

        def add(sign: int, left: np.ndarray, right: np.ndarray, x: int, y: int) -> None:
            for side, w in ((left, weights), (right, weights[alone])):
                sums = np.bincount(side, w)
                for z in np.flatnonzero(sums[1:]) + 1:
                    change[(int(z), x) if side is left else (y, int(z))] += sign * int(sums[z])

        add(-1, t[hits - 1], t[hits[alone] + 2], a, b)
        kept = np.ones(len(t), bool)
        kept[hits + 1] = False
        t[hits] = made
        self.tokens = t = t[kept]
        self.starts = self.starts - np.searchsorted(hits + 1, self.starts)
        at = hits - np.arange(len(hits))
        add(1, t[at - 1], t[at[alone] + 1], made, made)
        change.pop((a, b), None)
        return change


def merges_of_many(pieces: Pieces, vocab_size: int, min_frequency: int, max_length: int) -> list[tuple[str, str]]:
    """merges_of() over pieces in one array."""
    to = alphabet()
    names = ["", *(to[b] for b in range(256))]
    number = {c: k for k, c in enumerate(names)}
    pairs = pieces.pairs()
    heap = [(-n, names[x], names[y]) for (x, y), n in pairs.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str]] = []
    room = vocab_size - 256 - len(SPECIALS)
    while heap and len(merges) < room:
        n, a, b = heapq.heappop(heap)
        pair = number[a], number[b]
        if -n != pairs.get(pair, 0):
            continue  # counted anew since
        if -n < min_frequency:
            break
        if len(a) + len(b) > max_length:
            continue
        merges.append((a, b))
        if a + b not in number:
            number[a + b] = len(names)
            names.append(a + b)
        change = pieces.merge(*pair, number[a + b])
        pairs.pop(pair)
        for x, d in change.items():
            if d:
                pairs[x] = pairs.get(x, 0) + d
                if pairs[x] > 0:
                    heapq.heappush(heap, (-pairs[x], names[x[0]], names[x[1]]))
                else:
                    del pairs[x]
    return merges


def _batch(pairs: list[tuple[int, tuple[str, str]]], made: set[str]) -> list[tuple[str, str]]:
    """Of pairs in their order the first that can be merged at once: they share no token with each other, so no
    merge changes another's count, and a pair that a merge makes is as frequent as one left out at most."""
    taken: list[tuple[int, tuple[str, str]]] = []
    used: set[str] = set()
    for n, (a, b) in pairs:
        if a in used or b in used:
            break
        taken.append((n, (a, b)))
        used |= {a, b}
        if a == b or a + b in made:  # what it makes may be more frequent than the next
            break
        made = made | {a + b}
    left = pairs[min(len(taken), len(pairs) - 1)][0]
    while len(taken) > 1 and taken[-1][0] <= left:  # a pair made now may tie with these
        taken.pop()
    return [pair for _, pair in taken]


def _merger(first: dict[str, str]):
    """A function of a column: arrays of tokens in which pairs (key and value of first) are merged."""

    def one(old: list[str]) -> list[str]:
        new, at = [], 0
        while at < len(old):
            both = at + 1 < len(old) and first.get(old[at]) == old[at + 1]
            new.append(old[at] + old[at + 1] if both else old[at])
            at += 1 + both
        return new

    @F.pandas_udf("array<string>")
    def merged(s: pd.Series) -> pd.Series:
        return s.map(lambda x: one(list(x)))

    return merged


def merges_by_spark(counts: DataFrame, vocab_size: int, min_frequency: int, max_length: int) -> list[tuple[str, str]]:
    """merges_of() over a table of pieces (piece, n) of any size: each round counts all pairs in Spark and merges
    a batch of the most frequent."""
    to = alphabet()

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [to[b] for b in x.encode()])

    table = _written(counts.select(split("piece").alias("parts"), "n").where(F.size("parts") > 1))
    merges: list[tuple[str, str]] = []
    made = set(to.values())
    room = vocab_size - 256 - len(SPECIALS)
    while len(merges) < room:
        both = F.transform(F.slice("parts", F.lit(1), F.size("parts") - 1), lambda x, k: F.struct(x.alias("a"), F.get("parts", k + 1).alias("b")))
        each = table.select(F.explode(both).alias("pair"), "n").where(F.length("pair.a") + F.length("pair.b") <= max_length)
        top = each.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= min_frequency).orderBy(F.desc("n"), "pair.a", "pair.b").limit(1000)
        pairs = [(r["n"], (r["pair"]["a"], r["pair"]["b"])) for r in top.collect()]
        if not pairs:
            break
        now = _batch(pairs, made)[: room - len(merges)]
        merges += now
        made |= {a + b for a, b in now}
        before, table = table, _written(table.select(_merger(dict(now))("parts").alias("parts"), "n").where(F.size("parts") > 1))
        _remove(before)
    return merges


def train(df: DataFrame, text: str, vocab_size: int = 24576, min_frequency: int = 10, max_length: int = 20, max_pieces: int = 500_000) -> dict:
    """A tokenizer file's content. All pieces are counted by Spark; up to max_pieces distinct ones (about 0.8 KB
    each) are merged on the driver, more in one array there while they need no more memory than so many (128
    bytes of text for each of max_pieces), beyond that by Spark, all with the same result."""
    counts = _written(pretoken_counts(df, text))
    to = alphabet()
    size = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()
    if size[0] <= max_pieces:
        words: Counter = Counter()
        for r in counts.toLocalIterator():
            words["".join(to[b] for b in r["piece"].encode())] += r["n"]
        merges = merges_of(words, vocab_size, min_frequency, max_length)
    elif size[1] + size[0] <= 128 * max_pieces:
        merges = merges_of_many(_gathered(counts, vocab_size), vocab_size, min_frequency, max_length)
    else:
        merges = merges_by_spark(counts, vocab_size, min_frequency, max_length)
    return content_of(merges)


def content_of(merges: list[tuple[str, str]]) -> dict:
    """A tokenizer file's content from its merges."""
    tokens = [*SPECIALS, *sorted(alphabet().values()), *(a + b for a, b in merges)]
    vocab = {t: k for k, t in enumerate(dict.fromkeys(tokens))}
    return {
        "version": "1.0", "truncation": None, "padding": None,
        "added_tokens": [{"id": k, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for k, t in enumerate(SPECIALS)],
        "normalizer": {"type": "NFC"},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
        "post_processor": None,
        "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": [list(m) for m in merges]},
    }


def merges_as_lines(spec: dict) -> dict:
    """A tokenizer file's content with merges in the older form, "a b"."""
    model = spec["model"] | {"merges": [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]}
    return spec | {"model": model}


def special_id(spec: dict, token: str) -> int:
    ids = {x["content"]: x["id"] for x in spec["added_tokens"]}
    if token not in ids:
        raise KeyError(f"{token} is not one of {sorted(ids)}")
    return ids[token]


def pad_id(spec: dict) -> int:
    """The id that fills batches up: the padding token's, else the end's."""
    try:
        return special_id(spec, "<|pad|>")
    except KeyError:
        return special_id(spec, "<|endoftext|>")


_loaded: dict[str, Encoder] = {}
#: Distinct units, and characters and ids of them, whose ids a worker keeps; a full cache is emptied.
KEPT, KEPT_SIZE = 500_000, 32 << 20


class Encoder:
    """A tokenizer file's encoder and decoder, by the tokenizers library. Of a file that splits as train() has it,
    the ids of distinct units are kept, since a unit has the same ids wherever it stands."""

    def __init__(self, content: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        spec = json.loads(content)
        added = spec["added_tokens"]
        plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added)
        split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Isolated", "invert": False}
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        usual = spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [split, level]} and spec["normalizer"] == {"type": "NFC"}
        self.by_unit = plain and usual and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"] and not spec["truncation"] and not spec["padding"]
        self.added = {x["content"]: np.array([x["id"]], np.int32).tobytes() for x in added}
        names = sorted(map(regex.escape, self.added), key=len, reverse=True)
        self.apart = regex.compile("(" + "|".join(names) + ")").split if names else None
        self.whole: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.held = 0
        self.quick = self._quick(spec) if self.by_unit else None
        self.bytes_of: dict[int, bytes] | None = None
        if (spec["decoder"] or {}).get("type") == "ByteLevel":
            to = {c: b for b, c in alphabet().items()}
            names_of = {i: t for t, i in (*spec["model"]["vocab"].items(), *((x["content"], x["id"]) for x in added))}
            self.bytes_of = {i: bytes(to[c] for c in t) if all(c in to for c in t) else t.encode() for i, t in names_of.items()}

    def _quick(self, spec: dict):
        """tiktoken's encoder of the same merges, or None. It merges any two tokens that make a third, so each
        must be what the file's own merges make of its text, with ids in the order of the merges: then two that
        the file leaves apart make none."""
        try:
            import tiktoken
        except ImportError:
            return None
        to = {c: b for b, c in alphabet().items()}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if len(made) + 256 != len(vocab) or any(a >= b for a, b in zip(made, made[1:], strict=False)) or not set(to) <= set(vocab):
            return None
        if any([x.id for x in self.tokenizer.model.tokenize(t)] != [i] for t, i in vocab.items()):
            return None
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={bytes(to[c] for c in t): i for t, i in vocab.items()}, special_tokens={})

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _joined(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        if self.quick is not None and text and not LATER(text):
            try:
                return self.quick.encode_to_numpy(text, disallowed_special=()).astype(np.int32).tobytes()
            except ValueError:  # its splitting gives up on some very long runs
                pass
        whole, spaced = _units(text)
        try:
            return b"".join([*map(self.whole.__getitem__, whole), *map(self.spaced.__getitem__, spaced)])
        except KeyError:
            pass
        if len(self.whole) + len(self.spaced) > KEPT or self.held > KEPT_SIZE:
            self.whole.clear()
            self.spaced.clear()
            self.held = 0
        for units, known, before in ((whole, self.whole, ""), (spaced, self.spaced, " ")):
            new = [u for u in dict.fromkeys(units) if u not in known]
            known.update(zip(new, self._ids([before + u for u in new]), strict=True))
            self.held += sum(len(u) + len(known[u]) for u in new)
        return b"".join([*map(self.whole.__getitem__, whole), *map(self.spaced.__getitem__, spaced)])

    def encode(self, text: str) -> np.ndarray:
        if not self.by_unit:
            return np.frombuffer(self._ids([text])[0], np.int32)
        if self.apart is None or not any(x in text for x in self.added):
            return np.frombuffer(self._joined(text), np.int32)
        return np.frombuffer(b"".join(self.added[x] if x in self.added else self._joined(x) for x in self.apart(text) if x), np.int32)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        if self.bytes_of is None:
            return self.tokenizer.decode(list(ids), skip_special_tokens=False)
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        return b"".join([self.bytes_of.get(i, b"") for i in ids]).decode("utf-8", "replace")


def _encoder(content: str) -> Encoder:
    if content not in _loaded:
        _loaded.clear()
        _loaded[content] = Encoder(content)
    return _loaded[content]


def encoder(spec: dict):
    """A function of a column: ids of texts, loaded once for each worker; null for null."""
    content = json.dumps(spec, ensure_ascii=False)

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _encoder(content)
        for s in parts:
            yield pd.Series([None if x is None else t.encode(x) for x in s], index=s.index, dtype=object)

    return ids


def decoder(spec: dict):
    """A function of a column: texts of ids, special tokens kept."""
    content = json.dumps(spec, ensure_ascii=False)

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _encoder(content)
        for s in parts:
            yield s.map(lambda x: None if x is None else t.decode(x))

    return text


def masked_encoder(spec: dict):
    """A function of segments(): struct of ids and mask, 1 where a segment is the assistant's."""
    content = json.dumps(spec, ensure_ascii=False)

    @F.pandas_udf("struct<ids:array<int>,mask:array<int>>")
    def both(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = _encoder(content)
        for s in parts:
            rows = []
            for segs in s:
                ids = [np.empty(0, np.int32)]
                mask = [np.empty(0, np.int32)]
                for seg in [] if segs is None else segs:
                    ids.append(t.encode(seg["text"]))
                    mask.append(np.full(len(ids[-1]), int(seg["assistant"]), np.int32))
                rows.append((np.concatenate(ids), np.concatenate(mask)))
            yield pd.DataFrame(rows, columns=["ids", "mask"])

    return both


def with_end(ids: Column, end: int) -> Column:
    return F.array_append(ids, F.lit(end))
