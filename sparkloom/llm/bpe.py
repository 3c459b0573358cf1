"""Byte-level BPE by prefix-sharing traversal of a trie of distinct words.

The last token of the encoding of every prefix of a word determines the
encoding: walking back from the end, each last token leaves a shorter prefix.
Distinct words are laid out as a trie in depth-first order (sorted, each word
keeping the path that it shares with the one before), so a prefix that many
words share is worked out once. At a node, the last token is the one token
that ends there and fits what the node at its start holds; two tokens fit if
the merges that build them leave the border between them alone.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import columns_of

#: How the byte-level pre-tokenizer splits text; white space is Unicode's White_Space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
NEVER = 1 << 40
#: Entries and bytes that a worker keeps of each cache, about; a full cache is emptied.
KEPT, KEPT_BYTES = 500_000, 48 << 20
#: Characters that are gathered before their new words go into a trie together.
GATHERED = 4 << 20


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the
    others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TrieBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, file: str):
        self.file = file
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.specials}
        self.ids = {as_bytes(t): i for t, i in vocab.items()}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.specials.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {i: -1 for i in self.ids.values()}  # rank of the merge that makes a token
        self.left: dict[int, tuple[tuple[int, int], ...]] = {}
        self.right: dict[int, tuple[tuple[int, int], ...]] = {}
        for b in range(256):
            i = self.ids[bytes([b])]
            self.left[i] = self.right[i] = ((i, NEVER),)
        self.size = {i: len(b) for i, b in self.bytes_of.items()}
        usable = {self.ids[bytes([b])] for b in range(256)}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = r
        for (a, b), r in self.rank.items():  # in order of rank
            made = self.ids[self.bytes_of[a] + self.bytes_of[b]]
            if a in usable and b in usable and made not in usable and self._fit(a, b, r):
                # the outer pieces of a token, innermost first, each with the rank at which the next swallows it
                self.left[made] = (*self.left[a][:-1], (a, r), (made, NEVER))
                self.right[made] = (*self.right[b][:-1], (b, r), (made, NEVER))
                usable.add(made)
        self.words = {self.bytes_of[i]: i for i in usable}
        self.tails = {w[k:] for w in self.words for k in range(len(w))}
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")").split if self.specials else None
        self.odd = regex.compile(r"(?:^|\p{White_Space}) |\p{White_Space}$| \p{White_Space}").search
        self.unit_split = regex.compile(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+").findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.word_ids: dict[bytes, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.held_words = self.held_units = 0

    def _fit(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether no merge (of a rank under before) crosses the border while a and b are built beside each
        other. Of equal ranks the left merge comes first."""
        xs, ys, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, x_next), (y, y_next) = xs[i], ys[j]
            r = self.rank.get((x, y), NEVER)
            if r < before and r < x_next and r <= y_next:
                return False
            if x_next == y_next == NEVER:
                return True
            if x_next <= y_next:
                i += 1
            else:
                j += 1

    def encode_words(self, words: set[bytes]) -> None:
        """Work out the ids of new words, in the trie's depth-first order."""
        ids, tails, fits, size = self.words, self.tails, self.fits, self.size
        path, last = b"", [-1]  # last[d]: the last token of the first d bytes of path
        self.held_words += sum(map(len, words))
        if len(self.word_ids) + len(words) > KEPT or self.held_words > KEPT_BYTES:
            self.word_ids.clear()
            self.held_words = sum(map(len, words))
        if len(fits) > KEPT:
            fits.clear()
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start, ending = end - 1, []
                while start >= 0 and (tail := word[start:end]) in tails:
                    if (t := ids.get(tail)) is not None:
                        ending.append(t)
                    start -= 1
                for t in reversed(ending):
                    if size[t] == end:
                        break
                    pair = (last[end - size[t]], t)
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = self._fit(*pair)
                    if ok:
                        break
                last.append(t)
            path, found, at = word, [], len(word)
            while at:
                found.append(last[at])
                at -= size[last[at]]
            self.word_ids[word] = struct.pack(f"<{len(found)}I", *reversed(found))

    def _pieces(self, text: str) -> list[str]:
        """Units that are encoded alike wherever they stand: white space with what follows it."""
        if self.odd(text):
            return self.unit_split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def _known(self, units: list[list]) -> None:
        """Make the units of these texts known."""
        new = {u for text in units for u in text if u not in self.units}
        if not new:
            return
        self.held_units += sum(map(len, new))
        if len(self.units) + len(new) > KEPT or self.held_units > KEPT_BYTES:
            self.units.clear()
            new = {u for text in units for u in text}
            self.held_units = sum(map(len, new))
        parts = {u: [w.encode() for w in self.split(u)] for u in new}
        fresh = {w for ws in parts.values() for w in ws if w not in self.word_ids}
        if len(self.word_ids) + len(fresh) > KEPT or self.held_words + sum(map(len, fresh)) > KEPT_BYTES:
            fresh = {w for ws in parts.values() for w in ws}  # encode_words() will empty the cache
        self.encode_words(fresh)
        got = self.word_ids
        for u, ws in parts.items():
            self.units[u] = got[ws[0]] if len(ws) == 1 else b"".join([got[w] for w in ws])

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[str] = []
        held = 0
        for text in texts:
            group.append(text)
            held += len(text)
            if held > GATHERED:
                out += self._encode_group(group)
                group, held = [], 0
        return out + self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        plain = [t if self.special is None or not any(s in t for s in self.specials) else None for t in texts]
        units = [self._pieces(t) if t else [] for t in plain]
        parts = {k: [x if x in self.specials else (self._pieces(x) if x else []) for x in self.special(t)] for k, t in enumerate(texts) if plain[k] is None}
        self._known(units + [p for ps in parts.values() for p in ps if isinstance(p, list)])
        get = self.units.__getitem__
        packed = [b"".join(map(get, u)) for u in units]
        for k, ps in parts.items():
            packed[k] = b"".join(b"".join(map(get, p)) if isinstance(p, list) else struct.pack("<I", self.specials[p]) for p in ps)
        return packed

    def encode(self, text: str) -> list[int]:
        return list(struct.unpack(f"<{len(p := self.encode_packed([text])[0]) // 4}I", p))

    def decode_bytes(self, packed: bytes) -> bytes:
        ids = array("I", packed)
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(struct.pack(f"<{len(ids)}I", *ids)).decode("utf-8", "replace")


class RankBpe:
    """Encoder by a library's own merges, for operators that only need ids: tiktoken with the file's ranks. It
    can stand for the file if the ids of merged tokens rise with the merges."""

    #: Fixed value: the splitting pattern in the library's own words.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, file: str):
        import tiktoken

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in specials}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merged = [vocab[a + b] for a, b in pairs]
        if merged != sorted(merged) or len(set(merged)) != len(merged) or len(merged) + 256 != len(vocab):
            raise ValueError(f"ids in {file} don't follow its merges")
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
        self.encoding = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=specials)
        self.specials, self.file = set(specials), file

    def _packed(self, text: str) -> bytes:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special=self.specials).astype("<u4", copy=False).tobytes()
        except ValueError:  # its splitting gives up on some very long runs
            return load(self.file).encode_packed([text])[0]

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [self._packed(t) if t else b"" for t in texts]


_loaded: dict[tuple[type, str], TrieBpe | RankBpe] = {}


def load(file: str, kind: type = TrieBpe) -> TrieBpe | RankBpe:
    """One encoder for each file and worker process."""
    if (kind, file) not in _loaded:
        _loaded[kind, file] = kind(file)
    return _loaded[kind, file]


def encode_documents(docs: DataFrame, file: str, with_ids: bool = False) -> DataFrame:
    """A row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids); nothing is shuffled.

    file: a tokenizer file that every executor has under this path. Defined cases: a null or empty text has no
    tokens; special tokens' strings become their ids, as the library has it; texts of any length and repeated
    rows are encoded in full, a row each; other columns are ignored."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        bpe = load(file)
        for batch in batches:
            doc_ids, texts = columns_of(batch, "doc_id", "text")
            for k in range(0, len(texts), 500):
                packed = bpe.encode_packed([t or "" for t in texts[k : k + 500]])
                out = {
                    "doc_id": pa.array(doc_ids[k : k + 500], pa.int64()),
                    "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
                    "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
                    "decoded_sha256": [hashlib.sha256(bpe.decode_bytes(p).decode("utf-8", "replace").encode()).hexdigest() for p in packed],
                }
                if with_ids:
                    out["ids"] = pa.array([array("I", p).tolist() for p in packed], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
