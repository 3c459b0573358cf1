"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum over all ways to cut it into pieces, which a
forward pass over its characters gives; a text's is the product over its
words. Sums of words of any length are kept in range by rescaling, for each
word and language by itself. Piece probabilities come from a bounded sample of
labelled documents by expectation maximisation over the same sums, there over
words of STRETCH characters at most (longer ones are cut to be learnt from).

Defined cases: a null text, or one without a letter, is `und` with score 0;
texts of any length are scored whole; rows with a null language or id don't
teach; more languages than Learning.languages are an error; rows that repeat
an id, or have none, are predicted each; ties go to the language that sorts
first; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, held_out, slices

UNKNOWN = "und"
#: Longer words are cut into stretches of so many characters to be learnt from.
STRETCH = 48
#: Bytes of words and their sums that a worker keeps, about.
KEPT_BYTES = 64 << 20
#: A sum below TINY is multiplied by 1 / TINY; looked at every AFTER characters, of which each costs 1e-9 at most.
TINY, AFTER = 1e-100, 8
#: Characters of words of one length whose sums are worked out together.
TOGETHER = 400_000
#: Words of a stretch whose language is compared with the text's.
STEP = 3
_M = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BREAKS = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalpha()})


@dataclass(frozen=True)
class Learning:
    """docs_per_language and chars_per_doc bound the sample that is learnt from; languages: how many there may be
    (the model has a number for each piece and language and goes to every worker); rounds: of expectation maximisation; smoothing: added to each piece's expected count."""

    docs_per_language: int = 300
    chars_per_doc: int = 20_000
    languages: int = 500
    rounds: int = 2
    smoothing: float = 0.1
    folds: int = 5
    fold: int = 0


def vocabulary(file: str) -> list[str]:
    """The lower-case pieces of a sentencepiece model, the mark of a word's start included."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file)
    normal = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return sorted({p.lower() for p in normal})


def words_of(text: str) -> list[str]:
    """Lower-case words, cut at ASCII characters that are not letters, each with the mark of its start."""
    return text.lower().translate(_BREAKS).split()


def _stretches(word: str) -> list[str]:
    word = "▁" + word
    return [word[k : k + STRETCH] for k in range(0, len(word), STRETCH)]


class Pieces:
    """Finds the pieces that end at each character of many words at once."""

    def __init__(self, pieces: list[str]):
        self.longest = min(STRETCH, max(map(len, pieces), default=1))
        powers = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(STRETCH):
                powers.append(powers[-1] * _BASE)
        self.powers = np.array(powers, np.uint64)
        hashes = np.array([self._hash(p) for p in pieces if len(p) <= STRETCH], np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.lengths = sorted({len(p) for p in pieces})
        self.n = len(hashes)

    def _mixed(self, codes: np.ndarray) -> np.ndarray:
        x = (codes.astype(np.uint64) + np.uint64(1)) * _M
        return x ^ (x >> np.uint64(29))

    def _hash(self, piece: str) -> np.uint64:
        x = self._mixed(np.frombuffer(piece.encode("utf-32-le"), np.uint32))
        with np.errstate(over="ignore"):
            return (x * self.powers[: len(x)][::-1]).sum(dtype=np.uint64)

    def ending(self, words: list[str]) -> Ending:
        """For words of one length: by (end, length) the piece of each word, n if it is none."""
        return Ending(self, words)


class Ending(dict):
    """The pieces that end at each character: of all at once, or of one after another as advance() is called."""

    def __init__(self, pieces: Pieces, words: list[str], window: bool = False):
        super().__init__()
        self.pieces, self.size, self.window = pieces, len(words[0]), window
        self.codes = pieces._mixed(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)).reshape(-1, self.size)
        self.running: dict[int, np.ndarray] = {}
        self.end = 0
        if not window:
            while self.end < self.size:
                self.advance()

    def advance(self) -> None:
        p = self.pieces
        if self.window:
            self.clear()
        self.end = end = self.end + 1
        with np.errstate(over="ignore"):
            c = self.codes[:, end - 1]
            self.running = {start: h * _BASE + c for start, h in self.running.items() if end - start <= p.longest}
            self.running[end - 1] = c
            for start, h in self.running.items():
                if end - start in p.lengths:
                    at = np.searchsorted(p.sorted, h)
                    at[at == p.n] = 0
                    self[end, end - start] = np.where(p.sorted[at] == h, p.order[at], p.n)


def forward(pieces: Pieces, words: list[str], probs: np.ndarray, ending: dict | None = None) -> list[np.ndarray]:
    """For words of one length, what all segmentations of each prefix sum to in each language. The last row of
    probs is that of no piece; a character that is none by itself counts as unknown."""
    size, ending = len(words[0]), ending or pieces.ending(words)
    alpha = [np.ones((len(words), probs.shape[1]))]
    for end in range(1, size + 1):
        total = np.zeros_like(alpha[0])
        for length in pieces.lengths:
            if (at := ending.get((end, length))) is not None:
                total += alpha[end - length] * (_single(at, probs) if length == 1 else probs[at])
        alpha.append(total)
    return alpha


def log_sums(pieces: Pieces, words: list[str], probs: np.ndarray) -> np.ndarray:
    """For words of one length, the logarithm of what all segmentations sum to in each language."""
    size, shape = len(words[0]), (len(words), probs.shape[1])
    ending, scale = Ending(pieces, words, window=True), np.zeros(shape)
    alpha = {0: np.ones(shape)}  # by end; only those that a piece can still start from
    for end in range(1, size + 1):
        total = np.zeros(shape)
        ending.advance()
        for length in pieces.lengths:
            if length <= end:
                at = ending[end, length]
                total += alpha[end - length] * (_single(at, probs) if length == 1 else probs[at])
        alpha[end] = total
        alpha.pop(end - pieces.longest, None)
        if end % AFTER == 0 and (low := total < TINY).any():
            scale[low] += np.log(TINY)
            for a in alpha.values():
                a[low] /= TINY
    return np.log(alpha[size]) + scale


def _single(at: np.ndarray, probs: np.ndarray) -> np.ndarray:
    out = probs[at]
    out[at == len(probs) - 1] = 1e-9
    return out


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Words in groups of one length, and their places."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        for at in np.array_split(np.flatnonzero(sizes == size), max(1, (sizes == size).sum() * size // TOGETHER)):
            yield at, [words[k] for k in at]


def learn(samples: dict[str, Counter], pieces: Pieces, rounds: int, smoothing: float) -> np.ndarray:
    """Probabilities of pieces (rows, and one for no piece) by language (columns, in the order of samples)."""
    columns = []
    for counts in samples.values():
        parts: Counter = Counter()
        for w, n in counts.items():
            for s in _stretches(w):
                parts[s] += n
        groups = [(ws, np.array([parts[w] for w in ws], float), pieces.ending(ws)) for _, ws in by_length(list(parts))] if parts else []
        p = np.full((pieces.n + 1, 1), 1.0 / max(1, pieces.n))
        p[-1] = 0
        for _ in range(rounds):
            expected = np.zeros(pieces.n + 1)
            for ws, n, ending in groups:
                size = len(ws[0])
                alpha = forward(pieces, ws, p, ending)
                beta = [np.zeros((len(ws), 1)) for _ in range(size)] + [np.ones((len(ws), 1))]
                for (end, length), at in sorted(ending.items(), key=lambda x: -x[0][0]):
                    here = (_single(at, p) if length == 1 else p[at]) * beta[end]
                    expected += np.bincount(at, weights=(alpha[end - length] * here / np.maximum(alpha[size], 1e-300))[:, 0] * n, minlength=pieces.n + 1)
                    beta[end - length] += here
            expected[-1] = 0
            p = ((expected + smoothing) / (expected.sum() + smoothing * pieces.n))[:, None]
            p[-1] = 0
        columns.append(p[:, 0])
    return np.array(columns).T.copy() if columns else np.zeros((pieces.n + 1, 0))


class Scorer:
    """Log probabilities of words by language; words that were seen before are looked up."""

    def __init__(self, pieces: list[str], probs: np.ndarray):
        self.pieces, self.probs = Pieces(pieces), probs
        self.at: dict[str, int] = {}
        self.logs = np.zeros((0, probs.shape[1]))
        self.held = 0

    def words(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, int]]:
        """For each text a row for each word, and their characters."""
        split = [words_of(t) if t else [] for t in texts]
        new = list({w for ws in split for w in ws if w not in self.at})
        size = lambda ws: sum(2 * len(w) for w in ws) + (150 + 8 * self.probs.shape[1]) * len(ws)
        if self.held + size(new) > KEPT_BYTES and self.at:
            self.at, self.logs, self.held = {}, self.logs[:0], 0
            new = list({w for ws in split for w in ws})
        if new:
            logs = np.zeros((len(new), self.probs.shape[1]))
            for at, ws in by_length(["▁" + w for w in new]):
                logs[at] = log_sums(self.pieces, ws, self.probs)
            start = len(self.logs)
            self.logs = np.concatenate([self.logs, logs])
            self.at.update(zip(new, range(start, start + len(new)), strict=True))
            self.held += size(new)
        get = self.at.__getitem__
        for ws in split:
            yield self.logs[np.fromiter(map(get, ws), np.int64, len(ws))], sum(map(len, ws))

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """A row of sums for each text."""
        return np.array([logs.sum(axis=0) for logs, _ in self.words(texts)]).reshape(len(texts), -1)

    def measured(self, texts: list[str | None], levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """texts(), and of each text's best language: the share of words in stretches of STEP that are most
        likely in it, too, and how far a character's mean log probability is below the language's level."""
        sums, agree, below = np.zeros((len(texts), len(levels))), np.zeros(len(texts)), np.full(len(texts), np.inf)
        for k, (logs, chars) in enumerate(self.words(texts)):
            if len(logs):
                sums[k] = logs.sum(axis=0)
                best = sums[k].argmax()
                starts = np.arange(0, len(logs), STEP)
                sizes = np.diff(np.append(starts, len(logs)))
                agree[k] = sizes[np.add.reduceat(logs, starts).argmax(axis=1) == best].sum() / len(logs)
                below[k] = levels[best] - sums[k, best] / chars
        return sums, agree, below


def levels_of(samples: dict[str, Counter], scorer: Scorer) -> np.ndarray:
    """The mean log probability of a character of each language's sample in that language."""
    levels = []
    for column, counts in enumerate(samples.values()):
        words, total, chars = list(counts), 0.0, 0
        for start in range(0, len(words), 20_000):
            part = words[start : start + 20_000]
            n = np.array([counts[w] for w in part], float)
            total += float(n @ scorer.texts(part)[:, column])
            chars += sum(counts[w] * len(w) for w in part)
        levels.append(total / max(1, chars))
    return np.array(levels)


def _sample(docs: DataFrame, how: Learning) -> dict[str, Counter]:
    """Word counts by language of a bounded sample: the documents whose hashed ids are smallest, about."""
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), how.folds, how.fold))
    sizes = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(how.languages + 1).collect()}
    if len(sizes) > how.languages:
        raise ValueError(f"more than {how.languages} languages; raise Learning.languages if there is memory for the model")
    if not sizes:
        return {}
    spark = docs.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, 1.3 * how.docs_per_language / n)) for k, n in sizes.items()], "lang string, share double")
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = taught.select("lang", "doc_id", "text").join(F.broadcast(shares), "lang").where(chance < F.col("share"))  # shares: one row a language
    samples: dict[str, Counter] = {k: Counter() for k in sorted(sizes)}
    used: Counter = Counter()
    for r in picked.select("lang", F.substring("text", 1, how.chars_per_doc).alias("text")).toLocalIterator():
        if used[r["lang"]] < 1.6 * how.docs_per_language:
            used[r["lang"]] += 1
            samples[r["lang"]].update(words_of(r["text"]))
    return samples


_scorers: dict[str, Scorer] = {}


def identify(docs: DataFrame, file: str, how: Learning = Learning(), row: str = "doc_id", measures: bool = False) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score (the language's share of the probability).

    measures: two columns more that don't grow with a text's length: agree and below, as in Scorer.measured().
    file: a sentencepiece model. row: the column (of longs) that is returned as doc_id. Languages, ids and sources are not looked at when predicting."""
    samples = _sample(docs, how)
    pieces = vocabulary(file)
    languages = list(samples)
    probs = learn(samples, Pieces(pieces), how.rounds, how.smoothing)
    levels = levels_of(samples, Scorer(pieces, probs)) if measures and languages else np.zeros(len(languages))
    model = docs.sparkSession.sparkContext.broadcast((pieces, probs))  # pieces x languages numbers
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(*model.value)
        scorer = _scorers[key]
        for batch in batches:
            ids, held, texts = columns_of(batch, "doc_id", "held_out", "text")
            for start, end in slices(texts):
                part = texts[start:end]
                letters = np.array([bool(t) and any(map(str.isalpha, t)) for t in part], bool)
                names, scores = np.full(len(part), UNKNOWN, object), np.zeros(len(part))
                agree, below = np.zeros(len(part)), np.full(len(part), np.inf)
                if languages:
                    if measures:
                        sums, agree, below = scorer.measured(part, levels)
                    else:
                        sums = scorer.texts(part)
                    best = sums.argmax(axis=1)
                    share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                    names[letters] = np.array(languages, object)[best[letters]]
                    scores[letters] = share[letters]
                columns = [pa.array(ids[start:end], pa.int64()), pa.array(held[start:end], pa.bool_()), pa.array(names.tolist(), pa.string()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(agree), pa.array(below)] * measures, names=["doc_id", "held_out", "lang_pred", "score", "agree", "below"][: 4 + 2 * measures])

    rows = docs.select(F.col(row).alias("doc_id"), held_out(F.col("doc_id"), how.folds, how.fold).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double" + ", agree double, below double" * measures)
