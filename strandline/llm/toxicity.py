"""Toxicity (operator 3): noisy-channel deobfuscation, then a lexicon score of the restored text.

Channel. A writer may replace letters by look-alikes (leetspeak), put single separators between pieces of one or two
letters of a word, or repeat letters. ``suspects`` finds such places in whole texts with array operations. Each is turned into a lattice:
every character offers the letters that it may stand for, or nothing (a repeated letter, a filler). Viterbi decoding
takes the path of highest probability under a character trigram model of the corpus. The model's counts are taken over
all documents, summed in tasks before they meet, and have a fixed number of cells.

Score. Features are the words of the plain text and the restored words, and their beginnings of four to eight bytes, as
64-bit hashes. A lexicon of features that mark toxic rows is learned from a bounded sample of labelled rows (half of it),
and a logistic curve over the strongest and the summed evidence from the other half.

Defined results: null and empty texts have no evidence and get the curve's lowest score; with no labelled rows of one
class every score is 0.5; null labels and ids never train; only ``text`` is read for a score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandline.llm.common import _BYTE_CODES, _STEP, LOWER, PIECE_BYTES, U64, Words, byte_table, crc_of_id, mix, powers, slices, text_buffer
from strandline.llm.decontaminate import HashSet
from strandline.llm.quality import labelled_sample

#: What a character may stand for. Fixed values of common leetspeak.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c"}
_LETTER = byte_table(lambda b: 97 <= b <= 122 or b >= 128)
_LEET = byte_table(lambda b: chr(b) in LOOKALIKES)
_DIGIT = byte_table(lambda b: 48 <= b <= 57)
_PIECE = _LETTER | _DIGIT
_JOINT = byte_table(lambda b: chr(b) in " .-_*")
_WORDLIKE = byte_table(lambda b: b > 32 and b != 127 and chr(b) not in ",;:/\\\"'?=&<>[]{}%#~^`")

# ------------------------------------------------------------------ character model

#: 0 word edge, 1..26 letters, 27 any byte beyond ASCII
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27
SYMBOLS = 28


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol trigrams over all documents: (28, 28, 28), pre-summed in tasks."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for lo, hi in slices(offsets):
                s = _SYMBOL[LOWER[data[offsets[lo] : offsets[hi]]]]
                s = np.concatenate([[0, 0], s, [0, 0]])
                code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                total += np.bincount(code, minlength=SYMBOLS**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    cells = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most 28 ** 3 rows
    out = np.zeros(SYMBOLS**3)
    for cell, n in cells:
        out[cell] = n
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), interpolated with the bigram and the single symbol."""
    one = counts.sum((0, 1)) + 1.0
    two = counts.sum(0) + 0.5 * one / one.sum()
    three = counts + 2.0 * two / two.sum(1, keepdims=True)
    return np.log(three / three.sum(2, keepdims=True))


_SWAP, _DROP_REPEAT, _DROP_FILLER, _KEEP_REPEAT = -1.0, -0.3, -10.0, -1.0


def decode(token: str, model: np.ndarray) -> str:
    """The most likely letters behind a token, by Viterbi over its lattice; states are the last two symbols."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    previous, run = "", 0
    for c in token:
        run = run + 1 if c == previous else 1
        previous = c
        if "a" <= c <= "z":
            offers = [(c, _KEEP_REPEAT if run > 1 else 0.0)] + ([("", _DROP_REPEAT)] if run > 1 else [])
        elif c in LOOKALIKES:
            offers = [(x, _SWAP) for x in LOOKALIKES[c]] + [("", _DROP_FILLER)] + ([("", _DROP_REPEAT)] if run > 1 else [])
        else:
            offers = [(c, 0.0)] if ord(c) >= 128 else [("", 0.0)]
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in states.items():
            for letter, cost in offers:
                if letter:
                    s = 27 if ord(letter) >= 128 else ord(letter) - 96
                    key, value = (b, s), score + cost + model[a, b, s]
                else:
                    key, value = (a, b), score + cost
                if key not in new or new[key][0] < value:
                    new[key] = (value, text + letter)
        states = new
    return max((score + model[a, b, 0], text) for (a, b), (score, text) in states.items())[1]


# ------------------------------------------------------------------ places to decode


def suspects(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans (start, end) of obfuscated-looking places in lower-cased bytes of texts that begin at ``cuts``."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(raw) + 1, bool)
    edge[cuts] = True
    letter, leet = _LETTER[raw], _LEET[raw]
    follows = np.zeros(len(raw), bool)  # this byte and the next are of one text
    follows[:-1] = ~edge[1:-1]
    after = np.zeros(len(raw), bool)
    after[:-1] = letter[1:] & follows[:-1]
    mixed = leet & after  # a look-alike before a letter
    ascii_letter = letter & (raw < 128)
    twice = np.zeros(len(raw), bool)
    twice[:-1] = ascii_letter[:-1] & (raw[1:] == raw[:-1]) & follows[:-1]
    thrice = np.zeros(len(raw), bool)
    thrice[:-1] = twice[:-1] & twice[1:]
    # words between blanks and joining marks
    inside = _WORDLIKE[raw]
    open_, close = inside.copy(), inside.copy()
    open_[1:] &= ~inside[:-1] | edge[1:-1]
    close[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(open_), np.flatnonzero(close) + 1
    if not len(start):
        return start, end
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (mixed, letter, thrice, twice, leet)]
    m, l, t, d, k = (x[end] - x[start] for x in sums)
    last = end - 1
    tail = leet[last] & (raw[last] != 33) & (k > 0)
    word = (l > 0) & ((m > 0) | (t > 0) | (d >= 2) | tail)
    # chains of pieces of one or two characters with single separators
    piece = _PIECE[raw] | (leet & ~_JOINT[raw])
    p_open, p_close = piece.copy(), piece.copy()
    p_open[1:] &= ~piece[:-1] | edge[1:-1]
    p_close[:-1] &= ~piece[1:] | edge[1:-1]
    ps, pe = np.flatnonzero(p_open), np.flatnonzero(p_close) + 1
    single = pe - ps <= 2
    chained = np.zeros(len(ps), bool)
    if len(ps) > 1:
        chained[:-1] = single[:-1] & single[1:] & (ps[1:] - pe[:-1] == 1) & _JOINT[raw[np.minimum(pe[:-1], len(raw) - 1)]] & ~edge[pe[:-1]] & ~edge[ps[1:]]
    grow = np.flatnonzero(chained & ~np.concatenate([[False], chained[:-1]]))
    stop = np.flatnonzero(chained & ~np.concatenate([chained[1:], [False]])) + 1
    long = stop - grow >= np.where(raw[np.minimum(pe[grow], len(raw) - 1)] == 32, 3, 2)  # four pieces between blanks, three between marks
    return np.concatenate([start[word], ps[grow[long]]]), np.concatenate([end[word], pe[stop[long]]])


class Restorer:
    """Decodes suspect places, with a bounded memory of those met before."""

    def __init__(self, model: np.ndarray, keep: int = 200_000):
        self.model, self.keep, self.known = model, keep, {}

    def words(self, place: bytes) -> list[bytes]:
        if place not in self.known:
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[place] = self._words(place)
        return self.known[place]

    def _words(self, place: bytes) -> list[bytes]:
        text = place.decode("utf-8", "replace").strip(".,;:?\"'-_*#%&=/<>[]{}")
        if all(len(x) <= 2 for x in text.replace(".", " ").replace("-", " ").replace("_", " ").replace("*", " ").split(" ")):
            text = "".join(c for c in text if c not in " .-_*")
        bare = text.rstrip("!$@+(|")  # marks at the end may be letters or emphasis: both are read
        readings = {decode(x, self.model) for x in {text, bare} if x}
        return [x.encode() for x in sorted(readings) if len(x) >= 3]


# ------------------------------------------------------------------ features

_BEGINNINGS = (4, 5, 6, 7, 8)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hashes of whole words, then of their beginnings (0 where the word is not longer)."""
    out = [np.zeros(len(start), U64) for _ in range(1 + len(_BEGINNINGS))]
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + PIECE_BYTES, "right")))
        left = int(start[at])
        part = raw[left : int(end[to - 1])]
        ups, downs = powers(_STEP, len(part) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(_BYTE_CODES[part] * ups[: len(part)], out=sums[1:])
        s, e = start[at:to] - left, end[at:to] - left
        out[0][at:to] = mix((sums[e] - sums[s]) * downs[s] + U64(1 << 40))
        for j, size in enumerate(_BEGINNINGS, 1):
            cut = np.minimum(s + size, e)
            out[j][at:to] = np.where(e - s > size, mix((sums[cut] - sums[s]) * downs[s] + U64(size)), U64(0))
        at = to
    return out


_WORD = byte_table(lambda b: 97 <= b <= 122 or b >= 128)


def text_features(texts: pa.Array, restorer: Restorer):
    """(lo, hi, owner, feature) arrays of slices of texts: hashed words and beginnings of plain and restored text."""
    data, offsets = text_buffer(texts)
    for lo, hi in slices(offsets):
        base = int(offsets[lo])
        raw = LOWER[data[base : int(offsets[hi])]]
        cuts = offsets[lo : hi + 1] - base
        w = Words(data, offsets, lo, hi, _WORD, LOWER)
        long = w.end - w.start >= 3
        start, end = w.start[long], w.end[long]
        owner = [w.doc[long]] * (1 + len(_BEGINNINGS))
        features = span_hashes(raw, start, end)
        s, e = suspects(raw, cuts)
        if len(s):
            view, restored, of = raw.tobytes(), [], []
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                for word in restorer.words(view[a:b]):
                    restored.append(word)
                    of.append(a)
            if restored:
                flat = np.frombuffer(b"".join(restored), np.uint8)
                sizes = np.fromiter(map(len, restored), np.int64, len(restored))
                ends = np.cumsum(sizes)
                features = features + span_hashes(flat, ends - sizes, ends)
                owner = owner + [np.searchsorted(cuts, np.array(of), "right") - 1 + lo] * (1 + len(_BEGINNINGS))
        o, f = np.concatenate(owner), np.concatenate(features)
        yield lo, hi, o[f != 0], f[f != 0]


@dataclass
class ToxicModel:
    trigrams: np.ndarray
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    curve: np.ndarray | None = None
    _ready: tuple | None = None

    def tools(self) -> tuple[Restorer, HashSet]:
        if self._ready is None:
            self._ready = Restorer(self.trigrams), HashSet(self.keys)
        return self._ready

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}


def evidence(texts: pa.Array, model: ToxicModel) -> np.ndarray:
    """(texts, 3): largest weight, log of the summed weights of distinct features, and that sum per hundred words."""
    restorer, lexicon = model.tools()
    out = np.zeros((len(texts), 3))
    for lo, hi, owner, feature in text_features(texts, restorer):
        at, key = lexicon.find(feature)
        words = np.bincount(owner - lo, minlength=hi - lo) / 3 + 20
        if len(at):
            pair = np.unique(np.stack([owner[at], key]), axis=1)
            w = model.weights[pair[1]]
            np.maximum.at(out[:, 0], pair[0], w)
            total = np.bincount(pair[0] - lo, w, minlength=hi - lo)
            out[lo:hi, 1] = np.log1p(total)
            out[lo:hi, 2] = np.log1p(100 * total / words)
    return out


def fit_toxicity_rows(sample: list[tuple[str, int]], trigrams: np.ndarray, *, least: int = 4, strong: float = 2.0, features: int = 50_000) -> ToxicModel:
    """Lexicon from two thirds of the sample, curve from the rest."""
    model = ToxicModel(trigrams)
    if min(sum(y == c for _, y in sample) for c in (0, 1)) < 6:
        return model
    # texts shared by copies carry one label: every distinct text counts once
    sample = sorted(dict(sample).items(), key=lambda r: (r[1], zlib.crc32(r[0].encode())))
    learn, tune = [r for i, r in enumerate(sample) if i % 3], sample[::3]
    texts, y = pa.array([t for t, _ in learn]), np.array([c for _, c in learn])
    owners, feats = [], []
    for _, _, o, f in text_features(texts, Restorer(trigrams)):
        pair = np.unique(np.stack([o.astype(U64), f]), axis=1)
        owners.append(pair[0].astype(np.int64))
        feats.append(pair[1])
    owner, feature = np.concatenate(owners), np.concatenate(feats)
    keys, which = np.unique(feature, return_inverse=True)
    bad = np.bincount(which, y[owner] == 1, minlength=len(keys))
    fine = np.bincount(which, y[owner] == 0, minlength=len(keys))
    weight = np.log((bad + 0.1) / ((y == 1).sum() + 0.2)) - np.log((fine + 0.5) / ((y == 0).sum() + 1))
    good = np.flatnonzero((bad >= least) & (weight >= strong))
    good = good[np.argsort(-weight[good], kind="stable")[:features]]
    good = np.sort(good)
    model.keys, model.weights = keys[good], weight[good]
    x = evidence(pa.array([t for t, _ in tune]), model)
    model.curve = _logistic(x, np.array([c for _, c in tune], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 200) -> np.ndarray:
    design = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(design.shape[1])
    penalty = ridge * np.append(np.ones(x.shape[1]), 0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (p - y) + penalty * beta
        curve = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty + 1e-6)
        step = np.linalg.solve(curve, slope)
        beta -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def toxicity_scores(texts: pa.Array, model: ToxicModel) -> np.ndarray:
    if model.curve is None:
        return np.full(len(texts), 0.5)
    x = evidence(texts, model)
    return 1 / (1 + np.exp(-np.clip(np.hstack([x, np.ones((len(x), 1))]) @ model.curve, -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, rows_per_class: int = 2000, most_chars: int = 12_000) -> ToxicModel:
    """Character model of all documents; lexicon and curve from labelled rows outside the held-out fold (crc32 mod 3 = 1)."""
    sample = labelled_sample(docs, labels, "toxic", crc_of_id("doc_id") % 3 != 1, rows_per_class, most_chars)
    return fit_toxicity_rows(sample, log_model(trigram_counts(docs)))


def score_toxicity(docs: DataFrame, model: ToxicModel, column: str = "score") -> DataFrame:
    """``docs`` with the toxicity of its whole restored ``text`` in ``column``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 28 ** 3 cells and 50,000 features

    @arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(toxicity_scores(texts, shared.value))

    return docs.withColumn(column, scored(F.col("text")))


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels, **fit))
    return scored.select("doc_id", (crc_of_id("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
