"""Personal data (operator 5): exact patterns, and a linear-chain conditional random field for what they miss.

Base spans follow fixed patterns (e-mail, IPv4, card, phone), leftmost and without overlap for each kind; matches that
fail their check (parts, Luhn, digit counts) are dropped. The field adds spans such as "kim at mail dot example dot org",
"(020) 555-1234" or a card written with dots. It is trained on ``LABELLED``, a small table of tagged lines below, by
maximum likelihood with word-shape features of a token and its neighbours, and decoded by Viterbi in numpy batches.

Every token of a text is scored, and a text is decoded as one sequence. Where the scores prove that each best path is
outside for some tokens (``Field.stretches``), those are not read, which changes no result; the rest is decoded in batches
of bounded size. Decoded spans that fail the check of their kind (an at and a dot, digit counts, Luhn), or that overlap a
base span, are dropped; base spans always stay.

Defined results: null and empty texts have no spans; repeated rows are judged alike; offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


KINDS = ("email", "ip", "card", "phone")

# ------------------------------------------------------------------ base patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    n = _digits(text)
    if kind == "card":
        return 14 <= len(n) <= 19 and luhn(n)
    if kind == "phone":
        return 10 <= len(n) <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then in the order of KINDS."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:  # each at sign once: its local part is the run of allowed characters before it
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            free = match.end()
            out.append((start, free, "email"))
        at = text.find("@", max(at + 1, free))
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if valid(kind, m.group())]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ------------------------------------------------------------------ labelled table

#: Tagged lines: a span is [kind|text]. Slots in braces are filled from SLOTS in turn.
LABELLED = (
    "write to [email|{name} at {host} dot {top}] today",
    "mail me : [email|{name} (at) {host} (dot) {top}] please",
    "contact [email|{name} [at] {host} [dot] {top}] for help",
    "{word} {word} [email|{name} dot {name} at {host} dot {top}] {word} {word}",
    "reach [email|{name}(at){host}.{top}] or ask",
    "{word} [email|{name} @ {host} . {top}] {word}",
    "[email|{name} at {host} dot example dot {top}] {word} {word}",
    "call [phone|({area}) {ex}-{line}] now",
    "phone : [phone|{area}-{ex}-{line}] after six",
    "tel [phone|{area} {ex} {line}] {word}",
    "tel . [phone|0{area} {ex}{line}] {word} {word}",
    "fax [phone|{area}.{ex}.{line}] {word}",
    "{word} {word} [phone|({area}) {ex}-{line}] {word} {word}",
    "[email|{name} (at) {host} (dot) {top}]",
    "{word} {word} [email|{name} (at) {host} (dot) {top}] . {word}",
    "{word} . [email|{name} [at] {host}.{top}] {word}",
    "[email|{name} at {host} dot {top}]",
    "[phone|({area}) {ex}-{line}]",
    "mobile [phone|00{area} {ex} {line} {area}] {word}",
    "card [card|{c}.{c}.{c}.{c}] expires soon",
    "pay with [card|{c}/{c}/{c}/{c}] {word}",
    "visa : [card|{c} . {c} . {c} . {c}] {word}",
    "host [ip|{b} . {b} . {b} . {b}] is down",
    "server at [ip|{b} dot {b} dot {b} dot {b}] {word}",
    "ip [ip|{b} (dot) {b} (dot) {b} (dot) {b}] {word}",
    "{word} [ip|{d} . {d} . {d} . {d}] {word}",
    "{word} {word} [ip|{b} . {b} . {b} . {b}] {word} {word}",
    # lines without personal data
    "{word} at {word} dot {word} {word}",
    "{word} {word} at the {word} , {word} at {word}",
    "on {year}-{m}-{d} the {word} {word}",
    "{word} {d}/{m}/{year} {word}",
    "version {d}.{m}.{d}.{m}{d} of {word}",
    "order {line}{area} , {line} pieces of {ex}",
    "{word} {ex},{area}.{d} {word} {word}",
    "at {d}:{m} {word} {word} , room {ex}",
    "token = \" {hex} \" {word}",
    "{word} | {c}{c}{c}{c} | {word}",
    "pages {ex}-{area} of {year} {word}",
    "{word} @ {word} {word} @ {ex}",
    "isbn {ex}-{d}-{line}-{ex}-{d} {word}",
    "{word} {c}{c} {word} {c}{c}{c}{c} {word}",
    "{word} {d} {m} {d} {word} {ex} {word} {line} {word}",
    "{word} {word} at {word} . {word} {word}",
    "{word} at {word} . {word} at {word} . {word}",
    "{word} {word} dot {word} dot {word} {word}",
    "{word} , {word} {word} . {word} {word} {word} ; {word} {word} : {word} {word}",
    "{word} ( {word} ) {word} [ {word} ] {word} - {word} {word} / {word}",
    "{d} . {word} {word} {d} . {word} {word} {d} . {word}",
    "{word} {word} {d} . {d} . {d} {word} {word}",
    "{word} {hex} {word} {hex} {word} - {word}",
    "{word} = {d} ; {word} = {ex} ; {word} ( {d} , {d} )",
    "< {word} {word} = \" {word} \" > {word} < / {word} >",
    "part {ex}-{line} or {ex}.{d} of {word}",
    "Copyright {year} {word} {word} , {year}-{year}",
)
SLOTS = {
    "name": ("kim", "jo.81", "maria", "sam_w", "tess", "el7", "lee", "anders"), "host": ("mail", "example", "post", "mail7", "work", "inbox"), "top": ("com", "org", "net", "de", "fr"),
    "word": ("the", "river", "green", "der", "immer", "les", "para", "Was", "of", "thing", "una", "Haus"), "area": ("020", "555", "961", "307", "212"), "ex": ("555", "340", "812", "199"),
    "line": ("1234", "7741", "0188", "9076"), "c": ("4532", "0151", "1283", "0366"), "b": ("10", "192", "7", "255", "38"), "year": ("1999", "2014", "2023"), "m": ("04", "11", "30"), "d": ("1", "7", "12"),
    "hex": ("00ff12ab34cd56ef", "c0ffee42", "a1b2c3d4e5f60718"),
}

_TAGS = ("O", *(f"{p}-{k}" for k, p in product(KINDS, "BI")))


#: What lines of plain prose are drawn from, besides words: marks, cue words and numbers that belong to no personal data.
_PROSE = (",", ",", ".", ".", ".\n", ";", ":", "at", "At", "(", ")", "-", "/", "=", '"', "dot", "mail", "call", "host", "card", "{d}", "{ex}", "{year}", "{line}", "***", "$$$", "&&&", "###", "%%%", "!", "!!", "?")


def prose_rows(count: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Lines without personal data: words, and now and then something of _PROSE."""
    rng, rows = np.random.default_rng(seed), []
    plain = [*SLOTS["word"], "x", "lo", "river", "mountains", "understandable", "Thing", "Wonderfully", "être", "straße", "niño"]
    for _ in range(count):
        line, last_at = "", -99
        for k in range(int(rng.integers(20, 45))):
            token = plain[rng.integers(len(plain))]
            if rng.random() < 0.3:
                token = _PROSE[rng.integers(len(_PROSE))]
                if token == "dot" and k - last_at < 8:
                    token = ","
                if token.lower() == "at":
                    last_at = k
                if token[0] == "{":
                    token = SLOTS[token[1:-1]][rng.integers(len(SLOTS[token[1:-1]]))]
            glue = "" if token in ",.;:.\n)***$$$&&&###%%%!!?" and rng.random() < 0.8 else " "
            line += glue + token
        line = line.strip()
        rows.append((line.upper() if rng.random() < 0.15 else line, []))
    return rows


def labelled_rows(copies: int = 3) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The lines of LABELLED, filled in ``copies`` ways, and as many lines of prose: (text, spans)."""
    rows, turn = prose_rows(copies * len(LABELLED)), {k: 0 for k in SLOTS}

    def fill(match: re.Match) -> str:
        slot = match.group(1)
        turn[slot] += 1
        return SLOTS[slot][(turn[slot] * 5 + turn[slot] // len(SLOTS[slot])) % len(SLOTS[slot])]

    for k in range(copies):
        for line in LABELLED:
            filled, text, spans, at = re.sub(r"\{(\w+)\}", fill, line), "", [], 0
            for m in re.finditer(r"\[(email|ip|card|phone)\|((?:[^\[\]]|\[at\]|\[dot\])*)\]", filled):
                text += filled[at : m.start()]
                spans.append((len(text), len(text) + len(m.group(2)), m.group(1)))
                text += m.group(2)
                at = m.end()
            text += filled[at:]
            rows.append((text if k % 2 == 0 else text.replace("call", "Call"), spans))
    return rows


# ------------------------------------------------------------------ tokens and their shapes

_CUES = {"at": "at", "dot": "dot", "tel": "tel", "phone": "tel", "call": "tel", "fax": "tel", "mobile": "tel", "telefon": "tel", "card": "card", "visa": "card", "mail": "mail", "email": "mail", "ip": "ip", "host": "ip", "server": "ip"}
_CUE_KINDS = tuple(dict.fromkeys(_CUES.values()))
_PUNCTUATION = tuple(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Shapes by number: edge, digit runs of 1 to 9 and more, cue words, words by case and length, punctuation, anything else.
SHAPES = ("<>", *(f"d{n}" for n in range(1, 10)), *(f"cue:{c}" for c in _CUE_KINDS), *(f"{c}{n}" for c in "xX" for n in range(5)), *_PUNCTUATION, "other")
_DIGITS, _CUE, _WORD, _MARK, _OTHER = 1, 10, 10 + len(_CUE_KINDS), 20 + len(_CUE_KINDS), len(SHAPES) - 1
_S = len(SHAPES)


@lru_cache(maxsize=1)
def _character_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of the first 65,536 code points: kind (0 space, 1 letter, 2 digit 0-9, 3 other) and whether upper case."""
    chars = [chr(c) for c in range(1 << 16)]
    kind = np.fromiter((_kind(c) for c in chars), np.uint8, 1 << 16)
    return kind, np.fromiter((c.isupper() for c in chars), bool, 1 << 16)


def _kind(c: str) -> int:
    return 2 if "0" <= c <= "9" else 1 if c.isalnum() and not c.isdecimal() else 0 if c.isspace() else 3


@lru_cache(maxsize=1)
def _cue_table() -> tuple[np.ndarray, np.ndarray]:
    keys = np.array([int.from_bytes(w.encode().ljust(8, b"\0"), "little") for w in _CUES], np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([_CUE + _CUE_KINDS.index(k) for k in _CUES.values()])[order]


class Tokens:
    """Tokens of some texts: code-point spans within their text, owner, shape, and whether glued to the one before."""

    __slots__ = ("end", "glued", "owner", "shape", "start")

    def __init__(self, codes: np.ndarray, cuts: np.ndarray):
        """``codes`` are the code points of texts that begin at ``cuts`` (the last cut is the end)."""
        kinds, uppers = _character_tables()
        low = np.minimum(codes, 0xFFFF)
        kind = kinds[low]
        for c in np.unique(codes[codes > 0xFFFF]).tolist():
            kind[codes == c] = _kind(chr(c))
        begins = np.zeros(len(codes) + 1, bool)
        begins[cuts] = True
        open_ = kind > 0
        open_[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 3) | begins[1:-1]
        close = kind > 0
        close[:-1] &= (kind[1:] != kind[:-1]) | (kind[:-1] == 3) | begins[1:-1]
        start, end = np.flatnonzero(open_), np.flatnonzero(close) + 1
        self.owner = np.searchsorted(cuts, start, "right") - 1
        self.glued = np.zeros(len(start), bool)
        self.glued[1:] = (start[1:] == end[:-1]) & (self.owner[1:] == self.owner[:-1])
        size, first = end - start, codes[start]
        of = kind[start]
        shape = np.full(len(start), _OTHER)
        shape[of == 2] = _DIGITS + np.minimum(size[of == 2], 9) - 1
        letters = of == 1
        upper = uppers[np.minimum(first, 0xFFFF)] & (first <= 0xFFFF)
        shape[letters] = _WORD + 5 * upper[letters] + np.minimum(size[letters] // 3, 4)
        marks = (of == 3) & (first < 127)
        mark_of = np.zeros(127, np.int64)
        mark_of[[ord(c) for c in _PUNCTUATION]] = np.arange(len(_PUNCTUATION))
        shape[marks] = _MARK + mark_of[first[marks]]
        short = np.flatnonzero(letters & (size <= 8))
        word = np.zeros(len(short), np.uint64)
        plain = np.ones(len(short), bool)
        for k in range(8):
            has = size[short] > k
            c = codes[np.minimum(start[short] + k, len(codes) - 1)]
            plain &= ~has | (c < 128)
            c = np.where((c >= 65) & (c <= 90), c + 32, c)
            word |= np.where(has, c & 0xFF, 0).astype(np.uint64) << np.uint64(8 * k)
        keys, cue = _cue_table()
        at = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
        hit = plain & (keys[at] == word)
        shape[short[hit]] = cue[at[hit]]
        self.shape = shape
        self.start, self.end = start - cuts[self.owner], end - cuts[self.owner]


def tokens_of(texts: list[str]) -> Tokens:
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    return Tokens(codes, np.cumsum([0, *map(len, texts)]))


# ------------------------------------------------------------------ the field

#: Features of a token: shapes at these places around it, and whether blanks stand on its left and right (l, r).
TEMPLATES = ((), (0,), (0, "l", "r"), (-1, "l"), (1, "r"), (-1, 0), (0, 1), (-2, -1), (1, 2), (-1, 0, 1), (2, 3), (-3, -2))
_WIDTHS = [int(np.prod([2 if isinstance(p, str) else _S for p in t], dtype=np.int64)) for t in TEMPLATES]
_FEATURES = sum(_WIDTHS)


def feature_numbers(tokens: Tokens):
    """The number of each template's feature of every token, template by template."""
    n = len(tokens.owner)
    place = np.arange(n) + 3 * (np.cumsum(np.append(True, tokens.owner[1:] != tokens.owner[:-1])) if n else np.zeros(0, np.int64))
    padded = np.zeros((place[-1] + 4) if n else 0, np.int64)  # three edges before and after each text
    padded[place] = tokens.shape
    right = np.append(tokens.glued[1:], False) if n else tokens.glued
    base = 0
    for template, width in zip(TEMPLATES, _WIDTHS, strict=True):
        number = np.zeros(n, np.int64)
        for p in template:
            number = number * 2 + (tokens.glued if p == "l" else right) if isinstance(p, str) else number * _S + padded[place + p]
        yield base + number
        base += width


class Field:
    """Weights of a linear-chain conditional random field: ``emit`` of the features ``known``, ``move`` between tags."""

    def __init__(self, known: np.ndarray, emit: np.ndarray, move: np.ndarray):
        self.known, self.emit, self.move, self._table = known, emit.astype(np.float32), move.astype(np.float32), None

    def __getstate__(self):
        return {**self.__dict__, "_table": None}

    def scores(self, tokens: Tokens) -> np.ndarray:
        """(tokens, tags) sums of the weights of known features."""
        if self._table is None:
            self._table = np.zeros((_FEATURES, len(_TAGS)), np.float32)
            self._table[self.known] = self.emit
        out = np.zeros((len(tokens.owner), len(_TAGS)), np.float32)
        for number in feature_numbers(tokens):
            out += self._table[number]
        return out

    def stretches(self, score: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, bool, bool]]:
        """Token ranges (start, end, begins a text, ends a text) outside which every best path is "outside" throughout.

        Let m be how much better a token scores outside than with any other tag, D bound what moves between tags can differ
        by, and E what the other tags of a token can. A token of m > 2 D is dull. Were a run of other tags inside dull
        tokens on a best path, outside instead would raise it by the sum of m - D less D > 0. Were a run to cross dull
        tokens of which those on either side of a token sum up to more than 2 D + E, outside up to there would raise it,
        too, even where the run's rest must begin anew. So the path is outside at that token, and may be cut there.
        """
        if not len(owner):
            return []
        allowed = self.move > -1000
        d = float(self.move[allowed].max() - self.move[:, 0].min())
        m = score[:, 0] - score[:, 1:].max(axis=1)
        bound = 2 * d + float((score[:, 1:].max(axis=1) - score[:, 1:].min(axis=1)).max())
        new = np.append(True, owner[1:] != owner[:-1])
        dull = m > 2 * d + 1e-3
        gain = np.where(dull, m - d, 0).astype(float)
        total = np.concatenate([[0.0], np.cumsum(gain)])
        # sums of the dull run up to and from each token
        first = dull & (new | ~np.append(False, dull[:-1]))
        begin = np.maximum.accumulate(np.where(first, np.arange(len(m)), 0))
        last = dull & np.append(new[1:] | ~dull[1:], True)
        stop = np.minimum.accumulate(np.where(last, np.arange(len(m)), len(m))[::-1])[::-1]
        left = total[np.arange(len(m)) + 1] - total[begin]
        right = total[np.minimum(stop + 1, len(m))] - total[np.arange(len(m))]
        cut = dull & (left > bound) & (right > bound)
        edges = np.flatnonzero(np.append(new, True) | np.append(False, cut))
        unread = np.concatenate([[0], np.cumsum(~dull)])
        some = np.flatnonzero(unread[edges[1:]] > unread[edges[:-1]])
        whole = np.append(new, True)
        return [(a, b, bool(whole[a]), bool(whole[b])) for a, b in zip(edges[some].tolist(), edges[some + 1].tolist(), strict=True)]

    def viterbi(self, parts: list[np.ndarray], begins: list[bool] | None = None, ends: list[bool] | None = None, cells: int = 1 << 16) -> list[np.ndarray]:
        """Best tags of sequences, in batches of at most ``cells`` padded tokens (or one sequence).

        One that does not begin its text follows a token outside; one that does not end it ends with a token outside.
        """
        out: list = [None] * len(parts)
        order = sorted((i for i in range(len(parts)) if len(parts[i])), key=lambda i: len(parts[i]))
        while order:
            longest = len(parts[order[-1]])
            batch = order[-max(1, cells // longest) :]
            del order[-len(batch) :]
            paths = self._batch([parts[i] for i in batch], [begins is None or begins[i] for i in batch], [ends is None or ends[i] for i in batch])
            for i, path in zip(batch, paths, strict=True):
                out[i] = path
        return [np.zeros(0, np.int8) if p is None else p for p in out]

    def _batch(self, parts, begins, ends) -> list[np.ndarray]:
        n, tags = len(parts), len(_TAGS)
        length = np.array([len(p) for p in parts])
        longest = int(length.max())
        grid, back = np.zeros((longest, tags, n), np.float32), np.zeros((longest, tags, n), np.int8)
        flat = np.concatenate(parts)
        row, at = np.repeat(np.arange(n), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        grid[at, :, row] = flat
        best = grid[0] + np.where(np.array(begins), self.move[0][:, None], self.move[1][:, None])
        for t in range(1, longest):
            if n < 48:
                options = best[:, None, :] + self.move[1:, :, None]
                back[t] = options.argmax(axis=0)
                new = options.max(axis=0)
            else:  # the same, one tag before at a time
                new, came = best[0] + self.move[1][:, None], back[t]
                for k in range(1, tags):
                    option = best[k] + self.move[k + 1][:, None]
                    better = option > new
                    np.copyto(new, option, where=better)
                    came[better] = k
            best = np.where(t < length, new + grid[t], best)
        tag = np.where(np.array(ends), best.argmax(axis=0), 0)
        path, rows = np.zeros((n, longest), np.int8), np.arange(n)
        for t in range(longest - 1, -1, -1):
            path[:, t] = tag
            tag = np.where(t < length, back[t, tag, rows], tag)
        return [path[i, : length[i]] for i in range(n)]


def _tag_sequence(tokens: Tokens, spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(len(tokens.start), np.int64)
    for i, (a, b) in enumerate(zip(tokens.start.tolist(), tokens.end.tolist(), strict=True)):
        for s, e, kind in spans:
            if s <= a and b <= e:
                out[i] = _TAGS.index(f"{'B' if a == s else 'I'}-{kind}")
    return out


def train_field(rows: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 90, ridge: float = 0.003, rate: float = 0.15) -> Field:
    """Maximum likelihood by Adam over the whole table; forward and backward passes over all lines at once."""
    data = []
    for text, spans in rows:
        tokens = tokens_of([text])
        data.append((np.stack(list(feature_numbers(tokens)), axis=1), _tag_sequence(tokens, spans)))
    known, flat = np.unique(np.concatenate([x.ravel() for x, _ in data]), return_inverse=True)
    flat = flat.ravel().reshape(-1, len(TEMPLATES))
    n, longest, tags = len(data), max(len(y) for _, y in data), len(_TAGS)
    ids, gold, mask, at = np.zeros((n, longest, len(TEMPLATES)), np.int64), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool), 0
    for i, (_, y) in enumerate(data):
        ids[i, : len(y)], gold[i, : len(y)], mask[i, : len(y)] = flat[at : at + len(y)], y, True
        at += len(y)
    emit, move = np.zeros((len(known), tags)), np.zeros((tags + 1, tags))  # row 0 of move: the first tag
    # a tag I-k follows B-k or I-k only
    banned = np.array([[t.startswith("I-") and s[2:] != t[2:] for t in _TAGS] for s in ("^", *_TAGS)])
    moments = [np.zeros_like(x) for x in (emit, emit, move, move)]
    last = mask.sum(1) - 1
    for step in range(1, rounds + 1):
        m = np.where(banned, -1e4, move)
        score = emit[ids].sum(2) * mask[..., None]
        alpha = np.zeros((n, longest, tags))
        alpha[:, 0] = m[0] + score[:, 0]
        for t in range(1, longest):
            x = alpha[:, t - 1, :, None] + m[1:][None]
            top = x.max(1)
            new = top + np.log(np.exp(x - top[:, None]).sum(1)) + score[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        beta = np.zeros((n, longest, tags))
        for t in range(longest - 2, -1, -1):
            x = m[1:][None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :]
            top = x.max(2)
            new = top + np.log(np.exp(x - top[..., None]).sum(2))
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
        final = alpha[np.arange(n), last]
        top = final.max(1, keepdims=True)
        z = (top[:, 0] + np.log(np.exp(final - top).sum(1)))[:, None]
        marginal = np.exp(alpha + beta - z[..., None]) * mask[..., None]
        delta = marginal.copy()
        rows_, cols = np.nonzero(mask)
        delta[rows_, cols, gold[rows_, cols]] -= 1
        where, slopes = ids[rows_, cols].ravel(), delta[rows_, cols]
        g_emit = np.stack([np.bincount(where, np.repeat(slopes[:, k], len(TEMPLATES)), len(known)) for k in range(tags)], axis=1)
        g_move = np.zeros_like(move)
        g_move[0] = delta[:, 0].sum(0)
        for t in range(1, longest):
            live = mask[:, t]
            pair = np.exp(alpha[live, t - 1, :, None] + m[1:][None] + (score[live, t] + beta[live, t])[:, None, :] - z[live][..., None])
            g_move[1:] += pair.sum(0)
            np.add.at(g_move, (gold[live, t - 1] + 1, gold[live, t]), -1)
        for k, (weight, slope) in enumerate(((emit, g_emit + ridge * emit), (move, g_move + ridge * move))):
            first, second = moments[2 * k], moments[2 * k + 1]
            first += 0.1 * (slope - first)
            second += 0.01 * (slope**2 - second)
            weight -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(known, emit, np.where(banned, -1e4, move))


@lru_cache(maxsize=2)
def default_field(copies: int = 3) -> Field:
    return train_field(labelled_rows(copies))


# ------------------------------------------------------------------ spans of texts

def plausible(kind: str, text: str) -> bool:
    """Checks of a decoded span: what any writing of the kind must hold."""
    if kind == "email":
        return re.search(r"(?:@|\bat\b).*(?:\.|\bdot\b)", text, re.IGNORECASE | re.DOTALL) is not None
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return valid(kind, text)


def decoded_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, str]]]:
    """Spans of the best path over all tokens of each text."""
    out: list[list] = [[] for _ in texts]
    tokens = tokens_of(texts)
    score = field.scores(tokens)
    parts = field.stretches(score, tokens.owner)
    paths = field.viterbi([score[a:b] for a, b, _, _ in parts], [x for *_, x, _ in parts], [x for *_, x in parts])
    for (a, _, _, _), path in zip(parts, paths, strict=True):
        for i in np.flatnonzero(path % 2 == 1).tolist():  # odd tags begin a span
            j = i + 1
            while j < len(path) and path[j] == path[i] + 1:
                j += 1
            out[int(tokens.owner[a + i])].append((int(tokens.start[a + i]), int(tokens.end[a + j - 1]), _TAGS[path[i]][2:]))
    return out


def find_spans(texts: list[str], field: Field, chars: int = 1 << 20) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; texts are decoded in slices of about ``chars`` characters."""
    out, lo = [], 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= chars):
            size += len(texts[hi] or "")
            hi += 1
        part = [t or "" for t in texts[lo:hi]]
        for text, more in zip(part, decoded_spans(part, field), strict=True):
            base = base_spans(text)
            taken = sorted((a, b) for a, b, _ in base)
            reach = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0, np.int64)
            begins = np.array([a for a, _ in taken], np.int64)
            good = []
            for a, b, kind in more:  # apart from base spans: those that begin before its end all end before it
                k = int(np.searchsorted(begins, b))
                if (k == 0 or reach[k - 1] <= a) and plausible(kind, text[a:b]):
                    good.append((a, b, kind))
            out.append((base, sorted([*base, *good], key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if good else base))
        lo = hi
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def spans_column(docs: DataFrame, column: str, field: Field | None = None) -> DataFrame:
    """``docs`` with a struct (base, spans) of span strings of its whole ``text``."""
    model = docs.sparkSession.sparkContext.broadcast(field or default_field())  # a few thousand features

    @arrow_udf("base string, spans string")
    def spans(texts: pa.Array) -> pa.Array:
        found = find_spans(texts.to_pylist(), model.value)
        base, all_ = [joined(b) for b, _ in found], [joined(s) for _, s in found]
        return pa.StructArray.from_arrays([pa.array(base, pa.string()), pa.array(all_, pa.string())], ["base", "spans"])

    return docs.withColumn(column, spans(F.col("text")))


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; other columns as they came."""
    model = docs.sparkSession.sparkContext.broadcast(field or default_field())

    @arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for i, (_, spans) in enumerate(find_spans(out, model.value)):
            if spans:
                out[i] = replace_spans(out[i], spans)
        return pa.array(out, pa.string())

    return docs.withColumn("text", clean(F.col("text")))


def replace_spans(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Overlapping spans are replaced as one, by the kind of the first."""
    parts, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            parts += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def pii_report(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans of every document."""
    found = spans_column(docs.select("doc_id", "text"), "_f", field).select("doc_id", "_f.base", "_f.spans")
    parts = F.split("base", ",")
    counts = [_count(parts, k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def _count(parts, kind: str):
    return F.size(F.filter(parts, lambda x: x.startswith(kind + ":"))).cast("long")


def sha_of(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
