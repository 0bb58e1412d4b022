"""Vectorised statistics of whole texts: words, character classes, repeated lines and passages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from dirlake.llm.common import utf8

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Character classes of a code point, told by its first byte; a continuation byte has none.
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "quote", "dash", "shout", "symbol", "pipe", "bracket", "other_ascii", "latin", "wide", "control")
_CLASS = np.full(256, CLASSES.index("other_ascii"), np.int64)
_CLASS[:32] = _CLASS[127] = CLASSES.index("control")
for _name, _chars in {"lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": b"0123456789", "space": b" \t\x0b\x0c\r", "newline": b"\n", "stop": b".,;:", "quote": b"'\"`", "dash": b"-_", "shout": b"!?", "symbol": b"#*$%&<>", "pipe": b"|", "bracket": b"()[]{}"}.items():
    _CLASS[list(_chars)] = CLASSES.index(_name)
_CLASS[0xC0:0xD0] = CLASSES.index("latin")
_CLASS[0xD0:] = CLASSES.index("wide")
_CLASS[0x80:0xC0] = len(CLASSES)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the odd hash base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[k] = np.multiply.accumulate(factors)
    return _POWERS


@dataclass
class Texts:
    """Some texts as one byte array: where words start and end, and prefix sums that give any span's hash."""

    raw: np.ndarray
    ends: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    doc: np.ndarray
    n_words: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, lower: bool = False) -> Texts:
        raw, ends = utf8(texts)
        space = _SPACE[raw]
        opened = np.empty(len(raw) + 1, bool)
        opened[0] = opened[-1] = True
        opened[1:-1] = space[:-1]
        opened[ends] = True
        starts = np.flatnonzero(~space & opened[:-1])
        closed = np.append(space[1:], True) if len(raw) else space
        if len(raw):
            closed[ends[(ends > 0)] - 1] = True
        stops = np.flatnonzero(~space & closed) + 1
        first = np.searchsorted(starts, ends)
        n_words = np.diff(first)
        power, _ = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[raw] if lower else raw] * power[: len(raw)], out=sums[1:])
        return cls(raw, ends, starts, stops, np.repeat(np.arange(len(n_words)), n_words), n_words, sums)

    def hashes(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        _, inverse = _powers(len(self.raw) + 1)
        return mix((self.sums[stops] - self.sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.stops)


def count_words(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words of each text, without the hashes."""
    space = _SPACE[raw]
    opened = np.empty(len(raw) + 1, bool)
    opened[0] = True
    opened[1:] = space
    opened[ends] = True
    return _per_text(~space & opened[:-1], ends)


def windows(words: np.ndarray, n_words: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` words inside a text, and the position of each window's first word."""
    if len(words) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        h = h * np.uint64(_BASE) + words[j : len(words) - width + 1 + j]
    last = np.repeat(np.cumsum(n_words), n_words)[: len(h)]
    at = np.flatnonzero(np.arange(len(h)) + width <= last)
    return mix(h[at]), at


def _salted(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(h + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def repeated_words(t: Texts, words: np.ndarray, width: int = 5) -> np.ndarray:
    """For each text, how many words stand in a window of `width` words that the text has twice or more."""
    h, at = windows(words, t.n_words, width)
    if not len(h):
        return np.zeros(len(t.n_words), np.int64)
    h = _salted(h, t.doc[at])
    ranked = np.sort(h)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return np.zeros(len(t.n_words), np.int64)
    where = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    at = at[twice[where] == h]
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(t.doc[covered], minlength=len(t.n_words))


def repeated_lines(t: Texts) -> np.ndarray:
    """For each text, how many of its \\n-split lines have a word and equal an earlier line."""
    n = len(t.n_words)
    breaks = np.flatnonzero(t.raw == 10)
    starts = np.unique(np.concatenate([breaks + 1, t.ends[:-1]]))
    starts = starts[starts < len(t.raw)]
    if not len(starts):
        return np.zeros(n, np.int64)
    stops = np.append(starts[1:], len(t.raw))
    ended = t.raw[stops - 1] == 10
    stops = stops - ended
    worded = np.searchsorted(t.starts, stops) > np.searchsorted(t.starts, starts)
    starts, stops = starts[worded], stops[worded]
    doc = np.searchsorted(t.ends, starts, "right") - 1
    h = _salted(t.hashes(starts, stops), doc)
    _, first = np.unique(h, return_index=True)
    return np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)


def class_counts(t: Texts) -> np.ndarray:
    """Code points of each character class, a row for each text."""
    n, k = len(t.n_words), len(CLASSES) + 1
    at = np.repeat(np.arange(n, dtype=np.int64) * k, np.diff(t.ends))
    at += _CLASS[t.raw]
    return np.bincount(at, minlength=n * k).reshape(n, k)[:, :-1]


def symbol_counts(t: Texts) -> np.ndarray:
    return _per_text(_SYMBOL[t.raw], t.ends)


def word_chars(t: Texts) -> np.ndarray:
    return _per_text(~_SPACE[t.raw] & ((t.raw & 0xC0) != 0x80), t.ends)


def _per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[ends])
