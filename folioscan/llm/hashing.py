"""Hashes of words and of runs of words, in numpy, for whole columns of texts at once.

A word's hash is a polynomial over its bytes, mixed: with running sums over all bytes of a column, every word costs two
look-ups however long it is. SEEDS independent polynomials give as many independent hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FACTOR, A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S30, S27, S31 = np.uint64(30), np.uint64(27), np.uint64(31)
#: Bytes that are hashed at once.
CHUNK = 1 << 19
SEEDS = 2
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of the splitmix64 generator: a bijection in which every bit depends on every bit."""
    x = x + FACTOR
    x = (x ^ (x >> S30)) * A
    x = (x ^ (x >> S27)) * B
    return x ^ (x >> S31)


class Polynomial:
    """Values of bytes, and the powers of an odd base and of its inverse modulo 2**64 for CHUNK places."""

    def __init__(self, seed: int):
        self.value = mix(np.arange(256, dtype=np.uint64) * FACTOR + np.uint64(seed))
        self.folded = self.value.copy()
        self.folded[0x41:0x5B] = self.value[0x61:0x7B]
        self.base = int(mix(np.array([seed + 1000], np.uint64))[0]) | 3
        self.up = self._powers(self.base)
        self.down = self._powers(pow(self.base, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(CHUNK + 1, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, data: np.ndarray, lower: bool) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.folded if lower else self.value)[data] * self.up[: len(data)], out=out[1:])
        return out

    def long_word(self, data: np.ndarray, lower: bool) -> np.uint64:
        """A word beyond CHUNK bytes, piece by piece."""
        total, step = 0, pow(self.base, CHUNK, 1 << 64)
        for at in reversed(range(0, len(data), CHUNK)):
            total = (total * step + int(self.sums(data[at : at + CHUNK], lower)[-1])) & 0xFFFFFFFFFFFFFFFF
        return np.uint64(total)


_polynomials: list[Polynomial] = []


def polynomials(n: int) -> list[Polynomial]:
    while len(_polynomials) < n:
        _polynomials.append(Polynomial(len(_polynomials)))
    return _polynomials[:n]


class Words(NamedTuple):
    """Words of rows first, first + 1, ...: their hashes by seed, one after another, and where each row's begin (and end).

    With spans, start and end are the byte places of each word in its row's text.
    """

    first: int
    hashes: list[np.ndarray]
    offsets: np.ndarray
    start: np.ndarray | None = None
    end: np.ndarray | None = None


def _edges(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of words and places behind them; rows has the first place of every row, where a word ends too."""
    blank = BLANK[data]
    opens, closes = ~blank, ~blank
    opens[1:] &= blank[:-1]
    closes[:-1] &= blank[1:]
    inner = rows[(rows > 0) & (rows < len(data))]
    opens[inner] = ~blank[inner]
    closes[inner - 1] = ~blank[inner - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _hashed(data: np.ndarray, rows: np.ndarray, lower: bool, seeds: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes by seed, first places and ends of the words of CHUNK bytes at most."""
    start, end = _edges(data, rows)
    out = []
    for p in polynomials(seeds):
        s = p.sums(data, lower)
        out.append(mix((s[end] - s[start]) * p.down[start]))
    return out, start, end


def _long_row(data: np.ndarray, lower: bool, seeds: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """As _hashed, for one text of any length: cut at blanks, a word longer than CHUNK piece by piece."""
    blanks = np.flatnonzero(BLANK[data])
    parts, at, none = [], 0, np.zeros(0, np.int64)
    while at < len(data):
        k = np.searchsorted(blanks, at + CHUNK) - 1
        if len(data) - at <= CHUNK:
            to = len(data)
        elif k >= 0 and blanks[k] >= at:
            to = int(blanks[k]) + 1
        else:
            to = int(blanks[k + 1]) if k + 1 < len(blanks) else len(data)
            parts.append(([mix(np.array([p.long_word(data[at:to], lower)])) for p in polynomials(seeds)], np.array([at]), np.array([to])))
            at = to
            continue
        h, start, end = _hashed(data[at:to], none, lower, seeds)
        parts.append((h, start + at, end + at))
        at = to
    return [np.concatenate([p[0][s] for p in parts]) for s in range(seeds)], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def words_of(texts: pa.Array, lower: bool = False, seeds: int = 1, spans: bool = False) -> Iterator[Words]:
    """Words of a column of texts, some rows at a time; a null text has none. lower folds A-Z alone. Words are parted
    by U+0020 and U+0009 to U+000D."""
    own = texts.cast(pa.large_binary()) if pa.types.is_binary(texts.type) else texts.cast(pa.large_string())
    own = pa.concat_arrays([own.fill_null(b"" if pa.types.is_large_binary(own.type) else "")])
    edges = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1, own.offset * 8)
    data = np.frombuffer(own.buffers()[2], np.uint8) if own.buffers()[2] is not None and edges[-1] > edges[0] else np.zeros(0, np.uint8)
    row = 0
    while row < len(own):
        to = max(row + 1, int(np.searchsorted(edges, edges[row] + CHUNK, "right")) - 1)
        part, rows = data[edges[row] : edges[to]], edges[row : to + 1] - edges[row]
        if len(part) > CHUNK:
            h, start, end = _long_row(part, lower, seeds)
        else:
            h, start, end = _hashed(part, rows[1:-1], lower, seeds)
        offsets = np.searchsorted(start, rows)
        if spans:
            base = np.repeat(rows[:-1], np.diff(offsets))
            yield Words(row, h, offsets, start - base, end - base)
        else:
            yield Words(row, h, offsets)
        row = to


def places(of: np.ndarray) -> np.ndarray:
    """0, 1, ... for each text, of of them for each."""
    return np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of)


class Coded(NamedTuple):
    """Words of some rows by codes: the rows' first row, each word's code (the last code is a row's end), the distinct words,
    lower-cased, and where each row's words begin, its end counted."""

    first: int
    code: np.ndarray
    words: list[bytes]
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def coded(texts: pa.Array, size: int) -> Iterator[Coded]:
    """Lower-cased words of a column of texts, rows of size bytes at a time; Python meets each distinct word of these rows once.

    Arrow parts texts by the same blanks as BLANK and folds A-Z alone; blanks at the ends of a text make empty words there,
    which are left out.
    """
    own = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    edges = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1, own.offset * 8)
    row = 0
    while row < len(own):
        to = max(row + 1, int(np.searchsorted(edges, edges[row] + size, "right")) - 1)
        parts = pc.ascii_split_whitespace(pc.ascii_lower(own.slice(row, to - row)))
        found = parts.flatten().dictionary_encode()
        code, kept = found.indices.to_numpy(), np.diff(parts.offsets.to_numpy())
        each = found.dictionary
        at = np.frombuffer(each.buffers()[1], np.int64, len(each) + 1, each.offset * 8).tolist()
        data = each.buffers()[2].to_pybytes() if at[-1] else b""
        words = [data[a:e] for a, e in zip(at, at[1:], strict=False)]
        if b"" in words:
            none = words.index(b"")
            live = code != none
            kept = np.diff(np.concatenate(([0], np.cumsum(live)))[np.concatenate(([0], np.cumsum(kept)))])
            code = code[live]
            code = code - (code > none)
            del words[none]
        ends = np.cumsum(kept)
        yield Coded(row, np.insert(code.astype(np.int64), ends, len(words)), words, np.concatenate(([0], ends)) + np.arange(len(kept) + 1))
        row = to


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of size words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(size))
    for j in range(size):
        out = out * A + h[j : n + j]
    return mix(out)


def shingle_set(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of size words; of the whole sequence if it is shorter; none of no words."""
    return np.unique(run_hashes(h, min(size, len(h)))) if len(h) else np.empty(0, np.uint64)


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """The hash of each word of one text."""
    found = list(words_of(pa.array([text], pa.string()), lower))
    return found[0].hashes[0] if found else np.empty(0, np.uint64)
