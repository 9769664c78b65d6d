"""Recompression of word sequences: rounds that name runs and pairs by content.

A word's name is a hash of its bytes. A run round names every maximal run of one symbol; a pair round splits all symbols into
left and right by a hash of their names and names each left symbol followed by a right one. Names depend on content
alone, so all texts everywhere give equal substrings equal symbols, but for a few at their edges.

How far "but for a few" reaches is carried along: [lo, hi) are the words that decide that a symbol stands where it stands.
If a window of words holds a symbol with [lo, hi) inside, every equal window holds it at the same place.
"""

from __future__ import annotations

import numpy as np

PAIR_ROUNDS = 5
RUN_ROUNDS = (0, 3)  # the pair rounds that a run round goes before
FAR = 1 << 40
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit of the input counts."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** k and its inverse modulo 2 ** 64, for k below n rounded up to a power of two."""
    size = 1 << max(16, (n - 1).bit_length())
    if (base, size) not in _POWERS:
        for old in [k for k in _POWERS if k[0] == base]:
            del _POWERS[old]

        def ladder(b: int) -> np.ndarray:
            out = np.ones(size, dtype=np.uint64)
            done, step = 1, b
            while done < size:
                out[done:2 * done] = out[:done] * np.uint64(step)
                done, step = 2 * done, step * step % (1 << 64)
            return out

        _POWERS[base, size] = ladder(base), ladder(pow(base, -1, 1 << 64))
    return _POWERS[base, size]


BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def words_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in a byte array."""
    edge = np.diff(np.concatenate([[True], _BLANK[data], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit names of the words data[starts:ends]; `which` picks one of two independent namings."""
    up, down = powers(BASES[which], len(data) + 1)
    letters = mix(np.arange(1, 257, dtype=np.uint64) * _M1 + np.uint64(which))[data]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * up[:len(data)])])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M1)


def window_names(names: np.ndarray, size: int, at: np.ndarray, which: int) -> np.ndarray:
    """Names of the windows of `size` words that start at `at`."""
    up, down = powers(BASES[which], len(names) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(names * up[:len(names)])])
    return mix((total[at + size] - total[at]) * down[at])


def symbols(names: np.ndarray, text: np.ndarray, pair_rounds: int = PAIR_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, text, lo, hi) of the symbols after all rounds.

    names: one per word, texts one after the other; text: the number of each word's text, rising. lo and hi count words from
    the start of `names`; a symbol that a text's own edge decides reaches far outside.
    """
    lo = np.arange(len(names), dtype=np.int64)
    hi = lo + 1
    for number in range(pair_rounds):
        if number in RUN_ROUNDS:
            names, text, lo, hi = _runs(names, text, lo, hi, number)
        names, text, lo, hi = _pairs(names, text, lo, hi, number)
    return names, text, lo, hi


def _neighbours(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lo of the symbol before and hi of the one after, far away where the text ends."""
    same = text[1:] == text[:-1]
    before, after = np.full(len(lo), -FAR), np.full(len(hi), FAR)
    before[1:] = np.where(same, lo[:-1], -FAR)
    after[:-1] = np.where(same, hi[1:], FAR)
    return before, after


def _runs(names, text, lo, hi, number):
    if not len(names):
        return names, text, lo, hi
    before, after = _neighbours(text, lo, hi)
    first = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([first[1:], [len(names)]]) - 1
    length = (last - first + 1).astype(np.uint64)
    named = np.where(length > 1, mix(names[first] ^ (length * _M1 + np.uint64(number))), names[first])
    return named, text[first], np.minimum(lo[first], before[first]), np.maximum(hi[last], after[last])


def _pairs(names, text, lo, hi, number):
    if not len(names):
        return names, text, lo, hi
    left = (mix(names + np.uint64((number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(1)).astype(bool)
    pair = np.zeros(len(names), dtype=bool)
    pair[:-1] = left[:-1] & ~left[1:] & (text[1:] == text[:-1])
    taken = np.zeros(len(names), dtype=bool)
    taken[1:] = pair[:-1]
    before, after = _neighbours(text, lo, hi)
    new_lo = np.where(pair | left, lo, np.minimum(lo, before))
    new_hi = np.where(pair, np.maximum(hi, after), np.where(left, np.maximum(hi, after), hi))
    named = names.copy()
    at = np.flatnonzero(pair)
    named[at] = mix(names[at] * _M1 + mix(names[at + 1]) + np.uint64(number))
    # The right symbol of a pair may have been decided by more words to its left than its own first.
    new_lo[at] = np.minimum(lo[at], lo[at + 1])
    stay = ~taken
    return named[stay], text[stay], new_lo[stay], new_hi[stay]
