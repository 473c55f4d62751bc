"""Words of flattened UTF-8 texts as positions and hashes, in numpy."""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the running hash, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2 ** 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Characters other than space and \t..\r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, lower-case a-z and all characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the words, which end where a document does."""
    word = is_word[data]
    change = np.empty(len(data) + 1, bool)
    change[0], change[-1] = True, True
    np.not_equal(word[1:], word[:-1], out=change[1:-1])
    change[offsets] = True
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    full = word[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n, kept for the next batch."""
    known = _POWERS.get(str(base))
    if known is None or len(known) < n:
        size = max(n, 1 << 20)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.cumprod(known)
        _POWERS[str(base)] = known
    return known[:n]


def running_hashes(data: np.ndarray):
    """A function (starts, ends) -> 64-bit hashes of these spans, from one running sum."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), _BASE), out=total[1:])
    inverse = _powers(len(data) + 1, _INVERSE)

    def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((total[ends] - total[starts]) * inverse[starts])
    return spans


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from differences of one running sum."""
    return running_hashes(data)(starts, ends)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` consecutive words; one for each position that has so many after it."""
    n = max(len(words) - width + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(_BASE) + words[k:k + n]
    return mixed(h + np.uint64(width))
