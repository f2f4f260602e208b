"""Sets of hashed word shingles of whole texts, with numpy.

Words are runs of bytes other than ASCII white space after lowering A-Z; a
text with at least :data:`WORDS` words has its distinct runs of that many
words as its set, a shorter one its whole sequence as one element, a text
without words the empty set. Elements are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
SEGMENT = 1 << 18          # bytes that are hashed at once (a longer word: that word)
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                     0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_LENGTH = np.uint64(0x1D8E4E27C47D124F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        for i, base in enumerate((_R, _R_INVERSE)):
            table = np.full(n + 1, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][:n + 1], _powers[1][:n + 1]


def _segment_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of one piece."""
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(
        (data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], dtype=np.uint64)))
    return starts, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of lower-cased bytes, a bounded piece at a time."""
    buffer = np.frombuffer(data, np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(buffer):
        end = min(at + SEGMENT, len(buffer))
        while end < len(buffer) and not _SPACE[buffer[end]]:
            rest = np.flatnonzero(_SPACE[buffer[end:end + SEGMENT]])
            end = end + int(rest[0]) if len(rest) else min(end + SEGMENT, len(buffer))
        s, h = _segment_words(buffer[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (
        np.empty(0, np.int64), np.empty(0, np.uint64))


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(elements of all sets one after another, each sorted; size of each set)."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    starts, words = word_hashes(b"\n".join(raw))
    doc = np.searchsorted(ends, starts, side="right")
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    out, sizes = [], np.zeros(len(texts), np.int64)
    total = np.zeros(len(words), np.uint64)
    for j in range(min(WORDS, len(words))):
        total[:len(words) - j] += words[j:] * _FACTORS[j]
    total = mix(total + np.uint64(WORDS) * _LENGTH)
    for i, (a, n) in enumerate(zip(first.tolist(), n_words.tolist(), strict=True)):
        if n >= WORDS:
            elements = np.sort(total[a:a + n - WORDS + 1])
            elements = elements[np.concatenate(([True], elements[1:] != elements[:-1]))]
        elif n:
            whole = (words[a:a + n] * _FACTORS[:n]).sum(dtype=np.uint64, keepdims=True)
            elements = mix(whole + np.array([n], np.uint64) * _LENGTH)
        else:
            continue
        out.append(elements)
        sizes[i] = len(elements)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), sizes
