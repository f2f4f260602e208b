"""Ids of whole texts from ids of distinct words.

Where a tokenizer never joins symbols across white space, a text's ids are
its words' ids one after the other. :class:`WordIds` encodes each distinct
word once per worker and gathers texts from that table with numpy; Arrow
splits the texts and finds the distinct words of a slice.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from .common import ragged

# Bytes that a worker's table of distinct words may take; beyond it the table
# starts anew. It bounds memory only: ids do not depend on it.
MAX_TABLE = 96 << 20
WORD_BYTES = 150           # of a word besides its text: string and dict entry, length, start


class _Codes(dict):
    def __missing__(self, word):
        code = self[word] = len(self)
        return code


class WordIds:
    """``encode_words(list of words) -> (flat ids, length of each)``."""

    def __init__(self, encode_words: Callable, dtype, max_bytes: int = MAX_TABLE):
        self._encode, self._dtype, self._max = encode_words, dtype, max_bytes
        self._reset()

    def _reset(self) -> None:
        self._codes = _Codes()
        self._flat = np.empty(0, self._dtype)
        self._lengths = np.empty(0, np.int32)
        self._starts = np.empty(0, np.int64)
        self._bytes = 0

    def texts(self, texts: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each text) of texts given as lists of words."""
        if self._bytes > self._max:
            self._reset()
        words = texts.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        known = len(self._codes)
        codes = np.fromiter(map(self._codes.__getitem__, distinct), np.int64, len(distinct))
        new = [distinct[i] for i in np.flatnonzero(codes >= known)]
        if new:
            flat, lengths = self._encode(new)
            self._bytes += WORD_BYTES * len(new) + sum(map(len, new)) + flat.size * self._flat.itemsize
            self._flat = np.concatenate([self._flat, flat.astype(self._dtype)])
            self._lengths = np.concatenate([self._lengths, lengths.astype(np.int32)])
            self._starts = np.cumsum(self._lengths, dtype=np.int64) - self._lengths
        codes = codes[words.indices.to_numpy()]
        lengths = self._lengths[codes].astype(np.int64)
        ids = self._flat[ragged(self._starts[codes], lengths)]
        ends = texts.offsets.to_numpy().astype(np.int64)
        total = np.concatenate(([0], np.cumsum(lengths)))[ends - ends[0]]
        return ids, np.diff(total)


def chunks(texts: list[str | None], chars: int = 8 << 20):
    """Slices of a list of texts of about ``chars`` characters each (a longer
    text is a slice of its own)."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > at and size + n > chars:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def text_slices(column: pa.Array, chars: int = 2 << 20):
    """``a, b, texts`` (null: empty) of slices of a string column of about ``chars``
    bytes each; only one slice at a time is Python strings."""
    sizes = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, total[a] + chars, side="right")) - 1)
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]
        a = b
