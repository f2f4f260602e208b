"""Hierarchical packing into sequences of several lengths (operator 11).

Context sizes are tiers: powers of two from ``SHORTEST`` to the longest
window. A document gives as many full windows as it has, and its rest goes
to the shortest tier that holds it. Tiers are packed from the longest down:
each document of a tier opens a sequence of that size, and the gap it leaves
is filled from the shorter tiers, always with the longest piece that fits. If
none fits, the next longer one is cut there and its rest goes back to a tier.
So every sequence is full. The one where the documents run out is split by
the binary digits of its length into shorter sequences, each a power of two
again: nothing is padded.

Sequences are then dealt to step groups, the costliest (by the sum of squared
piece lengths, which is what attention costs) to the group with the least,
so that the steps of a training run weigh alike.

The scan's own partitions are packed where they are read, a buffer of about
``BUFFER_TOKENS`` ids at a time: no text is shuffled, memory is bounded by
the buffer and the longest document, and a source or document of any
weight is cut like all others. A task that is run again gives the same rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged
from .token_files import encoder, special_pattern, split_words
from .words import text_slices

SHORTEST = 256             # the shortest tier that documents are routed to
BUFFER_TOKENS = 2_000_000  # ids that a task packs at once
SLICE_CHARS = 4 << 20      # of texts whose distinct words are looked up at once
PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long, step_group long")


def tiers(window: int, shortest: int = SHORTEST) -> list[int]:
    """Context sizes from the longest down, each half of the one before."""
    out = [window]
    while out[-1] > shortest and out[-1] % 2 == 0:
        out.append(out[-1] // 2)
    return out


class _Rests:
    """Pieces that wait for a place, by length; the longest of at most, or the
    shortest of more than, a given length is found in a bit set."""

    def __init__(self):
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.lengths = 0

    def put(self, doc: int, start: int, length: int) -> None:
        self.by_length.setdefault(length, []).append((doc, start))
        self.lengths |= 1 << length

    def take(self, length: int) -> tuple[int, int]:
        waiting = self.by_length[length]
        piece = waiting.pop()
        if not waiting:
            del self.by_length[length]
            self.lengths ^= 1 << length
        return piece

    def longest(self, most: int) -> int:
        """0 if there is none."""
        return (self.lengths & ((2 << most) - 1)).bit_length() - 1 if self.lengths & ((2 << most) - 1) else 0

    def shortest_above(self, length: int) -> int:
        above = self.lengths >> (length + 1)
        return length + (above & -above).bit_length() if above else 0


def pack(lengths: list[int], window: int, shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every token of
    documents of these lengths once. All are full: the window, a tier, or at
    the end a smaller power of two."""
    done: list[list[tuple[int, int, int]]] = []
    rests = _Rests()
    for doc, length in enumerate(lengths):
        whole = length - length % window
        done += [[(doc, at, window)] for at in range(0, whole, window)]
        if length > whole:
            rests.put(doc, whole, length - whole)
    sizes = tiers(window, shortest)
    for size, below in zip(sizes, [*sizes[1:], 0], strict=True):
        while (length := rests.longest(size)) > below:
            doc, start = rests.take(length)
            row, gap = [(doc, start, length)], size - length
            while gap and rests.lengths:
                if length := rests.longest(gap):
                    doc, start = rests.take(length)
                    row.append((doc, start, length))
                    gap -= length
                else:
                    length = rests.shortest_above(gap)
                    doc, start = rests.take(length)
                    row.append((doc, start, gap))
                    rests.put(doc, start + gap, length - gap)
                    gap = 0
            done += _digits(row) if gap else [row]
    return done


def _digits(row: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence cut into ones whose lengths are the binary digits of its own."""
    total = sum(n for _, _, n in row)
    out, waiting = [], row[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        gap = total & (1 << bit)
        if not gap:
            continue
        part = []
        while gap:
            doc, start, length = waiting.pop()
            n = min(length, gap)
            part.append((doc, start, n))
            if n < length:
                waiting.append((doc, start + n, length - n))
            gap -= n
        out.append(part)
    return out


def balance(sequences: list[list[tuple[int, int, int]]], step_tokens: int) -> list[int]:
    """A step group per sequence: as many groups as whole steps fit, the
    costliest sequence next to the group of least cost."""
    tokens = sum(n for row in sequences for _, _, n in row)
    load = [(0, g) for g in range(max(1, round(tokens / step_tokens)))]
    cost = [sum(n * n for _, _, n in row) for row in sequences]
    group = [0] * len(sequences)
    for i in sorted(range(len(sequences)), key=lambda i: (-cost[i], i)):
        spent, g = heapq.heappop(load)
        group[i] = g
        heapq.heappush(load, (spent + cost[i], g))
    return group


class _Buffer:
    """Encoded documents of a task that are packed together."""

    def __init__(self, window: int, step_tokens: int):
        self.window, self.step_tokens = window, step_tokens
        self.base = TaskContext.get().partitionId() << 40
        self.sequences = self.groups = 0
        self._empty()

    def _empty(self) -> None:
        self.docs: list[pa.Array] = []
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.waiting = 0

    def add(self, docs: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs.append(docs)
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.waiting += len(ids)

    def rows(self) -> pa.RecordBatch:
        docs, ids, lengths = pa.concat_arrays(self.docs), np.concatenate(self.ids), np.concatenate(self.lengths)
        self._empty()
        sequences = pack(lengths.tolist(), self.window)
        groups = np.array(balance(sequences, self.step_tokens), np.int64)
        doc, start, length = np.array([p for row in sequences for p in row], np.int64).reshape(-1, 3).T
        of = np.repeat(np.arange(len(sequences)), [len(row) for row in sequences])
        ends = np.cumsum(length)
        tokens = np.bincount(of, length, len(sequences)).astype(np.int64)
        offset = (ends - length) - (np.cumsum(tokens) - tokens)[of]
        flat = ids[ragged((np.cumsum(lengths) - lengths)[doc] + start, length)].astype("<u4")
        binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [
            None, pa.py_buffer(np.concatenate(([0], ends)) * 4), pa.py_buffer(flat)]).cast(pa.binary())
        rows = pa.record_batch([
            docs.take(pa.array(doc)), pa.array(start), pa.array(length), binary, pa.array(lengths[doc]),
            pa.array(self.base + self.sequences + of), pa.array(offset), pa.array(tokens[of]),
            pa.array(self.base + self.groups + groups[of])],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens",
                   "step_group"])
        self.sequences += len(sequences)
        self.groups += int(groups.max()) + 1
        return rows


def _packer(tokenizer: str, end_id: int, window: int, step_tokens: int, special_in_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = encoder(tokenizer)
        special = special_pattern(tokenizer) if special_in_text else None
        buffer = _Buffer(window, step_tokens)
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text"), SLICE_CHARS):
                ids, lengths = words.texts(split_words(texts, special))
                buffer.add(batch.column("doc_id").slice(a, b - a), np.insert(ids, np.cumsum(lengths), end_id),
                           lengths + 1)
                if buffer.waiting >= BUFFER_TOKENS:
                    yield buffer.rows()
        if buffer.waiting:
            yield buffer.rows()
    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, step_tokens: int = 64 * 2048,
                   id_col: str = "doc_id", text_col: str = "text", special_in_text: bool = False) -> DataFrame:
    """A row per piece: ``doc_id, start`` (ids of the document before it),
    ``length, ids`` (unsigned 32-bit, little-endian), ``doc_tokens, sequence_id,
    offset`` (in the sequence), ``sequence_tokens`` (a power of two times
    an odd ``window``'s odd part, or a power of two) and ``step_group``.

    Every whole text is encoded (null: empty) and ends with ``end_id``. Ids of
    a document lie in order in its pieces, each in exactly one. Rows that share
    an id or have none are documents of their own. ``special_in_text`` is as in
    :func:`token_files.write_tokens`. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_packer(tokenizer, end_id, window, step_tokens, special_in_text), PIECES)
