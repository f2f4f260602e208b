"""SentencePiece BPE by vectorised merge rounds (operator 8).

A BPE model merges, again and again, the neighbouring pair whose joined
piece has the best score, leftmost first. No piece of the model crosses
from a non-space character to a space mark, so a text is cut there into
words that merge independently, and each distinct word is encoded once.

All words of a batch are one flat numpy array of symbols. A round finds the
best pair rank of every word (a segmented minimum), merges all leftmost,
non-overlapping places of that rank at once, and compacts the array; words
without a pair left are done. Merging equal ranks at once equals merging
them one by one unless a merge makes a pair that ranks at least as well;
such pieces are found when the model is loaded, and of those only the
leftmost place is merged in a round.

Decoding gathers the pieces' bytes by id, again with numpy only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged
from .words import WordIds, text_slices

SLICE_BYTES = 1 << 20      # of texts that a task holds as Python objects (a longer text: that text)
MARK = "▁"
NONE = np.iinfo(np.int32).max
_RUNS = re.compile(" *[^ ]+| +")


class BpeModel:
    """Tables of a SentencePiece BPE model, read through the library."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        probe = "ﬁ Ａ  é\tx "
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("only models with identity normalisation and byte fallback are supported")
        self.size, self.end_id = size, sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        self.control = np.array([sp.is_control(i) for i in range(size)])
        self.is_byte = np.array([sp.is_byte(i) for i in range(size)])
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
        if any(sp.is_unused(i) for i in normal):
            raise ValueError("models with unused pieces are not supported")
        if any(MARK in pieces[i].lstrip(MARK) for i in normal):
            raise ValueError("the model has pieces that cross word ends")
        by_piece = {pieces[i]: i for i in normal}

        # Symbols: piece ids, then characters that are no piece of their own
        # (size + code point).
        self.byte_ids = np.zeros(256, np.int64)
        for i in np.flatnonzero(self.is_byte):
            self.byte_ids[int(pieces[i][3:5], 16)] = i
        self.char_symbol = np.arange(0x110000, dtype=np.int64) + size
        for piece, i in by_piece.items():
            if len(piece) == 1:
                self.char_symbol[ord(piece)] = i

        def symbol(text: str):
            return int(self.char_symbol[ord(text)]) if len(text) == 1 else by_piece.get(text)

        scores = np.array([sp.get_score(i) for i in range(size)])
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
        rank = {i: order[scores[i]] for i in normal}
        pairs, merged = [], []
        for piece, i in by_piece.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs.append((left, right))
                    merged.append(i)
        base = size + 0x110000
        keys = np.array([a * base + b for a, b in pairs], np.int64)
        by_key = np.argsort(keys)
        self.base = base
        self.keys, self.merged = keys[by_key], np.array(merged, np.int64)[by_key]
        self.rank = np.array([rank[int(m)] for m in self.merged], np.int32)
        self.one_by_one = np.zeros(size, bool)
        for (left, right), m in zip(pairs, merged, strict=True):
            for part in (left, right):
                if part in rank and len(pieces[part]) > 1 and rank[m] <= rank[part]:
                    self.one_by_one[part] = True

        # Bytes of each piece, for decoding.
        raw = [b"" if self.control[i] else bytes([int(pieces[i][3:5], 16)]) if self.is_byte[i]
               else " ⁇ ".encode() if sp.is_unknown(i) else pieces[i].replace(MARK, " ").encode()
               for i in range(size)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_length = np.array([len(b) for b in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, joined piece) of symbol pairs; rank NONE where there is no piece."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), self.merged[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, length of each word's ids). A word is its key in
        :func:`split_words`: a lone leading space is left out."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        marked = [(w if w[:1] == " " else " " + w).replace(" ", MARK) for w in words]
        n_chars = np.fromiter(map(len, marked), np.int64, len(marked))
        points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        symbols = self.char_symbol[points]
        word = np.repeat(np.arange(len(words)), n_chars)
        done: list[tuple[np.ndarray, np.ndarray]] = []

        rank, joined = self._neighbours(symbols, word)
        while len(symbols):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            lengths = np.diff(np.append(starts, len(symbols)))
            best = np.minimum.reduceat(rank, starts)
            active = np.repeat(best < NONE, lengths)
            if not active.all():
                done.append((word[~active], symbols[~active]))
                symbols, word, rank, joined = symbols[active], word[active], rank[active], joined[active]
                lengths, best = lengths[best < NONE], best[best < NONE]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, lengths))
            # Leftmost first without overlap: every second place of a run of
            # neighbouring places.
            fresh = np.diff(at, prepend=-2) != 1
            run = np.flatnonzero(fresh)
            take = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
            first = np.diff(word[at], prepend=-1) != 0
            lone = self.one_by_one[joined[at]]
            if lone.any():  # a word with such a place merges its leftmost place only
                held = np.zeros(len(words), bool)
                held[word[at[lone]]] = True
                take &= first | ~held[word[at]]
            at = at[take]
            symbols[at] = joined[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = (np.cumsum(keep) - 1)[at]
            symbols, word, rank, joined = symbols[keep], word[keep], rank[keep], joined[keep]
            stale = np.zeros(len(symbols), bool)
            stale[place] = True
            stale[place[place > 0] - 1] = True
            changed = np.flatnonzero(stale)
            rank[changed], joined[changed] = self._neighbours_at(symbols, word, changed)

        word = np.concatenate([w for w, _ in done])
        symbols = np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return self._ids(word[order], symbols[order], len(words))

    def _neighbours_at(self, symbols, word, at):
        right = np.minimum(at + 1, len(symbols) - 1)
        rank, joined = self._pairs(symbols[at], symbols[right])
        rank[(right == at) | (word[right] != word[at])] = NONE
        return rank, joined

    def _neighbours(self, symbols, word):
        return self._neighbours_at(symbols, word, np.arange(len(symbols)))

    def _ids(self, word, symbols, n_words):
        """Symbols without a piece become the ids of their UTF-8 bytes."""
        unknown = symbols >= self.size
        if unknown.any():
            width = np.ones(len(symbols), np.int64)
            points = symbols[unknown] - self.size
            width[unknown] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            starts = np.cumsum(width) - width
            ids = np.repeat(symbols, width)
            raw = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            ids[ragged(starts[unknown], width[unknown])] = self.byte_ids[np.frombuffer(raw, np.uint8)]
            word, symbols = np.repeat(word, width), ids
        return symbols, np.bincount(word, minlength=n_words)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of flat ids. Control ids give nothing; the first space, which
        encoding put in front, goes; bytes that are not UTF-8 become U+FFFD."""
        width = self.raw_length[ids]
        raw = self.raw[ragged(self.raw_start[ids], width)].tobytes()
        ends = np.concatenate(([0], np.cumsum(width)))[np.cumsum(lengths)]
        out, a = [], 0
        for b in ends.tolist():
            text = raw[a:b].decode("utf-8", "replace")
            out.append(text[1:] if text[:1] == " " else text)
            a = b
        return out


def split_words(texts: list[str]) -> pa.ListArray:
    """Words of each text behind its dummy space, as keys: a word with the
    spaces before it, where one lone space is left out. The mark itself
    reads as a space; so it is free to separate keys here."""
    lines = []
    for text in texts:
        text = text.replace(MARK, " ")
        if "  " not in text and text[:1] != " " and text[-1:] != " ":
            lines.append(text.replace(" ", MARK))
        else:
            lines.append(MARK.join(w[1:] if w[1:2] != " " else w for w in _RUNS.findall(" " + text)))
    words = pa.compute.split_pattern(pa.array(lines, pa.string()), MARK)
    if "" in texts:  # the empty text has no word, not one empty word
        empty = pa.array([], pa.string())
        words = pa.array([empty if not t else w for t, w in zip(texts, words, strict=True)], words.type)
    return words


_models: dict[str, tuple[BpeModel, WordIds]] = {}


def model(path: str) -> tuple[BpeModel, WordIds]:
    """Loaded once per Python worker."""
    if path not in _models:
        bpe = BpeModel(path)
        _models[path] = bpe, WordIds(bpe.encode_words, np.int32)
    return _models[path]


def encode_texts(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, ids per text), an end id after each text."""
    bpe, words = model(path)
    ids, lengths = words.texts(split_words(texts))
    return np.insert(ids, np.cumsum(lengths), bpe.end_id), lengths + 1


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` (array of int): the ids of each whole text and
    the end id. A null text is empty: the end id alone. Every other column
    stays; one that is already called ``ids_col`` is replaced."""
    kept = [c for c in docs.columns if c != ids_col]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(text_col), SLICE_BYTES):
                ids, lengths = encode_texts(path, texts)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                part = batch.slice(a, b - a)
                yield pa.record_batch([*part.columns, pa.ListArray.from_arrays(offsets, ids.astype(np.int32))],
                                      names=[*kept, ids_col])
    return rows.mapInArrow(run, f"{types}, `{ids_col}` array<int>")


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col``: the text of each row's ids; null ids give null."""
    kept = [c for c in docs.columns if c != text_col]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = model(path)
        for batch in batches:
            column = batch.column(ids_col)
            lengths = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
            texts = bpe.decode(column.flatten().to_numpy(zero_copy_only=False), lengths)
            texts = [t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist(), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*kept, text_col])
    return rows.mapInArrow(run, f"{types}, `{text_col}` string")


def encode_and_decode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` as by :func:`encode` and ``text_col`` decoded from
    these ids, in one step: a slice of texts at a time is all that a task
    holds. A null text comes back empty."""
    kept = [c for c in docs.columns if c not in (text_col, ids_col)]
    rows = docs.select(*(F.col(f"`{c}`") for c in [*kept, text_col]))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = model(path)
        for batch in batches:
            for a, b, texts in text_slices(batch.column(text_col), SLICE_BYTES):
                ids, lengths = encode_texts(path, texts)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                yield pa.record_batch([*(batch.column(c).slice(a, b - a) for c in kept),
                                       pa.ListArray.from_arrays(offsets, ids.astype(np.int32)),
                                       pa.array(bpe.decode(ids, lengths), pa.string())],
                                      names=[*kept, ids_col, text_col])
    return rows.mapInArrow(run, f"{types}`{ids_col}` array<int>, `{text_col}` string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids, and return digests of both:
    ``doc_id, n_tokens, ids_sha256`` (of the decimal ids joined by one
    space) and ``decoded_sha256``. The ids do not leave the task."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = model(path)
        names = [str(i) for i in range(bpe.size)]
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text"), SLICE_BYTES):
                ids, lengths = encode_texts(path, texts)
                decoded = bpe.decode(ids, lengths)
                out, at = [], 0
                for n in lengths.tolist():
                    line = " ".join(map(names.__getitem__, ids[at:at + n].tolist()))
                    out.append(hashlib.sha256(line.encode()).hexdigest())
                    at += n
                yield pa.record_batch([
                    batch.column("doc_id").slice(a, b - a), pa.array(lengths, pa.int64()), pa.array(out),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return rows.mapInArrow(run, DIGEST)
