"""Token ids in Arrow files of equal-length sequences (operator 4).

Texts are encoded in ascending doc_id order, an end id after each, and the
ids of one range of documents are packed into rows of ``length`` ids. A
shard is an Arrow IPC file of record batches with two fixed-size-list
columns: ``input_ids`` and ``mask`` (false on the padding of the shard's
last row). Fixed-size lists have no offsets, so row k of a batch is a slice
of one buffer: a memory-mapped shard gives any sequence without a copy. A
second Arrow file per shard says where each document lies.

The shards' manifest is a Parquet table; ``start`` of a document over the
whole corpus is its place in the shard plus the ids of all earlier shards.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedFile, partitions, ragged, scratch, spill, store_of
from .words import MAX_TABLE, WordIds, text_slices

MANIFEST = "shard int, n_docs long, n_tokens long, tokens_file string, docs_file string"
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
BATCH_ROWS = 512          # sequences of one record batch
MARK = " "                # begins a word that is a special token; others hold no space

_tokenizers: dict = {}    # by path: loaded once per Python worker


def _word_encoder(path: str):
    """Encode white-space-free words with the tokenizers library."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # Words that are not marked special are text, also if lowering made them look special.
    tokenizer.encode_special_tokens = True
    special = {i.content: k for k, i in tokenizer.get_added_tokens_decoder().items()}
    ends = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
    for token, i in tokenizer.get_vocab().items():
        ends[i] = token.endswith("</w>")

    def one_by_one(words: list[str]):
        found = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        flat = np.fromiter((i for ids in found for i in ids), np.int64)
        return flat, np.fromiter(map(len, found), np.int64, len(found))

    def joined(words: list[str]):
        """Words of letters only are one pre-token each, whose last id ends a word."""
        flat = np.asarray(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        last = np.flatnonzero(ends[flat])
        if len(last) != len(words):
            return one_by_one(words)
        return flat, np.diff(last, prepend=-1)

    def stems(words: list[str]):
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))
        lengths = np.zeros(len(words), np.int64)
        parts = []
        for which, how in ((plain, joined), (~plain, one_by_one)):
            at = np.flatnonzero(which)
            for a in range(0, len(at), 50_000):
                part = at[a:a + 50_000]
                flat, n = how([words[i] for i in part])
                lengths[part] = n
                parts.append((part, flat, n))
        flat = np.empty(int(lengths.sum()), np.int64)
        starts = np.cumsum(lengths) - lengths
        for part, ids, n in parts:
            flat[ragged(starts[part], n)] = ids
        return flat, lengths

    def encode(words: list[str]):
        """A final ``.`` or ``,`` after letters is a pre-token of its own, so
        such a word has the ids of its stem and of the mark."""
        cut = [i for i, w in enumerate(words) if w[-1:] in (".", ",") and _letters(w[:-1])]
        if not cut:
            return stems(words)
        whole = list(words)
        for i in cut:
            whole[i] = words[i][:-1]
        flat, lengths = stems(whole)
        marks, n_marks = zip(*(one_by_one([mark]) for mark in (".", ",")), strict=True)
        which = np.fromiter((words[i][-1] == "," for i in cut), np.int64, len(cut))
        n = np.concatenate(n_marks)
        ids = np.concatenate(marks)[ragged((np.cumsum(n) - n)[which], n[which])]
        flat = np.insert(flat, np.repeat(np.cumsum(lengths)[cut], n[which]), ids)
        lengths[cut] += n[which]
        return flat, lengths

    def with_special(words: list[str]):
        marked = [i for i, w in enumerate(words) if w.startswith(MARK)]
        if not marked:
            return encode(words)
        plain = list(words)
        for i in marked:
            plain[i] = ""
        flat, lengths = encode(plain)
        before = (np.cumsum(lengths) - lengths)[marked]
        flat = np.insert(flat, before, [special[words[i].removeprefix(MARK)] for i in marked])
        lengths[marked] = 1
        return flat, lengths
    return with_special, len(ends)


def _letters(stem: str) -> bool:
    """Whether a word is letters only, as written and as the library normalizes it."""
    return stem.isalpha() and (stem.isascii() or unicodedata.normalize("NFC", stem).lower().isalpha())


@functools.cache
def special_pattern(path: str) -> re.Pattern | None:
    """Finds special tokens in texts. Those that match on other terms than
    exact text are refused, as their ids would differ from the library's."""
    from tokenizers import Tokenizer

    added = list(Tokenizer.from_file(path).get_added_tokens_decoder().values())
    if any(t.normalized or t.single_word or t.lstrip or t.rstrip or not t.special for t in added):
        raise ValueError("added tokens must be special ones that match exact text")
    names = sorted((t.content for t in added), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def split_words(texts: list[str], special: re.Pattern | None) -> pa.ListArray:
    """Words of each text. Cutting at ASCII white space changes no id (the
    tokenizer drops white space and never joins across it), nor does
    lowering A-Z first. Empty words have no id. Special tokens, looked for
    before lowering, are words of their own that begin with :data:`MARK`."""
    pieces, counts, marked = [], np.ones(len(texts), np.int64), []
    for i, text in enumerate(texts):
        found = special.split(text) if special else [text]
        counts[i] = len(found)
        if len(found) > 1:
            marked += range(len(pieces) + 1, len(pieces) + len(found), 2)
        pieces += found
    words = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(pa.array(pieces, pa.string())))
    if not marked:
        return words
    names = pa.array([[MARK + pieces[i]] for i in marked], words.type)
    which = np.arange(len(pieces))
    which[marked] = len(pieces) + np.arange(len(marked))
    words = pa.concat_arrays([words, names]).take(pa.array(which))
    ends = np.concatenate(([0], np.cumsum(counts)))
    offsets = words.offsets.to_numpy()[ends]
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), words.flatten())


def encoder(path: str) -> tuple[WordIds, np.dtype]:
    if path not in _tokenizers:
        encode, size = _word_encoder(path)
        dtype = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        _tokenizers[path] = WordIds(encode, dtype, 2 * MAX_TABLE), dtype
    return _tokenizers[path]


class _Shard:
    """Packs a stream of ids into record batches of one shard."""

    def __init__(self, folder: str, length: int, dtype: np.dtype):
        self.length, self.dtype = length, dtype
        self.tokens = SharedFile(folder, "tokens", ".arrow")
        self.docs = SharedFile(folder, "docs", ".arrow")
        item = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("input_ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.token_file = pa.ipc.new_file(self.tokens.stream, self.schema)
        self.doc_file = pa.ipc.new_file(self.docs.stream, DOCS)
        self.n_docs = self.n_tokens = self.waiting = 0
        self.pending: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        starts = self.n_tokens + np.cumsum(lengths) - lengths
        self.doc_file.write_batch(pa.record_batch([doc_ids, pa.array(starts), pa.array(lengths)], schema=DOCS))
        self.n_docs, self.n_tokens = self.n_docs + len(lengths), self.n_tokens + len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BATCH_ROWS * self.length:
            self._write(last=False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, self.dtype)
        rows = -(-len(ids) // self.length) if last else len(ids) // self.length
        full, held = ids[:rows * self.length], ids[rows * self.length:]
        mask = np.ones(rows * self.length, bool)
        if len(full) < len(mask):
            mask[len(full):] = False
            full = np.concatenate([full, np.zeros(len(mask) - len(full), self.dtype)])
        for a in range(0, rows, BATCH_ROWS):
            cut = slice(a * self.length, min(a + BATCH_ROWS, rows) * self.length)
            self.token_file.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(full[cut]), self.length),
                pa.FixedSizeListArray.from_arrays(pa.array(mask[cut]), self.length)], schema=self.schema))
        self.pending, self.waiting = [held], len(held)

    def close(self) -> dict:
        self._write(last=True)
        self.token_file.close()
        self.doc_file.close()
        return {"n_docs": self.n_docs, "n_tokens": self.n_tokens,
                "tokens_file": self.tokens.commit(), "docs_file": self.docs.commit()}


def _writer(folder: str, tokenizer: str, end_id: int, length: int, special_in_text: bool):
    schema = pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                        ("tokens_file", pa.string()), ("docs_file", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, dtype = encoder(tokenizer)
        special = special_pattern(tokenizer) if special_in_text else None
        shard = None
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                ids, lengths = words.texts(split_words(texts, special))
                ids = np.insert(ids, np.cumsum(lengths), end_id).astype(dtype)
                shard = shard or _Shard(folder, length, dtype)
                shard.add(batch.column("doc_id").slice(a, b - a), ids, lengths + 1)
        if shard is not None:
            row = shard.close() | {"shard": TaskContext.get().partitionId()}
            yield pa.RecordBatch.from_pylist([row], schema)
    return write


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048,
                 folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 special_in_text: bool = False) -> DataFrame:
    """Write the shards and return their manifest.

    Every whole text is encoded (null: empty, which is its end id alone) in
    ascending id order, nulls first, rows of one id ordered by text. Other
    columns are ignored. With ``special_in_text`` special tokens that stand in a
    text exactly as written get their own id, as the library does by itself;
    otherwise they are ordinary text. An empty table has an empty manifest and no file.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = (rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))
    return spill(ordered.mapInArrow(_writer(f"{folder}/shards", tokenizer, end_id, length, special_in_text), MANIFEST),
                 "manifest", f"{folder}/manifest.parquet")


def open_shard(path: str) -> pa.ipc.RecordBatchFileReader:
    """A shard for random access; a local one is memory-mapped, so slices are not copied."""
    from pyarrow import fs

    store, inner = store_of(path)
    return pa.ipc.open_file(pa.memory_map(inner) if isinstance(store, fs.LocalFileSystem)
                            else store.open_input_file(inner))


def sequence(shard: pa.ipc.RecordBatchFileReader, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of one sequence of a shard; the ids are a view of the file."""
    batch = shard.get_batch(row // BATCH_ROWS)
    ids, mask = (batch.column(c)[row % BATCH_ROWS].values for c in ("input_ids", "mask"))
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


class _Ids:
    """The unpadded ids of a shard as one stream, read a batch at a time."""

    def __init__(self, path: str):
        self.file, self.next, self.held = open_shard(path), 0, np.empty(0, np.uint16)

    def take(self, n: int) -> np.ndarray:
        parts, have = [self.held], len(self.held)
        while have < n:
            batch = self.file.get_batch(self.next)
            self.next += 1
            ids, mask = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("input_ids", "mask"))
            parts.append(ids if mask.all() else ids[mask])
            have += len(parts[-1])
        ids = np.concatenate(parts) if len(parts) > 1 else parts[0]
        self.held = ids[n:]
        return ids[:n]


READ = "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long"


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, tokens_file, docs_file in zip(*(batch.column(c).to_pylist() for c in (
                "shard", "tokens_file", "docs_file")), strict=True):
            ids, docs = _Ids(tokens_file), open_shard(docs_file)
            for k in range(docs.num_record_batches):
                part = docs.get_batch(k)
                lengths = part.column("n_tokens").to_numpy()
                crc = [zlib.crc32(ids.take(int(n)).astype("<u4")) for n in lengths]
                yield pa.record_batch([part.column("doc_id"), pa.array([shard] * len(lengths), pa.int32()),
                                       part.column("start"), part.column("n_tokens"),
                                       pa.array(crc, pa.int64())],
                                      names=["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame) -> DataFrame:
    """Read the shards back: ``doc_id, start, n_tokens, ids_crc32`` per document.

    The running total over shards is a window without a key; it orders one
    small row per shard, not documents.
    """
    spark = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    read = (manifest.select("shard", "tokens_file", "docs_file")
            .repartition(partitions(spark), "shard").mapInArrow(_crc, READ))
    return (read.join(F.broadcast(base), "shard")
            .select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32"))
