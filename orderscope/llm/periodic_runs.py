"""Periodic runs of words by suffix trees (operator 13).

A run is a stretch of words with smallest period q that is at least
``min_length`` words and two periods long and that no neighbour extends. By
the runs theorem each run has a Lyndon root: for one of two opposite word
orders it is the longest Lyndon word where it starts. That word ends where
the next smaller suffix begins, and suffix ranks in both orders are the leaf
order of one suffix tree, read with its children up or down (the end mark
first both times). A candidate is extended to the right by the common
prefix of two suffixes and to the left by that of two suffixes of the
reversed words. Both are string depths of lowest common ancestors: the
least depth between two leaves in the tree's Euler tour, which a sparse
table gives in constant time.

Trees (Ukkonen's, linear time) are built where a run can be at all. In a run
at least k = ceil(min_length / 2) neighbouring words recur one period on, so all
of its words lie in k-grams that occur again in the document. The other
words cut a document into segments, each with its runs to itself, and the
test is repeated inside the segments. This loses no run: it only spares trees
of stretches without any.

The work on a document is linear in its length and needs no other document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix
from .words import text_slices

ROUNDS = 4                 # rounds of cutting into segments; more would only spare more trees
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


# ---- suffix tree ----

class SuffixTree:
    """Of a list of symbols >= 0; the end mark -1 is added."""

    def __init__(self, symbols: list[int]):
        s = [*symbols, -1]
        n = len(s)
        start, stop, link, kids = [0], [0], [0], [{}]
        leaf_of = []                       # node of each suffix: leaves are made in order of suffixes
        node = length = edge = waiting = 0
        for i, c in enumerate(s):
            waiting += 1
            split = 0
            while waiting:
                if not length:
                    edge = i
                children = kids[node]
                child = children.get(s[edge])
                if child is None:
                    children[s[edge]] = len(start)
                    leaf_of.append(len(start))
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    kids.append(None)
                    if split:
                        link[split] = node
                        split = 0
                else:
                    at = start[child]
                    size = stop[child] - at
                    if length >= size:
                        edge += size
                        length -= size
                        node = child
                        continue
                    if s[at + length] == c:
                        length += 1
                        if split:
                            link[split] = node
                        break
                    inner = len(start)
                    start.append(at)
                    stop.append(at + length)
                    link.append(0)
                    leaf_of.append(inner + 1)
                    kids.append({s[at + length]: child, c: inner + 1})
                    children[s[edge]] = inner
                    start[child] = at + length
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    kids.append(None)
                    if split:
                        link[split] = inner
                    split = inner
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.n, self.start, self.stop, self.kids, self.leaf_of = n, start, stop, kids, leaf_of

    def leaf_ranks(self, up: bool) -> list[int]:
        """Rank of each suffix, words in ascending or descending order, the end mark first."""
        seen = [0] * len(self.start)
        kids, rank, stack = self.kids, 0, [0]
        while stack:
            node = stack.pop()
            children = kids[node]
            if children is None:
                seen[node] = rank
                rank += 1
            elif up:
                stack += [children[c] for c in sorted(children, reverse=True)]
            else:
                end = children.get(-1)
                stack += [children[c] for c in sorted(children) if c >= 0]
                if end is not None:
                    stack.append(end)
        return [seen[leaf] for leaf in self.leaf_of]

    def common_prefixes(self) -> CommonPrefixes:
        """The Euler tour's string depths, and where each leaf is in it."""
        start, stop, kids = self.start, self.stop, self.kids
        tour, place = [], [0] * len(start)
        stack = [(0, 0)]                   # (node, its depth) or (-1, depth): back at an ancestor
        while stack:
            node, depth = stack.pop()
            tour.append(depth)
            if node < 0:
                continue
            children = kids[node]
            if children is None:
                place[node] = len(tour) - 1
                continue
            for child in children.values():
                stack.append((-1, depth))
                stack.append((child, depth + stop[child] - start[child]))
        return CommonPrefixes(np.array(tour, np.int32), np.array(place, np.int64)[self.leaf_of])


class CommonPrefixes:
    """Longest common prefixes of suffixes in constant time each: range minima
    over blocks of :data:`BLOCK` depths, so that the tables stay linear."""

    BLOCK = 16

    def __init__(self, depths: np.ndarray, places: np.ndarray):
        self.places = places
        size = self.BLOCK
        blocks = -(-len(depths) // size)
        padded = np.full(blocks * size, np.iinfo(np.int32).max, np.int32)
        padded[:len(depths)] = depths
        by_block = padded.reshape(blocks, size)
        self.to_end = np.minimum.accumulate(by_block[:, ::-1], axis=1)[:, ::-1].ravel()
        self.from_start = np.minimum.accumulate(by_block, axis=1).ravel()
        self.short = self._table(padded, size)
        self.long = self._table(by_block.min(axis=1), blocks)

    @staticmethod
    def _table(values: np.ndarray, longest: int) -> list[np.ndarray]:
        table, step = [values], 1
        while 2 * step <= longest:
            last = table[-1]
            row = last.copy()
            row[:len(last) - step] = np.minimum(last[:len(last) - step], last[step:])
            table.append(row)
            step *= 2
        return table

    @staticmethod
    def _least(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minima of [a, b], both included, for a <= b."""
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int32)
        for k in np.unique(level).tolist():
            of = level == k
            out[of] = np.minimum(table[k][a[of]], table[k][b[of] - (1 << k) + 1])
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For suffixes i != j."""
        a, b = self.places[i], self.places[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        block_a, block_b = a // self.BLOCK, b // self.BLOCK
        out = np.empty(len(a), np.int32)
        near = block_a == block_b
        out[near] = self._least(self.short, a[near], b[near])
        far = ~near
        out[far] = np.minimum(self.to_end[a[far]], self.from_start[b[far]])
        wide = block_b - block_a > 1
        out[wide] = np.minimum(out[wide], self._least(self.long, block_a[wide] + 1, block_b[wide] - 1))
        return out


def _next_smaller(ranks: list[int]) -> list[int]:
    """For each suffix the place of the next one that ranks below it."""
    out = [0] * len(ranks)
    stack: list[int] = []
    for i, rank in enumerate(ranks):
        while stack and ranks[stack[-1]] > rank:
            out[stack.pop()] = i
        stack.append(i)
    return out


def segment_runs(symbols: list[int], min_length: int) -> np.ndarray:
    """(start, length, period) of the runs of a list of symbols, by start, then period."""
    n = len(symbols)
    tree = SuffixTree(symbols)
    at = np.arange(n)
    # The end mark ranks first, so every suffix of the symbols has a next smaller one.
    roots = [np.array(_next_smaller(tree.leaf_ranks(up))[:n], np.int64) for up in (True, False)]
    i = np.concatenate([at, at])
    j = np.concatenate(roots)
    key = np.unique(i * (n + 1) + j)
    i, j = key // (n + 1), key % (n + 1)
    right = tree.common_prefixes()(i, j)
    del tree
    left = SuffixTree(symbols[::-1]).common_prefixes()(n - i, n - j)
    period = j - i
    length = period + left + right
    found = np.unique(np.stack([i - left, length, period], axis=1)[length >= np.maximum(2 * period, min_length)], axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


# ---- documents ----

def _stretches(group: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, group) of the words that lie in k-grams which occur again in their
    group (ascending group numbers); neighbouring words get one new group."""
    n = len(words) - k + 1
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gram = np.zeros(n, np.uint64)
    for j in range(k):
        gram = mix(gram * _FACTOR + words[j:j + n])
    whole = np.flatnonzero(group[:n] == group[k - 1:])
    gram = mix(gram[whole] + group[whole].astype(np.uint64) * _FACTOR)
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    again = whole[order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + k, -1)
    inside = np.cumsum(edge[:-1]) > 0
    at = np.flatnonzero(inside)
    fresh = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(group[at]) > 0))) if len(at) else np.empty(0, bool)
    return at, np.cumsum(fresh)


def find_runs(codes: np.ndarray, counts: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, [start, length, period] in it) of all runs of documents given
    as word codes one after another; by document, start, period."""
    k = (min_length + 1) // 2
    at, group = np.arange(len(codes)), np.repeat(np.arange(len(counts)), counts)
    hashed = mix(codes.astype(np.uint64) + _FACTOR)
    for _ in range(ROUNDS):
        before = len(at)
        inner, new = _stretches(group, hashed[at], k)
        at, group = at[inner], new
        if len(at) == before:
            break
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    cut = np.flatnonzero(np.diff(group, prepend=-1))
    docs, runs = [], []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)], strict=False):
        if b - a < min_length:
            continue
        _, symbols = np.unique(codes[at[a]:at[b - 1] + 1], return_inverse=True)
        found = segment_runs(symbols.tolist(), min_length)
        doc = int(owner[at[a]])
        docs.append(np.full(len(found), doc))
        runs.append(found + np.array([at[a] - first[doc], 0, 0]))
    if not docs:
        return np.empty(0, np.int64), np.empty((0, 3), np.int64)
    return np.concatenate(docs), np.concatenate(runs).astype(np.int64)


def _words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(all words, number of each text's words); words end at ASCII white space."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy().astype(np.int64)
    total = np.concatenate(([0], np.cumsum(full)))
    return words.filter(pa.array(full)), np.diff(total[ends - ends[0]])


RUNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _detect(kept: list[str], text_col: str, min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(text_col)):
                words, counts = _words(texts)
                coded = words.dictionary_encode()
                codes = coded.indices.to_numpy().astype(np.int64)
                docs, runs = find_runs(codes, counts, min_length)
                # Words after the first period of a run go.
                first = np.cumsum(counts) - counts
                edge = np.zeros(len(codes) + 1, np.int64)
                np.add.at(edge, first[docs] + runs[:, 0] + runs[:, 2], 1)
                np.add.at(edge, first[docs] + runs[:, 0] + runs[:, 1], -1)
                stays = np.cumsum(edge[:-1]) == 0
                left = np.concatenate(([0], np.cumsum(stays)))[np.concatenate(([0], np.cumsum(counts)))]
                kept_words = pa.LargeListArray.from_arrays(pa.array(left), words.filter(pa.array(stays)))
                n_runs = np.bincount(docs, minlength=len(counts))
                spans = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in range(3)],
                                                   names=["start", "length", "period"])
                yield pa.record_batch([
                    *(batch.column(c).slice(a, b - a) for c in kept), pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_runs))), pa.int32()), spans),
                    pc.binary_join(kept_words, pa.scalar(" ", pa.large_string())).cast(pa.string())],
                    names=[*kept, "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, min_length: int = 12, text_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col`` and with ``n_words``, ``runs`` (start, length
    and period in words, by start, then period) and ``collapsed``: the words
    that no run holds after its first period, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+`` and are compared exactly. A null, empty
    or blank text has no words, no runs and an empty ``collapsed``. Every row is
    a document of its own. Columns ``n_words``, ``runs`` and ``collapsed`` of the
    input are replaced, all others stay. An empty table gives an empty result.
    """
    if min_length < 2:
        raise ValueError("min_length must be 2 at least")
    kept = [c for c in docs.columns if c not in (text_col, "n_words", "runs", "collapsed")]
    rows = docs.select(*(F.col(f"`{c}`") for c in [*kept, text_col]))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])
    return rows.mapInArrow(_detect(kept, text_col, min_length), types + RUNS)
