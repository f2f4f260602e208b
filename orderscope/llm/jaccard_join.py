"""N-gram Jaccard join: a size-aware heavy-light set join (operator 2).

Two documents link when their shingle sets' Jaccard similarity is at least
3/4. If so, then with elements in any one order and k = 1, 2, ..., the
first |s| - ceil(3/4 |s|) + k elements of both sets share k elements. That
gives two kinds of keys:

* small sets (size up to a boundary) are enumerated: one key for every
  subset of two elements of that prefix with k = 2;
* large sets are found by scanning inverted lists: one key for every
  element of the prefix with k = |s| / 10, and two sets are candidates only
  if they meet on as many keys as the smaller k. Sets that have just a
  passage in common seldom do. Small sets within 3/4 of the boundary write
  these keys too, to meet large ones;
* sets of more than ``MARKED`` elements are cut into groups by ranges of hash
  values, as many for all sets of a class of sizes. If two sets link, two of
  their groups of one range do, since sums of differences and of sizes are
  sums over the groups. So a group is a small set of its own here: one key for
  every element of its prefix with k = 1, and one such key makes a candidate.
  Sets within 3/4 of a class write its keys too.

Of two sets that link, the smaller shares 6/7 of its elements with the other:
for it the same elements are found in the first |s| - ceil(6/7 |s|) + k. So
a key brings two sets together only if the smaller has it there. Sets that
share a passage of 3/4 to 6/7 of their elements do not meet on it.

Sizes travel with the keys, so sets meet only if neither size is below 3/4 of the
other. Most sets that have one element in common fail this. So does a mark of each
set: 128 bits, each the parity of the elements whose hash names it. Marks differ
in no more bits than sets in elements, and sets that link differ in a seventh of
their sizes' sum at most. Sets of a large group that have half of their elements
in common share many keys, but their marks keep nearly all from meeting. A key of a
group has the group's size and mark. Enumerated sets of more than ``MARKED``
elements have no mark: two of them may differ in half of its bits.

The boundary is where enumerating costs more than scanning, by a cost
summed over the sizes of all sets and the measured length of lists.
Elements found in many sets ("heavy") come last in the order, the most frequent
ones at the end, so shared passages seldom are keys. Any order gives the same
result; so the table of heavy elements is bounded (``HEAVY`` entries) and
broadcast, and its frequencies are those seen in slices of the table and in
one of ``ORDER_SHARE`` documents.

Groups of near copies are kept out of the lists: minima of eight ranges of
hash values propose a centre for each set (a star, no pairs), exact counts
confirm it, and each set writes its keys in the name of its centre, once a
task. A key that meets two centres proposes them as a pair. Jaccard
distance is a metric, so two stars can only hold a link between members x
and y of centres a and b if d(a,b) <= 1/4 + d(a,x) + d(b,y); pairs of
members within that bound are checked, all others need not be. Where many
centres are near each other without being linked, they and their members are
held against what most of them have in common instead (:mod:`.crowds`). Every
link is confirmed with whole sets, and components of the links are found by
alternating star contraction. Equal sets are one set throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ragged, small_side, spill
from .components import components
from .crowds import crowd_links, settle, star_homes
from .shingles import mix, shingle_sets
from .words import text_slices

HEAVY = 1 << 18            # heavy elements in the broadcast table (2 MB of hashes)
ORDER_SHARE = 32           # one of as many documents tells how frequent elements are
VERIFY_COST = 8.0          # cost of a listed set, in keys written
LIST_PAIRS = 1_000_000     # pairs that a task gathers before it counts them
TESTED_PAIRS = 1 << 18     # pairs of a list's sets whose sizes a task compares at once
SLICE_CHARS = 4 << 20
KEY_CHARS = 1 << 20        # of texts whose keys or sets a task holds at once
PICKS = 4                  # pairs of each centre that are checked first in a crowd
MOST_TURNS = 4             # such turns; what is left is checked in full
MARKED = 224               # larger sets have no mark; larger ones that are listed are cut into groups
TENTH = 10                 # a large set's prefix goes on for 1/10 of it
_PAIR_A, _PAIR_B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407)


def needed(n):
    """ceil(3/4 n): the elements a set of n must share with any set it links with."""
    return (3 * n + 3) // 4


def _text_slices(batches: Iterator[pa.RecordBatch], chars: int = SLICE_CHARS):
    for batch in batches:
        for a, b, texts in text_slices(batch.column("text"), chars):
            yield batch.slice(a, b - a), *shingle_sets(texts)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# ---- first pass: sizes, signatures, sketches, repeated elements ----

PROFILE = "doc long, n long, sig1 long, sig2 long, sketch array<long>, element long, times long, told long"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and a row per element that repeats within a slice or is
    in a document that tells how frequent elements are (``told``: in how many)."""
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()),
                        ("sketch", pa.list_(pa.int64())), ("element", pa.int64()), ("times", pa.int64()), ("told", pa.int64())])
    for batch, elements, sizes in _text_slices(batches):
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        sig = np.zeros((2, len(sizes)), np.uint64)
        for k, salt in enumerate((_PAIR_A, _PAIR_B)):
            if len(full):
                sig[k, full] = np.add.reduceat(mix(elements ^ salt), starts)
        # The smallest element of each of eight ranges of hash values.
        owner = np.repeat(np.arange(len(sizes)), sizes)
        part = owner * 8 + (elements >> np.uint64(61)).astype(np.int64)
        least = np.flatnonzero(np.diff(part, prepend=-1))
        n_least = np.bincount(owner[least], minlength=len(sizes))
        offsets = np.concatenate(([0], np.cumsum(n_least))).astype(np.int32)
        sketch = pa.ListArray.from_arrays(offsets, _signed(elements[least]))
        none = pa.nulls(len(sizes), pa.int64())
        yield pa.record_batch([batch.column("doc"), pa.array(sizes), _signed(sig[0]), _signed(sig[1]), sketch,
                               none, none, none], schema=schema)
        if not len(elements):
            continue
        tells = mix(batch.column("doc").to_numpy().view(np.uint64)) % np.uint64(ORDER_SHARE) == 0
        ordered = np.sort(elements)
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        times = np.diff(np.append(first, len(ordered)))
        told = np.bincount(np.searchsorted(ordered[first], elements[tells[owner]]), minlength=len(first))
        rows = np.flatnonzero((times > 1) | (told > 0))
        if len(rows):
            none = pa.nulls(len(rows), pa.int64())
            times = np.where(times > 1, times, 0)
            yield pa.record_batch([none, none, none, none, pa.nulls(len(rows), pa.list_(pa.int64())),
                                   _signed(ordered[first][rows]), pa.array(times[rows]), pa.array(told[rows])],
                                  schema=schema)


# ---- exact counts for proposed pairs ----

def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, elements, sizes in _text_slices(batches, KEY_CHARS):
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        rows = [elements[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.record_batch([batch.column("doc"), pa.array(sizes), pa.array(rows, pa.large_binary())],
                              names=["doc", "n", "elements"])


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted so that a centre comes before the sets compared with it."""
    centre, centre_set = None, np.empty(0, np.uint64)
    for batch in batches:
        a_col, x_col = batch.column("a").to_pylist(), batch.column("x").to_pylist()
        rows = batch.column("elements")
        out = []
        for i, (a, x) in enumerate(zip(a_col, x_col, strict=True)):
            values = np.frombuffer(rows[i].as_buffer(), np.uint64)
            if x is None:
                centre, centre_set = a, values.copy()
                continue
            if a != centre or not len(centre_set) or not len(values):
                continue
            at = np.minimum(np.searchsorted(centre_set, values), len(centre_set) - 1)
            shared = int((centre_set[at] == values).sum())
            out.append((a, x, shared, len(centre_set) + len(values) - shared))
        yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([],) * 4)],
                              names=["a", "x", "shared", "joined"])


class _Verifier:
    """Exact counts for pairs of documents, by whole sets made from the texts."""

    def __init__(self, docs: DataFrame):
        self.docs, self.n = docs, partitions(docs.sparkSession)

    def __call__(self, pairs: DataFrame, name: str) -> DataFrame:
        """``a, x, shared, joined`` of rows ``a, x``. Sets travel once per pair
        (x) or once per centre and slice of its pairs (a)."""
        wanted = pairs.select(F.explode(F.array("a", "x")).alias("doc")).distinct()
        wanted = small_side(spill(wanted, f"{name}-wanted"), F.count(F.lit(1)) * 16)
        sets = spill(self.docs.join(wanted, "doc", "left_semi")
                     .mapInArrow(_sets, "doc long, n long, elements binary"), f"{name}-sets")
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(self.n)).cast("int"))
        members = salted.join(sets.select(F.col("doc").alias("x"), "elements"), "x").select("a", "salt", "x", "elements")
        centres = (salted.select("a", "salt").distinct()
                   .join(sets.select(F.col("doc").alias("a"), "elements"), "a")
                   .select("a", "salt", F.lit(None).cast("long").alias("x"), "elements"))
        both = (members.unionByName(centres).repartition(self.n, "a", "salt")
                .sortWithinPartitions("a", "salt", F.col("x").asc_nulls_first()))
        return spill(both.select("a", "x", "elements").mapInArrow(
            _count_shared, "a long, x long, shared long, joined long"), f"{name}-counts")


LINK = "100 * shared >= 75 * joined"


# ---- keys ----

def _prefix(elements: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """The first |s| - ceil(3/4 |s|) + k elements: light ones (rank 0) by hash, then heavy ones by rank."""
    n = len(elements)
    size = min(n, n - int(needed(n)) + k)
    light = elements[rank == 0]
    if len(light) >= size:
        return light[:size]
    heavy = np.flatnonzero(rank)
    heavy = heavy[np.argsort(rank[heavy], kind="stable")]
    return np.concatenate([light, elements[heavy[:size - len(light)]]])


def _index_size(n, k: int):
    """The elements among which a set shares k with any set it links with that is
    not smaller: ceil(6/7 n) are shared then."""
    return n - (6 * n + 6) // 7 + k


def _classes(n: int, boundary: int) -> list[int]:
    """Classes of sizes whose sets a set of n may link with: class c > 0 has sizes
    from MARKED * 2 ** (c - 1) to twice that, beyond the boundary."""
    own = ((n - 1) // MARKED).bit_length()
    return [c for c in (own, own + 1)
            if c and n >= needed(max(MARKED << c - 1, boundary) + 1) and MARKED << c > boundary]


def _group_keys(elements: np.ndarray, rank: np.ndarray, c: int):
    """(keys, sizes, marks) of a set's groups in class c, of MARKED / 4 to MARKED / 2 elements
    for a set of that class."""
    group = (elements >> np.uint64(63 - c)).astype(np.int64)
    sizes = np.bincount(group)
    order = np.lexsort((rank, group))
    at = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = at < np.repeat(sizes - needed(sizes) + 1, sizes)
    order, at = order[prefix], at[prefix]
    group = group[order]
    index = at < _index_size(sizes, 1)[group]
    keys = mix(elements[order]) & ~_CLASS_AND_FLAG | np.uint64(2 * c) | index.astype(np.uint64)
    return keys, sizes[group], _marks(elements, sizes)[:, group]


def _keyed(elements: np.ndarray, rank: np.ndarray, mark: np.ndarray, boundary: int, grouped: bool):
    """(keys, sizes, marks): a set's keys, and of each the size and the mark of the set or
    group that meets others there. A key's lowest bit says whether that may be the
    smaller one of a pair, the five bits before its class (0: the whole set).
    Unless ``grouped``, listed sets stay whole, whatever their size."""
    n, keys, flags = len(elements), [], []
    if n <= boundary:
        p = _prefix(elements, rank, 2)
        order = np.argsort(p)
        p, index = p[order], order < _index_size(n, 2)
        a, b = np.triu_indices(len(p), 1)
        keys.append(mix(p[a] * _PAIR_A + p[b] * _PAIR_B))
        flags.append(index[a] & index[b])
    if (n <= MARKED or not grouped) and (n >= needed(boundary + 1) or n > boundary):
        k = max(1, n // TENTH)
        p = _prefix(elements, rank, k)
        keys.append(mix(p))
        flags.append(np.arange(len(p)) < _index_size(n, k))
    whole = np.concatenate([np.empty(0, np.uint64), *keys]) & ~_CLASS_AND_FLAG
    whole |= np.concatenate([np.empty(0, bool), *flags]).astype(np.uint64)
    parts = [(whole, np.full(len(whole), n), np.repeat(mark, len(whole), axis=1))]
    parts += [_group_keys(elements, rank, c) for c in (_classes(n, boundary) if grouped else [])]
    keys, sizes, marks = zip(*parts, strict=True)
    return np.concatenate(keys), np.concatenate(sizes), np.concatenate(marks, axis=1)


def _keys_of(elements: np.ndarray, rank: np.ndarray, boundary: int) -> np.ndarray:
    """The keys of a whole set alone."""
    return _keyed(elements, rank, np.zeros((2, 1), np.uint64), boundary, False)[0]


_CLASS_AND_FLAG = np.uint64(63)
_BITS, _ONE = np.uint64(45), np.uint64(1023 << 7)


def _coarse(x: np.ndarray) -> np.ndarray:
    """Positive integers in 16 bits: their eight leading binary digits and how many follow."""
    return ((x.astype(np.float64).view(np.uint64) >> _BITS) - _ONE).astype(np.uint16)


def _least_of(coarse: np.ndarray) -> np.ndarray:
    return ((coarse.astype(np.uint64) + _ONE) << _BITS).view(np.float64)


def _most_of(coarse: np.ndarray) -> np.ndarray:
    return np.ceil(((coarse.astype(np.uint64) + _ONE + np.uint64(1)) << _BITS).view(np.float64)) - 1


# Of sets that may link with any other by their marks: large ones, and those of a
# centre that write a key and differ in theirs.
ANY_MARK = np.uint64((1 << 64) - 1)


def _marks(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two words a set: bit b is the parity of its elements whose hash ends in b.
    A set of more than ``MARKED`` elements has ``ANY_MARK``."""
    marks = np.zeros((2, len(sizes)), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        bits = np.uint64(1) << (elements & np.uint64(63))
        upper = (elements & np.uint64(64)).astype(bool)
        for word, here in enumerate((~upper, upper)):
            marks[word, full] = np.bitwise_xor.reduceat(np.where(here, bits, np.uint64(0)), starts)
    return np.where(sizes > MARKED, ANY_MARK, marks)


# ``spans``: least and most size of a centre's sets (or their groups) that write a key, both coarse.
KEYS = "bucket int, keys binary, centres binary, homes binary, spans binary, marks binary"


def _write_keys(heavy, boundary: int, buckets: int, grouped: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ranks = heavy.value
        for batch, elements, sizes in _text_slices(batches, KEY_CHARS):
            docs = batch.column("doc").to_numpy()
            centre = batch.column("centre")
            centre = np.where(centre.is_null().to_numpy(zero_copy_only=False), docs,
                              centre.fill_null(0).to_numpy())
            # A set that is in no crowd and has no link yet is a home of its own.
            home = batch.column("home")
            home = np.where(home.is_null().to_numpy(zero_copy_only=False), centre, home.fill_null(0).to_numpy())
            at = np.minimum(np.searchsorted(table, elements), max(0, len(table) - 1))
            rank = np.where(table[at] == elements, ranks[at], 0) if len(table) else np.zeros(len(elements), np.int64)
            whole = _marks(elements, sizes)
            keys, spans, marks, written, end = [], [], [], np.zeros(len(sizes), np.int64), 0
            for i, n in enumerate(sizes.tolist()):
                if n:
                    of_set = _keyed(elements[end:end + n], rank[end:end + n], whole[:, i:i + 1], boundary, grouped)
                    keys.append(of_set[0])
                    spans.append(of_set[1])
                    marks.append(of_set[2])
                    written[i] = len(keys[-1])
                    end += n
            if not written.any():     # sets of one element need none
                continue
            span = _coarse(np.concatenate(spans))
            keys, owners, homes, spans, marks = _once(
                np.concatenate(keys), np.repeat(centre, written), np.repeat(home, written),
                np.array([span, span]), np.concatenate(marks, axis=1))
            # Keys are hashes in order, so a bucket is one stretch of them.
            bucket = ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cut[1:], len(keys))
            yield pa.record_batch([
                pa.array(bucket[cut], pa.int32()),
                pa.array([keys[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                pa.array([owners[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                pa.array([homes[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                pa.array([spans[:, a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                pa.array([marks[:, a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())],
                names=["bucket", "keys", "centres", "homes", "spans", "marks"])
    return run


def _once(keys: np.ndarray, owners: np.ndarray, homes: np.ndarray, spans: np.ndarray, marks: np.ndarray):
    """Each key and owner once, in order, as the smaller set's if it is that for one of
    its sets, with the spans of all of them and the mark that all have, if any."""
    order = np.lexsort((keys, owners, keys >> np.uint64(1)))
    keys, owners, homes, spans, marks = keys[order], owners[order], homes[order], spans[:, order], marks[:, order]
    last = (keys[1:] >> np.uint64(1) != keys[:-1] >> np.uint64(1)) | (owners[1:] != owners[:-1])
    last = np.concatenate((last, [True])) if len(keys) else np.empty(0, bool)
    if not last.all():
        starts = np.flatnonzero(np.concatenate(([True], last[:-1])))
        spans = np.array([f.reduceat(span, starts)
                          for f, span in zip((np.minimum, np.maximum), spans, strict=True)])
        alike = (np.minimum.reduceat(marks, starts, axis=1) == np.maximum.reduceat(marks, starts, axis=1)).all(axis=0)
        marks = np.where(alike, marks[:, starts], ANY_MARK)
    return keys[last], owners[last], homes[last], spans, marks


def _may_link(spans: np.ndarray, marks: np.ndarray, smaller: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sizes of both sides, from least to most, and marks allow a link, and the
    smaller set of a pair may be one that is there as that."""
    n, m, most_n, most_m = (f(span[at]) for f, span in zip((_least_of, _most_of), spans, strict=True) for at in (one, other))
    differ = np.bitwise_count(marks[:, one] ^ marks[:, other]).sum(axis=0, dtype=np.int64)
    unmarked = (marks == ANY_MARK).all(axis=0)
    return ((4 * most_m >= 3 * n) & (4 * most_n >= 3 * m)
            & ((7 * differ <= most_n + most_m) | unmarked[one] | unmarked[other])
            & (smaller[one] & (n <= most_m) | smaller[other] & (m <= most_n)))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of centres that share keys, and on how many keys of this task. Of
    a pair the smaller set must be there as that; sizes and marks must allow a link.
    A key of a group counts as many as any set of its class must share.
    A task reads the keys of its buckets; a centre occurs at most once per key
    and writing task. Those of one home are settled or linked already."""
    keys, centres, homes, spans, marks = [], [], [], [], []
    for batch in batches:
        keys += [np.frombuffer(k.as_buffer(), np.uint64) for k in batch.column("keys")]
        centres += [np.frombuffer(c.as_buffer(), np.int64) for c in batch.column("centres")]
        homes += [np.frombuffer(h.as_buffer(), np.int64) for h in batch.column("homes")]
        spans += [np.frombuffer(s.as_buffer(), np.uint16).reshape(2, -1) for s in batch.column("spans")]
        marks += [np.frombuffer(m.as_buffer(), np.uint64).reshape(2, -1) for m in batch.column("marks")]
    if not keys:
        return
    keys, centres, homes, spans, marks = _once(np.concatenate(keys), np.concatenate(centres), np.concatenate(homes),
                                               np.concatenate(spans, axis=1), np.concatenate(marks, axis=1))
    smaller, keys = (keys & np.uint64(1)).astype(bool), keys >> np.uint64(1)
    order = np.lexsort((~smaller, keys))
    smaller, keys, centres, homes = smaller[order], keys[order], centres[order], homes[order]
    spans, marks = spans[:, order], marks[:, order]
    classes = (keys & np.uint64(31)).astype(np.int64)
    counts = np.where(classes > 0, (MARKED << classes) // TENTH, 1)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    lengths = np.diff(np.append(starts, len(keys)))
    # Each set that may be the smaller one with all behind it in its list.
    behind = np.repeat(starts + lengths, lengths) - np.arange(len(keys)) - 1
    first = np.flatnonzero(smaller & (behind > 0))
    behind = behind[first]
    out_a, out_x, out_n, waiting, begin, total = [], [], [], 0, 0, np.cumsum(behind)
    while begin < len(first):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] - behind[begin] + TESTED_PAIRS, side="right")))
        one = np.repeat(first[begin:end], behind[begin:end])
        other = ragged(first[begin:end] + 1, behind[begin:end])
        begin = end
        met = homes[one] != homes[other]
        one, other = one[met], other[met]
        met = _may_link(spans, marks, smaller, one, other)
        out_a.append(centres[one[met]])
        out_x.append(centres[other[met]])
        out_n.append(counts[one[met]])
        waiting += len(out_a[-1])
        if waiting >= LIST_PAIRS:
            yield _counted_pairs(out_a, out_x, out_n)
            out_a, out_x, out_n, waiting = [], [], [], 0
    if waiting:
        yield _counted_pairs(out_a, out_x, out_n)


def _counted_pairs(out_a: list, out_x: list, out_n: list) -> pa.RecordBatch:
    a, x, n = np.concatenate(out_a), np.concatenate(out_x), np.concatenate(out_n)
    a, x = np.minimum(a, x), np.maximum(a, x)
    order = np.lexsort((x, a))
    a, x, n = a[order], x[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (x[1:] != x[:-1]))))
    return pa.record_batch([pa.array(a[first]), pa.array(x[first]), pa.array(np.add.reduceat(n, first))],
                           names=["a", "x", "keys"])


def choose_boundary(sizes: list[tuple[int, int]], list_length: float) -> int:
    """The size up to which sets are enumerated, from (size, number of sets)
    and the mean length of an element's list: the smallest total cost."""
    total = {n: c for n, c in sizes}
    scan = {n: c * (n - int(needed(n)) + 1) * (1 + VERIFY_COST * list_length) for n, c in total.items()}
    best, best_cost = 0, sum(scan.values())
    cost = best_cost
    for n in sorted(total):
        p = min(n, n - int(needed(n)) + 2)
        cost += total[n] * p * (p - 1) / 2 - scan[n]
        if cost < best_cost:
            best, best_cost = n, cost
    return best


OWN_NODES = 1 << 62        # from here on nodes are hashes, below they are ids


def with_node(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``node``, never null, that only rows equal in id and
    text share: the id, or a hash of id and text from :data:`OWN_NODES` on where
    the id is missing, repeated or as large as that."""
    ids = docs.select(F.col(id_col).cast("long").alias("twice"))
    twice = ids.filter(F.col("twice") < OWN_NODES).groupBy("twice").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    twice = small_side(spill(twice.select("twice"), "jaccard-repeated-ids"), F.count(F.lit(1)) * 16)
    i = F.col("d").getField(id_col).cast("long")
    own = F.xxhash64(i, F.col("d").getField(text_col)).bitwiseAND(F.lit(OWN_NODES - 1)).bitwiseOR(F.lit(OWN_NODES))
    names = [c for c in docs.columns if c != "node"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("d"))
    joined = rows.join(twice, i == F.col("twice"), "left")
    node = F.when((i < OWN_NODES) & F.col("twice").isNull(), i).otherwise(own)
    return joined.select(*(F.col("d").getField(c).alias(c) for c in names), node.alias("node"))


def jaccard_links(docs: DataFrame, id_col: str = "node", text_col: str = "text"):
    """(classes, links): ``doc, n, rep`` per row, where ``doc`` is the row's node
    and rows with equal sets share ``rep`` (their smallest node), and the
    confirmed links ``a, x`` between representatives: all that it takes to
    reach every linked row (links inside a star are those to its centre)."""
    spark = docs.sparkSession
    n_parts = partitions(spark)
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    profile = spill(docs.mapInArrow(_profile, PROFILE), "jaccard-profile")
    rows = profile.filter("doc IS NOT NULL").select("doc", "n", "sig1", "sig2", "sketch")
    repeats = (profile.filter("element IS NOT NULL").groupBy("element")
               .agg(F.sum("times").alias("times"), F.sum("told").alias("told")).filter("times > 1 OR told > 1"))
    repeats = spill(repeats, "jaccard-repeats")

    signature = ["sig1", "sig2", "n"]
    reps = spill(rows.filter("n > 0").groupBy(*signature).agg(F.min("doc").alias("rep")), "jaccard-reps")
    classes = spill(rows.select("doc", *signature).join(reps, signature, "left")
                    .select("doc", "n", F.coalesce("rep", "doc").alias("rep")), "jaccard-classes")

    # Stars: a set's centre is the least (by a hash of the id) of the sets that share
    # one of its eight sketch values, if it is that for two of them. Linked sets
    # share six on average, sets with a passage in common often one; links that no
    # star has are found by keys.
    chosen = (rows.filter("n > 0").select(*signature, "doc", F.explode("sketch").alias("key"))
              .join(reps.withColumnRenamed("rep", "doc"), [*signature, "doc"])
              .select("doc", "n", "key"))
    chosen = spill(chosen, "jaccard-sketch")
    least = (chosen.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc").alias("order"), "doc", "n")).alias("c"),
                                       F.count(F.lit(1)).alias("size")).filter("size > 1")
             .select("key", F.col("c.doc").alias("a"), F.col("c.n").alias("a_n")))
    proposed = (chosen.join(least, "key").filter("doc != a AND 4 * n >= 3 * a_n AND 4 * a_n >= 3 * n")
                .groupBy("a", F.col("doc").alias("x")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("a", "x"))
    verify = _Verifier(docs)
    counted = verify(spill(proposed, "jaccard-proposed"), "jaccard-stars")
    star_links = counted.filter(LINK)
    centres = star_links.join(star_links.select(F.col("x").alias("a")).distinct(), "a", "left_anti")
    stars = spill(centres.groupBy("x").agg(F.max(F.struct((F.col("shared") / F.col("joined")).alias("j"), "a")).alias("s"))
                  .select(F.col("x").alias("doc"), F.col("s.a").alias("centre"), (1 - F.col("s.j")).alias("d")),
                  "jaccard-stars-of")

    # Crowds of near copies are settled by differences from what they have in common.
    links = star_links.select("a", "x")
    together = lambda links: components(links.select(F.col("a").alias("u"), F.col("x").alias("v")))
    known = together(links)
    held = star_homes(counted.filter(f"NOT ({LINK})"), known, stars)
    # Sets that star links connect need not meet either. A component that is no
    # crowd is a home; those of its sets that are held against a crowd are left out.
    homes = held.select("doc", "home").unionByName(
        known.select(F.col("node").alias("doc"), F.col("component").alias("home")).join(held.select("doc"), "doc", "left_anti"))
    homes = spill(homes, "jaccard-homes")
    if not held.isEmpty():
        links = links.unionByName(settle(docs, held))
        known = together(links)

    # The order of elements, and the boundary between small and large sets.
    often = F.greatest("times", F.when(F.col("told") > 1, F.col("told") * ORDER_SHARE).otherwise(0))
    heavy = (repeats.select("element", often.alias("times")).filter("times > 2")
             .orderBy(F.desc("times"), "element").limit(HEAVY).toPandas().sort_values(["times", "element"]))
    heavy = heavy["element"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(heavy)
    heavy = spark.sparkContext.broadcast((heavy[order], order + 1))
    total = rows.agg(F.sum("n").alias("t")).first()["t"] or 0
    extra = repeats.filter("times > 1").agg(F.sum(F.col("times") * F.log2("times")).alias("t")).first()["t"] or 0
    # At most one row per set size; sizes beyond 4096 are never enumerated.
    sizes = [(r["n"], r["c"]) for r in rows.filter("n BETWEEN 1 AND 4096").groupBy("n")
             .agg(F.count(F.lit(1)).alias("c")).collect()]
    boundary = choose_boundary(sizes, extra / max(1, total))

    # Keys, in the name of the centre. Documents that repeat another's set
    # write none.
    special = (classes.filter("n > 0").join(stars, classes.rep == stars.doc, "left")
               .select(classes.doc, "rep", "centre").filter("doc != rep OR centre IS NOT NULL")
               .groupBy("doc").agg(F.min("rep").alias("rep"), F.min("centre").alias("centre")))
    special = special.join(homes, "doc", "full").withColumn("rep", F.coalesce("rep", "doc"))
    special = small_side(spill(special, "jaccard-special"), F.count(F.lit(1)) * 48)
    writers = (docs.join(special, "doc", "left").filter("rep IS NULL OR rep = doc")
               .select("doc", "centre", "home", "text"))
    buckets = 2 * n_parts         # a task holds all keys of its buckets
    keys = writers.mapInArrow(_write_keys(heavy, boundary, buckets, grouped=True), KEYS)
    met = keys.repartition(buckets, "bucket").mapInArrow(_meet, "a long, x long, keys long")
    met = spill(met.groupBy("a", "x").agg(F.sum("keys").alias("keys")), "jaccard-met")

    # Pairs of centres that are not connected yet.
    reps_n = classes.filter("doc = rep").groupBy("rep").agg(F.max("n").alias("n"))
    radius = stars.groupBy("centre").agg(F.max("d").alias("r"))
    side = lambda s: (reps_n.join(radius, reps_n.rep == radius.centre, "left")
                      .select(F.col("rep").alias(s), F.col("n").alias(f"{s}_n"), F.coalesce("r", F.lit(0.0)).alias(f"{s}_r")))
    sized = lambda pairs: pairs.join(side("a"), "a").join(side("x"), "x")

    def unconnected(pairs: DataFrame, known: DataFrame) -> DataFrame:
        label = lambda s: known.select(F.col("node").alias(s), F.col("component").alias(f"{s}_c"))
        return (pairs.join(label("a"), "a", "left").join(label("x"), "x", "left")
                .filter(F.coalesce("a_c", "a") != F.coalesce("x_c", "x")).drop("a_c", "x_c"))

    apart = sized(unconnected(met, known))
    # Two sets alone can only link if their sizes allow it. Linked members of
    # two stars share the keys that the smaller of them must share at least;
    # a member has at least 3/4 of its centre's size.
    apart = apart.filter("a_r > 0 OR x_r > 0 OR (4 * a_n >= 3 * x_n AND 4 * x_n >= 3 * a_n)")
    least_n = lambda s: F.when(F.col(f"{s}_r") > 0, F.expr(f"(3 * {s}_n + 3) div 4")).otherwise(F.col(f"{s}_n"))
    must = lambda n: F.when(n <= boundary, 1).otherwise(F.greatest(F.lit(1), F.floor(n / TENTH)))
    apart = apart.filter(F.col("keys") >= F.least(must(least_n("a")), must(least_n("x")))).select("a", "x")
    apart = spill(apart, "jaccard-apart")

    # So are those that only their keys bring together.
    settled = crowd_links(docs, apart, known, stars)
    if settled:
        links = links.unionByName(settled[0])
        known = together(links)
        apart = spill(unconnected(settled[1], known), "jaccard-apart")

    # Where many centres are near each other, a few pairs of each are checked
    # first; pairs that their links connect need no check.
    between = None
    for turn in range(MOST_TURNS):
        ends = apart.select(F.col("a").alias("node"), F.col("x").alias("other")).unionByName(
            apart.select(F.col("x").alias("node"), F.col("a").alias("other")))
        picked = ends.groupBy("node").agg(F.count(F.lit(1)).alias("size"), *(
            F.min(F.struct(F.xxhash64("other", F.lit(turn * PICKS + i)).alias("order"), "other")).alias(f"p{i}")
            for i in range(PICKS)))
        picked = spill(picked.select("node", "size", F.array(*(f"p{i}.other" for i in range(PICKS))).alias("others")),
                       "jaccard-picked")
        crowd = picked.agg(F.count(F.lit(1)).alias("nodes"), F.sum("size").alias("ends")).first()
        if not crowd["nodes"] or crowd["ends"] <= 4 * PICKS * crowd["nodes"]:
            break
        first = picked.select("node", F.explode("others").alias("other")).select(
            F.least("node", "other").alias("a"), F.greatest("node", "other").alias("x")).distinct()
        first = spill(first, "jaccard-first")
        counted = verify(first, f"jaccard-turn-{turn}")
        between = counted if between is None else between.unionByName(counted)
        links = links.unionByName(counted.filter(LINK).select("a", "x"))
        known = together(links)
        apart = spill(unconnected(apart.join(first, ["a", "x"], "left_anti"), known), "jaccard-apart")
    counted = verify(apart, "jaccard-centres")
    between = counted if between is None else between.unionByName(counted)
    links = links.unionByName(counted.filter(LINK).select("a", "x"))

    # Members of stars that are near enough for a link between them.
    near = (sized(unconnected(between.filter(f"NOT ({LINK})"), known))
            .withColumn("slack", 0.25 + 1e-9 - (1 - F.col("shared") / F.col("joined")))
            .filter("(a_r > 0 OR x_r > 0) AND slack + a_r + x_r >= 0").select("a", "x", "slack", "x_r"))
    near = spill(near, "jaccard-near")
    members = stars.select("centre", "doc", "d").unionByName(
        near.select(F.explode(F.array("a", "x")).alias("centre")).distinct()
        .select("centre", F.col("centre").alias("doc"), F.lit(0.0).alias("d")))
    member = lambda s: members.select(F.col("centre").alias(s), F.col("doc").alias(f"{s}_m"), F.col("d").alias(f"{s}_d"))
    with_n = lambda s: reps_n.select(F.col("rep").alias(f"{s}_m"), F.col("n").alias(f"{s}_mn"))
    inner = (near.join(member("a"), "a").filter("slack + a_d + x_r >= 0")
             .join(member("x"), "x").filter("slack + a_d + x_d >= 0 AND (a_m != a OR x_m != x)")
             .join(with_n("a"), "a_m").join(with_n("x"), "x_m")
             .filter("4 * a_mn >= 3 * x_mn AND 4 * x_mn >= 3 * a_mn")
             .select(F.col("a_m").alias("a"), F.col("x_m").alias("x")).distinct())
    inner = verify(spill(inner, "jaccard-inner"), "jaccard-members")
    links = links.unionByName(inner.filter(LINK).select("a", "x"))
    return classes, links


def row_components(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``node, doc_id, n_shingles, component_id`` per row of :func:`with_node`."""
    classes, links = jaccard_links(rows, "node", text_col)
    found = components(links.select(F.col("a").alias("u"), F.col("x").alias("v")))
    # A node below OWN_NODES is its row's id; the others' ids are looked up.
    own = rows.filter(F.col("node") >= OWN_NODES).select("node", F.col(id_col).cast("long").alias("own_id")).distinct()
    own = spill(own, "jaccard-own-nodes")
    labels = spill(classes.join(found, classes.rep == found.node, "left")
                   .select(F.col("doc").alias("node"), "n", F.coalesce("component", "rep").alias("component")),
                   "jaccard-labels")
    labels = labels.join(small_side(own, F.count(F.lit(1)) * 24), "node", "left")
    # A component's least node is its least id among rows whose node is the id.
    least = (labels.filter("own_id IS NOT NULL").groupBy("component").agg(F.min("own_id").alias("least_id")))
    least = small_side(spill(least, "jaccard-least-ids"), F.count(F.lit(1)) * 24)
    real = lambda c: F.when(F.col(c) < OWN_NODES, F.col(c))
    return (labels.join(least, "component", "left")
            .select("node", F.coalesce(real("node"), "own_id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.least(real("component"), "least_id").alias("component_id")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document (see the module).

    A null or wordless text has the empty set and links with nothing. Rows
    with equal sets are linked. Rows that share an id, or have none, are
    documents of their own, linked by their texts only (rows equal in id and
    text are alike). A component's id is the smallest id of its rows, null
    if none has one. Other columns are ignored. An empty table gives no rows.
    """
    rows = with_node(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return row_components(rows).drop("node")
