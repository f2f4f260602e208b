"""Spelling variants by a relational trie frontier (operator 12).

The words are put into a trie that is a table: a row per node (a prefix) with
the letters that may follow it. A second trie in the same table holds the
words backwards; a mark in front tells the two apart. A state is (word,
position, node, edits): the word's letters before ``position`` have been spent
on the path to ``node`` with that many edits. Level by level the states of
one depth are joined with the nodes of that depth:

* with no edit yet a state may go on with the word's next letter, take
  another of the node's letters for it, or leave the letter out;
* after the edit only the word's own next letter will do;
* a one-edit state whose word is spent, on a node where a word ends, is a pair
  of neighbours.

An inserted letter is a left-out one of the other word, and of two words that
differ in a letter the one with the smaller letter finds the other; both
directions come from one find. Edits are tried in a word's second half
only: those in its first half are in the second half of the word
backwards. So no state branches near the root, where a node has many words
below it, and few do elsewhere. States without an edit are the words' own
prefixes; they are made for each level from the words, not carried along.

A node has as many rows as letters at most, and a word as many neighbours as
it has letters times the alphabet, so no group grows with the corpus; many
words on one node are a skewed join key that Spark splits. Words beyond
``LONGEST`` letters would take as many levels: from there on, words are
matched by hashes of themselves without one letter, and confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spill
from .shingles import mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST = 64               # letters of words that go through the trie
FORWARD, BACKWARD = ">", "<"
_BASE = 0x9E3779B97F4A7C15 | 1
_R, _R_INVERSE = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))


def runs_of(text: Column, min_letters: int) -> Column:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of at least ``min_letters``, A-Z
    lower-cased; null gives none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(low, F.lit("[a-zÀ-ÿ]{%d,}+" % min_letters), F.lit(0))


def count_words(words: DataFrame, min_letters: int = 7, min_count: int = 2) -> DataFrame:
    """``word, n`` of a column ``word``: those long and frequent enough. Counts
    are folded before the shuffle. Nulls are left out."""
    return (words.filter(F.length("word") >= min_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_count))


# ---- the trie frontier ----

def _key(node: Column) -> Column:
    """What states and nodes are joined by: a number sorts faster than a prefix does."""
    return F.xxhash64(node)


def _nodes(marked: DataFrame) -> DataFrame:
    """``depth, node, key, letters`` (ascending) ``, ends`` (whether a word ends there) per node.
    A word's nodes begin where the states of a word with one letter less do."""
    begin = F.lit(1) + F.expr("(length(t) - 2) div 2").cast("int")
    prefixes = marked.select("t", F.explode(F.sequence(begin, F.length("t"))).alias("depth"))
    return (prefixes.select("depth", F.substr("t", F.lit(1), F.col("depth")).alias("node"),
                            F.substr("t", F.col("depth") + 1, F.lit(1)).alias("letter"))
            .groupBy("depth", "node").agg(F.collect_set("letter").alias("letters"))
            .select("depth", "node", _key(F.col("node")).alias("key"), F.array_remove("letters", "").alias("letters"),
                    F.array_contains("letters", "").alias("ends")))


STATES = "array<struct<pos:int,key:bigint,node:string>>"


def _step(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """One level: ``t, pos, key, node`` of what follows the states ``t, pos, key, edits``;
    ``node`` is the word found, null while there is none."""
    rows = states.join(nodes, "key")
    t, pos, node, letters, ends = (F.col(c) for c in ("t", "pos", "node", "letters", "ends"))
    here, after = F.substr("t", pos + 1, F.lit(1)), F.substr("t", pos + 2, F.lit(1))
    state = lambda p, n: F.struct(p.cast("int").alias("pos"), _key(n).alias("key"), F.lit(None).cast("string").alias("node"))
    found = F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).cast("long").alias("key"), node.alias("node")))
    none = F.array().cast(STATES)
    one = lambda s: F.array(s)
    last = pos + 1 == F.length("t")
    replaced = F.transform(F.filter(letters, lambda x: x > here), lambda x: state(pos + 1, F.concat(node, x)))
    left_out = (F.when(last & ends, found)
                .when(~last & (here != after) & F.array_contains(letters, after),
                      one(state(pos + 2, F.concat(node, after)))).otherwise(none))
    edited = (F.when((pos == F.length("t")) & ends, found)
              .when((pos < F.length("t")) & F.array_contains(letters, here),
                    one(state(pos + 1, F.concat(node, here)))).otherwise(none))
    branching = F.size(letters) + ends.cast("int") > 1
    follow = (F.when(F.col("edits") == 1, edited).when(branching, F.concat(replaced, left_out)).otherwise(none))
    return rows.select("t", F.inline(follow))


def _trie_pairs(words: DataFrame) -> DataFrame:
    """``word, near`` of words of at most LONGEST letters: each pair once or more, in one order."""
    ends = words.agg(F.min(F.length("word")).alias("least"), F.max(F.length("word")).alias("most")).first()
    marked = spill(words.select(F.explode(F.array(
        F.concat(F.lit(FORWARD), "word"), F.concat(F.lit(BACKWARD), F.reverse("word")))).alias("t")), "variant-words")
    if ends["least"] is None:
        return words.select("word", F.col("word").alias("near")).limit(0)
    nodes = _nodes(marked).repartitionByRange(F.col("depth"), F.col("key"))
    nodes = _by_depth(nodes, "variant-nodes")
    states, found = None, []
    for depth in range(1 + ends["least"] // 2, ends["most"] + 2):
        # The marked word has length + 1 letters, the mark being spent; a word without an edit that is spent is done.
        fresh = marked.filter((F.length("t") > depth) & (F.lit(1) + F.expr("(length(t) - 1) div 2") <= depth)).select(
            "t", F.lit(depth).alias("pos"), _key(F.substr("t", F.lit(1), F.lit(depth))).alias("key"), F.lit(0).alias("edits"))
        states = fresh if states is None else fresh.unionByName(states)
        stepped = spill(_step(states, nodes.filter(F.col("depth") == depth).drop("depth")), "variant-states")
        found.append(stepped.filter("node IS NOT NULL").select("t", "node"))
        states = stepped.filter("node IS NULL").select("t", "pos", "key", F.lit(1).alias("edits"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    plain = lambda c: F.when(F.substr(c, F.lit(1), F.lit(1)) == FORWARD, F.expr(f"substr({c}, 2)")).otherwise(
        F.reverse(F.expr(f"substr({c}, 2)")))
    # Nodes that share a key lead states to words that are not near, never past one that is.
    return pairs.select(plain("t").alias("word"), plain("node").alias("near")).filter(
        F.levenshtein("word", "near", 1) == 1)


def _by_depth(nodes: DataFrame, name: str) -> DataFrame:
    """The nodes as a table in folders by depth, so that a level reads its own only."""
    from .common import scratch

    spark, path = nodes.sparkSession, scratch(nodes.sparkSession, name)
    nodes.write.partitionBy("depth").parquet(path)
    return spark.read.schema(nodes.schema).parquet(path)


# ---- words too long for the levels ----

def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, place, key``: hashes of a word without the letter at each place, and of
    all of it (place -1). Linear in the letters."""
    for batch in batches:
        for word in batch.column("word").to_pylist():
            points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            n = len(points)
            power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _R))), dtype=np.uint64)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(points * power[:n], dtype=np.uint64)))
            without = sums[:-1] + (sums[-1] - sums[1:]) * _R_INVERSE
            keys = np.concatenate((without + np.uint64(n - 1) * power[n - 1], sums[-1:] + np.uint64(n) * power[n]))
            place = np.concatenate((np.arange(n), [-1]))
            yield pa.record_batch([pa.array([word] * (n + 1)), pa.array(place),
                                   pa.array(np.ascontiguousarray(mix(keys)).view(np.int64))],
                                  names=["word", "place", "key"])


def _long_pairs(words: DataFrame) -> DataFrame:
    keys = spill(words.mapInArrow(_shortened, "word string, place long, key long"), "variant-long")
    other = keys.select(F.col("word").alias("near"), F.col("place").alias("near_place"), "key")
    # A letter replaced: equal without the letter at one place. One left out: equal to the other word without it.
    replaced = keys.filter("place >= 0").join(other, "key").filter("place = near_place AND word < near")
    left_out = keys.filter("place >= 0").join(other.filter("near_place = -1"), "key")
    return (replaced.select("word", "near").unionByName(left_out.select("word", "near")).distinct()
            .filter(F.levenshtein("word", "near", 1) == 1))


def near_words(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``word, near``: every ordered pair of distinct words (column ``word``) that
    differ by exactly one inserted, deleted or replaced code point."""
    pairs = _trie_pairs(words.filter(F.length("word") <= longest).select("word"))
    # A long word's neighbours have one letter less at least.
    if words.filter(F.length("word") > longest).limit(1).count():
        pairs = pairs.unionByName(_long_pairs(words.filter(F.length("word") >= longest).select("word")))
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


# ---- groups ----

def variant_groups(counts: DataFrame, factor: int = 10, longest: int = LONGEST) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per row of ``word, n`` (words distinct).

    ``form`` is the near word of largest n (ties: the smallest in code-point
    order) if its n is at least ``factor`` times the word's, else null;
    ``root`` is where forms lead to, the word itself if it has none;
    ``n_near`` is the number of near words. ``factor`` must be 2 at least, so
    that forms cannot lead back. Rows with a null or empty word are left
    out, other columns ignored. An empty table gives no rows.
    """
    if factor < 2:
        raise ValueError("factor must be 2 at least")
    words = spill(counts.select("word", F.col("n").cast("long").alias("n")).filter("length(word) > 0"), "variant-counts")
    near = near_words(words, longest).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    is_form = -F.col("best.n") >= factor * F.col("n")
    found = spill(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")),
        "variant-forms")
    # Forms grow by the factor each time, so they are followed in a few rounds, each twice as far as the last.
    roots = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    moved = 1
    while moved:
        there = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = spill(roots.join(there, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        moved = roots.filter("moved").limit(1).count()
        roots = roots.drop("moved")
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
