"""Links inside crowds of near copies, by differences from a common reference.

A crowd is a large component of links found so far; sets that may link with
its members are held against it too. Its reference R holds the elements that
more than half of the members have. With D(x) the symmetric difference of a set
x and R, two sets differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| elements, and
they link just when 7 times that is at most |x| + |y|. With the excess
e(x) = 7 |D(x)| - |x| this reads e(x) + e(y) <= 14 |D(x) & D(y)|. So

* a set whose excess is outweighed by that of the member nearest to R links
  with it: one test a set, and no other pair of such sets matters;
* any other set must share ceil((e(x) + e(nearest)) / 14) elements of D(x)
  with its partner. Elements that no other set's difference holds are left out
  first; what remains is often too little. Otherwise one of the rarest
  elements is shared (all but that many less one), and pairs come from
  an equality join on those. The partner with less excess e must share
  ceil(e / 7) itself, so only its rarest (all but that many less one) are met.

So pairs that have no more in common than the crowd itself are never formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, spill
from .shingles import shingle_sets
from .words import chunks

LEAST_MEMBERS = 16         # smaller components are checked pair by pair
LEAST_PAIRS = 4            # so are those with fewer pairs a set
SLICE_CHARS = 4 << 20


def _slices(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in chunks(texts, SLICE_CHARS):
            elements, sizes = shingle_sets(texts[a:b])
            yield batch.slice(a, b - a), elements.view(np.int64), sizes


def _count_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many members of a slice have an element, by crowd."""
    for batch, elements, sizes in _slices(batches):
        home = np.repeat(batch.column("home").to_numpy(), sizes)
        order = np.lexsort((elements, home))
        home, elements = home[order], elements[order]
        if len(home):
            new = (home[1:] != home[:-1]) | (elements[1:] != elements[:-1])
            first = np.flatnonzero(np.concatenate(([True], new)))
            yield pa.record_batch([pa.array(home[first]), pa.array(elements[first]),
                                   pa.array(np.diff(np.append(first, len(home))))],
                                  names=["home", "element", "times"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, elements, sizes in _slices(batches):
        references = batch.column("reference")
        ends = np.cumsum(sizes)
        differences = [np.setxor1d(elements[end - n:end], references[i].values.to_numpy(), assume_unique=True)
                       for i, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True))]
        offsets = np.concatenate(([0], np.cumsum([len(d) for d in differences]))).astype(np.int32)
        values = np.concatenate([np.empty(0, np.int64), *differences])
        yield pa.record_batch([batch.column("doc"), batch.column("home"), pa.array(sizes),
                               pa.ListArray.from_arrays(offsets, pa.array(values))],
                              names=["doc", "home", "n", "difference"])


def homes_of(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc, home, own`` of the sets in ``pairs`` (``a, x``) that are held against a
    crowd: its own one, else the one with which it has most pairs."""
    crowds = known.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= LEAST_MEMBERS)
    crowd_of = spill(known.join(crowds.select("component"), "component").select("node", "component"), "crowds-of")
    of = lambda s: crowd_of.select(F.col("node").alias(s), F.col("component").alias(f"{s}_home"))
    both = pairs.join(of("a"), "a", "left").join(of("x"), "x", "left").filter("a_home IS NOT NULL OR x_home IS NOT NULL")
    sides = F.array(*(F.struct(F.col(s).alias("doc"), F.coalesce(f"{s}_home", f"{t}_home").alias("home"),
                               F.col(f"{s}_home").isNotNull().alias("own")) for s, t in ("ax", "xa")))
    votes = both.select(F.inline(sides)).groupBy("doc", "own", "home").agg(F.count(F.lit(1)).alias("c"))
    homes = votes.groupBy("doc").agg(F.max(F.struct("c", (-F.col("home")).alias("less"), "own")).alias("v"))
    homes = homes.select("doc", (-F.col("v.less")).alias("home"), F.col("v.own").alias("own"))
    return spill(homes, "crowds-homes")


def crowd_links(docs: DataFrame, pairs: DataFrame, known: DataFrame, stars: DataFrame):
    """(links ``a, x``, the pairs left) for candidate ``pairs`` of centres.

    ``docs`` has the texts by ``doc``, ``known`` the components of links so far,
    ``stars`` a ``centre`` for each ``doc`` that its centre stands for. Pairs
    of which both sides are held against one crowd are settled here,
    the members of their stars included, by links that connect all that are
    linked; the others are returned. None where there is no crowd.
    """
    homes = homes_of(pairs, known)
    side = lambda s: homes.select(F.col("doc").alias(s), F.col("home").alias(f"{s}_home"))
    placed = pairs.join(side("a"), "a", "left").join(side("x"), "x", "left")
    within = placed.filter("a_home = x_home").groupBy(F.col("a_home").alias("home")).agg(F.count(F.lit(1)).alias("pairs"))
    worth = (homes.groupBy("home").agg(F.count(F.lit(1)).alias("sets")).join(within, "home")
             .filter(F.col("pairs") >= LEAST_PAIRS * F.col("sets")).select("home"))
    worth = spill(worth, "crowds-worth")
    if worth.isEmpty():
        return None
    homes = homes.join(worth, "home")
    left = (placed.join(worth.select(F.col("home").alias("settled")), (F.col("a_home") == F.col("x_home"))
                        & (F.col("a_home") == F.col("settled")), "left_anti").select("a", "x"))
    # The centres and all that they stand for.
    held = homes.select("doc", "home", "own").unionByName(
        stars.join(homes.select(F.col("doc").alias("centre"), "home", "own"), "centre").select("doc", "home", "own"))
    held = spill(held.groupBy("doc").agg(F.min("home").alias("home"), F.max("own").alias("own")), "crowds-held")
    return settle(docs, held), left


def star_homes(apart: DataFrame, known: DataFrame, stars: DataFrame) -> DataFrame:
    """``doc, home, own`` of the sets in large components of ``known`` and of those
    that came near one as a centre or a member of a proposed star without a link
    (``apart``: pairs ``a, x``). A star is held whole against one crowd."""
    crowds = known.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= LEAST_MEMBERS)
    inside = known.join(crowds.select("component"), "component").select(F.col("node").alias("doc"), F.col("component").alias("home"))
    inside = spill(inside, "crowds-inside")
    near = apart.select("a", "x").unionByName(apart.select(F.col("x").alias("a"), F.col("a").alias("x")))
    votes = (near.join(inside.withColumnRenamed("doc", "a"), "a").select(F.col("x").alias("doc"), "home")
             .join(inside.select("doc"), "doc", "left_anti").join(stars.select("doc"), "doc", "left_anti")
             .groupBy("doc", "home").agg(F.count(F.lit(1)).alias("c")))
    outside = spill(votes.groupBy("doc").agg(F.max(F.struct("c", "home")).alias("v")).select(
        "doc", F.col("v.home").alias("home")), "crowds-outside")
    theirs = stars.select("doc", "centre").join(outside.withColumnRenamed("doc", "centre"), "centre").select("doc", "home")
    held = inside.withColumn("own", F.lit(True)).unionByName(
        outside.unionByName(theirs).withColumn("own", F.lit(False)))
    return spill(held, "crowds-star-homes")


def settle(docs: DataFrame, held: DataFrame) -> DataFrame:
    """Links ``a, x`` that connect all sets of ``held`` (``doc, home, own``) which are
    linked within a home. ``own`` marks the members, which make the reference."""
    texts = spill(docs.join(small_side(held, F.count(F.lit(1)) * 24), "doc").dropDuplicates(["doc"]), "crowds-texts")

    members = held.filter("own").groupBy("home").agg(F.count(F.lit(1)).alias("members"))
    counts = (texts.filter("own").select("home", "text")
              .mapInArrow(_count_elements, "home long, element long, times long")
              .groupBy("home", "element").agg(F.sum("times").alias("times")))
    references = (counts.join(members, "home").filter("2 * times > members")
                  .groupBy("home").agg(F.collect_list("element").alias("elements")))
    references = members.select("home").join(references, "home", "left").select(
        "home", F.coalesce("elements", F.expr("CAST(array() AS ARRAY<LONG>)")).alias("reference"))
    references = small_side(spill(references, "crowds-references"), F.sum(F.size("reference") + 4) * 8)
    sets = (texts.join(references, "home").select("doc", "home", "text", "reference")
            .mapInArrow(_differences, "doc long, home long, n long, difference array<long>")
            .withColumn("excess", (7 * F.size("difference") - F.col("n")).cast("long")))
    sets = spill(sets.filter("n > 0"), "crowds-differences")

    nearest = sets.groupBy("home").agg(F.min(F.struct("excess", "doc")).alias("v")).select(
        "home", F.col("v.doc").alias("nearest"), F.col("v.excess").alias("least"))
    nearest = small_side(spill(nearest, "crowds-nearest"), F.count(F.lit(1)) * 24)
    ranked = sets.join(nearest, "home")
    links = ranked.filter("excess + least <= 0 AND doc != nearest").select(
        F.least("doc", "nearest").alias("a"), F.greatest("doc", "nearest").alias("x"))

    # Elements in two differences or more, rarest first.
    elements = sets.select("home", "doc", F.explode("difference").alias("element"))
    shared = elements.groupBy("home", "element").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    rare = elements.join(shared, ["home", "element"]).groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("times", "element"))).alias("rare"))
    need = F.greatest(F.lit(0), F.ceil((F.col("excess") + F.col("least")) / 14))
    rare = spill(ranked.join(rare, "doc").select("home", "doc", "excess", F.size("rare").alias("s"), need.alias("need"),
                                                 F.col("rare.element").alias("rare")).filter("s >= need"), "crowds-rare")
    found = (rare_meetings(rare).filter("14 * least(s, p_s) >= excess + p_excess")
             .select(F.least("p", "doc").alias("a"), F.greatest("p", "doc").alias("x")).distinct())
    found = spill(found, "crowds-found")
    of = lambda s: sets.select(F.col("doc").alias(s), F.col("difference").alias(f"{s}_d"), F.col("excess").alias(f"{s}_e"))
    linked = (found.join(of("a"), "a").join(of("x"), "x")
              .filter("14 * size(array_intersect(a_d, x_d)) >= a_e + x_e").select("a", "x"))
    return spill(links.unionByName(linked), "crowds-links")


def rare_meetings(rare: DataFrame) -> DataFrame:
    """``p, p_excess, p_s, doc, excess, s`` for each rare element on which two sets of
    a home meet, from rows ``home, doc, excess, s, need, rare`` (``s`` elements,
    rarest first).

    Of a pair, the set with more excess looks for the other: it shares at least
    ``need``, which the nearest member leaves, and the other at least what its
    own excess asks of both. So both have a shared element among their rarest."""
    rarest = lambda least: F.slice("rare", F.lit(1), (F.col("s") - least + 1).cast("int"))
    own = F.greatest(F.lit(1), F.ceil(F.col("excess") / 7))
    index = rare.filter(F.col("s") >= own).select("home", "doc", "excess", "s", F.explode(rarest(own)).alias("element"))
    probe = rare.filter("need > 0").select(
        "home", F.col("doc").alias("p"), F.col("excess").alias("p_excess"), F.col("s").alias("p_s"),
        F.explode(rarest(F.col("need"))).alias("element"))
    return (probe.join(index, ["home", "element"])
            .filter("p_excess > excess OR p_excess = excess AND p > doc").drop("home", "element"))
