"""Mixing sources to target weights by temperature (operator 3).

A source's share of all tokens, p, becomes the weight q = p^a / sum(p^a).
At a = 1 the mix is the corpus as it is; at a = 0 all sources weigh the
same. The exponent is found by bisection on a grid of ``steps`` + 1 values
in [0, 1]: the largest that still reaches a target entropy, or the smallest
that keeps every source's repetitions within a limit of those of the least
repeated source. A pass evaluates many grid values at once in one
aggregation over the sources, which stands for several halvings.

A source's weight becomes a budget of tokens, realised as whole passes over
its documents and a part of one more. Each pass visits the source's blocks
(documents dealt by a hash of what tells them apart, about ``block_tokens`` tokens each)
in a permutation of its own, and each block's documents in another. Only
the block that the budget ends in is ordered document by document, so no
step sorts a source, however large it is.

Everything is DataFrame expressions; the driver sees the exponent only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, spill

WORD = "[^\\x20\\x09-\\x0D]+"
GRID_POINTS = 100     # grid values of one bisection pass


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _hash(*parts) -> Column:
    """60 bits of the MD5 of the parts joined by ``|``; null reads as ``null``."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def find_exponent(shares: DataFrame, reached: Column, steps: int, largest: bool) -> float:
    """Bisect ``reached`` (an aggregate over rows ``p, a``), which holds on one
    side of the grid only: the largest grid value where it holds, or the
    smallest; the far end (0 for largest, 1 for smallest) if it never does."""
    low, high = (0, steps + 1) if largest else (-1, steps)
    while high - low > 1:
        stride = max(1, math.ceil((high - low) / (GRID_POINTS + 1)))
        points = list(range(low + stride, high, stride))
        held = {r["k"]: r["held"] for r in
                shares.select("p", F.explode(F.array(*(F.lit(k) for k in points))).alias("k"))
                .withColumn("a", F.col("k") / steps).groupBy("k").agg(reached.alias("held")).collect()}
        for k in points:
            if bool(held.get(k)) == largest:
                low = k
            else:
                high = k
                break
    return (low if largest else high) / steps


def _block_side(blocks: DataFrame) -> DataFrame:
    """Blocks for a join to documents: a row per ``block_tokens`` words, so they
    are broadcast while they are few and no text is shuffled."""
    return small_side(blocks, F.sum(F.length("skey") + 40))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        min_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None,
        block_tokens: int = 4_000_000, steps: int = 10_000, seed: int = 17) -> DataFrame:
    """``docs`` in their mix: a row per visit, with the columns ``mix_epoch``
    (from 0), ``mix_block`` and ``mix_order``; sorted by these within a source
    they are its stream.

    ``min_entropy`` is a share of the greatest possible entropy, ln(number of
    sources); ``max_repeats`` limits how often a source is seen for one pass
    over the least repeated. Give exactly one. ``budget`` is in words
    (tokens); without one it is the smallest that shows every document at
    least once. A source ends with the document in which its budget ends.

    A null source is a source of its own. Sources without any word have no
    weight and are visited once. Rows are documents of their own even if
    they repeat an id or have none: they are dealt and ordered by id and text,
    and rows equal in both by a number that each is given once. A null text
    has no words. Other columns stay; ``mix_epoch``, ``mix_block`` and ``mix_order``
    of the input are replaced. An empty table gives an empty result.
    """
    if (min_entropy is None) == (max_repeats is None):
        raise ValueError("give either min_entropy or max_repeats")
    kept = [c for c in docs.columns if c not in ("mix_epoch", "mix_block", "mix_order")]
    doc_id, source = F.col(f"d.`{id_col}`"), F.col(f"d.`{source_col}`")
    key = F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string")))
    # Rows whose id is missing or repeated are told apart by their texts.
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    alike = docs.select(F.col(id_col).cast("string").alias("i"), text.alias("h")).groupBy("i", "h").agg(
        F.count(F.lit(1)).alias("alike"))
    alike = spill(alike, "mix-alike")
    many = alike.groupBy(F.col("i").alias("j")).agg(F.sum("alike").alias("rows")).filter("j IS NULL OR rows > 1")
    repeated = spill(alike.join(many, F.col("i").eqNullSafe(F.col("j")), "left_semi"), "mix-repeated")
    repeated = small_side(repeated, F.count(F.lit(1)) * 64)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("d"))
    rows = rows.select("d", key.alias("skey"), word_count(F.col(f"d.`{text_col}`")).alias("tokens"),
                       doc_id.cast("string").alias("id"), F.md5(F.coalesce(F.col(f"d.`{text_col}`"), F.lit(""))).alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    who = F.when(F.col("alike").isNull(), F.col("id")).otherwise(F.concat_ws(
        "|", F.coalesce("id", F.lit("null")), "text", F.when(F.col("alike") > 1, F.col("row").cast("string"))))
    rows = (rows.join(repeated, F.col("id").eqNullSafe(F.col("i")) & (F.col("text") == F.col("h")), "left")
            .select("d", "skey", "tokens", who.alias("who")))
    # The numbers are given here, once; all else reads them from the table.
    rows = spill(rows, "mix-rows").withColumn("deal", _hash(F.lit(seed), F.lit("block"), F.col("who")))

    sizes = rows.select("skey", "tokens", "deal", "who")
    totals = spill(sizes.groupBy("skey").agg(F.sum("tokens").alias("total")), "mix-totals")
    everything = F.sum("total").over(Window.partitionBy())
    shares = totals.filter("total > 0").select("skey", "total", (F.col("total") / everything).alias("p"))
    if min_entropy is not None:
        z, zl = F.sum(F.pow("p", "a")), F.sum(F.pow("p", "a") * F.log("p"))
        reached = F.log(z) - F.max("a") * zl / z >= min_entropy * F.log(F.count(F.lit(1)).cast("double"))
    else:
        reached = F.pow(F.max("p") / F.min("p"), 1 - F.max("a")) <= max_repeats
    exponent = find_exponent(shares, reached, steps, largest=min_entropy is not None)

    all_sources = Window.partitionBy()   # one row per source
    weights = (shares.withColumn("w", F.pow("p", F.lit(exponent)))
               .withColumn("q", F.col("w") / F.sum("w").over(all_sources)))
    words = F.lit(budget).cast("double") if budget is not None else F.max(F.col("total") / F.col("q")).over(all_sources)
    weights = weights.withColumn("goal", F.round(words * F.col("q")).cast("long"))
    plan = totals.join(weights.select("skey", "goal"), "skey", "left").select(
        "skey", "total",
        F.greatest(F.lit(1), F.ceil(F.col("total") / block_tokens)).cast("long").alias("n_blocks"),
        F.when(F.col("total") == 0, 1).otherwise(F.expr("goal div total")).cast("int").alias("epochs"),
        F.when(F.col("total") == 0, 0).otherwise(F.col("goal") % F.col("total")).alias("rest"))
    plan = spill(plan, "mix-plan")

    # Blocks: their size, their place in the partial pass, and what of it the
    # budget covers.
    dealt = sizes.join(plan, "skey").withColumn("block", F.col("deal") % F.col("n_blocks"))
    blocks = dealt.groupBy("skey", "block").agg(
        F.sum("tokens").alias("b_tokens"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"))
    order = Window.partitionBy("skey").orderBy(
        _hash(F.lit(seed), F.lit("pass"), F.col("epochs"), F.col("skey"), F.col("block")), "block")
    blocks = blocks.withColumn("before", F.coalesce(
        F.sum("b_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = spill(blocks.select("skey", "block", "epochs", F.greatest(
        F.lit(0), F.col("rest") - F.col("before")).alias("room"), "b_tokens"), "mix-blocks")
    cut_order = _hash(F.lit(seed), F.lit("doc"), F.col("epochs"), F.col("who"))
    in_block = Window.partitionBy("skey", "block").orderBy("o", "tokens")
    cuts = (dealt.select("skey", "block", "who", "tokens")
            .join(_block_side(blocks.filter("room > 0 AND room < b_tokens")), ["skey", "block"])
            .withColumn("o", cut_order)
            .withColumn("before", F.coalesce(F.sum("tokens").over(
                in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .filter(F.col("before") < F.col("room"))
            .groupBy("skey", "block").agg(F.max("o").alias("cut")))
    blocks = blocks.join(cuts, ["skey", "block"], "left").select(
        "skey", "block", "epochs", (F.col("room") > 0).alias("more"),
        F.when(F.col("room") < F.col("b_tokens"), F.col("cut")).alias("cut"))

    visits = (rows.join(plan.select("skey", "n_blocks"), "skey")
              .withColumn("block", F.col("deal") % F.col("n_blocks"))
              .join(_block_side(spill(blocks, "mix-cuts")), ["skey", "block"])
              .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
              .withColumn("o", _hash(F.lit(seed), F.lit("doc"), F.col("epoch"), F.col("who")))
              .filter((F.col("epoch") < F.col("epochs"))
                      | (F.col("more") & (F.col("cut").isNull() | (F.col("o") <= F.col("cut"))))))
    place = _hash(F.lit(seed), F.lit("pass"), F.col("epoch"), F.col("skey"), F.col("block"))
    return visits.select(*(F.col(f"d.`{c}`").alias(c) for c in kept), F.col("epoch").cast("int").alias("mix_epoch"),
                         place.alias("mix_block"), F.col("o").alias("mix_order"))
