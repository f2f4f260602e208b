"""Exact duplicates by a tree-merge of sorted digest runs (operator 1).

Every document becomes an entry (SHA-256 of its normalised text, its
smallest id, a count). Documents are dealt over P = radix^d leaf slots by a
hash of the id, so a text with very many copies starts on all slots alike.
Each slot holds one run, sorted by digest. The slots then exchange runs in
d binomial rounds: in round r, groups of ``radix`` slots that differ only
in digit r trade entries so that digit r of an entry's slot becomes digit r
of its digest's bucket. A slot merges the runs it receives in digest order
and folds equal neighbours, keeping the smallest id and the sum of the
counts, so a text with any number of copies is at most one entry per slot
after the first merge. After d rounds each digest is whole in one slot.

Equal digests count as equal texts only if the byte length and a second,
independent 64-bit hash agree too; this is checked at every level.

The verdict goes back along (slot, digest) pairs, never along the digest
alone, so a hot text meets no hot join key.

Memory: Spark's external sort merges the runs and its sorted aggregation
folds them as a stream; no task holds a group or a run, and no Python
worker stands beside the executor's heap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, partitions, spill

SPACES = "[\\x20\\x09-\\x0D]+"
KEY = ("digest", "check", "n_bytes")


def normalised(text):
    """The text with each run of ASCII white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _merge(runs: DataFrame, slots: int) -> DataFrame:
    """Bring each slot's runs together, merge them in digest order, fold equals.

    The least id is taken of a struct, which Spark folds as a stream over
    sorted rows: the merge is an external sort, and nothing is held but the
    open entry. Rows of a slot are in one partition already."""
    return (runs.repartition(slots, "slot")
            .groupBy("slot", *KEY)
            .agg(F.min("bucket").alias("bucket"), F.min(F.struct("id")).alias("least"), F.sum("n").alias("n"))
            .select("slot", "bucket", *KEY, F.col("least.id").alias("id"), "n"))


def tree_shape(partitions: int, most: int) -> tuple[int, int]:
    """(radix, rounds) with ``radix ** rounds`` slots, at least ``partitions``:
    as few rounds as a radix of at most ``most`` allows, then the smallest radix."""
    rounds = 1
    while most ** rounds < partitions:
        rounds += 1
    radix = 2
    while radix ** rounds < partitions:
        radix += 1
    return radix, rounds


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                most: int = 8) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of ASCII white space is
    replaced by one space; a null text is the empty text, which is a text
    like any other (all empty documents are one group). ``keep_id`` is the
    smallest id of the group; a null id counts as larger than all others,
    and a group of null ids has a null ``keep_id``. Rows that share the
    smallest id are one document and all stay. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    radix, rounds = tree_shape(partitions(spark), most)
    slots = radix ** rounds
    text = normalised(F.col(text_col))
    entries = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("t")
    ).select(
        "doc_id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.xxhash64("t").alias("check"),
        F.octet_length("t").cast("long").alias("n_bytes"),
    ).withColumn("slot", F.pmod(F.xxhash64("doc_id", "n_bytes"), F.lit(slots)).cast("int"))
    entries = spill(entries, "digests")

    bucket = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % slots
    leaves = spill(_merge(entries.select(
        "slot", bucket.cast("int").alias("bucket"), *KEY,
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.lit(1).cast("long").alias("n")), slots), "leaves")

    runs = leaves
    for r in range(rounds):
        step = radix ** r
        digit = lambda c: F.floor(F.col(c) / step) % radix
        runs = _merge(runs.withColumn(
            "slot", (F.col("slot") + (digit("bucket") - digit("slot")) * step).cast("int")), slots)

    roots = runs.select(*KEY, F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    verdicts = leaves.select("slot", *KEY).join(roots, list(KEY))
    return (entries.join(verdicts, ["slot", *KEY])
            .withColumn("keep_id", F.when(F.col("keep_id") != NO_ID, F.col("keep_id")))
            .select("doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))
