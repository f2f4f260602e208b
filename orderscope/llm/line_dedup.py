"""Line dedup by fingerprints of line hashes (operator 9).

A text is cut into lines: at line ends and after sentence ends, so that a
passage set into another paragraph still shares whole lines with its other
copies. Lines without a word are no part of the sequence that is compared.
In scripts without spaces a character counts as a word.

A fingerprint is the hash of a stretch of whole lines that has ``min_words``
words: from each line on the shortest such stretch, and up to each line the
shortest. A passage of at least ``min_words`` words, in one line or in many,
is the union of the stretches that lie in it, and each of them has the same
hash in every copy. No stretch is left out (a winnowing window of one
stretch): a passage just long enough may hold no other.

Fingerprints that occur more than once are joined to their first place in
the corpus, in order of (document, line), never to each other. So exactly
those lines are deleted that lie in a stretch of ``min_words`` words which
stands at an earlier place too, in another text or in the same one; the
first copy of a line always stays. Which earlier place it is makes no
difference, so one that shares a single stretch hides no longer passage.

Documents left with less than ``min_left`` of their words are dropped.

Everything is DataFrame expressions. Partial minima are folded before the
shuffle and the join back is an ordinary skew-splittable one, so a very
frequent line does not land in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, spill

# Scripts written without spaces; their sentences need none at their ends.
UNSPACED = (r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u9FFF\uA000-\uA4CF\uAC00-\uD7AF\uF900-\uFAFF"
            r"\uFF66-\uFF9F\x{20000}-\x{3FFFF}")
CUT = r"(?<=[\n.!?])(?:(?<=\n)|(?=[ \t]))"
FULL_STOPS = "。！？"
CUT_WITH_FULL_STOPS = CUT + f"|(?<=[{FULL_STOPS}])"
BLANK = " \t\n\r\x0b\x0c"


def lines_of(text: Column) -> Column:
    """The lines of a text; joined they give the text again. Null is empty."""
    text = F.coalesce(text, F.lit(""))
    has_stops = reduce(or_, (text.contains(c) for c in FULL_STOPS))
    return F.when(has_stops, F.split(text, CUT_WITH_FULL_STOPS, -1)).otherwise(F.split(text, CUT, -1))


def _body(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _has_odd_space(text: Column) -> Column:
    """Whether words may be set apart by anything but one space."""
    odd = text.contains("  ")
    for c in "\t\r\x0b\x0c":
        odd = odd | text.contains(c)
    return odd


def _words_in(body: Column, odd_space: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; where characters take two bytes or more on
    average, each of a script without spaces is a word of its own."""
    return (F.when(F.length(body) == 0, 0)
            .when(F.octet_length(body) >= 2 * F.length(body),
                  F.regexp_count(body, F.lit(f"[{UNSPACED}]|[^\\x20\\x09-\\x0D{UNSPACED}]+")))
            .when(odd_space, F.regexp_count(body, F.lit("[^\\x20\\x09-\\x0D]+")))
            .otherwise(F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit(""))) + 1))


def words_of(line: Column, odd_space: Column) -> Column:
    """Words of a line."""
    return _words_in(_body(line), odd_space)


def _two(a: Column, b: Column) -> Column:
    """Two line numbers as one long, ordered by the first; null if one is null."""
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def _document(doc_id: Column, text: Column) -> list[Column]:
    """The columns that tell documents apart and order them."""
    return [F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("doc"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash")]


def _once(*columns: Column | str) -> list[Column]:
    """The columns as a step of their own: behind a generator they are worked out
    once a row, not again in each place that uses them."""
    return [F.inline(F.array(F.struct(*columns)))]


def _with_sums(lines: DataFrame, m: int) -> tuple[DataFrame, list[int]]:
    """Arrays ``n2``, ``n4``, ... of the words in so many lines from each line on,
    made of ``n1``, for stretches of fewer than ``m`` lines; and these sizes."""
    sizes = [1]
    while sum(sizes) < m - 1:
        k = sizes[-1]
        longer = F.transform(f"n{k}", lambda x, i: x + F.coalesce(F.get(f"n{k}", i + k), F.lit(0)))  # noqa: B023
        lines = lines.select(*lines.columns, *_once(longer.alias(f"n{2 * k}")))
        sizes.append(2 * k)
    return lines, sizes


def _with_reach(lines: DataFrame, name: str, forwards: bool, sizes: list[int], m: int) -> DataFrame:
    """Columns ``{name}_lines`` and ``{name}_words`` of the shortest stretch from
    line ``pos`` on, or back from it, that has ``m`` words; where there are fewer,
    of one that has fewer. Found by halving; every step is generated code."""
    size, words = f"{name}_lines", f"{name}_words"
    keep = lines.columns
    lines = lines.select(*keep, F.lit(0).alias(size), F.lit(0).alias(words))
    place = lambda k: F.col("pos") + F.col(size) if forwards else F.col("pos") - F.col(size) - (k - 1)
    for k in reversed(sizes):
        more = F.col(words) + F.get(f"n{k}", place(k))      # null beyond an end
        lines = lines.select(*keep, F.when(more < m, F.col(size) + k).otherwise(F.col(size)).alias(size),
                             F.when(more < m, more).otherwise(F.col(words)).alias(words))
    return lines.select(*keep, (F.col(size) + 1).alias(size),
                        (F.col(words) + F.coalesce(F.get("n1", place(1)), F.lit(0))).alias(words))


def repeated_runs(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """Later copies of stretches: ``doc, text_hash, runs`` where ``runs`` is an
    array of (start, end) line numbers, both included, by start. Runs may
    overlap."""
    m = max(1, min_words)
    odd = _has_odd_space(F.coalesce(F.col("text"), F.lit("")))
    split = docs.select(*_document(F.col("doc_id"), F.col("text")), *_once(
        F.transform(lines_of(F.col("text")), _body).alias("bodies"), odd.alias("odd")))
    lines = F.filter(F.transform("bodies", lambda s, i: F.struct(
        i.alias("line"), F.xxhash64(s).alias("h"), _words_in(s, F.col("odd")).alias("n"))), lambda x: x["n"] > 0)
    lines = split.select("doc", "text_hash", *_once(lines.alias("lines")))
    lines = lines.select("doc", "text_hash", *_once(
        F.col("lines.line").alias("line"), F.col("lines.h").alias("h"), F.col("lines.n").alias("n1")))
    # From each line on, and up to it, the shortest stretch of enough words. One
    # that is both, from its first line and up to its last, is taken once.
    lines, sizes = _with_sums(lines, m)
    each = lines.select(*lines.columns, F.posexplode("n1").alias("pos", "own"))
    each = _with_reach(_with_reach(each, "on", True, sizes, m), "back", False, sizes, m)
    stretch = lambda first, size, whole: F.struct(first.alias("first"), size.alias("size"), whole.alias("whole"))
    each = each.select("doc", "text_hash", "line", "h", F.inline(F.array(
        stretch(F.col("pos"), F.col("on_lines"), F.col("on_words") >= m),
        stretch(F.col("pos") - F.col("back_lines") + 1, F.col("back_lines"),
                F.col("back_words") - F.col("own") >= m)))).filter("whole")
    places = each.select("doc", "text_hash",
                         _two(F.get("line", F.col("first")), F.get("line", F.col("first") + F.col("size") - 1)).alias("run"),
                         F.xxhash64(F.slice("h", F.col("first") + 1, F.col("size"))).alias("f"))
    places = spill(places, "line-fingerprints")
    first = (places.groupBy("f").agg(F.min(F.struct("doc", "text_hash", "run")).alias("e"),
                                     F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    # As a table, so that the join is a plain one whose hot lines can be split.
    first = spill(first, "line-first")
    later = places.join(first, "f").filter(F.struct("doc", "text_hash", "run") > F.col("e"))
    # The runs of one document are as many as twice its lines at most.
    return later.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("run")).alias("runs")).select(
        "doc", "text_hash", F.transform("runs", lambda r: F.struct(
            F.shiftright(r, 32).cast("int").alias("start"),
            r.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("end"))).alias("runs"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_words: int = 20, min_left: float = 0.2) -> DataFrame:
    """``docs`` with later copies of repeated runs cut out of the text, and the
    columns ``n_deleted`` (lines) and ``kept``.

    Lines are compared without white space at their ends. Documents are
    ordered by id (null last) and by a hash of the text among equal ids;
    rows equal in both are one document and are treated alike. A null text
    has no line that repeats and stays null; so does any text without a
    long enough repeat. Lines without words go with a shortest stretch that
    they stand in, not at its ends: one between two lines that have
    ``min_words`` words each stays. ``kept`` is false where something was deleted and
    less than ``min_left`` of the words remain; such rows still come with
    their remaining text. Columns ``n_deleted`` and ``kept`` of the input are
    replaced. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("n_deleted", "kept")]
    text = F.col(f"d.`{text_col}`")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("d"))
    runs = spill(repeated_runs(rows.select(F.col(f"d.`{id_col}`").alias("doc_id"), text.alias("text")),
                               min_words), "line-runs")
    joined = rows.select("d", *_document(F.col(f"d.`{id_col}`"), text)).join(runs, ["doc", "text_hash"], "left")
    # Only texts with runs are cut into lines again.
    cut = joined.withColumn("lines", F.when(F.col("runs").isNotNull(), lines_of(text)))
    odd = F.when(F.col("runs").isNotNull(), _has_odd_space(F.coalesce(text, F.lit(""))))
    cut = cut.select("d", "runs", *_once("lines", odd.alias("odd")))
    cut = cut.withColumn("words", F.transform("lines", lambda s: words_of(s, F.col("odd"))))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, w: s + w)
    # Line spans between the runs, in order: (first line, number of lines).
    spans = F.aggregate(
        F.concat("runs", F.array(F.struct(F.size("lines").alias("start"), F.size("lines").alias("end")))),
        F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<a:int,n:int>>").alias("keep")),
        lambda acc, r: F.struct(
            F.greatest(acc["next"], r["end"] + 1).alias("next"),
            F.when(r["start"] > acc["next"], F.concat(acc["keep"], F.array(F.struct(
                acc["next"].alias("a"), (r["start"] - acc["next"]).alias("n"))))).otherwise(acc["keep"]).alias("keep")),
        lambda acc: acc["keep"])
    cut = cut.withColumn("spans", F.when(F.size("runs") > 0, spans))
    pick = lambda name: F.flatten(F.transform("spans", lambda s: F.slice(name, s["a"] + 1, s["n"])))
    cut = cut.withColumn("left_lines", pick("lines")).withColumn("left_words", total(pick("words")))
    cut = cut.withColumn("touched", F.col("left_lines").isNotNull())
    # The generator keeps a filter on what it returns, such as ``kept``, above
    # itself; pushed below, the filter would repeat all of the cutting.
    result = F.struct(
        F.when(F.col("touched"), F.array_join("left_lines", "")).otherwise(text).alias("left_text"),
        F.when(F.col("touched"), F.size("lines") - F.size("left_lines")).otherwise(0).alias("n_deleted"),
        (~F.col("touched") | ((F.col("left_words") > 0)
                              & (F.col("left_words") >= min_left * total(F.col("words"))))).alias("kept"))
    done = cut.select("d", F.inline(F.array(result)))
    return done.select(*(F.col("left_text").alias(c) if c == text_col else F.col(f"d.`{c}`").alias(c) for c in names),
                       "n_deleted", "kept")
