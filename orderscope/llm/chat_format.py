"""Chat formatting by prefix-target expansion (operator 5).

Every assistant turn becomes one example: all turns before it are its
context, which is written out in the example, and only the reply's text is
trainable. So the examples of a conversation grow with the square of its
length. They are made in stretches of :data:`TURNS_PER_STRETCH` turns, each
from its own copy of the turns up to its end, so that a long conversation's
examples are spread over tasks; the examples of a stretch lie next to each
other in the output, where what their contexts have in common is compressed.

The template marks turns with control strings. Inside texts a backslash
becomes ``\\s`` and a control string gets ``\\c`` after its first character,
so none can appear there, and both steps can be undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, spill

# What stands before and after the text of a turn, by role.
# Any other role is written between the markers of OTHER.
TEMPLATE = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
    "user": ("<s>[INST] ", " [/INST]"),
    "assistant": (" ", " </s>"),
}
OTHER = ("<<ROLE>>", "\n<</ROLE>>\n")
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>")
TURNS_PER_BLOCK = 1024   # places are summed within blocks first, then over blocks
TURNS_PER_STRETCH = 256  # replies among as many turns are expanded from one copy of the turns before them


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\c{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\c"), F.lit("")), F.lit("\\s"), F.lit("\\"))


def _by_role(role: Column, side: int, other: Column) -> Column:
    out = None
    for name, marks in TEMPLATE.items():
        out = (F if out is None else out).when(role == name, F.lit(marks[side]))
    return out.otherwise(other)


def opening(role: Column) -> Column:
    return _by_role(role, 0, F.concat(F.lit(OTHER[0]), escape(role), F.lit("\n")))


def closing(role: Column) -> Column:
    return _by_role(role, 1, F.lit(OTHER[1]))


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, seq, turn, role, segment, start, trainable``.

    Turns are in order of ``turn`` (null first), then role, then text, and
    ``seq`` counts them from 1; ``start`` is the segment's first character in
    the formatted conversation. Null text or role is empty; rows with a null
    conversation are one conversation; repeated rows are turns of their own.
    Other columns are ignored. An empty table gives an empty result.

    The numbering runs over blocks of consecutive turn numbers and then over
    the blocks' totals, so a very long conversation is not one window.
    """
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).select(
        "conv_id", "turn", "role",
        F.concat(opening(F.col("role")), escape(F.col("text")), closing(F.col("role"))).alias("segment"),
        F.floor(F.col("turn") / TURNS_PER_BLOCK).alias("block"))
    rows = rows.withColumn("chars", F.char_length("segment").cast("long"))
    block_key = [F.coalesce("conv_id", F.lit(0)), F.col("conv_id").isNull(), F.col("block")]
    inside = Window.partitionBy(*block_key).orderBy(F.col("turn").asc_nulls_first(), "role", "segment")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("in_seq", F.row_number().over(inside))
            .withColumn("in_start", F.coalesce(F.sum("chars").over(before), F.lit(0))))
    blocks = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c"))
    earlier = (Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first())
               .rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"),
                           F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base_seq"),
                           F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("base_start"))
    return (rows.join(blocks, rows.conv_id.eqNullSafe(blocks.b_conv) & rows.block.eqNullSafe(blocks.b_block))
            .select("conv_id", (F.col("base_seq") + F.col("in_seq")).alias("seq"), "turn", "role", "segment",
                    (F.col("base_start") + F.col("in_start")).alias("start"),
                    (F.col("role") == "assistant").alias("trainable")))


def expand_replies(turns: DataFrame) -> DataFrame:
    """One example per assistant turn of :func:`format_turns`' rows: ``conv_id,
    target_seq, context_turns, context_chars, context, reply, loss_start, loss_end``.

    The example's text is ``context``, the segments of all turns before it,
    and then ``reply``; the loss mask is true on ``[loss_start, loss_end)`` of
    it, which is the reply's text without its marks.

    A task holds one conversation up to the end of a stretch at a time, as
    much as that stretch's last example has."""
    open_chars, close_chars = (len(s) for s in TEMPLATE["assistant"])
    stretch = lambda seq: F.floor((seq - 1) / TURNS_PER_STRETCH).cast("int")
    last = (turns.filter("trainable").groupBy(F.col("conv_id").alias("l_conv"))
            .agg(stretch(F.max("seq")).alias("last")))
    last = small_side(last, F.count(F.lit(1)) * 16)
    copies = (turns.join(last, turns.conv_id.eqNullSafe(F.col("l_conv")) & (stretch(turns.seq) <= F.col("last")))
              .select("conv_id", F.explode(F.sequence(stretch(F.col("seq")), "last")).alias("stretch"),
                      F.struct("seq", "segment", "start", "trainable").alias("turn")))
    # Turns are numbered from 1 without gaps, so a turn's number is its place in the list.
    told = copies.groupBy("conv_id", "stretch").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    replies = F.filter("turns", lambda t: t.trainable & (stretch(t.seq) == F.col("stretch")))
    before = F.slice("segments", F.lit(1), (F.col("r.seq") - 1).cast("int"))
    return (told.select("conv_id", F.col("turns.segment").alias("segments"), F.explode(replies).alias("r"))
            .select("conv_id", F.col("r.seq").alias("target_seq"), (F.col("r.seq") - 1).alias("context_turns"),
                    F.col("r.start").alias("context_chars"), F.array_join(before, "").alias("context"),
                    F.col("r.segment").alias("reply"), (F.col("r.start") + open_chars).alias("loss_start"),
                    (F.col("r.start") + F.char_length("r.segment") - close_chars).alias("loss_end")))


def example_texts(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """``conv_id, target_seq, text`` of chosen examples, made from the turns alone."""
    chosen = examples.select(F.col("conv_id").alias("c"), "target_seq")
    return (turns.join(chosen, turns.conv_id.eqNullSafe(F.col("c")) & (turns.seq <= F.col("target_seq")))
            .groupBy("conv_id", "target_seq")
            .agg(F.array_sort(F.collect_list(F.struct("seq", "segment"))).alias("parts"))
            .select("conv_id", "target_seq", F.array_join("parts.segment", "").alias("text")))


def write_examples(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Write both tables to shared storage; return (turns, examples) read back."""
    turns = spill(format_turns(conversations), "chat-turns")
    return turns, spill(expand_replies(turns), "chat-examples", codec="zstd")


def conversation_digests(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """Digests of written output, per conversation: ``conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars`` (the characters
    of its formatted turns, each once).

    Texts are cut out of the segments, the loss spans out of the examples'
    whole texts, and unescaped. A SHA-256 needs its conversation as one string,
    so this step (not the operator) holds one conversation at a time in a task."""
    role = F.col("role")
    opened, closed = F.char_length(opening(role)), F.char_length(closing(role))
    text = unescape(F.substr("segment", opened + 1, F.char_length("segment") - opened - closed))
    read = turns.select("conv_id", "seq", F.char_length("segment").alias("chars"),
                        F.concat(role, F.lit("\n"), text, F.lit("\n")).alias("line"))
    whole = read.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("lines"),
        F.sum("chars").alias("formatted_chars"))
    whole = whole.select("conv_id", "n_turns", F.sha2(F.array_join("lines.line", ""), 256).alias("turns_sha256"),
                         "formatted_chars")
    loss = examples.select(F.col("conv_id").alias("e_conv"), "target_seq", unescape(F.substr(
        F.concat("context", "reply"), (F.col("loss_start") + 1).cast("int"),
        (F.col("loss_end") - F.col("loss_start")).cast("int"))).alias("text"))
    loss = loss.groupBy("e_conv").agg(
        F.array_sort(F.collect_list(F.struct("target_seq", "text"))).alias("texts"))
    loss = loss.select("e_conv", F.array_join("texts.text", "").alias("loss")).select(
        "e_conv", F.char_length("loss").cast("long").alias("chars"), F.sha2("loss", 256).alias("sha256"))
    return (whole.join(loss, whole.conv_id.eqNullSafe(F.col("e_conv")), "left")
            .select("conv_id", "n_turns", "turns_sha256", F.coalesce("chars", F.lit(0)).cast("long").alias("loss_chars"),
                    F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("loss_sha256"), "formatted_chars"))
