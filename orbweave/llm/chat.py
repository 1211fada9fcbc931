"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as assistant, the others as named
users, system turns as system. A rendering is a table of segments in order with their character offsets, so a
conversation of any length is rendered without gathering it: turns are dealt in blocks of BLOCK turn numbers, and what
stands before a block comes from small sums per block and speaker. The mask of a segment is the span that the
participant's own turns train on (text and end mark).

Defined cases: a null role is the speaker "unknown"; a null text is empty; a null turn comes last; equal turns are
ordered by role, then text (repeated rows are segments of their own); a null conv_id is one conversation; other columns
are ignored; a conversation of system turns only has no participant and no rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 256
START, END = "<|im_start|>", "<|im_end|>"
LAST_TURN = (1 << 62) - 1


def _length(*parts: str | Column) -> Column:
    return sum((F.lit(len(p)) if isinstance(p, str) else F.char_length(p) for p in parts), F.lit(0)).cast("long")


def rotate_perspectives(turns: DataFrame, system: str = "system") -> DataFrame:
    """Per conversation, participant and turn of turns(conv_id, turn, role, text): the rendered segment.

    Columns: conv_id, perspective, turn, speaker, rendered_role, segment, start, length, mask_start, mask_length
    (character positions in the whole rendering; mask_length 0 where nothing is trained on).
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("place", F.coalesce(F.col("turn").cast("long"), F.lit(LAST_TURN)))
    t = t.withColumn("block", F.floor(F.col("place") / BLOCK))
    named = F.when(F.col("speaker") == system, _length(START, "system\n", F.col("text"), END, "\n")).otherwise(
        _length(START, "user name=", F.col("speaker"), "\n", F.col("text"), END, "\n")
    )
    t = t.withColumn("named", named)
    # Small tables: one row per conversation, block and speaker.
    sums = t.groupBy("conv_id", "block", "speaker").agg(F.count("*").alias("n"), F.sum("named").alias("named"))
    by_block = Window.partitionBy("conv_id").orderBy("block")
    blocks = sums.groupBy("conv_id", "block").agg(F.sum("named").alias("named"))
    blocks = blocks.select("conv_id", "block", (F.sum("named").over(by_block) - F.col("named")).alias("before"))
    people = sums.filter(F.col("speaker") != system).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    frame = blocks.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("speaker").alias("s"), "n")
    frame = frame.join(own, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")) & (F.col("perspective") == F.col("s")), "left")
    by_own = Window.partitionBy("conv_id", "perspective").orderBy("block")
    n = F.coalesce("n", F.lit(0))
    frame = frame.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "perspective", "before", (F.sum(n).over(by_own) - n).alias("own_before"))
    # Texts are dealt once, by conversation and block.
    t = t.join(frame, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    inside = Window.partitionBy("conv_id", "block", "perspective").orderBy("place", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    is_own = F.col("speaker") == F.col("perspective")
    t = t.withColumn("named_before", F.coalesce(F.sum("named").over(inside), F.lit(0)) + F.col("before"))
    t = t.withColumn("turns_before", F.coalesce(F.sum(is_own.cast("long")).over(inside), F.lit(0)) + F.col("own_before"))
    # A turn rendered as assistant is shorter or longer than the named one by a constant for each speaker.
    shift = F.lit(len("assistant")) - (F.lit(len("user name=")) + F.char_length("perspective"))
    role = F.when(is_own, F.lit("assistant")).when(F.col("speaker") == system, F.lit("system")).otherwise(F.lit("user"))
    head = F.concat(F.lit(START), F.when(role == "user", F.concat(F.lit("user name="), "speaker")).otherwise(role), F.lit("\n"))
    t = t.withColumn("rendered_role", role).withColumn("segment", F.concat(head, "text", F.lit(END + "\n")))
    t = t.withColumn("start", F.col("named_before") + shift * F.col("turns_before")).withColumn("length", F.char_length("segment").cast("long"))
    return t.select(
        "conv_id", "perspective", "turn", "speaker", "rendered_role", "segment", "start", "length",
        F.when(is_own, F.col("start") + F.char_length(head)).alias("mask_start"),
        F.when(is_own, (F.char_length("text") + len(END)).cast("long")).otherwise(0).alias("mask_length"),
    )
