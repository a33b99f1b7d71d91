"""Chat formatting with multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and the
others as named users; system turns stay system turns. The loss mask of a rendering is the list of character
spans of the assistant's contents with their end marks.

The whole dialogue is one rendering, so renderings are as many characters as participants times dialogue, which is what rotation
asks for; one is a string, of at most 2 GB. A message's place is a running sum over its conversation, and a speaker's spans
follow from the places of its own messages, so masks take as long as there are messages.

Defined results: a null text is empty; a null role is a speaker of its own, named `_null`; null turns come after all
others, a null conversation id is a conversation. Messages with one turn number follow each other by role (null first)
and text; messages that repeat are repeated. Marks inside a text are broken up. Names that don't start with a letter,
digit or hyphen or hold other characters than these and `_` are written as `_` and the hexadecimal form of their
UTF-8 bytes, so that different speakers have different names. A conversation of system turns alone has no participants
and no rows. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.windows import running

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, ASSISTANT, USER = "system", "assistant", "user name="


def _name(role: Column) -> Column:
    plain = role.rlike(r"^[A-Za-z0-9-][A-Za-z0-9_-]*\z")
    return F.when(role.isNull(), "_null").when(plain, role).otherwise(F.concat(F.lit("_"), F.lower(F.hex(F.encode(role, "UTF-8")))))


def _heading(role: Column, perspective: Column) -> Column:
    other = F.concat(F.lit(USER), _name(role))
    return F.when(role == SYSTEM, F.lit(SYSTEM)).when(role.eqNullSafe(perspective), F.lit(ASSISTANT)).otherwise(other)


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, perspective, n_messages, rendered, mask array<struct<start, end>>), one row per participant."""
    clean = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    rows = turns.select(F.col(conversation).alias("conv"), F.col(turn).isNull().alias("late"), F.col(turn).alias("turn"), F.col(role).alias("role"), clean.alias("text"))
    # Pieces are as long in all renderings but the speaker's own, where `assistant` stands for its name.
    frame = len(f"{OPEN}\n{CLOSE}\n")
    named = F.when(F.col("role") == SYSTEM, F.lit(len(SYSTEM))).otherwise(F.char_length(_name(F.col("role"))) + len(USER))
    sized = rows.withColumn("size", (frame + named + F.char_length("text")).cast("bigint"))
    placed = running(sized, ["conv"], [F.col(c).asc() for c in ("late", "turn", "role", "text")], {"upto": F.col("size")})
    own = F.sort_array(F.collect_list(F.struct("upto", "size", F.char_length("text").alias("chars"))))
    speakers = placed.filter(F.col("role").isNull() | (F.col("role") != SYSTEM)).groupBy(F.col("conv").alias("who"), F.col("role").alias("perspective")).agg(own.alias("own"))
    shorter = F.char_length(_name(F.col("perspective"))) + len(USER) - len(ASSISTANT)
    begin = lambda m, i: m.upto - m.size - i * shorter + len(f"{OPEN}{ASSISTANT}\n")
    mask = F.transform("own", lambda m, i: F.struct(begin(m, i).cast("int").alias("start"), (begin(m, i) + m.chars + len(CLOSE)).cast("int").alias("end")))
    message = F.struct("late", "turn", "role", "text")
    dialogues = rows.groupBy("conv").agg(F.sort_array(F.collect_list(message)).alias("msgs"))
    both = dialogues.join(speakers, dialogues.conv.eqNullSafe(speakers.who))
    pieces = F.transform("msgs", lambda m: F.concat(F.lit(OPEN), _heading(m.role, F.col("perspective")), F.lit("\n"), m.text, F.lit(CLOSE + "\n")))
    return both.select(F.col("conv").alias(conversation), "perspective", F.size("msgs").cast("bigint").alias("n_messages"), F.array_join(pieces, "").alias("rendered"), mask.alias("mask"))


def rotation_digests(turns: DataFrame, **columns: str) -> DataFrame:
    """rotate with the rendering and mask as lengths, a digest and a string."""
    found = rotate(turns, **columns)
    conversation = found.columns[0]
    masked = F.aggregate("mask", F.lit(0).cast("bigint"), lambda n, s: n + s.end - s.start)
    spans = F.array_join(F.transform("mask", lambda s: F.concat(s.start.cast("string"), F.lit("-"), s.end.cast("string"))), ",")
    return found.select(
        conversation, "perspective", "n_messages", F.char_length("rendered").cast("bigint").alias("n_chars"), masked.alias("masked_chars"), F.sha2("rendered", 256).alias("rendered_sha256"), spans.alias("mask")
    )
