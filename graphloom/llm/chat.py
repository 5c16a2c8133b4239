"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

A turn is written `<turn>### role`, a line feed, the text and `</turn>` with a line feed. In roles and
texts a backslash, "<" and "#" are written as \\b, \\l and \\h (and a line feed of a role as \\n), so none
of the template's marks can stand inside them, and reading back is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BREAK, CLOSE = "<turn>### ", "\n", "</turn>\n"
#: Fixed order: the backslash is escaped first and read back last.
_ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), ("\n", "\\n")]


def escape(text: Column, of_role: bool = False) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _ESCAPES if of_role else _ESCAPES[:3], text)


def unescape(text: Column) -> Column:
    """What `escape` was given. Every backslash in escaped text is followed by its letter."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), _ESCAPES[::-1], text)


def format_chats(turns: DataFrame, target: str = "assistant") -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end, whole): one row per turn of the target role.

    An example is all turns up to its target turn; only that turn's text, the code points from loss_start
    to before loss_end, is trainable. A conversation that ends with another role has one more example of
    all its turns, with nothing to train (loss_start = loss_end), so that no turn is lost; whole marks the
    example with all turns. turns has conv_id, turn, role, text. Turns go by (turn, role, text), nulls
    first; null texts and roles are empty; repeated rows are turns each. One shuffle brings a
    conversation together; examples are made from it row by row, so a task holds one conversation. Long texts
    are formatted whole; as each example repeats the turns before it, a conversation's examples grow with the
    square of its turns.
    """
    told = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    both = told.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"], True), F.lit(BREAK))
    shown = lambda t: F.struct(F.length(head(t)).alias("head"), F.concat(head(t), escape(t["text"]), F.lit(CLOSE)).alias("all"), (t["role"] == target).alias("hit"))
    made = both.select("conv_id", F.transform("turns", shown).alias("shown"))
    n = F.size("shown")
    last = F.filter(F.array(n), lambda k: ~F.element_at("shown", -1)["hit"])
    at = F.concat(F.filter(F.sequence(F.lit(1), n), lambda k: F.element_at("shown", k.cast("int"))["hit"]), last)
    each = made.select("conv_id", "shown", F.posexplode(at).alias("example", "k"))
    text = F.array_join(F.transform(F.slice("shown", 1, F.col("k")), lambda s: s["all"]), "")
    each = each.select("conv_id", "example", text.alias("formatted"), F.element_at("shown", F.col("k")).alias("t"), (F.col("k") == n).alias("whole"))
    end = F.length("formatted") - len(CLOSE)
    start = F.length("formatted") - F.length("t.all") + F.col("t.head")
    return each.select("conv_id", "example", "formatted", F.when(F.col("t.hit"), start).otherwise(end).alias("loss_start"), end.alias("loss_end"), "whole")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    parts = F.filter(F.split(formatted, CLOSE, -1), lambda x: F.length(x) > 0)

    def turn(x: Column) -> Column:
        body = F.substring(x, len(OPEN) + 1, 2147483647)
        role = F.substring_index(body, BREAK, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The text under an example's loss mask."""
    return unescape(F.substr(formatted, start + 1, end - start))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: its turns, their digest, the trainable text's digest and sizes."""
    spelled = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id", "example", F.length("formatted").cast("long").alias("chars"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        F.when(F.col("whole"), F.struct(F.size(read_turns(F.col("formatted"))).cast("long").alias("n"), F.sha2(spelled, 256).alias("sha"))).alias("turns"),
    )
    by = read.groupBy("conv_id").agg(
        F.max("turns").alias("turns"), F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
    )
    return by.select(
        "conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )
