"""Chat formatting of conversations with a loss mask, in Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into
one block, their texts apart by a separator mark, so that they can be told apart again:

    <|im_start|>role NEWLINE text <|im_sep|> text <|im_end|> NEWLINE

Control strings inside texts and roles are escaped: a backslash is doubled, then <| becomes <\\|; in a role a
newline becomes \\n as well. The loss mask has one flag for each text of the formatted string, in order: those
of the trained role are under it, marks and other roles are not.

One row is one conversation, so the longest conversation has to fit in a row, as its formatted text does.

Defined results: null texts and roles are empty; turns sort by turn (null last), then role, then text, so
repeated turns stay, next to each other; a null conv_id is a conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # split at doubled backslashes, from the left: a single one that is left belongs to a newline or a mark
    parts = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")))
    return F.array_join(parts, "\\")


def format_chats(rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss, an array with a flag for each text of formatted."""
    turn = F.struct(F.col("turn").isNull().alias("late"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    places = F.sequence(F.lit(1), F.size("turns"))
    starts = F.filter(places, lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"]))
    started = sorted_.withColumn("starts", starts)

    def block(start: Column, k: Column) -> Column:
        after = F.coalesce(F.get("starts", k + 1), F.size("turns") + 1)
        texts = F.array_join(F.transform(F.slice("turns", start, after - start), lambda t: escape(t["text"])), SEPARATOR)
        return F.concat(F.lit(START), escape_role(F.get("turns", start - 1)["role"]), F.lit("\n"), texts, F.lit(END))

    loss = F.transform("turns", lambda t: t["role"] == trained_role)
    return started.select("conv_id", F.array_join(F.transform("starts", block), "").alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns, structs of role and text, that a formatted text holds."""

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(head) + 2, F.length(block) - F.length(head) - 1 - len(END))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(unescape_role(head).alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, r"<\|im_start\|>", -1)
    return F.flatten(F.transform(F.slice(blocks, 2, F.size(blocks)), turns))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text of formatted under the loss mask, unescaped."""
    return F.array_join(F.filter(read_turns(formatted)["text"], lambda t, i: F.get(loss, i)), "")
