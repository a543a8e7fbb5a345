"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of one role merged with array
aggregation, and written into one string. The template marks a turn as::

    <s>[role]\\x1ftext\\x1f...</s>          (one block for each run of one role)

and control characters inside roles and texts are escaped, so that no text can close a block:
``\\`` -> ``\\\\``, ``<`` -> ``\\l``, ``[`` -> ``\\b``, unit separator -> ``\\u``. Escaping is reversible: :func:`parse_chats`
reads roles, texts and the loss mask back from the formatted string alone.

Cases: a null text is empty; a null role is the empty role; rows without conv_id form one conversation
with a null id; rows of equal turn are ordered by role, then text; repeated rows are kept; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "\x1f"
OPEN, CLOSE = "<s>[", "</s>"


def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("<"), F.lit("\\l"))
    out = F.replace(out, F.lit("["), F.lit("\\b"))
    return F.replace(out, F.lit(SEP), F.lit("\\u"))


def unescape(c: Column) -> Column:
    """Split at doubled backslashes, undo the other escapes in the parts, join with one backslash."""

    def undo(p: Column) -> Column:
        p = F.replace(p, F.lit("\\l"), F.lit("<"))
        p = F.replace(p, F.lit("\\b"), F.lit("["))
        return F.replace(p, F.lit("\\u"), F.lit(SEP))

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), undo), "\\")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (code point [start, end) pairs of the
    escaped texts that train, in order). ``turns`` has conv_id, turn, role, text."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))

    def piece(t: Column, i: Column) -> Column:
        same = (i > 0) & (F.try_element_at("t", F.greatest(i, F.lit(1))).getField("role") == t["role"])
        opened = F.concat(F.lit(OPEN), escape(t["role"]), F.lit("]"))
        head = F.when(same, F.lit(SEP)).when(i > 0, F.concat(F.lit(CLOSE), opened, F.lit(SEP))).otherwise(F.concat(opened, F.lit(SEP)))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("trains"))

    pieces = chats.select("conv_id", F.transform("t", piece).alias("p"))
    spans_of = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(acc: Column, p: Column) -> Column:
        start = acc["pos"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("pos"), F.when(p["trains"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("p", F.struct(F.lit(0).cast("bigint").alias("pos"), spans_of.alias("spans")), add)["spans"]
    text = F.concat(F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"])), ""), F.lit(CLOSE))
    return pieces.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Read (conv_id, formatted, loss_spans) back: adds turns (array of role, text) and loss_texts."""
    inner = F.expr(f"substring(formatted, {len(OPEN) + 1}, length(formatted) - {len(OPEN) + len(CLOSE)})")
    blocks = F.split(inner, r"</s><s>\[", -1)

    def read(b: Column) -> Column:
        parts = F.split(b, SEP, -1)
        role = unescape(F.substring(parts[0], F.lit(1), F.length(parts[0]) - 1))
        return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", F.flatten(F.transform(blocks, read))).withColumn("loss_texts", loss)
