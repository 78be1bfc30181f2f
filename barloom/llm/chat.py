"""Chat formatting with Spark expressions only.

A conversation becomes one string. Its turn structs are collected and sorted; adjacent turns of one role
share one block. Template, with ``<|`` reserved for the marks:

    <|role|>ROLE<|text|>TEXT<|next|>TEXT ... <|end|>

Texts and roles are escaped: ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, so marks never occur in
them and reading back is exact.

Cases: null roles and texts are empty; equal turn numbers go by role, then text; a null turn number comes
first; a null conversation id is one conversation; repeated rows are turns of their own; an empty
table gives no rows. Columns other than the four named are not read. A conversation is one value, and so as large as its texts:
its turns are gathered in each map task before they are shuffled, and every step over them takes time in
proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, NEXT, END = "<|role|>", "<|text|>", "<|next|>", "<|end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """Per conversation: conv_id, pieces, formatted.

    pieces: array of (piece, loss), the formatted string cut where the loss mask changes; loss is true for the texts
    of role ``learn``. formatted is the pieces' concatenation.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sorted_turns = turns.select(F.col(conv_id).alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    plain = lambda piece: F.struct(piece.alias("piece"), F.lit(False).alias("loss"))

    def pieces(row: Column, at: Column) -> Column:
        before = F.get("turns", at - 1)["role"]
        head = F.concat(F.when(at > 0, F.lit(END)).otherwise(F.lit("")), F.lit(ROLE), escaped(row["role"]), F.lit(TEXT))
        mark = F.when((at > 0) & (before == row["role"]), F.lit(NEXT)).otherwise(head)
        return F.array(plain(mark), F.struct(escaped(row["text"]).alias("piece"), (row["role"] == learn).alias("loss")))

    cut = F.concat(F.flatten(F.transform("turns", pieces)), F.array(plain(F.lit(END))))
    return sorted_turns.select("conv_id", cut.alias("pieces")).select("conv_id", "pieces", F.array_join("pieces.piece", "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.split(F.substring(formatted, len(ROLE) + 1, 2147483647), r"<\|end\|>(?:<\|role\|>|\z)")
    # the last block's end mark leaves one empty string behind
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        parts = F.split(block, r"<\|text\|>", 2)
        texts = F.split(F.get(parts, F.lit(1)), r"<\|next\|>")
        return F.transform(texts, lambda t: F.struct(unescaped(F.get(parts, F.lit(0))).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped: a piece ends with a whole escape, so all can be read at once."""
    return unescaped(F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: p["piece"]), ""))
