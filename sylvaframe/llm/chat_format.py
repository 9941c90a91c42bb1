"""Chat formatting with Spark expressions only.

Turn rows of a conversation are collected as structs and sorted by turn; neighbouring turns with one role are merged
into a block by array aggregation, and the blocks are concatenated:

    <|start|>role<|message|>text<|next|>text<|end|>

`<|next|>` parts the texts of a merged block, so nothing of the original turns is lost. Inside roles and texts each
backslash is doubled and `<|` becomes `<`, backslash, `|`, so marks never occur there and reading back is exact.

Null texts and roles count as empty; null turns sort first, rows with equal turns are ordered by role and text, and
repeated rows stay. Rows with a null conversation id form one conversation. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MESSAGE, NEXT, END = "<|start|>", "<|message|>", "<|next|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The inverse of `escape`: only there a single backslash stands between `<` and `|`, all others are doubled."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def block_starts(turns: Column) -> Column:
    """Positions (from 0) of turns whose role differs from the one before."""
    places = F.sequence(F.lit(0), F.size(turns) - 1)
    return F.filter(places, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))


def blocks_of(turns: Column) -> Column:
    """Blocks of role and escaped texts, in order."""
    starts = block_starts(turns)
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(turns)))
    return F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda x: F.struct(
            F.get(turns, x["a"])["role"].alias("role"),
            F.transform(F.slice(turns, x["a"] + 1, x["b"] - x["a"]), lambda t: t["text"]).alias("texts"),
        ),
    )


def head(block: Column) -> Column:
    return F.concat(F.lit(START), block["role"], F.lit(MESSAGE))


def body(block: Column) -> Column:
    return F.array_join(block["texts"], NEXT)


def format_chats(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """`id_col`, formatted (string) and loss_spans: start (from 0) and length of each loss_role block's body, in code points."""
    rows = turns.select(
        turns[id_col].alias("id"),
        F.struct(
            turns[turn_col].alias("turn"),
            escape(F.coalesce(turns[role_col].cast("string"), F.lit(""))).alias("role"),
            escape(F.coalesce(turns[text_col], F.lit(""))).alias("text"),
        ).alias("turn"),
    )
    chats = rows.groupBy("id").agg(F.sort_array(F.collect_list("turn")).alias("turns")).select("id", blocks_of(F.col("turns")).alias("blocks"))
    parts = chats.select(
        "id",
        F.transform("blocks", lambda b: F.struct(head(b).alias("head"), body(b).alias("body"), (b["role"] == loss_role).alias("loss"))).alias("parts"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(done: Column, part: Column) -> Column:
        here = done["at"] + F.length(part["head"])
        span = F.array(F.struct(here.alias("start"), F.length(part["body"]).alias("length")))
        return F.struct(
            (here + F.length(part["body"]) + len(END)).alias("at"), F.when(part["loss"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans")
        )

    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return parts.select(F.col("id").alias(id_col), formatted.alias("formatted"), F.aggregate("parts", start, step, lambda x: x["spans"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The original turns (role and text) from a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")
    turns = F.transform(
        blocks,
        lambda b: F.transform(
            F.split(F.substring_index(b, MESSAGE, -1), r"<\|next\|>"),
            lambda t: F.struct(
                unescape(F.replace(F.substring_index(b, MESSAGE, 1), F.lit(START), F.lit(""))).alias("role"),
                unescape(t).alias("text"),
            ),
        ),
    )
    return F.flatten(turns)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped: the parts of merged turns one after the other."""
    pieces = F.transform(spans, lambda s: F.replace(F.substr(formatted, s["start"] + 1, s["length"]), F.lit(NEXT), F.lit("")))
    return F.array_join(F.transform(pieces, unescape), "")
