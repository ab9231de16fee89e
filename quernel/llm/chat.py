r"""Chat formatting with a reversible template.

A formatted conversation is a sequence of blocks, one for each run of
adjacent turns of one role:

    <|im_start|>ROLE\nTEXT<|im_sep|>TEXT<|im_end|>\n

Texts and roles never hold ``<|``: within them each ``<``, run of
backslashes and ``|`` gets one more backslash, and a role's line feeds
become ``<|nl|>``, so every control string in the output is the template's
and the turns can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.text import sha256_hex

START, SEP, END, NL = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments.

    ``segments`` is an array of (text, loss) whose texts joined give
    ``formatted``; ``loss`` marks the trained role's texts, in their escaped
    form, and nothing else. Turns are taken by (turn, role, text), nulls
    first: ties have one order, repeated rows stay as repeated turns. Null
    roles and texts count as empty; rows with a null conv_id form one
    conversation. Other columns are ignored. An empty table gives no rows.

    The sort and the merging run within a row in time linear in the number of
    turns (but for the sort): a block is a slice between two role changes. A
    conversation is one value of the output, so one task holds it whole.
    """
    own = turns.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    grouped = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # A turn opens a block if its role differs from the one before it.
    opened = grouped.withColumn(
        "starts",
        F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", F.greatest(i - 1, F.lit(0))).getField("role") != F.get("turns", i).getField("role"))),
    )
    merged = opened.withColumn(
        "blocks",
        F.transform(
            "starts",
            lambda at, k: F.struct(
                F.get("turns", at).getField("role").alias("role"),
                F.transform(F.slice("turns", at + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - at), lambda t: escape(t.getField("text"))).alias("texts"),
            ),
        ),
    )

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)

    def segments(b: Column) -> Column:
        head = F.concat(F.lit(START), F.replace(escape(b.getField("role")), F.lit("\n"), F.lit(NL)), F.lit("\n"))
        texts = F.flatten(
            F.transform(
                b.getField("texts"),
                lambda t, i: F.array(piece(F.when(i == 0, head).otherwise(F.lit(SEP)), no), piece(t, b.getField("role") == trained_role)),
            )
        )
        return F.concat(texts, F.array(piece(F.lit(END + "\n"), no)))

    cut = merged.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("segments"))
    return cut.select("conv_id", F.array_join(F.transform("segments", lambda s: s.getField("text")), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns, as an array of (role, text), from formatted text alone."""

    def turns(block: Column) -> Column:
        at = F.instr(block, "\n")
        role = unescape(F.replace(F.substring(block, F.lit(1), at - 1), F.lit(NL), F.lit("\n")))
        body = F.substring(block, at + 1, F.length(block) - at - len(END) - 1)
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, i: i > 0)
    return F.flatten(F.transform(blocks, turns))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted output holds: turns and loss texts, counted and hashed."""
    loss = F.transform(F.filter("segments", lambda s: s.getField("loss")), lambda s: unescape(s.getField("text")))
    held = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), F.array_join(loss, "").alias("loss_text"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n"))), "")
    return held.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_hex(told).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        sha256_hex(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
