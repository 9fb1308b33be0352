"""Chat formatting with Spark expressions only.

A conversation is one string. Turns are collected as structs and sorted by
(turn, role, text); adjacent turns of one role share a block and are kept apart
by a mark inside it, so the turns can be read back:

    <|turn|>user<|text|>first<|next|>second<|end|><|turn|>assistant<|text|>...<|end|>

A control string inside a role or text gets a backslash after its first
character, and one more where backslashes stand there already; reading back
removes exactly one. Control strings are those of this template and the
``FOREIGN`` ones of common templates.

The loss mask is a list of spans (code points, end exclusive) of the formatted
string, one for each assistant text.

Null texts and roles count as empty; a null turn sorts first; rows without a
conversation id form one conversation of id null; repeated rows are turns of
their own. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>")
_TAILS = "|".join(re.escape(x[1:]) for x in (TURN, TEXT, NEXT, END, *FOREIGN))


def escape(x: Column) -> Column:
    return F.regexp_replace(x, rf"([<\[])(\\*)(?={_TAILS})", r"$1\\$2")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, rf"([<\[])\\(\\*)(?={_TAILS})", r"$1$2")


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans and n_blocks of every conversation.

    Null roles and texts are empty; a null conv_id is one conversation. Rows of one turn go by role, then text, and repeated rows stay
    repeated. No rows give no conversation. A conversation is one row of the result, however long it is. Other columns are not read.
    """
    rows = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    turns_of = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    merged = turns_of.withColumn("starts", F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 OR turns[i].role <> turns[i - 1].role)"))
    blocks = merged.withColumn(
        "blocks",
        F.transform(
            "starts",
            lambda s, j: F.struct(
                F.element_at("turns", s + 1)["role"].alias("role"),
                F.transform(
                    F.slice("turns", s + 1, F.coalesce(F.get("starts", j + 1), F.size("turns")) - s),
                    lambda t: escape(t["text"]),
                ).alias("texts"),
            ),
        ),
    )
    rendered = blocks.withColumn(
        "formatted",
        F.array_join(
            F.transform("blocks", lambda b: F.concat(F.lit(TURN), escape(b["role"]), F.lit(TEXT), F.array_join(b["texts"], NEXT), F.lit(END))), ""
        ),
    )
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def in_block(acc: Column, b: Column) -> Column:
        body = acc["at"] + F.lit(len(TURN) + len(TEXT)) + F.length(escape(b["role"]))
        inner = F.aggregate(
            b["texts"],
            F.struct(body.alias("at"), acc["spans"].alias("spans")),
            lambda a, x: F.struct(
                (a["at"] + F.length(x) + F.lit(len(NEXT))).alias("at"),
                F.when(b["role"] == loss_role, F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(x)).alias("end")))))
                .otherwise(a["spans"])
                .alias("spans"),
            ),
        )
        return F.struct((inner["at"] - F.lit(len(NEXT) - len(END))).alias("at"), inner["spans"].alias("spans"))

    spans = F.aggregate("blocks", F.struct(F.lit(0).alias("at"), none.alias("spans")), in_block, lambda a: a["spans"])
    return rendered.select("conv_id", "formatted", spans.alias("loss_spans"), F.size("blocks").cast("long").alias("n_blocks"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""

    def block(b: Column) -> Column:
        role = unescape(F.substring_index(b, TEXT, 1))
        body = F.substring_index(F.substring_index(b, TEXT, -1), END, 1)
        return F.transform(F.split(body, re.escape(NEXT), -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(F.filter(F.split(formatted, re.escape(TURN), -1), lambda b: b != ""), block))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
