"""Conversations as training strings with a loss mask, in Spark expressions alone.

A message is ``<s>[role]`` text ``</s>``.  Adjacent turns of one role share a
message, their texts set apart by ``<+>``, so that merging can be undone.  In
roles and texts the characters ``~ < [ ]`` become ``~0 ~1 ~2 ~3``: no control
string of this or of a like template can occur inside a text, and every text
can be read back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, ROLE_END, NEXT = "<s>[", "</s>", "]", "<+>"
#: Escapes in the order in which they are put in; taken out in reverse.
ESCAPES = [("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3")]


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_conversations(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss (spans [start, end) in code points of the texts to learn) of each conversation.

    Reads ``conv_id``, ``turn``, ``role`` and ``text`` only.  Turns go by turn, then role, then text, a null turn
    first; repeated rows are turns of their own.  A null role or text is empty; the rows with a null conv_id are one
    conversation.  An empty table gives no conversation, an empty text a span of no length.  A conversation is one
    string and has to fit a row (2 GB), whatever the number of its turns.
    """
    row = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))

    def piece(x: Column, i: Column) -> Column:
        before = F.get(F.col("turns"), i - 1)
        head = F.concat(F.lit(OPEN), escape(x["role"]), F.lit(ROLE_END))
        return F.struct(
            F.when(i == 0, head)
            .when(before["role"] == x["role"], F.lit(NEXT))
            .otherwise(F.concat(F.lit(CLOSE), head))
            .alias("lead"),
            escape(x["text"]).alias("body"),
            (x["role"] == learn).alias("learned"),
        )

    pieces = sorted_turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"])), "")
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["lead"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(p["learned"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    loss = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])
    return pieces.select("conv_id", F.concat(whole, F.lit(CLOSE)).alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text in order) and learned (the texts under the loss mask), from the strings alone."""
    messages = F.split("formatted", CLOSE, -1)
    messages = F.slice(messages, 1, F.size(messages) - 1)

    def message(m: Column) -> Column:
        role = F.substring_index(m, ROLE_END, 1)
        body = F.substr(m, F.length(role) + 2)
        name = unescape(F.substr(role, F.lit(len(OPEN) + 1)))
        return F.transform(
            F.split(body, r"<\+>", -1), lambda t: F.struct(name.alias("role"), unescape(t).alias("text"))
        )

    learned = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    return formatted.select(
        "conv_id", F.flatten(F.transform(messages, message)).alias("turns"), learned.alias("learned"), "formatted"
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Sizes and SHA-256 digests of what the strings hold, read back from them."""
    back = read_back(formatted)
    listing = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    text = back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(listing, "").cast("binary"), 256).alias("turns_sha256"),
        F.array_join("learned", "").alias("_learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return text.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("_learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
