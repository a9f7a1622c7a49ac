"""Chat formatting with typed content parts, in DataFrame functions only.

A message is an ordered array of typed parts. A visitor, one case a type, turns each part into text: a text part is
escaped, any other part becomes a placeholder `<part:N>` numbered in order within its message, with its
reference kept aside and the number of tokens it stands for. Turns are written

    <turn>role\\ntext</turn>\\n

so the strings `<turn>`, `</turn>` and `<part:` control the layout. Inside a text a backslash is doubled and a `<` before
one of these gets a backslash after it; the steps are undone in reverse order. The loss mask is a list of byte spans
that hold exactly the assistant's escaped texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_SCHEMA = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
OPEN, CLOSE = "<turn>", "</turn>\n"
#: Tokens that stand for an attachment: image patches, audio frames a second, tokens a document page.
PATCH, FRAMES_A_SECOND, TOKENS_A_PAGE = 14, 25, 576


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, "<(?=turn>|/turn>|part:)", "<\\\\")


def unescape(text: Column) -> Column:
    bare = F.regexp_replace(text, r"<\\(?=turn>|/turn>|part:)", "<")
    return F.replace(bare, F.lit("\\\\"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A message of one text part."""
    null = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.cast("string").alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"),
            null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages"),
        )
    )


def _tokens(part: Column) -> Column:
    patches = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    return F.coalesce(
        F.when(part["type"] == "image", patches)
        .when(part["type"] == "audio", F.ceil(part["seconds"] * FRAMES_A_SECOND))
        .when(part["type"] == "document", part["pages"].cast("long") * TOKENS_A_PAGE),
        F.lit(0),
    ).cast("long")


def flatten_parts(parts: Column) -> Column:
    """struct<body, attachments array<struct<slot,type,ref,tokens>>, expanded_tokens> of an array of typed parts.

    Unknown types count as attachments of no tokens; null parts and null texts are empty.
    """
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    start = F.struct(F.lit("").alias("body"), F.lit(0).alias("slots"))

    def visit(state: Column, part: Column) -> Column:
        shown = F.when(is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<part:"), state["slots"].cast("string"), F.lit(">"))
        )
        return F.struct(F.concat(state["body"], shown).alias("body"), (state["slots"] + F.when(is_text(part), 0).otherwise(1)).alias("slots"))

    parts = F.filter(F.coalesce(parts, F.array().cast(PART_SCHEMA)), lambda p: p.isNotNull())
    others = F.filter(parts, lambda p: ~is_text(p))
    attachments = F.transform(others, lambda p, i: F.struct(i.alias("slot"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    return F.struct(
        F.aggregate(parts, start, visit)["body"].alias("body"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv, formatted, loss_spans array<struct<start,length>> (bytes), attachments, expanded_tokens.

    turns: a row a message, `parts` as PART_SCHEMA. Messages go by turn, nulls first; equal turns by role, then body, so any row
    order gives the same output. Null roles are empty; roles are percent-encoded, so that no role can break the layout. Repeated
    rows stay repeated messages. Other columns are ignored. No rows give no rows.
    """
    flat = flatten_parts(F.col(parts))
    name = F.url_encode(F.coalesce(F.col(role), F.lit("")))
    rows = turns.select(
        F.col(conv), F.struct(F.col(turn).alias("turn"), name.alias("role"), flat.alias("flat"), F.coalesce(F.col(role) == loss_role, F.lit(False)).alias("loss")).alias("m")
    )
    packed = rows.groupBy(conv).agg(F.sort_array(F.collect_list("m")).alias("ms"))
    head = lambda m: F.concat(F.lit(OPEN), m["role"], F.lit("\n"))

    def place(state: Column, m: Column) -> Column:
        begins = state["at"] + F.octet_length(head(m))
        n = F.octet_length(m["flat"]["body"])
        span = F.when(m["loss"], F.array(F.struct(begins.alias("start"), n.alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        return F.struct((begins + n + len(CLOSE)).alias("at"), F.concat(state["spans"], span).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return packed.select(
        conv,
        F.array_join(F.transform("ms", lambda m: F.concat(head(m), m["flat"]["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("ms", none, place)["spans"].alias("loss_spans"),
        F.flatten(F.transform("ms", lambda m, i: F.transform(m["flat"]["attachments"], lambda a: F.struct(i.alias("message"), a.alias("part"))))).alias("attachments"),
        F.aggregate("ms", F.lit(0).cast("long"), lambda n, m: n + m["flat"]["expanded_tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted conversation: the inverse of the layout and of the escapes."""
    pieces = F.filter(F.split(formatted, F.lit("</turn>\n"), -1), lambda p: p != "")
    bare = F.transform(pieces, lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    return F.transform(
        bare,
        lambda p: F.struct(
            F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped span by span."""
    raw = F.to_binary(formatted, F.lit("utf-8"))
    return F.array_join(F.transform(spans, lambda s: unescape(F.decode(F.substring(raw, s["start"] + 1, s["length"]), "utf-8"))), "")
