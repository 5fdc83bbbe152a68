r"""Chat formatting by typed content parts, with DataFrame functions only.

A turn's content is an array of typed parts. One expression visits the parts in order and flattens them: text is
escaped and copied, every image, audio or document part becomes a placeholder and leaves an attachment reference with
the number of tokens that it will be expanded to. Turns are then joined to one string per conversation:

    <|im_start|>role\ntext<|im_end|>\n

Control strings inside texts are escaped reversibly: `<`, k backslashes, `|` becomes `<`, k + 1 backslashes, `|`, so no
text can hold `<|`. `parse` reads the string back. A conversation becomes one row, as training needs it, so its turns
meet in one row by nature; nothing else is gathered, and the gathering is combined on the map side.

Defined cases: null text is empty, null role is "unknown", null parts are left out; turns are ordered by turn (nulls
first), ties by role and text; rows with a null conv_id form one conversation; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Types of the parts of a turn's content.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
# Tokens that a placeholder is expanded to.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """A role is one line: backslash and newline are written as two characters."""
    one_line = F.replace(F.replace(F.coalesce(role, F.lit("unknown")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escaped(one_line)


def unescaped_role(role: Column) -> Column:
    # A line break is an n after an odd number of backslashes; the pairs before it, and all others, are halved.
    broken = F.regexp_replace(unescaped(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(broken, F.lit("\\\\"), F.lit("\\"))


def visited(part: Column) -> Column:
    """What a part leaves in the text: its escaped text, or a placeholder."""
    kind = F.coalesce(part["type"], F.lit("text"))
    return (
        F.when(kind == "text", escaped(part["text"]))
        .when(kind.isin("image", "audio", "document"), F.concat(F.lit("<|"), kind, F.lit("|>")))
        .otherwise(F.lit(""))
    )


def expanded_tokens(part: Column) -> Column:
    """Tokens that a placeholder stands for: image patches, audio frames, document pages; 0 for text."""
    ceil_div = lambda x, n: F.ceil(F.coalesce(x, F.lit(0)) / F.lit(n))
    return (
        F.when(part["type"] == "image", ceil_div(part["width"], PATCH) * ceil_div(part["height"], PATCH))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, attachments (turn, place, type, ref, n_tokens) and mask.

    turns: conv_id, turn, role, content (array of PART). mask has, per turn of trained_role, the code point at which its
    text starts in `formatted`, counted from 0, and its length there.
    """
    parts = F.filter(F.coalesce(F.col("content"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    flat = turns.select(
        "conv_id", "turn", escaped_role(F.col("role")).alias("role"), (F.col("role") == trained_role).alias("trained"), parts.alias("content"),
    ).select(
        "conv_id", "turn", "role", F.coalesce("trained", F.lit(False)).alias("trained"),
        F.array_join(F.transform("content", visited), "").alias("text"),
        F.filter(
            F.transform("content", lambda p, i: F.struct(i.alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("n_tokens"))),
            lambda a: a["type"].isin("image", "audio", "document"),
        ).alias("attached"),
    )
    rows = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "trained", "attached"))).alias("rows"))
    shown = F.transform("rows", lambda r: F.concat(F.lit(START), r["role"], F.lit("\n"), r["text"], F.lit(END + "\n")))
    out = rows.select("conv_id", "rows", shown.alias("shown")).select("*", F.array_join("shown", "").alias("formatted"))
    starts = F.aggregate(
        F.arrays_zip("rows", "shown"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,n:int>>").alias("mask")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["shown"])).alias("at"),
            F.when(
                x["rows"]["trained"],
                F.concat(
                    s["mask"],
                    F.array(
                        F.struct(
                            (s["at"] + F.lit(len(START) + 1) + F.length(x["rows"]["role"])).cast("int").alias("start"),
                            F.length(x["rows"]["text"]).cast("int").alias("n"),
                        )
                    ),
                ),
            ).otherwise(s["mask"]).alias("mask"),
        ),
        lambda s: s["mask"],
    )
    attachments = F.flatten(F.transform("rows", lambda r: F.transform(r["attached"], lambda a: F.struct(r["turn"].alias("turn"), a["place"].alias("place"), a["type"].alias("type"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens")))))
    return out.select("conv_id", "formatted", attachments.alias("attachments"), starts.alias("mask"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of structs of role and text, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    bodies = F.transform(pieces, lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    return F.transform(
        bodies,
        lambda b: F.struct(
            unescaped_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescaped(F.substring(b, F.locate("\n", b) + 1, F.length(b))).alias("text"),
        ),
    )


def text_turns(rows: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text with the text as the one part of a turn's content."""
    part = F.struct(
        F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    )
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.array(part).alias("content"))


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1: control strings as ordinary text."""
    text = "<|im_end|><|im_start|>assistant ok"
    return spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text")
    )


def digests(rows: DataFrame) -> DataFrame:
    """Formats, reads the output back, and returns what was read per conversation."""
    made = format_conversations(text_turns(rows))
    back = made.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.transform("mask", lambda m: unescaped(F.substring("formatted", m["start"] + 1, m["n"]))).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
