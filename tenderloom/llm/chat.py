"""Chat formatting of typed content parts, with DataFrame functions only.

A turn is a list of parts: text, image, audio or document. A visitor turns each part into its
text or its placeholder, in order, and notes the reference and the token count that the
placeholder expands to. Turns stand between control strings; the same strings inside roles and
texts are broken up by a backslash after their first character, and backslashes are doubled,
so dropping one backslash before any character gives the text back.

Null roles, texts and parts count as empty; a part of unknown kind counts as text. Turns of a
conversation are ordered by turn, role and parts, nulls first, so repeated rows and ties have
a defined order. Null ids form one conversation. Empty tables give no rows. A conversation is
the unit of the result, so its turns meet in one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Strings that some chat template treats as control, besides everything that begins with <|.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Pixels of an image token's side, audio tokens a second, document tokens a page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 512
#: Whose text is trained on.
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROL, F.replace(text, F.lit("\\"), F.lit("\\\\")))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """The parts of a plain text: one text part."""
    rest = (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in rest)))


def visit(part: Column) -> Column:
    """A part as (piece, kind, ref, tokens); kind is null for text."""
    kind = F.lower(part["kind"])
    side = lambda n: F.ceil(F.coalesce(part[n], F.lit(0)) / PATCH)
    tokens = (
        F.when(kind == "image", side("width") * side("height"))
        .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND))
        .when(kind == "document", F.coalesce(part["pages"], F.lit(0)) * PER_PAGE)
    )
    piece = reduce(lambda c, k: c.when(kind == k, F.lit(PLACEHOLDERS[k])), PLACEHOLDERS, F.when(F.lit(False), F.lit("")))
    return F.struct(
        piece.otherwise(escape(F.coalesce(part["text"], F.lit("")))).alias("piece"),
        F.when(kind.isin(*PLACEHOLDERS), kind).alias("kind"),
        part["ref"].alias("ref"),
        tokens.cast("long").alias("tokens"),
    )


def _spans(pieces: Column, at: Column) -> Column:
    """Where the text pieces lie, in code points, when the first begins at `at`."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(seen, x):
        end = seen["at"] + F.char_length(x["piece"])
        span = F.struct(seen["at"].alias("start"), end.alias("end"))
        is_text = x["kind"].isNull() & (end > seen["at"])
        return F.struct(end.alias("at"), F.when(is_text, F.array_append(seen["spans"], span)).otherwise(seen["spans"]).alias("spans"))

    return F.aggregate(pieces, F.struct(at.cast("long").alias("at"), none.alias("spans")), step, lambda seen: seen["spans"])


def format_conversations(turns: DataFrame, conversation: str, turn: str, role: str, parts: str) -> DataFrame:
    """One row per conversation from rows of turns with an array of parts.

    Returns the conversation's id, n_turns, formatted, turns (start and the loss spans of each
    turn, in code points of formatted) and attachments (index in order of the placeholders,
    turn, kind, ref, tokens).
    """
    rows = turns.select(
        F.col(conversation).alias("conversation"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    rows = rows.withColumn("pieces", F.transform("parts", visit))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(MESSAGE))
    body = F.array_join(F.transform("pieces", lambda x: x["piece"]), "")
    rows = rows.withColumn("head", head).withColumn("line", F.concat("head", body, F.lit(END)))
    order = Window.partitionBy("conversation").orderBy("turn", "role", F.to_json("parts"))
    before = F.sum(F.char_length("line")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = F.when(F.col("role") == LOSS_ROLE, _spans(F.col("pieces"), F.char_length("head")))
    rows = rows.select(
        "conversation",
        F.row_number().over(order).alias("no"),
        F.coalesce(before, F.lit(0)).cast("long").alias("start"),
        "line",
        F.coalesce(spans, F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("loss"),
        F.filter("pieces", lambda x: x["kind"].isNotNull()).alias("attached"),
    )
    whole = rows.groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct("no", "start", "line", "loss", "attached"))).alias("lines"))
    moved = lambda x: F.transform(x["loss"], lambda s: F.struct((s["start"] + x["start"]).alias("start"), (s["end"] + x["start"]).alias("end")))
    attached = F.flatten(
        F.transform(
            "lines",
            lambda x: F.transform(
                x["attached"], lambda a: F.struct(x["no"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))
            ),
        )
    )
    return whole.select(
        F.col("conversation").alias(conversation),
        F.size("lines").cast("long").alias("n_turns"),
        F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("formatted"),
        F.transform("lines", lambda x: F.struct(x["start"].alias("start"), moved(x).alias("loss"))).alias("turns"),
        F.transform(
            attached, lambda a, i: F.struct(i.alias("index"), a["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))
        ).alias("attachments"),
    )


def read_back(formatted: Column, turns: Column) -> Column:
    """Turns (role, text, loss) read from formatted text and its mask; placeholders stay."""
    lines = F.slice(F.split(formatted, r"<\|start\|>", -1), F.lit(2), F.size(turns))

    def parse(line, t):
        role = F.substring_index(line, MESSAGE, 1)
        skip = F.char_length(role) + len(MESSAGE)
        text = F.substring(line, skip + 1, F.char_length(line) - skip - len(END))
        at = lambda s: (s["start"] - t["start"] - len(START) + 1).cast("int")
        masked = F.transform(t["loss"], lambda s: unescape(F.substring(line, at(s), (s["end"] - s["start"]).cast("int"))))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"), F.array_join(masked, "").alias("loss"))

    return F.zip_with(lines, turns, parse)
