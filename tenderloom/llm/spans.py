"""Spans of pattern matches with their positions, with DataFrame functions only.

Matches are bracketed by a control character in one pass of the regular expression; the pieces
between the brackets then give positions by their lengths in code points. The text's own such
characters are replaced by another that no pattern knows, so positions stay true.

Patterns must not repeat a group without a bound: the regular expression engine would recurse
once per repetition. Runs of single characters are safe at any length.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Brackets a match; stands for a character inside a run; stands for either in a text.
MARK, JOINT, OTHER = "\x01", "\x02", "\x03"
#: Pieces whose spans are gathered at once, to keep appending cheap in texts with many matches.
CHUNK = 256
SPAN = "struct<kind:int,start:bigint,end:bigint,value:string>"


def bound(column: Column, use) -> Column:
    """use(column) with the column computed once per row, however often use refers to it."""
    return F.transform(F.array(column), use)[0]


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def plain(text: Column) -> Column:
    """The text (null: empty) without control characters of this module."""
    return F.translate(F.coalesce(text, F.lit("")), MARK + JOINT, OTHER + OTHER)


def find(text: Column, pattern: str, kind: int) -> Column:
    """Spans of the pattern's leftmost matches, which don't overlap, in a plain text."""

    def located(pieces):
        empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("inside"), no_spans().alias("spans"))
        count = F.ceil(F.size(pieces) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.slice(pieces, c * CHUNK + 1, CHUNK))

        def piece(seen, p):
            end = seen["at"] + F.char_length(p)
            span = F.struct(F.lit(kind).alias("kind"), seen["at"].alias("start"), end.alias("end"), p.alias("value"))
            return F.struct(end.alias("at"), (~seen["inside"]).alias("inside"), F.when(seen["inside"], F.array_append(seen["spans"], span)).otherwise(seen["spans"]).alias("spans"))

        def chunk(done, part):
            begin = F.struct(done["at"].alias("at"), F.lit(False).alias("inside"), no_spans().alias("spans"))
            found = F.aggregate(part, begin, piece)
            return bound(found, lambda f: F.struct(f["at"].alias("at"), F.array_append(done["groups"], f["spans"]).alias("groups")))

        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("groups"))
        return F.flatten(F.aggregate(chunks, start, chunk)["groups"])

    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    return bound(marked, lambda m: F.when(F.contains(m, F.lit(MARK)), located(F.split(m, MARK, -1))).otherwise(no_spans()))


def original(spans: Column, text: Column) -> Column:
    """The spans with the text's own characters instead of joints."""
    return F.transform(
        spans,
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).alias("value")),
    )


def listing(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.split(F.reverse(value), "")

    def add(total, d, i):
        v = F.try_to_number(d, F.lit("9")).cast("int")
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return F.when(i % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.transform(places, lambda d, i: F.coalesce(add(None, d, i), F.lit(0))), F.lit(0), lambda a, b: a + b) % 10 == 0
