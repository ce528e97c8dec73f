"""Threshold-scaled document fingerprints, with DataFrame functions only.

A sketch keeps every shingle hash below a fixed share of the hash range, so its size follows
the document, sketches merge by union, and containment between very unequal documents is
estimated without bias. A document in which no hash falls below the bound keeps its smallest
one, so that short documents are told apart; merging drops it once a regular hash is there.

Shingles are five consecutive words of the whole text; a text of fewer words is one shingle.
Null and empty texts, and texts without a word, have an empty sketch: it equals another empty
one and is like nothing else. Rows are independent, so repeated rows have equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderloom.llm.common import fresh, text_or_empty

SHINGLE = 5
#: Hashes are the first 16 hex digits of MD5; those below this bound are kept: one in eight.
BOUND = "2"
#: Accuracy of the cut points that spread ids over tasks; results don't depend on it.
ACCURACY = 10_000


def _bound(column: Column, use) -> Column:
    """use(column) with the column computed once per row, however often use refers to it."""
    return F.transform(F.array(column), use)[0]


def shingle_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(text_or_empty(text), r"[\x20\x09-\x0D]+", -1), "")

    def hashes(w):
        last = F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))
        each = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, SHINGLE), " ")), 1, 16))
        return F.when(F.size(w) > 0, each).otherwise(F.array().cast("array<string>"))

    return _bound(words, hashes)


def sketch(text: Column) -> Column:
    """Sorted distinct hashes that the document keeps."""

    def keep(h):
        low = F.filter(h, lambda x: x < BOUND)
        return F.when(F.size(low) > 0, low).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(h)

    return F.array_sort(F.array_distinct(_bound(shingle_hashes(text), keep)))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two documents' shingles together."""

    def regular(u):
        low = F.filter(u, lambda x: x < BOUND)
        return F.when(F.size(low) > 0, low).otherwise(F.slice(F.array_sort(u), 1, 1))

    return F.array_sort(_bound(F.array_union(a, b), regular))


def fingerprint(sketched: Column) -> Column:
    """A sketch as text."""
    return F.array_join(sketched, "")


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of both."""
    together = F.size(F.array_union(a, b))
    return F.when(together == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / together)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def with_next(docs: DataFrame, key: str, payload: list[str], tie: list[str], parts: int) -> DataFrame:
    """Each row with next_<payload>, the payload of the row after it in descending key order.

    The last row's next is the first. Ties go by `tie`, descending; null keys come last. Rows
    are spread over tasks by cut points that are keys themselves, and the rows at a cut go to
    the part above it too, so no part needs more than its own rows and no task sees them all.
    """
    part, ghost, cut = fresh(docs, "part"), fresh(docs, "ghost"), fresh(docs, "cut")
    shares = [k / parts for k in range(1, parts)] or [0.5]
    known = docs.agg(F.percentile_approx(key, shares, ACCURACY).alias("cuts"), F.max(key).alias("top")).first()
    cuts, top = sorted(set(known["cuts"] or [])), known["top"]
    kind = docs.schema[key].dataType
    bounds = F.array(*map(F.lit, cuts)).cast("array<" + kind.simpleString() + ">")
    # The number of cuts below a key, by bisection.
    steps = [2**k for k in reversed(range(max(1, len(cuts).bit_length())))]

    def bisect(at, step):
        further = at + step
        inside = F.when(further <= len(cuts), F.get(bounds, further - 1) < F.col(key)).otherwise(F.lit(False))
        return F.when(inside, further).otherwise(at)

    own = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), bisect)
    none = F.lit(None).cast("struct<part:int,ghost:int>")
    at = lambda p, g: F.struct(p.cast("int").alias("part"), F.lit(g).alias("ghost"))
    places = F.array_compact(
        F.array(
            at(F.col(cut), 0),
            F.when(F.get(bounds, F.col(cut)) == F.col(key), at(F.col(cut) + 1, 1)).otherwise(none),
            F.when(F.col(key).eqNullSafe(F.lit(top)), at(F.lit(0), 2)).otherwise(none),
        )
    )
    spread = docs.withColumn(cut, F.coalesce(own, F.lit(0))).select(*docs.columns, F.explode(places).alias(part))
    spread = spread.select(*docs.columns, F.col(f"{part}.ghost").alias(ghost), F.col(f"{part}.part").alias(part)).repartition(parts, part)
    order = Window.partitionBy(part).orderBy(F.col(ghost) == 2, F.col(key).desc_nulls_last(), *(F.col(t).desc_nulls_last() for t in tie))
    return spread.select(*docs.columns, ghost, *(F.lead(c).over(order).alias(f"next_{c}") for c in payload)).filter(F.col(ghost) == 0).drop(ghost)


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as much of the beginning of the next."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(following, F.lit(1), third))


def edited_likeness(docs: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """Sketches of documents and their edited texts, and how alike they are.

    Columns: the key, text, edited, sketch, edited_sketch, next_sketch.
    """
    plain = docs.select(F.col(key), text_or_empty(text).alias("text"))
    sketched = plain.withColumn("sketch", sketch(F.col("text")))
    follow = with_next(sketched, key, ["text", "sketch"], ["text"], parts)
    changed = follow.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    return changed.select(key, "text", "edited", "sketch", sketch(F.col("edited")).alias("edited_sketch"), "next_sketch")
