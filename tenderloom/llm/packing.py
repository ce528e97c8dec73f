"""Packing of tokenised documents into windows of fixed length by non-negative least squares.

Documents become ids, ids become pieces of at most a window, and pieces are packed without
further cuts. Lengths are rounded up to units; every way of filling a window exactly with up
to `depth` rounded lengths is a column of a small matrix, and non-negative least squares finds
how often each should be used to use up the histogram of lengths. Counts are rounded to what
is there, and what they leave over is packed greedily, largest first, again on the histogram.

The driver sees only the histogram (window / unit numbers), whatever the corpus. Pieces take
their place by their rank among pieces of their class. Ranks come from salted groups, so a
class that holds most pieces is spread over many tasks.

Null text counts as empty: such a document has the end id alone. Repeated rows are pieces of
their own. Equal pieces are interchangeable. Empty tables give no rows.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType

from tenderloom.llm.bpe import Memo, byte_letters
from tenderloom.llm.common import fresh
from tenderloom.session import cut_lineage

#: Words and word parts that a worker remembers with their ids; a full memory starts anew. Never changes a result.
WORDS_KEPT = 1 << 18
PARTS_KEPT = 1 << 19
#: Longer ones aren't remembered, to bound the memory of an entry.
WORD_CHARS = 48
#: Pieces that one numbering group holds on average.
GROUP_ROWS = 100_000


class WordTokens:
    """Ids of whole texts by the library's tokeniser, word by word.

    Only for vocabulary files whose splitter drops white space, so that a text's ids are its
    words' ids in order. Words of Latin letters, which no normalisation but lower case
    changes, are split here and their parts go to the library's merges; all others go through
    the library as they are.
    """

    # Control characters that str.split() takes for white space, unlike the vocabulary's pattern.
    odd = re.compile("[\x1c-\x1f]")
    words = re.compile("[^ \t\n\r\x0b\x0c]+")
    latin = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    # Fixed value: the vocabulary's splitter, for lower-case Latin words.
    split = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        one, two = self._library("Ab ß"), self._library("a") + self._library("b")
        if one != self._library("ab") + self._library("ß") or two != self._library("a b"):
            raise ValueError(f"{path} doesn't lower letters and drop white space")
        self.merge = self.tokenizer.model.tokenize
        self.letter = {b: c for c, b in byte_letters().items()}
        if any("<|" not in t.content for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens are expected to hold <|")
        self.known = Memo(self._word, WORDS_KEPT, WORD_CHARS)
        self.parts = Memo(self._part, PARTS_KEPT, WORD_CHARS)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        name = part if part.isascii() else "".join([self.letter[b] for b in part.encode()])
        return array("I", [t.id for t in self.merge(name)]).tobytes()

    def _word(self, word: str) -> bytes:
        if "<|" in word or not self.latin.fullmatch(word):
            return self._library(word)
        if word.isalpha():
            return self.parts[word.lower()]
        return b"".join(map(self.parts.__getitem__, self.split.findall(word.lower())))

    def ids(self, text: str) -> bytes:
        words = self.words.findall(text) if self.odd.search(text) else text.split()
        return b"".join(map(self.known.__getitem__, words))


@lru_cache(2)
def loaded(path: str) -> WordTokens:
    return WordTokens(path)


def tokenize(text: Column, path: str, end_id: int) -> Column:
    """Ids of each text and the end id, as binary little-endian 32-bit integers."""
    end = int(end_id).to_bytes(4, "little")

    @F.arrow_udf(BinaryType())
    def ids(texts: pa.Array) -> pa.Array:
        tokens = loaded(path)
        return pa.array((tokens.ids(t.as_py() or "") + end for t in texts), pa.binary())

    # Else the optimiser may put a copy of the call wherever the ids are used.
    return ids.asNondeterministic()(text)


def cut(ids: Column, window: int) -> Column:
    """Binary ids as an array of pieces (start, length, crc32) of at most a window each."""
    total = (F.octet_length(ids) / 4).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(total - 1, F.lit(0)), F.lit(window).cast("long"))
    size = lambda s: F.least(F.lit(window).cast("long"), total - s)

    def piece(s):
        part = F.substring(ids, (s * 4 + 1).cast("int"), (size(s) * 4).cast("int"))
        return F.struct(s.alias("start"), size(s).alias("length"), F.crc32(part).alias("ids_crc32"))

    return F.transform(starts, piece)


def fillings(units: int, depth: int) -> list[tuple[int, ...]]:
    """All multisets of at most depth class numbers that sum to units."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int):
        top = head[-1] if head else units
        if left <= top:
            out.append((*head, left))
        if len(head) + 1 < depth:
            for c in range(min(top, left - 1), 0, -1):
                if c * (depth - len(head)) >= left:
                    grow((*head, c), left - c)

    grow((), units)
    return [f for f in out if sum(f) == units]


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with small |a x - b|, by an active set (Lawson and Hanson)."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    scale = max(b.max(initial=0), 1.0)
    b = b / scale
    for _ in range(3 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        new = int(slope.argmax())
        if slope[new] <= 1e-9:
            break
        active[new] = True
        while True:
            at = np.flatnonzero(active)
            part = a[:, at]
            best = np.linalg.solve(part.T @ part + 1e-10 * np.eye(len(at)), part.T @ b)
            if (best > 0).all():
                x[:] = 0
                x[at] = best
                break
            low = at[best <= 0]
            ratio = x[low] / np.maximum(x[low] - best[best <= 0], 1e-300)
            x[at] += ratio.min() * (best - x[at])
            x[low[ratio <= ratio.min()]] = 0
            active[at[x[at] <= 1e-15]] = False
    return x * scale


def plan(histogram: np.ndarray, depth: int) -> list[tuple[dict[int, int], int]]:
    """Fillings ({class: pieces}, repeats) that use up a histogram over classes 1..units exactly."""
    units = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    columns = [f for f in fillings(units, depth) if all(left[c] for c in f)]
    chosen: list[tuple[dict[int, int], int]] = []
    if columns:
        a = np.zeros((units, len(columns)))
        for k, f in enumerate(columns):
            for c in f:
                a[c - 1, k] += 1
        # Long leftovers are the hardest to place, so their classes weigh more.
        weight = np.arange(1, units + 1) / units
        x = least_squares(a * weight[:, None], left[1:] * weight)
        for k in np.argsort(-x, kind="stable"):
            parts = {c: columns[k].count(c) for c in columns[k]}
            n = min(int(round(x[k])), *(int(left[c] // m) for c, m in parts.items()))
            if n > 0:
                chosen.append((parts, n))
                for c, m in parts.items():
                    left[c] -= n * m
    while left.any():
        room, parts = units, {}
        for c in range(units, 0, -1):
            if (m := min(room // c, int(left[c]))) > 0:
                parts[c] = m
                room -= m * c
        n = min(int(left[c] // m) for c, m in parts.items())
        chosen.append((parts, n))
        for c, m in parts.items():
            left[c] -= n * m
    return chosen


def pack(pieces: DataFrame, keys: list[str], length: str, window: int, unit: int = 8, depth: int = 3) -> DataFrame:
    """Pieces with sequence_id (from 0) and offset (from 0, without gaps) in their sequence.

    keys identify a piece and order equal lengths; length is 1..window. window must be a
    multiple of unit: the rounding costs under unit / 2 ids a piece of padding on average.
    """
    if window % unit:
        raise ValueError("window must be a multiple of unit")
    spark = pieces.sparkSession
    columns = pieces.columns
    kind, salt, rank = fresh(pieces, "class"), fresh(pieces, "salt"), fresh(pieces, "rank")
    pieces = cut_lineage(pieces.withColumn(kind, F.ceil(F.col(length) / unit).cast("int")))
    counts = {r[kind]: r["n"] for r in pieces.groupBy(kind).agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(window // unit + 1, np.int64)
    for c, n in counts.items():
        histogram[c] = n
    salts = max(1, -(-int(histogram.sum()) // GROUP_ROWS))

    # Ranks within a class: a number within a salted group, after the groups before it.
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(kind, salt).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy(kind).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)))
    numbered = salted.withColumn(rank, F.row_number().over(Window.partitionBy(kind, salt).orderBy(*keys)).cast("long") - 1)
    ranked = numbered.join(before.drop("n"), [kind, salt]).withColumn(rank, F.col(rank) + F.coalesce("before", F.lit(0)))

    # Which ranks of a class go to which filling; a few rows per class, whatever the corpus.
    slots, taken, first = [], {}, 0
    for parts, n in plan(histogram, depth):
        for c, m in parts.items():
            start = taken.get(c, 0)
            slots.append((c, start, start + m * n, n, first))
            taken[c] = start + m * n
        first += n
    if len(slots) > 100 * len(histogram) * depth:
        raise RuntimeError("the plan has more rows than its classes allow")
    slot_table = spark.createDataFrame(slots, f"{kind} int, slot_from long, slot_to long, repeats long, first_sequence long")
    near = (F.col(rank) >= F.col("slot_from")) & (F.col(rank) < F.col("slot_to"))
    placed = ranked.alias("p").join(F.broadcast(slot_table).alias("s"), (F.col(f"p.{kind}") == F.col(f"s.{kind}")) & near)
    placed = placed.select(
        *(F.col(f"p.`{c}`") for c in columns),
        (F.col("first_sequence") + (F.col(rank) - F.col("slot_from")) % F.col("repeats")).alias("sequence_id"),
    )
    # A sequence has at most a window of pieces.
    inside = Window.partitionBy("sequence_id").orderBy(F.desc(length), *keys)
    return placed.withColumn("offset", F.sum(length).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(length))


def padding(packed: DataFrame, length: str, window: int) -> DataFrame:
    """Sequences, their ids and the padding that fills them up (none at a power of two)."""
    full = packed.groupBy("sequence_id").agg(F.sum(length).alias("ids"))
    powers = reduce(add, [(F.col("ids") == 2**k).cast("int") for k in range(window.bit_length())])
    pad = F.when(powers > 0, F.lit(0)).otherwise(F.lit(window) - F.col("ids"))
    return full.agg(F.count("*").alias("sequences"), F.sum("ids").alias("ids"), F.sum(pad).alias("padding"))
