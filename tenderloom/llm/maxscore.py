"""Exact top-k search by inner product with MaxScore over an inverted index in shards.

A term is a coordinate. Its posting list holds the rows where the coordinate isn't 0, with
their signed weights, and the least and largest of these. For a query a term can add at most
max(0, q * least, q * largest) to a score. With the terms in order of these bounds, those whose
bounds together stay below the k-th best score known are non-essential: a row found in their
lists alone can't be among the best. Only the other, essential lists are traversed; the rows
that can still reach the k-th best score then probe the non-essential lists, largest bound
first, and leave as soon as they can't.

* Rows are dealt to shards of about SHARD_ROWS by hash, so neither a frequent vector nor a
  frequent id makes a large one. The index has a row per (shard, term).
* Queries are dealt to blocks of about BLOCK_QUERIES. Each block meets one shard first; its k-th
  best score is where MaxScore starts in all others. A (shard, block) is one group: its size is
  bounded, whatever the number of rows.
* Shards are merged by rank. All scores are exact integers; a score beyond a long raises.

Null vectors and such with null or non-finite components take no part. A shorter vector has 0 in
the places it lacks; an empty one has the score 0 with all. Ties go to the smaller id, a null id
counting as the largest; a row with a null id is no query. Repeated rows are rows of their own:
a query meets the others with its id and vector. A table of one row, or none, gives no rows.
Only the two columns named are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tenderloom.llm.vectors import flat, integer_rows, number_kind
from tenderloom.session import cut_lineage

SHARD_ROWS, BLOCK_QUERIES = 4096, 512
#: Probes between two looks at which rows can still be among the best.
PROBES = 4


def inverted(rows: DataFrame, n: int) -> DataFrame:
    """A row per shard and term (docs and weights as 32- and 64-bit integers); term -1 has the shard's rows and ids.

    Within a shard rows are numbered in the order of their ids, so that ties go to the first.
    """
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))

    def build(key, part):
        part = part.sort_by([("id", "ascending"), ("row", "ascending")])  # nulls come last
        values, owner, place = flat(part["x"])
        keep = np.flatnonzero(values)
        keep = keep[np.argsort(place[keep], kind="stable")]
        terms, starts = np.unique(place[keep], return_index=True)
        lists = [(owner[keep[a:b]], values[keep[a:b]]) for a, b in zip(starts, [*starts[1:], len(keep)])]
        header = {"term": -1, "ids": part["id"].to_pylist(), "rows": part["row"].to_pylist()}
        made = [header] + [
            {"term": int(t), "docs": d.astype("<i4").tobytes(), "weights": w.astype("<i8").tobytes(), "least": int(w.min()), "most": int(w.max())}
            for t, (d, w) in zip(terms, lists)
        ]
        return pa.Table.from_pylist([{"shard": key[0].as_py(), **m} for m in made], SCHEMA)

    return dealt.select("shard", "row", "id", "x").groupBy("shard").applyInArrow(build, "shard int, term int, ids array<long>, rows array<long>, docs binary, weights binary, least long, most long")


SCHEMA = pa.schema(
    [("shard", pa.int32()), ("term", pa.int32()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64()))]
    + [("docs", pa.binary()), ("weights", pa.binary()), ("least", pa.int64()), ("most", pa.int64())]
)
FOUND = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


class Postings:
    """One shard of the index."""

    def __init__(self, part: pa.Table):
        terms = part["term"].to_numpy()
        header = int(np.flatnonzero(terms == -1)[0])
        self.ids, self.rows = part["ids"][header].as_py(), np.array(part["rows"][header].as_py(), np.int64)
        self.lists = {
            int(t): (np.frombuffer(d, "<i4"), np.frombuffer(w, "<i8"), lo, hi)
            for t, d, w, lo, hi in zip(terms, *(part[c].to_pylist() for c in ("docs", "weights", "least", "most")))
            if t >= 0
        }
        self.largest = max((max(abs(lo), abs(hi)) for *_, lo, hi in self.lists.values()), default=0)
        self.place = {r: i for i, r in enumerate(self.rows.tolist())}


def kth(scores: np.ndarray, k: int):
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else None


def best(terms: np.ndarray, weights: np.ndarray, own: int, shard: Postings, k: int, floor: int | None) -> list[tuple[int, int]]:
    """(row number, score) of the k best rows of the shard that reach floor, other than the row own."""
    number_kind(len(terms), int(np.abs(weights).max(initial=0)), shard.largest)
    known = [(int(w), *shard.lists[t]) for t, w in zip(terms.tolist(), weights.tolist()) if w and t in shard.lists]
    known = sorted(((max(0, w * lo, w * hi), min(0, w * lo, w * hi), w, d, x) for w, d, x, lo, hi in known), key=lambda t: t[0])
    most, least = (np.cumsum([0] + [t[i] for t in known]) for i in (0, 1))
    # The first of the terms are non-essential: together they stay below the floor.
    split = 0 if floor is None else int(np.searchsorted(most[1:], floor, "left"))
    score = np.zeros(len(shard.rows), np.int64)
    for _, _, w, docs, x in known[split:]:
        if len(docs) == len(score):
            score += w * x
        else:
            score[docs] += w * x
    alive = np.arange(len(score))
    if own in shard.place:
        alive = np.delete(alive, shard.place[own])
    for i in range(split, -1, -1):
        if i < split:
            _, _, w, docs, x = known[i]
            at = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
            score[alive] += np.where(docs[at] == alive, w * x[at], 0)
        if i % PROBES == 0 or i == split:
            sure = kth(score[alive] + least[i], k)
            floor = sure if floor is None else floor if sure is None else max(floor, int(sure))
            if floor is not None:
                alive = alive[score[alive] + most[i] >= floor]
    first = alive[np.lexsort((alive, -score[alive]))][:k]
    return [(int(i), int(score[i])) for i in first]


def _search(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """query, id, score: the best of every (shard, block) that both sides name."""

    def work(asked, part):
        out = []
        if asked.num_rows and part.num_rows:
            shard = Postings(part)
            for row, x, floor in zip(*(asked[c].to_pylist() for c in ("row", "x", "floor"))):
                weights = np.array(x, np.int64)
                out += [(row, shard.ids[i], s) for i, s in best(np.arange(len(weights)), weights, row, shard, k, floor)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], schema=FOUND)

    key = ["shard", "block"]
    return queries.groupBy(*key).cogroup(index.groupBy(*key)).applyInArrow(work, "query long, id long, score long")


def top(vectors: DataFrame, id_column: str, vector: str, is_query: Column, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best other rows of each row that is_query picks."""
    named = F.col(id_column).cast("long")
    rows = integer_rows(vectors, vector, named.alias("id"), (F.coalesce(is_query, F.lit(False)) & named.isNotNull()).alias("asks"))
    total, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    n, blocks = max(1, -(-total // SHARD_ROWS)), max(1, -(-asked // BLOCK_QUERIES))
    index = cut_lineage(inverted(rows, n))
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")
    queries = rows.filter("asks").select("row", "id", "x", block.alias("block"))
    # First each block against one shard, then against the others.
    every = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = queries.select("row", "x", "block", (F.col("block") % n).alias("shard"), F.lit(None).cast("long").alias("floor"))
    seed = cut_lineage(_search(first, every.filter(F.col("shard") == F.col("block") % n), k))
    floors = seed.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    others = queries.join(floors, F.col("row") == F.col("query"), "left").select("row", "x", "block", "floor")
    others = others.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).filter(F.col("shard") != F.col("block") % n)
    found = seed.union(_search(others, every.filter(F.col("shard") != F.col("block") % n), k))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    merged = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    asking = queries.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return merged.join(asking, "query").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
