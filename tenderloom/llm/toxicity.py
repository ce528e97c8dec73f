"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Labelled documents get a severity grade: 0 if clean, else 1..3 by how many different marked
words they have, cut at the thirds of the toxic documents. One weight vector serves all thresholds:
P(grade <= k) = sigmoid(threshold_k - score). The outcome is the expected severity, and a
document is toxic if it is more likely graded than clean.

Features are the different words of the whole text and the beginnings of longer words, so that
inflected forms of a root share evidence; a feature counts once for each word that has it. Those with enough support and odds towards toxic documents are kept,
counted over the labelled sample. The sample is bounded (SAMPLE documents of either label, by
hash of their id); scoring covers every document.

Null and empty texts score nothing. Null labels are skipped; a document labelled twice is toxic
if either label is. Without both labels the model marks nothing and rejects nothing. Rows are
independent, so repeated rows get equal results. Columns of docs that have the names of results
are replaced; all others pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tenderloom.llm.bpe import Memo
from tenderloom.llm.common import fresh, text_or_empty
from tenderloom.llm.sketch import shingle_hashes
from tenderloom.session import cut_lineage

#: Labelled documents of either label that a model is fitted on, at most.
SAMPLE = 8000
#: Features of a model at most; the odds towards toxic documents that a feature needs, and the
#: likelihood ratio (2 log) against chance, about what the best of a million words reaches.
FEATURES, ODDS, EVIDENCE = 4000, 5.0, 25.0
GRADES = 4
#: Lengths of the beginnings of longer words.
BEGINNINGS = range(3, 10)
STEPS, RATE, RIDGE = 1500, 0.1, 1e-5
WORDS_KEPT = 1 << 16
#: Features counted at once: a task's counts leave it when they reach as many, and are added up by Spark.
COUNTED = 1 << 15
LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if n < len(word))]


@dataclass
class Severity:
    """weights by feature, and the ascending thresholds between grades."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [50.0 + k for k in range(GRADES - 1)])

    def score(self, text: Column) -> Column:
        """Sum of the weights of the features of the text's different words."""
        weights = self.weights

        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            of_word = Memo(lambda w: sum(weights.get(f, 0.0) for f in features(w)), WORDS_KEPT, 64).__getitem__
            # fsum: the same whatever the order of the words.
            return pa.array((fsum(map(of_word, set(LETTERS.findall((t.as_py() or "").lower())))) for t in texts), pa.float64())

        return scored(text)

    def above(self, score: Column) -> list[Column]:
        """P(grade > k) for each threshold."""
        return [1 / (1 + F.exp(F.lit(t) - score)) for t in self.thresholds]


def severities(docs: DataFrame, model: Severity, text: str = "text") -> DataFrame:
    """docs with score, expected_severity, grade (the likeliest), p_toxic and toxic, in place of columns of these names."""
    made = fresh(docs, "severity")
    scored = docs.withColumn(made, model.score(text_or_empty(text)))
    above = model.above(F.col(made))
    each = [1 - above[0], *(a - b for a, b in zip(above, above[1:])), above[-1]]
    best = F.greatest(*each)
    grade = F.coalesce(*(F.when(p == best, F.lit(k)) for k, p in enumerate(each)))
    expected = sum(above[1:], above[0])
    return scored.withColumns({"score": F.col(made), "expected_severity": expected, "grade": grade, "p_toxic": above[0], "toxic": above[0] >= 0.5}).drop(made)


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """The texts of the labelled sample without most copies, and the number of labels of either kind."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("is_toxic"))
    totals = {r.is_toxic: r["count"] for r in known.groupBy("is_toxic").count().collect()}
    picks = [known.filter(F.col("is_toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    # At most 2 * SAMPLE rows.
    texts = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(picks[0].union(picks[1])), "doc_id")
    # Near copies share their smallest or largest shingle hash; one of each stays.
    for end in (F.array_min, F.array_max):
        marked = texts.withColumn("end", end(shingle_hashes(F.col("text"))))
        texts = marked.groupBy("is_toxic", "end").agg(F.min(F.struct("doc_id", "text")).alias("first")).select("is_toxic", "first.*")
    return cut_lineage(texts.select("is_toxic", "text")), totals


def _counts(rows: Iterable[tuple[int, str]], most: int = COUNTED) -> Iterator[dict[str, list]]:
    """How many texts of either label have each feature, in parts of little more than `most` features."""
    seen = Counter(), Counter()

    def part():
        every = list(seen[1] | seen[0])
        return {"feature": every, "toxic": [seen[1][f] for f in every], "clean": [seen[0][f] for f in every]}

    for k, t in rows:
        seen[k].update({f for w in set(LETTERS.findall(t.lower())) for f in features(w)})
        if len(seen[0]) + len(seen[1]) >= most:
            yield part()
            seen = Counter(), Counter()
    yield part()


def _select(sample: DataFrame, sizes: list[int]) -> list[str]:
    def count(batches):
        rows = ((k.as_py(), t.as_py()) for batch in batches for k, t in zip(batch["is_toxic"], batch["text"]))
        for part in _counts(rows):
            yield pa.RecordBatch.from_pydict(part, pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]))

    found = sample.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    toxic, clean = F.col("toxic"), F.col("clean")
    odds = (toxic + 0.5) / (sizes[1] + 1) / ((clean + 0.5) / (sizes[0] + 1))
    share = (toxic + clean) / sum(sizes)
    part = lambda n, size: F.when(n > 0, n * F.log(n / (size * share))).otherwise(0.0)
    evidence = 2 * (part(toxic, sizes[1]) + part(clean, sizes[0]))
    kept = found.withColumn("evidence", evidence).filter((odds >= ODDS) & (F.col("evidence") >= EVIDENCE))
    return [r.feature for r in kept.orderBy(F.desc("evidence"), "feature").limit(FEATURES).collect()]


def _rows(sample: DataFrame, chosen: list[str]) -> list[tuple[int, list[int], int]]:
    """Per document of the sample: label, features, different marked words."""
    number = {f: i for i, f in enumerate(chosen)}

    def look(batches):
        for batch in batches:
            out = []
            for k, t in zip(batch["is_toxic"], batch["text"]):
                marks = [[number[f] for f in features(w) if f in number] for w in set(LETTERS.findall(t.as_py().lower()))]
                out.append({"is_toxic": k.as_py(), "at": sorted(i for m in marks for i in m), "marked": sum(map(bool, marks))})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("is_toxic", pa.int32()), ("at", pa.list_(pa.int32())), ("marked", pa.int32())]))

    return [(r.is_toxic, list(r["at"]), r.marked) for r in sample.mapInArrow(look, "is_toxic int, at array<int>, marked int").collect()]


def ordinal_fit(rows: list[list[int]], grade: np.ndarray, weight: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the largest weighted likelihood with a small ridge (Adam steps)."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate([np.asarray(r, int) for r in rows]) if rows else np.zeros(0, int)
    weight = weight / weight.sum()
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    # The first threshold, then logarithms of the steps to the next.
    free = np.concatenate([np.zeros(width), [1.0], np.zeros(GRADES - 2)])
    first, second = np.zeros_like(free), np.zeros_like(free)
    thresholds = lambda: free[width] + np.concatenate([[0], np.cumsum(np.exp(free[width + 1 :]))])
    for step in range(1, STEPS + 1):
        score = np.bincount(owner, free[column], len(rows))
        border = np.concatenate([[-60.0], thresholds(), [60.0]])
        low, high = sigmoid(border[grade] - score), sigmoid(border[grade + 1] - score)
        low, high = np.where(grade == 0, 0.0, low), np.where(grade == GRADES - 1, 1.0, high)
        chance = np.maximum(high - low, 1e-12)
        by_score = weight * (1 - low - high)
        up, down = weight * high * (1 - high) / chance, weight * low * (1 - low) / chance
        by_border = np.bincount(grade, down, GRADES)[1:] - np.bincount(grade, up, GRADES)[:-1]
        slope = np.concatenate([np.bincount(column, by_score[owner], width) + RIDGE * free[:width], [by_border.sum()], np.zeros(GRADES - 2)])
        slope[width + 1 :] = np.cumsum(by_border[::-1])[::-1][1:] * np.exp(free[width + 1 :])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        free = free - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return free[:width], thresholds()


def fit(docs: DataFrame, labels: DataFrame) -> Severity:
    sample, totals = _sample(docs, labels)
    sizes = {r.is_toxic: r["count"] for r in sample.groupBy("is_toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Severity()
    chosen = _select(sample, [sizes[0], sizes[1]])
    rows = _rows(sample, chosen)
    rows.sort()
    toxic = np.array([r[0] for r in rows])
    marked = np.array([r[2] for r in rows])
    cuts = np.quantile(marked[toxic == 1], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, marked, "left"), 0)
    # The sample's rows stand for all labelled ones.
    weight = np.array([totals[k] / sizes[k] for k in (0, 1)])[toxic]
    weights, thresholds = ordinal_fit([r[1] for r in rows], grade, weight, len(chosen))
    return Severity({f: float(w) for f, w in zip(chosen, weights)}, [float(t) for t in thresholds])
