"""Removal of word passages that repeat anywhere, by level-wise doubling.

A window of LENGTH words is removed where its word sequence starts at another place too, in the
same document or another. Windows of 9 words are looked at first, only where a window of the
full length has its least 9-word hash: equal windows have it at the same place, so a window
whose least one is found once can't repeat. Those found again are extended to twice the length
and counted again, and so on up to LENGTH or until no candidate is left. Only candidates' texts
are read after the first level, and only hashes of windows are shuffled.

Windows are named by 64-bit hashes of their words' hashes, counted over all documents; a
document that is an exact copy of another has all its windows repeated, and stands for its
copies in the counts. A hash that a third of all documents share is one row a document in a
counting that combines before the shuffle, and a join that splits large partitions.

Null and empty texts have no words and stay as they are; texts shorter than LENGTH too.
Repeated rows are copies of each other. Ids may repeat or be null. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenderloom.llm.common import text_or_empty
from tenderloom.llm.ngram_join import MIX, word_hashes, mix
from tenderloom.session import cut_lineage

LENGTH = 35
#: Lengths of the levels: each is twice the one before, or the full length.
LEVELS = (9, 18, LENGTH)


def split(text: str) -> list[bytes]:
    """Words between the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))


def double(g: np.ndarray, size: int, to: int) -> np.ndarray:
    """Hashes of windows of `to` words from those of `size` words, to at most twice as long."""
    with np.errstate(over="ignore"):
        return mix(g[: len(g) - (to - size)] * MIX + g[to - size :])


def windows(h: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all windows of each level's length; h has LENGTH words or more."""
    out, size, g = {}, 1, h
    for to in (2, 4, 8, *LEVELS):
        g, size = double(g, size, to), to
        out[to] = g
    return out


def least(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of its smallest, the leftmost if several."""
    at, span = np.arange(len(g)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(g[left] <= g[right], left, right)
        span += step
    return at


def first_level(h: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Window hashes, and the place of the least first-level window in each full window."""
    w = windows(h)
    return w, least(w[LEVELS[0]], LENGTH - LEVELS[0] + 1)


def inner(place: np.ndarray) -> np.ndarray:
    """Where the second-level window lies that holds each full window's least first-level one."""
    return np.minimum(place, np.arange(len(place)) + LENGTH - LEVELS[1])


def candidates(h: np.ndarray, level: int, marks: np.ndarray) -> np.ndarray:
    """Hashes of this level's windows at places that the marks of the level before leave over."""
    w, place = first_level(h)
    if level == 1:
        alive = np.isin(w[LEVELS[0]][place], marks)
        return w[LEVELS[1]][np.unique(inner(place)[alive])]
    return w[LENGTH][np.isin(w[LEVELS[1]][inner(place)], marks)]


def covered(h: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which words lie in a full window whose hash is marked."""
    step = np.zeros(len(h) + 1, np.int64)
    if len(h) >= LENGTH:
        hit = np.flatnonzero(np.isin(windows(h)[LENGTH], marks))
        step[hit] += 1
        step[hit + LENGTH] -= 1
    return np.cumsum(step[:-1]) > 0


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _profile(docs: DataFrame, row: str) -> DataFrame:
    """Per row: its number, its text's name, words, the digest of all its words and first-level windows."""

    def work(batches):
        for batch in batches:
            out = []
            for t in batch["text"].to_pylist():
                words = split(t)
                found, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if len(words) >= LENGTH:
                    w, place = first_level(hashes(words))
                    found, n = np.unique(w[LEVELS[0]][np.unique(place)], return_counts=True)
                out.append((hashlib.md5(t.encode("utf-8", "surrogatepass")).digest(), len(words), _sha(words), found.view(np.int64), n))
            name, size, sha, found, n = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch[row], pa.array(name, pa.binary()), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(found, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int64()))],
                [row, "name", "n_words", "sha", "found", "n"],
            )

    kind = docs.schema[row].dataType.simpleString()
    return docs.mapInArrow(work, f"{row} {kind}, name binary, n_words long, sha string, found array<long>, n array<long>")


def _again(rows: DataFrame) -> DataFrame:
    """name and marks: the hashes of each text that are found at two places or more."""
    several = rows.groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1").select("hash")
    return rows.join(several, "hash").groupBy("name").agg(F.collect_list("hash").alias("marks"))


def _level(texts: DataFrame, level: int) -> DataFrame:
    """Rows (name, hash, n) of a level's windows in texts (name, text, marks)."""

    def work(batches):
        for batch in batches:
            names, found, counts = [], [], []
            for name, text, marks in zip(batch["name"].to_pylist(), batch["text"].to_pylist(), batch["marks"]):
                h, n = np.unique(candidates(hashes(split(text)), level, marks.values.to_numpy().view(np.uint64)), return_counts=True)
                names += [name] * len(h)
                found.append(h)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64))],
                ["name", "hash", "n"],
            )

    return cut_lineage(texts.select("name", "text", "marks").mapInArrow(work, "name binary, hash long, n long"))


def _without(texts: DataFrame) -> DataFrame:
    """name, n_removed, kept_words, sha of texts (name, text, marks) without their marked windows."""

    def work(batches):
        for batch in batches:
            out = []
            for text, marks in zip(batch["text"].to_pylist(), batch["marks"]):
                words = split(text)
                gone = covered(hashes(words), marks.values.to_numpy().view(np.uint64))
                kept = [w for w, g in zip(words, gone) if not g]
                out.append((int(gone.sum()), b" ".join(kept).decode("utf-8", "surrogatepass"), _sha(kept)))
            removed, kept, sha = zip(*out) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([batch["name"], pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], ["name", "n_removed", "kept", "sha_kept"])

    return texts.select("name", "text", "marks").mapInArrow(work, "name binary, n_removed long, kept string, sha_kept string")


def repeats(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """What repeats in docs.

    First: per row its key, name (of its text), n_words, n_removed and sha of the kept words.
    Second: name and kept (words joined by a space) of texts of which some part is removed;
    a text whose words are all removed because it has a copy isn't there.
    """
    plain = docs.select(F.col(key), text_or_empty(text).alias("text"))
    profile = cut_lineage(_profile(plain, key))
    texts = profile.groupBy("name").agg(F.min(key).alias(key), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("found").alias("found"), F.first("n").alias("n"))
    texts = cut_lineage(texts)
    rows = texts.filter(F.size("found") > 0).select("name", F.explode(F.arrays_zip("found", "n")).alias("x")).select("name", F.col("x.found").alias("hash"), F.col("x.n").alias("n"))
    marked = _again(rows).join(texts.select("name", key), "name")
    # The text of one row of each name; another row with the same id may have another text.
    raw = plain.select(F.col(key).alias("row"), "text").join(marked, F.col("row").eqNullSafe(F.col(key)))
    raw = raw.filter(F.unhex(F.md5("text")) == F.col("name")).select("name", "text", "marks")
    if not profile.groupBy(key, "name").count().filter("count > 1").isEmpty():
        raw = raw.dropDuplicates(["name"])
    raw = cut_lineage(raw)
    found = _again(_level(raw, 1))
    for level in range(2, len(LEVELS)):
        found = _again(_level(raw.drop("marks").join(found, "name"), level))
    parts = cut_lineage(_without(raw.drop("marks").join(found, "name")))
    copies = texts.filter((F.col("copies") > 1) & (F.col("n_words") >= LENGTH)).select("name", F.lit(True).alias("copied"))
    out = profile.select(key, "name", "n_words", "sha").join(copies, "name", "left").join(parts.drop("kept"), "name", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    out = out.select(
        key,
        "name",
        "n_words",
        F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), F.lit(nothing)).otherwise(F.coalesce("sha_kept", "sha")).alias("kept_sha256"),
    )
    return out, parts.select("name", "kept")
