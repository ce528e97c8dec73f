"""N-gram Jaccard self-join by sizes: subsets for small sets, inverted lists for large ones.

A document's set holds its distinct shingles of N words. Two sets link when
100 * intersection >= PERCENT * union, so sets of sizes s and t need an overlap of
o(s, t) = ceil(PERCENT (s + t) / (100 + PERCENT)).

* Small sets (up to the boundary) list all their subsets of each size o(s, t) for which a
  partner size t exists; linked sets share one.
* Large sets, and small ones that could link with them, enter inverted lists. In any order of
  all shingles linked sets share one of their first s - o_min(s) + 1, so only those are listed,
  rare shingles first.
* The boundary is the size at which all sets together cost least, a subset's key counting 1 and
  a listed shingle COMPARED, since few but linked sets share a subset. Any boundary is exact.

Equal sets are one set from the start. Within a list every set is held against the list's first
set, which takes as many comparisons as the list is long; sets that are connected by then need
no further comparison. Only lists that still hold several components are compared across
components, one of those with the same members, and there the metric of Jaccard rules out pairs by their distances from the
first set, and counts by remainder, carried with the members, those that can't share enough. All comparisons are exact, over whole sets. No list is cut.

Links that the search for components didn't need are counted afterwards: linked sets are in one
component, so each component's sets are held against each other, in parts of bounded size, and
only the counts per set leave a part.

Frequencies that lists are ordered by come from one shingle in `sampled`, over all documents. Where
lists come out longer than LONG_LIST, the first shingles of their sets are counted, frequent ones
are moved to the end of the order, and every set that listed one of them is listed anew: a common
passage of which no shingle had been counted heads no list afterwards. Any order is exact.

Null and empty texts, and texts without a word, have an empty set and link with nothing. Sets are
told apart by a digest, not by ids: rows with a null id link like others, and rows that share an
id are judged each by its own text. A component is named by its smallest id; one without any id
has none, and its rows and those without a set are named by their own id. Repeated rows are equal
sets. Empty tables give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tenderloom.llm.bpe import Memo
from tenderloom.llm.common import FEW, broadcast_if_few, text_or_empty
from tenderloom.llm.components import components
from tenderloom.session import cut_lineage

#: Shingles whose frequency every task knows, at most (9 bytes each); the rest count as rare.
KNOWN = 1 << 21
#: Sizes that may be small: beyond, subsets outnumber any list.
LARGEST_SMALL = 48
#: Parts in which the sizes of sets are held against each other before the sets are.
BUCKETS = 256
DIGEST = 64
#: What a listed shingle costs, its list's comparisons included, where a subset's key costs 1.
COMPARED = 16
#: Sets and shingles of a part of a component, about, and shingles held against each other at a time.
PART_SETS, PART_SHINGLES, COLUMNS = 512, 1 << 19, 4096
MIX = np.uint64(0x9E3779B97F4A7C15)
WORDS_KEPT = 1 << 16
#: Sets in a list beyond which the shingles of its sets are counted: so many times as many as a set lists.
LONG_LIST, CHOICE = 32, 4


def needed(s: int, t: int, percent: int) -> int:
    """Least overlap with which sets of s and t link."""
    return -(-percent * (s + t) // (100 + percent))


def partners(s: int, percent: int) -> range:
    """Sizes that a set of s can link with."""
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def listed(s, percent: int):
    """Shingles of a set of s (or an array of sizes) that enter lists."""
    least = -(-percent * s // 100)  # the overlap with the smallest partner
    return s - least + 1


def sampled(percent: int) -> int:
    """One shingle in so many has its frequency counted: enough to fill the lists of most sets."""
    return max(1, 80 // (100 - percent)) if percent < 100 else 64


def subset_sizes(s: int, most: int, percent: int) -> list[int]:
    """Sizes of the subsets that a small set of s lists."""
    found = {needed(s, t, percent) for t in partners(s, percent) if 0 < t <= most and needed(s, t, percent) <= min(s, t)}
    if found == {s} and needed(s, s + 1, percent) > s:
        return []  # only an equal set could link
    return sorted(found)


def subset_keys(s: int, most: int, percent: int) -> int:
    return sum(comb(s, o) for o in subset_sizes(s, most, percent))


def boundary(histogram: dict[int, int], percent: int) -> int:
    """The largest small size with the least cost in all; histogram covers LARGEST_SMALL and more."""
    best = (float("inf"), 0)
    for most in range(LARGEST_SMALL + 1):
        reach = percent * (most + 1) / 100  # small sets from here on may link with large ones
        cost = sum(
            n * ((subset_keys(s, most, percent) if s <= most else 0) + (COMPARED * listed(s, percent) if s >= reach else 0))
            for s, n in histogram.items()
            if s <= LARGEST_SMALL / percent * 100 + 1
        )
        best = min(best, (cost, most))
    return best[1]


@lru_cache(1)
def word_hashes() -> Memo:
    return Memo(xxhash.xxh64_intdigest, WORDS_KEPT, 64)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out * MIX + h[k : len(words) - size + 1 + k])
    return np.unique(out)


def _per_document(docs: DataFrame, schema: str, of, names: list[str], kinds: list) -> DataFrame:
    """One row of `of(shingles)` per document, after its id."""

    def work(batches):
        for batch in batches:
            rows = [of(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", *names])

    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(work, schema)


def name_of(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set (null if empty), the text's MD5 and the sampled shingles."""
    one_in = np.uint64(sampled(percent))

    def of(text):
        s = shingles(text, n)
        return len(s), name_of(s), hashlib.md5(text.encode("utf-8", "surrogatepass")).digest(), s[s % one_in == 0].view(np.int64)

    schema = "doc_id long, n_shingles long, name binary, digest binary, some array<long>"
    return _per_document(docs, schema, of, ["n_shingles", "name", "digest", "some"], [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())])


def _levels(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Keys of counted (key, n), sorted, the logarithms of n, and whether these are all: the most frequent, at most KNOWN."""
    several = cut_lineage(counted.select("key", F.ceil(F.log2("n")).cast("byte").alias("k")))
    above = {r.k: r["count"] for r in several.groupBy("k").count().collect()}
    least = min((k for k in range(65) if sum(c for j, c in above.items() if j >= k) <= KNOWN), default=65)
    table = several.filter(F.col("k") >= least).toArrow()
    keys, k = table["key"].to_numpy().view(np.uint64), table["k"].to_numpy()
    order = np.argsort(keys)
    return keys[order], k[order].astype(np.uint8), least <= 1


def _frequencies(every: DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Sampled shingles that occur in several documents, as _levels has them."""
    return _levels(every.select(F.explode("some").alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))


def _rank(s: np.ndarray, keys: np.ndarray, logs: np.ndarray, unknown: int) -> np.ndarray:
    """Places in the order by sorted keys and the logarithms of their counts."""
    if not len(keys):
        return np.full(len(s), unknown, np.uint8)
    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
    return np.where(keys[at] == s, logs[at] + 1, unknown).astype(np.uint8)


def places(s: np.ndarray, keys: np.ndarray, logs: np.ndarray, percent: int, later: tuple | None = None) -> np.ndarray:
    """Ranks of a set's shingles in the order of all: rare sampled ones, those not counted, frequent ones."""
    counted = np.flatnonzero(s % np.uint64(sampled(percent)) == 0)
    rank = np.ones(len(s), np.uint8)
    rank[counted] = _rank(s[counted], keys, logs, 0)
    if later is not None:
        rest = np.flatnonzero(rank == 1)
        rank[rest] = _rank(s[rest], *later, 1)
    return rank


def signature(s: np.ndarray, keys: np.ndarray, logs: np.ndarray, known: bool, most: int, percent: int, later: tuple | None = None) -> np.ndarray:
    """All keys of a set: hashes of subsets and of listed shingles.

    keys and logs are of sampled shingles, later those of others that come after the uncounted.

    Where all sampled shingles of several documents are known, the others' lists would hold
    this set alone, so they are left out.
    """
    size, out = len(s), []
    if size <= most:
        with np.errstate(over="ignore"):
            whole = s.sum(dtype=np.uint64)
            for o in subset_sizes(size, most, percent):
                drop = np.array([s[list(c)].sum(dtype=np.uint64) for c in combinations(range(size), size - o)], np.uint64)
                out.append(mix((whole - drop) ^ np.uint64(o * 2 + 1)))
    if size >= percent * (most + 1) / 100:
        rank = places(s, keys, logs, percent, later)
        # The set is sorted and the sort is stable: by rank, then by hash.
        first = np.argsort(rank, kind="stable")[: listed(size, percent)]
        out.append(s[first[rank[first] > 0] if known else first])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _signatures(docs: DataFrame, order: tuple, n: int, percent: int, most: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def of(text):
        s = shingles(text, n)
        return name_of(s), len(s), signature(s, *shared.value, most, percent).view(np.int64).tolist()

    return _per_document(docs, "doc_id long, name binary, size int, keys array<long>", of, ["name", "size", "keys"], [pa.binary(), pa.int32(), pa.list_(pa.int64())])


def _listed_anew(stored: DataFrame, order: tuple, later: tuple, percent: int, most: int) -> DataFrame:
    """node, size and keys of stored sets (node, shingles) in another order."""
    shared = stored.sparkSession.sparkContext.broadcast((order, later))

    def work(batches):
        for batch in batches:
            sets = [np.frombuffer(b, np.uint64) for b in batch["shingles"].to_pylist()]
            keys = [signature(s, *shared.value[0], most, percent, shared.value[1]).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["node", "size", "keys"])

    return stored.select("node", "shingles").mapInArrow(work, "node long, size int, keys array<long>")


def _counted(stored: DataFrame, order: tuple, percent: int) -> DataFrame:
    """key and n of the shingles that more than LONG_LIST of the stored sets have among their first ones.

    A set's first ones are CHOICE times as many as it lists, so that it can list others instead.
    """
    shared = stored.sparkSession.sparkContext.broadcast(order[:2])

    def work(batches):
        for batch in batches:
            sets = [np.frombuffer(b, np.uint64) for b in batch["shingles"].to_pylist()]
            some = [s[np.argsort(places(s, *shared.value, percent), kind="stable")[: CHOICE * listed(len(s), percent)]] for s in sets]
            keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *some]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    every = stored.select("shingles").mapInArrow(work, "key long, n long")
    return every.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > LONG_LIST)


def buckets(s: np.ndarray) -> bytes:
    """How many shingles have each of BUCKETS remainders."""
    return np.bincount((s % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS).astype("<u4").tobytes()


def digest(s: np.ndarray) -> np.ndarray | None:
    """As buckets, of DIGEST remainders, to be carried with list members; None where a count is too large."""
    n = np.bincount((s % np.uint64(DIGEST)).astype(np.int64), minlength=DIGEST)
    return n.astype(np.int16) if n.max() < 1 << 15 else None


def _sides(pairs: DataFrame, stored: DataFrame, column: str) -> list[DataFrame]:
    """(a, left) and (b, right): a column of the stored sets that pairs (a, b) name on either side.

    Where these are few, the other sets stay where they are.
    """
    sides = []
    for node, as_name in (("a", "left"), ("b", "right")):
        wanted = cut_lineage(pairs.select(F.col(node).alias("node")).distinct())
        some = stored.join(F.broadcast(wanted), "node", "left_semi") if wanted.count() <= FEW else stored
        sides.append(some.select(F.col("node").alias(node), F.col(column).alias(as_name)))
    return sides


def _promising(pairs: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that can link by their buckets: what sets share they share bucket by bucket."""

    def work(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u4").reshape(-1, BUCKETS).astype(np.int64) for c in ("left", "right"))
            most = np.minimum(x, y).sum(axis=1)
            alive = 100 * most >= percent * (x.sum(axis=1) + y.sum(axis=1) - most)
            yield batch.select(["a", "b"]).filter(pa.array(alive))

    left, right = _sides(pairs, stored, "buckets")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(work, "a long, b long")


def _compare(pairs: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that can link, with their overlap, from the stored sets (node, shingles, buckets)."""
    pairs = cut_lineage(_promising(pairs, stored, percent))

    def work(batches):
        for batch in batches:
            both = zip(batch["left"].to_pylist(), batch["right"].to_pylist())
            overlap = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), True)) for x, y in both]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(overlap, pa.int32())], ["a", "b", "overlap"])

    left, right = _sides(pairs, stored, "shingles")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(work, "a long, b long, overlap int")


def linking(xs: list[np.ndarray], ys: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets xs link with which of ys; where both are the same list, none with itself."""
    x, y = np.concatenate(xs), np.concatenate(ys)
    sizes = [np.array([len(s) for s in side], np.int64) for side in (xs, ys)]
    if xs is ys:
        shared, held = np.unique(x, return_counts=True)
        shared = shared[held > 1]
    else:
        shared = np.intersect1d(x, y)
    overlap = np.zeros((len(xs), len(ys)))
    if len(shared):
        sides = []
        for keys, lengths in zip((x, y), sizes):
            at = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
            ok = shared[at] == keys
            at, owner = at[ok], np.repeat(np.arange(len(lengths)), lengths)[ok]
            order = np.argsort(at, kind="stable")
            sides.append((at[order], owner[order], len(lengths)))
        for start in range(0, len(shared), COLUMNS):
            width = min(COLUMNS, len(shared) - start)
            dense = []
            for at, owner, n in sides:
                lo, hi = np.searchsorted(at, [start, start + width])
                table = np.zeros((n, width), np.float32)
                table[owner[lo:hi], at[lo:hi] - start] = 1
                dense.append(table)
            overlap += dense[0] @ dense[1].T
    found = 100 * overlap >= percent * (sizes[0][:, None] + sizes[1][None] - overlap)
    if xs is ys:
        np.fill_diagonal(found, False)
    return found


def link_counts(joined: DataFrame, stored: DataFrame, percent: int) -> DataFrame:
    """node, n_links: how many other sets each set links with; joined holds all sets that link (node, component)."""
    sized = stored.join(broadcast_if_few(joined), "node").select("node", "component", "shingles")
    weight = F.octet_length("shingles") / 8
    parts = F.ceil(F.greatest(F.count("*") / PART_SETS, F.sum(weight) / PART_SHINGLES)).cast("int")
    several = sized.groupBy("component").agg(parts.alias("parts")).filter("parts > 1")
    total = sized.agg(F.sum(weight)).first()[0] or 0
    # Small components share a task, a large one is dealt in pairs of parts.
    placed = sized.join(broadcast_if_few(cut_lineage(several)), "component", "left")
    dealt = placed.withColumn("large", F.col("parts").isNotNull()).withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = F.when(F.col("large"), F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(int(total // PART_SHINGLES) + 1)))
    dealt = dealt.select("large", group.alias("g"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "component", "mine", "node", "shingles")

    def work(rows):
        ids, counts = [], []
        for _, each in rows.groupby("component"):
            i, j = each["i"].iloc[0], each["j"].iloc[0]
            sides = [each[each["mine"] == k] for k in ((i,) if i == j else (i, j))]
            if not all(map(len, sides)):
                continue
            sets_of = [[np.frombuffer(b, np.uint64) for b in side["shingles"]] for side in sides]
            found = linking(sets_of[0], sets_of[-1], percent)
            for axis, side in zip((1, 0), sides):
                ids.append(side["node"].to_numpy())
                counts.append(found.sum(axis=axis))
        return pd.DataFrame({"node": np.concatenate(ids) if ids else np.zeros(0, np.int64), "n": np.concatenate(counts).astype(np.int64) if ids else np.zeros(0, np.int64)})

    found = dealt.groupBy("large", "g", "i", "j").applyInPandas(work, "node long, n long")
    return found.groupBy("node").agg(F.sum("n").alias("n_links"))


def _members(rows: DataFrame) -> DataFrame:
    """key, pivot (the first set, with its size) and n of the lists of several sets."""
    # A repeated row of a set's first document is the same member.
    lists = rows.groupBy("key").agg(F.min(F.struct("node", "size")).alias("pivot"), F.max("node").alias("last"), F.count("*").alias("n"))
    return lists.filter("pivot.node < last").select("key", "pivot", "n")


def join(docs: DataFrame, n: int = 3, percent: int = 90, counted: bool = True) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, digest (of its text), component (a number; null without a set) and, if
    counted, n_links (how many different other sets its set links with)."""
    docs = docs.select("doc_id", "text")
    every = cut_lineage(sets(docs, n, percent))
    # Equal sets are one: a node, found again in its smallest id's row.
    first = every.filter("name IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("size"))
    first = cut_lineage(first.withColumn("node", F.monotonically_increasing_id()))
    histogram = {r.s: r["count"] for r in first.groupBy(F.least("size", F.lit(2 * LARGEST_SMALL)).alias("s")).count().collect()}
    most = boundary(histogram, percent)
    order = _frequencies(every)

    def of_first(made: DataFrame) -> DataFrame:
        return made.join(first.select("name", "first", "node"), "name").filter(F.col("doc_id").eqNullSafe(F.col("first"))).drop("doc_id", "name", "first")

    def whole(text):
        s = shingles(text, n)
        return name_of(s), s.tobytes(), buckets(s), digest(s)

    def stored_sets(nodes: DataFrame) -> DataFrame:
        ids = broadcast_if_few(cut_lineage(first.join(nodes, "node").select(F.col("first").alias("id"), "node", F.col("name").alias("wanted"))))
        raw = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id"))).select(F.struct("node", "wanted").alias("doc_id"), "text")
        kinds = [pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int16())]
        kept = _per_document(raw, "doc_id struct<node:long,wanted:binary>, name binary, shingles binary, buckets binary, digest array<short>", whole, ["name", "shingles", "buckets", "digest"], kinds)
        # A row with the same id and another text is none of these.
        kept = kept.filter(F.col("name") == F.col("doc_id.wanted")).select("doc_id.node", "shingles", "buckets", "digest")
        # Only a row that is in the table twice is here twice.
        return cut_lineage(kept if once else kept.dropDuplicates(["node"]))

    def with_missing(stored: DataFrame, nodes: DataFrame) -> DataFrame:
        missing = cut_lineage(nodes.join(stored.select("node"), "node", "left_anti"))
        return stored if missing.isEmpty() else stored.union(stored_sets(missing))

    once = every.groupBy("doc_id", "name").count().filter("count > 1").isEmpty()
    rows = cut_lineage(of_first(_signatures(docs, order, n, percent, most)).select("node", "size", F.explode("keys").alias("key")))
    lists = cut_lineage(_members(rows))
    stored = stored_sets(cut_lineage(rows.join(lists.select("key"), "key").select("node").distinct()))
    long = lists.filter(F.col("n") > LONG_LIST).select("key")
    crowded = cut_lineage(rows.join(long, "key").select("node").distinct())
    if not crowded.isEmpty():
        moved = cut_lineage(_counted(stored.join(broadcast_if_few(crowded), "node", "left_semi"), order, percent))
        more = _levels(moved)
        # At most KNOWN keys of 8 bytes.
        keys = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"key": more[0].view(np.int64)})))
        changed = cut_lineage(rows.join(keys, "key").select("node").distinct())
        stored = with_missing(stored, changed)
        anew = _listed_anew(stored.join(broadcast_if_few(changed), "node", "left_semi"), order, more[:2], percent, most).select("node", "size", F.explode("keys").alias("key"))
        rows = cut_lineage(rows.join(broadcast_if_few(changed), "node", "left_anti").union(anew))
        lists = cut_lineage(_members(rows))
    members = cut_lineage(rows.join(lists.select("key", "pivot"), "key").select("key", "node", "size", F.col("pivot.node").alias("pivot"), F.col("pivot.size").alias("pivot_size")))
    stored = with_missing(stored, cut_lineage(members.select("node").distinct()))

    fits = lambda s, t: 100 * F.least(s, t) >= percent * F.greatest(s, t)
    similar = lambda o, s, t: 100 * o >= percent * (s + t - o)
    # Each set against the first of its lists, if sizes allow; the overlap is kept for the bound below.
    could = fits(F.col("size"), F.col("pivot_size"))
    near = members.filter((F.col("node") != F.col("pivot")) & could).select(F.col("node").alias("a"), F.col("pivot").alias("b"), "size", "pivot_size").distinct()
    near = cut_lineage(_compare(near.select("a", "b"), stored, percent).join(near, ["a", "b"]))
    links = cut_lineage(near.filter(similar(F.col("overlap"), F.col("size"), F.col("pivot_size"))).select("a", "b"))
    joined = components(links)

    # Lists that still hold several components.
    known = members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Of lists with the same members one is enough: two 64-bit hashes of each, summed, tell them apart.
    marks = [F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(20,0)")).alias(f"mark{i}") for i in (0, 1)]
    by_list = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), *marks)
    mixed = by_list.filter("low < high").groupBy("n", "mark0", "mark1").agg(F.min("key").alias("key")).select("key")
    far = near.select(F.col("a").alias("node"), F.col("b").alias("pivot"), (1 - F.col("overlap") / (F.col("size") + F.col("pivot_size") - F.col("overlap"))).alias("far"))
    rest = known.join(mixed, "key").join(far, ["node", "pivot"], "left").withColumn("far", F.when(F.col("node") == F.col("pivot"), 0.0).otherwise(F.col("far")))
    several = cut_lineage(rest.select("node").distinct())
    digests = cut_lineage(stored.join(broadcast_if_few(several), "node", "left_semi").select("node", "digest"))
    rest = cut_lineage(rest.join(digests, "node").select("key", "node", "size", "component", "far", "digest"))
    x, y = rest.alias("x"), rest.alias("y")
    bound = F.coalesce(F.abs(F.col("x.far") - F.col("y.far")) <= 1 - percent / 100 + 1e-9, F.lit(True))
    # What sets share they share remainder by remainder. Written so that the sum is computed once per pair.
    shared = F.aggregate(F.zip_with("x.digest", "y.digest", lambda m, n: F.least(m, n).cast("int")), F.lit(0), lambda total, n: total + n)
    likely = F.coalesce((100 + percent) * shared >= percent * (F.col("x.size") + F.col("y.size")), F.lit(True))
    apart = (F.col("x.component") < F.col("y.component")) & fits(F.col("x.size"), F.col("y.size")) & bound & likely
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & apart)
    cross = cross.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.size").alias("s"), F.col("y.size").alias("t")).distinct()
    cross = cut_lineage(cross)
    more = _compare(cross.select("a", "b"), stored, percent).join(cross, ["a", "b"]).filter(similar(F.col("overlap"), F.col("s"), F.col("t"))).select("a", "b")
    links = cut_lineage(links.union(more).distinct())
    joined = cut_lineage(components(links))
    least = first.join(joined, "node").groupBy("component").agg(F.min("first").alias("component_id"))
    linked = joined.join(least, "component")
    named = first.join(linked, "node", "left")
    if counted:
        named = named.join(link_counts(joined, stored, percent), "node", "left")
    extra = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if counted else []
    named = named.select("name", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("component", "node").alias("component"), *extra)
    made = every.drop("some").join(named, "name", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    if counted:
        made = made.withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return made.select("doc_id", "n_shingles", "component_id", "digest", "component", *(["n_links"] if counted else []))
