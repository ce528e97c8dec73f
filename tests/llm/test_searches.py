"""MaxScore and R-tree searches against all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import maxscore, rtree
from tests.llm.checks import matches_sql, on_tables

SCHEMA = "vec_id long, embedding array<float>, label int, score int, row string, x int"


def ints(vector):
    if vector is None or any(v is None or not math.isfinite(v) for v in vector):
        return None
    return [math.floor(256 * float(np.float32(v))) for v in vector]


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def last(i):
    return (i is None, i or 0)


def brute_top(rows, k):
    use = [(r[0], ints(r[1])) for r in rows if ints(r[1]) is not None]
    out = []
    for n, (q, x) in enumerate(use):
        if q is not None and q % 50 == 0:
            scored = sorted(((-product(x, y), last(i), i) for m, (i, y) in enumerate(use) if m != n), key=lambda t: t[:2])
            out += [(q, rank, i, -s) for rank, (s, _, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=lambda t: (t[0], t[1]))


def brute_negatives(rows, positives=5, negatives=3):
    use = [(r[0], ints(r[1]), (r[2] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[2]) for r in rows if ints(r[1]) is not None and r[2] is not None]
    out = []
    for n, (q, x, label) in enumerate(use):
        if q is None or q % 50:
            continue
        scored = sorted(((-product(x, y), last(i), i, b) for m, (i, y, b) in enumerate(use) if m != n), key=lambda t: t[:2])
        for s, _, p, _ in [t for t in scored if t[3] == label][:positives]:
            found = [t for t in scored if t[3] != label and 50 * -s <= 100 * -t[0] <= 95 * -s][:negatives]
            out += [(q, p, rank, t[2], -s, -t[0]) for rank, t in enumerate(found, 1)]
    return sorted(out, key=repr)


def table_of(rng, n, dims, hot=0.0):
    common = [rng.gauss(0, 0.2) for _ in range(dims)]
    vectors = [list(common) if rng.random() < hot else [round(rng.gauss(0, 0.2), 2) * (rng.random() < 0.8) for _ in range(dims)] for _ in range(n)]
    return [(i, v, rng.randrange(4), 7, "r", 1) for i, v in enumerate(vectors)]


def odd_rows():
    rows = table_of(random.Random(5), 300, 6, 0.35)
    rows += rows[:40] + rows[100:110]  # repeated rows, queries among them
    nan, inf = float("nan"), float("inf")
    odd = [(350, None, 1), (400, [], 1), (450, [0.5, None], 1), (500, [0.5, nan, 0.1, 0.2, 0.1, 0.1], 1), (550, [inf] * 6, 2), (600, [0.3, 0.2], 2)]
    odd += [(None, [0.4] * 6, 1), (None, None, None), (650, [0.4] * 6, None), (700, [0.0] * 6, 0), (-50, [0.3] * 6, 3)]
    return rows + [(*r, None, None, None) for r in odd]


@pytest.fixture
def small(monkeypatch):
    """Shards, tiles, pages and groups so small that a few hundred rows fill many."""
    for module, names in ((maxscore, ["SHARD_ROWS", "BLOCK_QUERIES"]), (rtree, ["TILE_ROWS", "PAGE_TILES", "GROUP_QUERIES"])):
        for name, size in zip(names, (70, 3, 2)):
            monkeypatch.setattr(module, name, size)


def got_top(df, k):
    made = maxscore.top(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, k)
    return sorted(map(tuple, made.collect()), key=lambda t: (t[0], t[1]))


def got_negatives(df):
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, rtree.hard_negatives(df, "vec_id", "embedding", noisy, F.col("vec_id") % 50 == 0).collect()), key=repr)


@pytest.mark.parametrize("seed,hot", [(1, 0.0), (2, 0.4)])
def test_searches_over_many_shards(spark, small, seed, hot):
    rows = table_of(random.Random(seed), 900, 8, hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got_top(df, 5) == brute_top(rows, 5)
    assert got_negatives(df) == brute_negatives(rows)


def test_odd_rows(spark, small):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    # Rows that are there twice ask twice, so their results are too.
    assert sorted(got_top(df, 5), key=repr) == sorted(brute_top(rows, 5), key=repr)
    assert got_negatives(df) == brute_negatives(rows)


@pytest.mark.parametrize("rows", [[], [(0, [0.5], 1, 1, "", 1)], [(0, None, 1, 1, "", 1)], [(0, [0.5], 1, 1, "", 1), (1, [0.5], 1, 1, "", 1)]])
def test_tiny_tables(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert got_top(df, 5) == brute_top(rows, 5)
    assert got_negatives(df) == brute_negatives(rows)


@pytest.mark.parametrize("name", ["op11_maxscore", "op13_rtree"])
def test_sql(spark, tmp_path, name):
    matches_sql(spark, name, "/root/testdata/sf0.01")
    rows = [r for r in odd_rows() if r[0] != 400 and r[0] != 600]  # SQL has a score for equally long vectors only
    got, want = on_tables(spark, tmp_path, name, embeddings=spark.createDataFrame(rows, SCHEMA))
    assert got == want


def test_scores_beyond_a_long_raise(spark):
    df = spark.createDataFrame([(i, [1e30, -1e30], 1, 1, "", 1) for i in range(3)], SCHEMA)
    with pytest.raises(Exception, match="may exceed a long"):
        got_top(df, 5)


def postings(matrix):
    header = [{"term": -1, "ids": list(range(len(matrix))), "rows": list(range(len(matrix)))}]
    lists = []
    for t in range(matrix.shape[1]):
        docs = np.flatnonzero(matrix[:, t])
        if len(docs):
            w = matrix[docs, t]
            lists.append({"term": t, "docs": docs.astype("<i4").tobytes(), "weights": w.tobytes(), "least": int(w.min()), "most": int(w.max())})
    return maxscore.Postings(pa.Table.from_pylist(header + lists, maxscore.SCHEMA))


def test_maxscore_with_any_floor():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, dims, k = rng.integers(1, 60), rng.integers(1, 9), int(rng.integers(1, 6))
        m = rng.integers(-6, 7, (n, dims)) * (rng.random((n, dims)) < 0.7)
        q, shard = rng.integers(-6, 7, dims), postings(m.astype(np.int64))
        own = int(rng.integers(0, n + 1))
        order = sorted((i for i in range(n) if i != own), key=lambda i: (-int(m[i] @ q), i))
        floor = None if rng.random() < 0.3 else int(rng.integers(-80, 120))
        want = [(i, int(m[i] @ q)) for i in order[:k] if floor is None or int(m[i] @ q) >= floor]
        got = maxscore.best(np.arange(dims), q, own, shard, k, floor)
        assert [g for g in got if floor is None or g[1] >= floor] == want


def test_non_essential_lists_are_not_traversed():
    m = np.zeros((1000, 3), np.int64)
    m[:10, 0], m[:, 1], m[:, 2] = 100, 1, 2
    shard = postings(m)

    class Counting(dict):
        seen = 0

        def __getitem__(self, t):
            Counting.seen += 1
            return super().__getitem__(t)

    shard.lists = Counting(shard.lists)
    found = maxscore.best(np.arange(3), np.array([1, 1, 1]), -1, shard, 3, 103)
    assert found == [(0, 103), (1, 103), (2, 103)]


def test_every_row_is_in_one_leaf_and_boxes_hold_it():
    x = np.random.default_rng(4).integers(-50, 50, (1000, 5))
    order, nodes = rtree.pack(x)
    assert sorted(order.tolist()) == list(range(1000))
    leaves = [(a, b) for a, b, child, _ in nodes.tolist() if not child]
    assert sorted(i for a, b in leaves for i in range(a, b)) == list(range(1000)) and max(b - a for a, b in leaves) <= rtree.LEAF_ROWS


def test_a_search_leaves_boxes_out():
    rng = np.random.default_rng(6)
    x = np.sort(rng.integers(0, 10_000, (4000, 1)), axis=0)
    part = pa.table({"row": range(4000), "id": range(4000), "label": [1] * 4000, "x": x.tolist()})
    tree = rtree.Tree(rtree.tile_row(0, part), 1, 1)

    class Counted(list):
        seen = []

        def __getitem__(self, i):
            Counted.seen.append(i)
            return super().__getitem__(i)

    tree.nodes = Counted(tree.nodes)
    found = tree.search(np.array([1]), -1, 0, False, [(2000, 5000, -rtree.OPEN)], 3)
    assert [s for *_, s in found] == sorted((v for v in x[:, 0].tolist() if v <= 5000), reverse=True)[:3]
    assert len(Counted.seen) < len(tree.nodes) / 8


def test_leaves_without_a_score_in_a_window_are_left_at_once():
    draw = np.random.default_rng(4)
    x = draw.integers(-200, 200, (4096, 16))
    part = pa.table({"x": pa.array(x.tolist(), pa.list_(pa.int64())), "id": np.arange(4096), "label": np.arange(4096, dtype=np.int32) % 7, "row": np.arange(4096)})
    tree = rtree.Tree(rtree.tile_row(0, part), 16, 200)

    class Counted(np.ndarray):
        looks = 0

        def __getitem__(self, key):
            Counted.looks += 1
            return super().__getitem__(key)

    labels, tree.labels = tree.labels, tree.labels.view(Counted)
    q = draw.integers(-200, 200, 16)
    scores = np.array([tree.x[p] @ q for p in range(4096)]).astype(int)
    best = int(scores[labels != 3].max())
    windows = [(best * a // 100, best * b // 100, -rtree.OPEN) for a, b in ((90, 95), (92, 97))]
    found = tree.search(q, -1, 3, False, windows, 3)
    for w, (low, high, _) in enumerate(windows):
        fits = np.flatnonzero((labels != 3) & (scores >= low) & (scores <= high))
        want = sorted(fits, key=lambda p: (-scores[p], tree.ids[p]))[:3]
        assert [(p, s) for i, p, s in found if i == w] == [(p, scores[p]) for p in want]
    in_use = (scores >= windows[0][0]) & (scores <= windows[1][1])
    assert Counted.looks <= 2 * in_use.sum()
