import re
from collections import Counter

import numpy as np
import pytest

from tenderloom.llm import substring_dedup
from tests.llm.checks import matches_sql, on_tables, sha


def test_query_matches_sql(spark):
    matches_sql(spark, "op10_substring_dedup")


def brute(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - 34) if counts[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        out.append((len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def rows_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found, _ = substring_dedup.repeats(df, "doc_id", "text")
    return [tuple(r)[1:] for r in sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect())]


@pytest.mark.parametrize("seed", [0, 1])
def test_passages_of_all_lengths(spark, seed):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(400)])
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    passages = [text(n) for n in (9, 18, 20, 33, 34, 35, 36, 37, 50, 71, 200)]
    texts = []
    for p in passages:
        for _ in range(rng.integers(2, 5)):
            texts.append(" \n".join([text(int(rng.integers(0, 60))), p, text(int(rng.integers(0, 60)))]))
    texts += [f"{passages[8]} {text(3)} {passages[8]}", "same word " * 60, "loop " * 36, "loop " * 35, "short", "", None, text(100)]
    texts += [texts[3], texts[3], "é x\x85y " * 20]
    assert rows_of(spark, texts) == brute(texts)


def test_least_window_is_the_leftmost():
    rng = np.random.default_rng(3)
    for width in (1, 2, 26, 27, 30):
        g = rng.integers(0, 6, 120).astype(np.uint64)
        assert substring_dedup.least(g, width).tolist() == [i + int(np.argmin(g[i : i + width])) for i in range(len(g) - width + 1)]


def test_equal_windows_pass_all_levels_together():
    rng = np.random.default_rng(4)
    inner = rng.integers(0, 2**60, 35).astype(np.uint64)
    seen = set()
    for _ in range(20):
        h = np.concatenate([rng.integers(0, 2**60, int(rng.integers(0, 50))).astype(np.uint64), inner, rng.integers(0, 2**60, int(rng.integers(0, 50))).astype(np.uint64)])
        i = int(np.flatnonzero(h == inner[0])[0])
        w, place = substring_dedup.first_level(h)
        seen.add((int(w[9][place[i]]), int(w[18][substring_dedup.inner(place)[i]]), int(w[35][i])))
    assert len(seen) == 1


def test_nulls_repeats_ties_and_clashing_names(spark, tmp_path):
    long = " ".join(f"t{i % 9000}" for i in range(30000))
    rows = [(1, long), (2, "a " * 34), (None, "b " * 40), (3, None), (4, ""), (5, "x " * 20 + long[:600])]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, marks string, hash int")
    got, want = on_tables(spark, tmp_path, "op10_substring_dedup", documents=df.filter("doc_id IS NOT NULL"))
    assert got == want
    found, parts = substring_dedup.repeats(df.union(df).union(spark.createDataFrame([(1, "tie " * 50, "n", 1)], df.schema)), "doc_id", "text")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in found.collect())
    n = 20 + len(long[:600].split())
    assert got == [(0, 40, 40), (0, 40, 40), (1, 50, 50), (1, 30000, 30000), (1, 30000, 30000), (2, 34, 0), (2, 34, 0), (3, 0, 0), (3, 0, 0), (4, 0, 0), (4, 0, 0), (5, n, n), (5, n, n)]


def test_empty_table(spark):
    found, parts = substring_dedup.repeats(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert found.count() == 0 and parts.count() == 0
